"""Mixing sources to target weights, in blocks of tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokenizer import IDS_AT_ONCE, as_text, encode_text, encoding, list_array, vocabulary_path
from tidemark.session import ship, written

#: Tail groups: the short ends that this many input splits leave of a source
#: are packed together.
SPLITS_A_TAIL = 64

#: Offsets of (source, input split) are broadcast up to this many rows (about 20
#: MB) and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000

#: Numbers from here on are drawn from the normal limit of the distribution:
#: numpy's exact sampler ends there, and the two differ by nothing that shows.
LARGE = 10**9

#: Slots that one task of the join hashes at most (about 10 MB).
SLOTS_A_TASK = 100_000

#: Slots that leave a task at a time.
SLOTS_AT_ONCE = 1 << 17


# -- pseudorandom permutations of an index range ------------------------------


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def permuted(index: np.ndarray, n: int, key: int | np.ndarray, *, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of ``0 .. n-1`` (or its inverse) at ``index``.

    A Feistel network over the next power of four, walked on until the result
    is in range; needs no table, so any index can be mapped anywhere. With an
    array of keys each index has a permutation of its own.
    """
    if n <= 1:
        return np.asarray(index, dtype=np.int64).copy()
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.broadcast_to(np.asarray(key, dtype=np.int64).astype(np.uint64), np.shape(index)) * np.uint64(8)
    rounds = [np.uint64(r) for r in range(4)]

    def once(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in reversed(rounds) if inverse else rounds:
            if inverse:
                left, right = right ^ (_mixed(left, k + r) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, k + r) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index).astype(np.uint64), keys)
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond], keys[beyond])
    return out.astype(np.int64)


# -- the plan of a mixture --------------------------------------------------------


@dataclass(frozen=True)
class Mixture:
    """What any shard of the output can be computed from; a few numbers a source."""

    sources: tuple[str, ...]
    blocks: tuple[int, ...]  # blocks there are of each source
    quotas: tuple[int, ...]  # blocks the mixture takes of each
    shard_blocks: int
    seed: int

    @property
    def slots(self) -> int:
        return sum(self.quotas)

    @property
    def shards(self) -> int:
        return -(-self.slots // self.shard_blocks)


def wanted_tokens(shares: Sequence[float], available: Sequence[int], repeats: Sequence[int], total: float) -> np.ndarray:
    """Tokens of each source: its share of ``total``, at most its repeats.

    What capped sources cannot give goes to the others in proportion to their
    shares, until the total is reached or all are capped.
    """
    share = np.asarray(shares, dtype=float)
    most = np.asarray(available, dtype=float) * np.asarray(repeats, dtype=float)
    capped = np.zeros(len(share), dtype=bool)
    while True:
        rest = share * ~capped
        if not rest.sum() > 0:
            return np.where(capped, most, 0.0)
        want = np.where(capped, most, rest / rest.sum() * max(0.0, total - most[capped].sum()))
        over = ~capped & (want > most)
        if not over.any():
            return want
        capped |= over


def split_counts(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source are among ``take`` slots of a range that holds ``counts``.

    Multivariate hypergeometric, source by source: what independent
    multinomial draws of all shards come to once their sum is given.
    """
    out = np.zeros_like(counts)
    rest = int(counts.sum())
    for i, have in enumerate(map(int, counts)):
        rest -= have
        least, most = max(0, take - rest), min(take, have)
        if least < most and have + rest < LARGE:
            got = int(rng.hypergeometric(have, rest, take))
        elif least < most:
            n = have + rest
            mean = take / n * have
            spread = (mean * (rest / n) * ((n - take) / (n - 1))) ** 0.5
            got = min(most, max(least, round(mean + spread * rng.standard_normal())))
        else:
            got = most
        out[i] = got
        take -= got
    return out


def shard_counts(mixture: Mixture, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, before, counts)`` of the shards ``first .. last - 1``, in order.

    ``counts`` are the shard's blocks of each source, ``before`` those of all
    shards before it. The shards are the leaves of a binary tree whose root
    holds the quotas; each node splits what it holds by a draw of its own,
    keyed by the seed and its range. So every shard is known after a draw for
    each level, without the others, and neighbours share their way down: a
    range of shards costs about one draw a shard. The counts of all shards add
    up to the quotas exactly.
    """
    total = mixture.slots

    def down(low: int, high: int, before: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if high <= first or low >= last:
            return
        if high - low == 1:
            yield low, before, counts
            return
        middle = (low + high) // 2
        size = min(middle * mixture.shard_blocks, total) - low * mixture.shard_blocks
        left = split_counts(counts, size, np.random.default_rng([mixture.seed, low, high]))
        yield from down(low, middle, before, left)
        yield from down(middle, high, before + left, counts - left)

    quotas = np.array(mixture.quotas, dtype=np.int64)
    if mixture.shards:
        yield from down(0, mixture.shards, np.zeros_like(quotas), quotas)


def shard_slots(mixture: Mixture, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """The slots of some shards and the block that each takes.

    The n-th slot of a source takes the block at ``n % blocks`` of the
    source's permutation of epoch ``n // blocks``; within a shard the slots
    are permuted, so that the sources lie mixed.
    """
    blocks = np.array(mixture.blocks, dtype=np.int64)
    names = pa.array(mixture.sources, pa.string())
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def out() -> pa.RecordBatch:
        shard, slot, code, nth = (np.concatenate(x) for x in zip(*held, strict=True))
        epoch = nth // blocks[code]
        index = np.empty(len(nth), dtype=np.int64)
        for s, e in np.unique(np.stack([code, epoch]), axis=1).T if len(nth) else ():
            here = np.flatnonzero((code == s) & (epoch == e))
            n = int(blocks[s])
            index[here] = permuted(nth[here] % n, n, mixture.seed * 1_000_003 + int(s) * 1009 + int(e))
        return pa.record_batch(
            [pa.array(shard), pa.array(slot), names.take(pa.array(code)), pa.array(epoch.astype(np.int32)), pa.array(index)],
            ["shard", "slot", "source", "epoch", "block"],
        )

    for shard, before, counts in shard_counts(mixture, first, last):
        n = int(counts.sum())
        code = np.repeat(np.arange(len(counts)), counts)
        nth = np.concatenate([np.arange(b, b + c) for b, c in zip(before, counts, strict=True)])
        slot = permuted(np.arange(n), n, mixture.seed * 1_000_003 + 7919 + shard)
        held.append((np.full(n, shard, dtype=np.int64), slot, code, nth))
        rows += n
        if rows >= SLOTS_AT_ONCE:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


# -- blocks -------------------------------------------------------------------------


class _Packer:
    """Fixed-length blocks of each source, in the order tokens arrive."""

    def __init__(self, block: int) -> None:
        self.block = block
        self.open: dict[str, list[np.ndarray]] = {}
        self.size: dict[str, int] = {}
        self.next: dict[str, int] = {}

    def add(self, source: str, ids: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
        parts = self.open.setdefault(source, [])
        if len(ids):
            parts.append(ids)
        size = self.size.get(source, 0) + len(ids)
        if size >= self.block:
            flat = np.concatenate(parts)
            whole = size // self.block * self.block
            for at in range(0, whole, self.block):
                yield self._out(source, flat[at : at + self.block])
            self.open[source] = [flat[whole:]] if whole < size else []
            size -= whole
        self.size[source] = size

    def _out(self, source: str, ids: np.ndarray) -> tuple[str, int, np.ndarray]:
        seq = self.next.get(source, 0)
        self.next[source] = seq + 1
        return source, seq, ids

    def rest(self) -> Iterator[tuple[str, int, np.ndarray]]:
        for source, size in self.size.items():
            if size:
                yield self._out(source, np.concatenate(self.open[source]))


_BLOCKS = "source string, split bigint, seq bigint, n_tokens int, ids array<int>"


def _batch(blocks: list[tuple[str, int, np.ndarray]], split: int) -> pa.RecordBatch:
    sizes = np.array([len(b[2]) for b in blocks], dtype=np.int32)
    return pa.record_batch(
        [
            pa.array([b[0] for b in blocks], pa.string()),
            pa.array(np.full(len(blocks), split, dtype=np.int64)),
            pa.array(np.array([b[1] for b in blocks], dtype=np.int64)),
            pa.array(sizes),
            list_array([b[2] for b in blocks]),
        ],
        ["source", "split", "seq", "n_tokens", "ids"],
    )


def _pack_texts(path: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, split = encoding(path), _Packer(block), TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += packer.add(source, np.array(encode_text(enc, as_text(text)), dtype=np.int32))
                if len(out) * block >= IDS_AT_ONCE:
                    yield _batch(out, split)
                    out = []
            if out:
                yield _batch(out, split)
        if out := list(packer.rest()):
            yield _batch(out, split)

    return run


def _pack_tails(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group = _Packer(block), None
        for batch in batches:
            ids = batch.column(2)
            for i, (source, g) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if group is not None and group != (source, g):
                    if out := list(packer.rest()):
                        yield _batch(out, -1 - group[1])
                    packer = _Packer(block)
                group = (source, g)
                if out := list(packer.add(source, ids[i].values.to_numpy(zero_copy_only=False))):
                    yield _batch(out, -1 - g)
        if group is not None and (out := list(packer.rest())):
            yield _batch(out, -1 - group[1])

    return run


def packed_blocks(
    df: DataFrame, source: str, text: str, *, block_tokens: int, vocabulary: str | None = None
) -> DataFrame:
    """``source, split, seq, n_tokens, ids``: all tokens in blocks, written once.

    Each task packs its own texts, source by source, without a shuffle; only
    the short ends, one per source and input split, are sent on and packed
    together in groups of ``SPLITS_A_TAIL`` splits. A block shorter than
    ``block_tokens`` is left per source and such group. No token is lost.
    """
    ship(df.sparkSession)
    path = vocabulary or vocabulary_path()
    rows = df.select(F.col(source).cast("string"), F.col(text).cast("binary").alias("_t")).where(
        F.col(source).isNotNull() & (F.octet_length("_t") > 0)
    )
    first = written(rows.mapInArrow(_pack_texts(path, block_tokens), _BLOCKS), "blocks")
    tails = (
        first.where(F.col("n_tokens") < block_tokens)
        .select("source", F.floor(F.col("split") / SPLITS_A_TAIL).cast("bigint").alias("_g"), "split", "ids")
        .repartition("source", "_g")
        .sortWithinPartitions("source", "_g", "split")
        .select("source", "_g", "ids")
    )
    packed = written(tails.mapInArrow(_pack_tails(block_tokens), _BLOCKS), "tails")
    return first.where(F.col("n_tokens") >= block_tokens).unionByName(packed)


def mix_sources(
    df: DataFrame,
    source: str,
    text: str,
    targets: Sequence[tuple[str, float, int]],
    *,
    block_tokens: int = 1024,
    shard_blocks: int = 1024,
    total_tokens: float | None = None,
    seed: int = 17,
    vocabulary: str | None = None,
) -> DataFrame:
    """The mixture: ``shard, slot, source, epoch, block, n_tokens, ids``.

    ``targets`` are (source, share of all tokens, how often a text may be used
    at most); shares are taken relative to their sum. The mixture has
    ``total_tokens`` tokens, by default as many as the texts of the listed
    sources have. A source that its repeats do not allow its share gives all
    they allow, and the others make up for it in proportion to their shares
    (see :func:`wanted_tokens`); :func:`reached_shares` reports the result.

    Tokens are packed into blocks of ``block_tokens``. Each output shard of
    ``shard_blocks`` blocks draws its source counts from a multinomial given
    the quotas (see :func:`shard_counts`), so the shares hold for every
    stretch of the output. The n-th slot of a source takes the block that the
    source's pseudorandom permutation of epoch ``n // blocks`` has at
    ``n % blocks``: a text is used again only when all blocks of its source
    have been. Slots are made on the executors and joined to the blocks by
    source and index, in one shuffle of the tokens; no key of it has more rows
    than its source may be repeated.

    Null, empty and unlisted sources and null or empty texts give nothing; a
    listed source without texts has no share; an empty table gives an empty
    result. Which texts share a block follows the input splits; the blocks
    are written once, and everything after follows from them and ``seed``.

    The blocks are packed and written when it is called, since the plan needs
    their number; the rest is lazy. Driver: a few numbers a source. All else
    is one pass over the texts and one over the blocks.
    """
    blocks, mixture = _planned(df, source, text, targets, block_tokens, shard_blocks, total_tokens, seed, vocabulary)
    return _placed(blocks, mixture)


def _planned(df, source, text, targets, block_tokens, shard_blocks, total_tokens, seed, vocabulary):
    """The written blocks with their index, and the plan."""
    listed = [t for t in targets if t[0] is not None and t[1] is not None and t[1] > 0]
    names = tuple(t[0] for t in listed)
    if len(set(names)) < len(names):
        raise ValueError("a source is listed twice")
    chosen = df.where(F.col(source).isin(list(names)))
    blocks = packed_blocks(chosen, source, text, block_tokens=block_tokens, vocabulary=vocabulary).withColumnRenamed(source, "source")
    parts = blocks.groupBy("source", "split").agg(F.count("*").alias("_n"), F.sum("n_tokens").alias("_tokens"))
    parts = parts.withColumn(
        "_before",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    # A row for each source and input split: small beside the blocks.
    parts = written(parts, "parts")
    have = {r[0]: (r[1], r[2]) for r in parts.groupBy("source").agg(F.sum("_n"), F.sum("_tokens")).collect()}
    counts = np.array([have.get(n, (0, 0))[0] for n in names], dtype=np.int64)
    tokens = np.array([have.get(n, (0, 0))[1] for n in names], dtype=np.int64)
    repeats = np.array([t[2] or 0 for t in listed], dtype=np.int64)
    total = float(tokens.sum()) if total_tokens is None else float(total_tokens)
    want = wanted_tokens([t[1] for t in listed], tokens, repeats, total)
    mean = np.divide(tokens, counts, out=np.ones(len(names)), where=counts > 0)
    quotas = np.minimum(np.rint(want / mean).astype(np.int64), counts * repeats)
    small = parts.select("source", "split", "_before")
    if parts.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    index = blocks.join(small, ["source", "split"]).withColumn(
        "block", F.col("_before") + F.col("seq")
    )
    return index.drop("_before", "split", "seq"), Mixture(names, tuple(counts.tolist()), tuple(quotas.tolist()), shard_blocks, seed)


def slots_of(spark: SparkSession, mixture: Mixture, shards_a_task: int = 256) -> DataFrame:
    """``shard, slot, source, epoch, block``: every slot of the output, made on the executors."""
    ship(spark)
    schema = "shard bigint, slot bigint, source string, epoch int, block bigint"
    tasks = max(1, -(-mixture.shards // shards_a_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                yield from shard_slots(mixture, task * shards_a_task, (task + 1) * shards_a_task)

    return spark.range(0, tasks, 1, min(tasks, 100_000)).mapInArrow(run, schema)


def _placed(blocks: DataFrame, mixture: Mixture) -> DataFrame:
    """Slots and blocks joined by source and index.

    The slots of a task are a small part of its blocks' tokens, so they are
    what is hashed, and the tokens are not sorted. There are as many tasks as
    keep each at :data:`SLOTS_A_TASK` slots, or those of the session if more.
    """
    spark = blocks.sparkSession
    slots = slots_of(spark, mixture)
    tasks = -(-mixture.slots // SLOTS_A_TASK)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        blocks, slots = (df.repartition(tasks, "source", "block") for df in (blocks, slots))
    slots = slots.hint("shuffle_hash")
    return blocks.join(slots, ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "n_tokens", "ids")


def reached_shares(mixed: DataFrame, available: DataFrame, targets: Sequence[tuple[str, float, int]]) -> DataFrame:
    """Target and actual share of each listed source.

    ``source, target_share, max_repeats, documents_tokens, used_tokens,
    actual_share, times_used`` from the mixture and the blocks it was made of.
    """
    spark = mixed.sparkSession
    goal = spark.createDataFrame(
        [(t[0], float(t[1]), int(t[2])) for t in targets], "source string, target_share double, max_repeats int"
    )
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"))
    have = available.groupBy("source").agg(F.sum("n_tokens").alias("documents_tokens"))
    full = goal.join(have, "source", "left").join(used, "source", "left").na.fill(0, ["used_tokens", "documents_tokens"])
    everything = Window.partitionBy(F.lit(1))
    return full.select(
        "source",
        "target_share",
        "max_repeats",
        "documents_tokens",
        "used_tokens",
        F.try_divide(F.col("used_tokens").cast("double"), F.sum("used_tokens").over(everything).cast("double")).alias("actual_share"),
        F.try_divide(F.col("used_tokens").cast("double"), F.col("documents_tokens").cast("double")).alias("times_used"),
    )


def mixture_report(df: DataFrame, source: str, text: str, targets: Sequence[tuple[str, float, int]], **settings) -> DataFrame:
    """:func:`reached_shares` of the mixture that :func:`mix_sources` makes."""
    options = {"block_tokens": 1024, "shard_blocks": 1024, "total_tokens": None, "seed": 17, "vocabulary": None} | settings
    blocks, mixture = _planned(df, source, text, targets, *options.values())
    narrow = blocks.select("source", "block", "n_tokens", F.array().cast("array<int>").alias("ids"))
    return reached_shares(_placed(narrow, mixture), blocks, targets)
