"""Changes between full snapshots, from invertible Bloom lookup tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, ship

#: Cells a record goes into.
HASHES = 3

#: Keys that differ are broadcast up to this many (about 10 MB), to fetch
#: their records without a shuffle of all; beyond, the join is Spark's.
BROADCAST_ROWS = 500_000

#: Pairs whose buckets a task decodes at a time.
PAIRS_AT_ONCE = 400_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public SplitMix64 generator (its constants are fixed values)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _joint(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One number for each pair."""
    with np.errstate(over="ignore"):
        return mix64(keys.view(np.uint64) + mix64(values.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _salted(joint: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(joint + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))


def _checks(joint: np.ndarray) -> np.ndarray:
    return _salted(joint, 1 << 32).view(np.int64)


def _cells(joint: np.ndarray, salt: int, cells: int) -> Iterator[np.ndarray]:
    """The place of each pair in each part of a table."""
    part = cells // HASHES
    for j in range(HASHES):
        h = _salted(joint, 1 + salt * HASHES + j) >> np.uint64(32)
        yield ((h * np.uint64(part)) >> np.uint64(32)).astype(np.int64) + j * part


class Tables:
    """Many tables of equal size: in each cell the number of pairs and the
    (wrapping) sums of their keys, values and checks."""

    def __init__(self, number: int, cells: int, salt: int) -> None:
        self.number, self.cells, self.salt = number, cells // HASHES * HASHES, salt
        self.sums = np.zeros((4, number * self.cells), dtype=np.int64)

    def add(self, table: np.ndarray, keys: np.ndarray, values: np.ndarray, signs: np.ndarray) -> None:
        joint = _joint(keys, values)
        checks = _checks(joint)
        with np.errstate(over="ignore"):
            amounts = (signs, keys * signs, values * signs, checks * signs)
            for cell in _cells(joint, self.salt, self.cells):
                at = table * self.cells + cell
                for sums, amount in zip(self.sums, amounts, strict=True):
                    np.add.at(sums, at, amount)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``table, key, value, sign`` of all pairs that come off, and which tables are empty then.

        A cell that holds one pair (a count of 1 or -1 and a check that fits)
        gives that pair away; it is taken out of its other cells, which may
        then hold one pair each, and so on, in all tables at once.
        """
        found: list[tuple[np.ndarray, ...]] = []
        count, key, value, check = self.sums
        look = np.flatnonzero(np.abs(count) == 1)
        # Each pair has a few cells, so a table that decodes is empty by then.
        for _ in range(4 * self.cells):
            sign = count[look]
            with np.errstate(over="ignore"):
                k, v, x = key[look] * sign, value[look] * sign, check[look] * sign
            pure = (np.abs(sign) == 1) & (_checks(_joint(k, v)) == x)
            if not pure.any():
                break
            rows = pd.DataFrame({"t": look[pure] // self.cells, "k": k[pure], "v": v[pure], "s": sign[pure]})
            t, k, v, s = (c.to_numpy() for _, c in rows.drop_duplicates(["t", "k", "v"]).items())
            self.add(t, k, v, -s)
            found.append((t, k, v, s))
            joint = _joint(k, v)
            look = np.unique(np.concatenate([t * self.cells + c for c in _cells(joint, self.salt, self.cells)]))
        empty = ~self.sums.reshape(4, self.number, self.cells).any(axis=(0, 2))
        none = np.zeros(0, dtype=np.int64)
        t, k, v, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none,) * 4
        return t, k, v, s, empty


def differing(
    bucket: np.ndarray, number: np.ndarray, keys: np.ndarray, values: np.ndarray, last: int, cells: int, growth: int, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """``delta, key`` of the pairs that only one of two consecutive snapshots has.

    ``number`` is the snapshot (0 .. ``last``) of a pair, delta d the step from
    d - 1 to d. Table (bucket, d) is the later one's minus the earlier one's.
    A table that does not empty, or whose pairs do not add up to the
    difference of the digests, is built again ``growth`` times as large; what
    still fails after ``rounds`` is compared pair by pair.
    """
    names, place = np.unique(bucket, return_inverse=True)
    steps = last
    # Each pair is the later side of one step and the earlier of the next.
    later, earlier = number >= 1, number < last
    table = np.concatenate([place[later] * steps + number[later] - 1, place[earlier] * steps + number[earlier]])
    sign = np.concatenate([np.ones(later.sum(), dtype=np.int64), np.full(earlier.sum(), -1, dtype=np.int64)])
    k, v = np.concatenate([keys[later], keys[earlier]]), np.concatenate([values[later], values[earlier]])
    digest = _salted(_joint(k, v), 1 << 33).view(np.int64)
    todo = np.arange(len(names) * steps)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    size = cells
    for salt in range(rounds):
        slot = np.full(len(names) * steps, -1, dtype=np.int64)
        slot[todo] = np.arange(len(todo))
        if salt:
            here = slot[table] >= 0
            table, sign, k, v, digest = (x[here] for x in (table, sign, k, v, digest))
        tables = Tables(len(todo), size, salt)
        if salt == 0:
            _fill_whole(tables, place, number, keys, values, steps)
        else:
            tables.add(slot[table], k, v, sign)
        t, pk, pv, ps, good = tables.peel()
        # What came off must be what the digests of the two sides differ by.
        sums = np.zeros((2, len(todo)), dtype=np.int64)
        with np.errstate(over="ignore"):
            np.add.at(sums[0], slot[table], sign), np.add.at(sums[1], slot[table], digest * sign)
            np.subtract.at(sums[0], t, ps), np.subtract.at(sums[1], t, _salted(_joint(pk, pv), 1 << 33).view(np.int64) * ps)
        good &= ~sums.any(axis=0)
        mine = good[t]
        out.append((todo[t[mine]] % steps + 1, pk[mine]))
        todo = todo[~good]
        if not len(todo):
            break
        size *= growth
    if len(todo):
        left = np.isin(table, todo)
        rest = pd.DataFrame({"t": table[left], "k": k[left], "v": v[left], "s": sign[left]})
        lone = rest.groupby(["t", "k", "v"], sort=False)["s"].sum()
        lone = lone[lone != 0].reset_index()
        out.append((lone["t"].to_numpy() % steps + 1, lone["k"].to_numpy()))
    delta, key = (np.concatenate(x) for x in zip(*out, strict=True))
    return delta, key


def _fill_whole(tables: Tables, place: np.ndarray, number: np.ndarray, keys: np.ndarray, values: np.ndarray, steps: int) -> None:
    """One table for each bucket and snapshot, and the next one minus each."""
    snapshots, cells = steps + 1, tables.cells
    each = Tables(tables.number // steps * snapshots, cells, tables.salt)
    each.add(place * snapshots + number, keys, values, np.ones(len(keys), dtype=np.int64))
    with np.errstate(over="ignore"):
        step = np.diff(each.sums.reshape(4, -1, snapshots, cells), axis=2)
    tables.sums = np.ascontiguousarray(step).reshape(4, -1)


def _decoder(last: int, cells: int, growth: int, rounds: int):
    """Decodes the buckets of a partition, whose rows come in order of the bucket."""

    def batch(columns: list[np.ndarray]) -> pa.RecordBatch:
        delta, key = differing(*columns, last, cells, growth, rounds)
        return pa.record_batch([pa.array(delta.astype(np.int32)), pa.array(key)], ["_d", "_k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in b.columns])
            rows += b.num_rows
            if rows >= PAIRS_AT_ONCE:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                # The last bucket may go on in the next batch.
                whole = int(np.searchsorted(columns[0], columns[0][-1]))
                if whole:
                    yield batch([c[:whole] for c in columns])
                held, rows = [[c[whole:] for c in columns]], len(columns[0]) - whole
        if rows:
            yield batch([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _hash_of(columns: Sequence[str], seed: int) -> Column:
    """Null is a value of its own: (null, 'a') and ('a', null) differ."""
    parts: list[Column] = [F.lit(seed)]
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    key: Sequence[str],
    values: Sequence[str],
    *,
    bucket_rows: int = 2048,
    cells: int = 384,
    growth: int = 4,
    max_rounds: int = 5,
) -> DataFrame:
    """Records added, removed or changed between consecutive snapshots.

    Result: ``snapshot`` (the later one), the key columns and ``change_kind``
    (added, removed or changed), one row for each key that differs. Columns
    come in ready to compare (normalised, rounded).

    Each snapshot's distinct (key hash, value hash) pairs go into one
    invertible Bloom lookup table for each hash bucket; the tables of
    consecutive snapshots are subtracted, and the pairs of one side only are
    peeled off the difference. Buckets whose table does not empty, or whose
    recovered pairs do not add up to the difference of the buckets' digests,
    are built again ``growth`` times as large; buckets that still fail after
    ``max_rounds`` are compared pair by pair. The recovered keys then fetch
    their records, and the kind follows from the actual values, so a hash
    collision cannot report an unchanged record.

    Nulls are values (equal to each other) in keys and values; a row without
    snapshot is left out. Repeats count once. A key with several values in
    one snapshot is changed if the set of its values differs. With fewer than
    two snapshots, or an empty table, the result is empty.

    Scale: copies are reduced map-side, and a bucket is chosen by key and
    value, so that a key with many values is spread too; a bucket has about
    ``bucket_rows`` pairs of each snapshot, and a task decodes its buckets in
    bounded portions. The rows are counted, and the keys that differ are
    recovered and checkpointed, when this is called; only the list of
    snapshots and counts reach the driver.
    """
    key, values = list(key), list(values)
    spark = df.sparkSession
    ship(spark)
    rows = df.where(F.col(snapshot).isNotNull()).select(snapshot, *dict.fromkeys(key + values))
    per_snapshot = rows.groupBy(snapshot).count().orderBy(snapshot).collect()
    numbers = spark.createDataFrame(
        [(r[0], i) for i, r in enumerate(per_snapshot)], rows.select(snapshot, F.lit(0).alias("_n")).schema
    )
    # The key and value hashes are all that the tables need of a record.
    numbered = rows.join(F.broadcast(numbers), snapshot).withColumns(
        {"_k": _hash_of(key, 1), "_v": _hash_of(values, 2)}
    )
    last = max(0, len(per_snapshot) - 1)
    if last:
        buckets = max(1, max(r[1] for r in per_snapshot) // bucket_rows)
        pairs = numbered.select("_n", "_k", "_v").distinct()
        pairs = pairs.select(F.pmod(F.xxhash64(F.lit(3), "_k", "_v"), F.lit(buckets)).alias("_b"), "_n", "_k", "_v")
        laid_out = pairs.repartition("_b").sortWithinPartitions("_b")
        found = laid_out.mapInArrow(_decoder(last, cells, growth, max_rounds), "_d int, _k bigint")
    else:
        found = spark.createDataFrame([], "_d int, _k bigint")
    found = cut_lineage(found.distinct())
    # Both snapshots of a step are asked for its keys.
    sides = F.inline(F.array(F.struct(F.col("_d").alias("_n"), F.lit(1).alias("_s")), F.struct((F.col("_d") - 1).alias("_n"), F.lit(-1).alias("_s"))))
    asked = found.select("_d", "_k", sides)
    if found.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    # Of the distinct values of both sides equal ones cancel in the digest, so
    # a key's values are compared without being gathered.
    kinds = (
        numbered.join(asked, ["_n", "_k"])
        .select("_d", *key, "_s", "_v")
        .distinct()
        .groupBy("_d", *key)
        .agg(
            F.count_if(F.col("_s") > 0).alias("_new"),
            F.count_if(F.col("_s") < 0).alias("_old"),
            F.bit_xor(F.xxhash64(F.lit(9), "_v")).alias("_g"),
        )
        .where((F.col("_g") != 0) | (F.col("_new") != F.col("_old")))
        .withColumn(
            "change_kind", F.when(F.col("_old") == 0, "added").when(F.col("_new") == 0, "removed").otherwise("changed")
        )
    )
    return kinds.join(F.broadcast(numbers.withColumnRenamed("_n", "_d")), "_d").select(snapshot, *key, "change_kind")


__all__ = ["Tables", "differing", "snapshot_changes"]
