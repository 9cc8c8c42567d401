"""Matching of events to sessions, merging of sources, and stable ids."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship


def match_by_ratio(
    events: DataFrame,
    sessions: DataFrame,
    *,
    by: str,
    event: str,
    at: str,
    ratio: str,
    session: str,
    open_ratio: str,
    days: int = 180,
    tolerance: float = 0.1,
) -> DataFrame:
    """``event, matched_session``: the first session whose price move fits a ratio.

    Sessions within ``days`` after the event are looked at; one fits if
    ``|ln(open_ratio * ratio)|`` is at most ``tolerance`` and at most half of
    ``|ln(ratio)|``. Events without one do not appear. Both sides meet on the
    key and a time bucket as wide as the window, of which an event needs two,
    so the pairs formed are those of neighbouring times only.
    """
    width = days + 1

    def bucket(c: str) -> Column:
        return F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)

    asked = events.where(F.col(ratio) > 0).select(
        F.col(by).alias("_k"), F.col(event).alias("_e"), F.col(at).alias("_t"), F.col(ratio).alias("_r"),
        F.explode(F.array(bucket(at), bucket(at) + 1)).alias("_b"),
    )
    offered = sessions.where(F.col(open_ratio) > 0).select(
        F.col(by).alias("_k"), F.col(session).alias("_s"), F.col(open_ratio).alias("_o"), bucket(session).alias("_b")
    )
    off = F.abs(F.log(F.col("_o") * F.col("_r")))
    fits = (off <= tolerance) & (off <= F.abs(F.log("_r")) / 2)
    near = (F.col("_s") > F.col("_t")) & (F.datediff("_s", "_t") <= days)
    met = asked.join(offered, ["_k", "_b"]).where(near & fits)
    return met.groupBy(F.col("_e").alias(event)).agg(F.min("_s").alias("matched_session"))


def best_source(df: DataFrame, by: Sequence[str], rank: Column) -> DataFrame:
    """The rows of the best (smallest) rank of each group."""
    w = Window.partitionBy(*by)
    return df.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(w)).where("_rank = _best").drop("_rank", "_best")


def confirmations(best: DataFrame, other: DataFrame, by: Sequence[str], record: str, value: str, tolerance: float) -> DataFrame:
    """``by..., best_id, other_id``: records of two sources paired one to one.

    Within a group each record of ``other``, in order of its value and id,
    takes the nearest free record of ``best`` within the relative
    ``tolerance`` (less than one; of equally near ones the smaller); a missing
    value fits a missing one. ``other_id`` has no ``best_id`` where it
    conflicts. A row with a null in ``by`` belongs to no group and is left
    out; ids come out as strings.

    Greedy matching depends on its own past, but only among values that reach
    each other: a group's values fall into clusters wherever two neighbours
    are further apart than the tolerance, so the clusters, not the groups, are
    what is matched in one piece. They stream through a task in order, one
    held at a time, each record finding its partner by bisection. Missing
    values are paired by their numbers, without Python.
    """
    ship(best.sparkSession)
    names = list(by)
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    sides = [df.select(*names, F.col(record).cast("string").alias("_id"), known.alias("_v"), F.lit(i).alias("_side")) for i, df in enumerate((best, other))]
    rows = sides[0].unionByName(sides[1]).na.drop(subset=names)
    numbered = rows.where("_v IS NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*names, "_side").orderBy("_id")))
    lone = numbered.where("_side = 1").select(*names, "_n", F.col("_id").alias("other_id"))
    missing = lone.join(numbered.where("_side = 0").select(*names, "_n", F.col("_id").alias("best_id")), [*names, "_n"], "left").select(*names, "best_id", "other_id")

    order = Window.partitionBy(*names).orderBy("_v")
    before = F.lag("_v").over(order)
    apart = before.isNotNull() & (F.col("_v") - before > F.lit(tolerance) * F.greatest(F.abs("_v"), F.abs(before)))
    clustered = rows.where("_v IS NOT NULL").withColumn("_new", F.when(apart, 1).otherwise(0))
    clustered = clustered.withColumn("_c", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    laid_out = clustered.select(*names, "_c", "_side", "_v", "_id").repartition(*names, "_c").sortWithinPartitions(*names, "_c", "_side", "_v", "_id")
    schema = T.StructType([*(laid_out.schema[n] for n in names), T.StructField("best_id", T.StringType()), T.StructField("other_id", T.StringType())])
    met = laid_out.mapInArrow(_pairer(len(names), tolerance, schema.names), schema)
    return met.unionByName(missing)


def nearest_free(free: Sequence[float], asked: Sequence[float], tolerance: float) -> list[int | None]:
    """For each value asked, in order, the place of the nearest value still free within the tolerance.

    ``free`` is sorted. The nearest free ones on either side are found by
    bisection and by ways that skip what is taken, so nothing is gone through
    again; of equal values the first free one is taken.
    """
    n = len(free)
    # The next free place at or after i (n is none), and the last one before i,
    # counted from 1 (0 is none).
    up, down = list(range(n + 1)), list(range(n + 1))

    def root(way: list[int], at: int) -> int:
        while way[at] != at:
            way[at] = way[way[at]]
            at = way[at]
        return at

    out: list[int | None] = []
    for x in asked:
        after = root(up, bisect_left(free, x))
        before = root(down, bisect_left(free, x)) - 1
        if before >= 0:
            # Of equal values below the first free one counts.
            before = root(up, bisect_left(free, free[before]))
        options = [(abs(free[i] - x), i) for i in (before, after) if 0 <= i < n and abs(free[i] - x) <= tolerance * abs(x)]
        taken = min(options)[1] if options else None
        if taken is not None:
            up[taken], down[taken + 1] = taken + 1, taken
        out.append(taken)
    return out


def _pairer(width: int, tolerance: float, names: Sequence[str]):
    """Matches one cluster after the other; its free records come before those that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, kinds = None, ([], []), None

        def close() -> list[tuple]:
            best, other = sides
            found = nearest_free([v for v, _ in best], [v for v, _ in other], tolerance)
            return [(*key[:width], None if i is None else best[i][1], name) for i, (_, name) in zip(found, other, strict=True)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(names))

        for b in batches:
            kinds = [*(b.schema.field(i).type for i in range(width)), pa.string(), pa.string()]
            out: list[tuple] = []
            for *group, side, v, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tuple(group) != key:
                    if key is not None:
                        out += close()
                    key, sides = tuple(group), ([], [])
                sides[side].append((v, name))
            if out:
                yield batch(out)
        if key is not None and (out := close()):
            yield batch(out)

    return run


def with_stable_id(df: DataFrame, parts: Sequence[str], order: Sequence[str], name: str = "record_key") -> DataFrame:
    """Adds 16 hex digits from ``parts`` and the occurrence of equal parts.

    Equal rows are numbered by ``order``; the same rows get the same ids in
    any order and layout of the input.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))
    again = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return df.withColumn(name, F.substring(F.sha1(F.concat_ws("|", text, again.cast("string"))), 1, 16))
