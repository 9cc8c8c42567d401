"""Ordered joins and set operations that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def islands(df: DataFrame, by: Sequence[str], order: str, flag: Column, name: str) -> DataFrame:
    """Adds ``name``, the number of the run of equal ``flag`` a row lies in."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumn("_f", flag).withColumn(
        "_new", F.when(F.lag("_f").over(w).eqNullSafe(F.col("_f")), 0).otherwise(1)
    )
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f", "_new")


def _slice_of(t: Column, kind: DataType, width: int) -> Column:
    """The number of the stretch of ``width`` days (or units of a number) a time lies in."""
    name = kind.typeName()
    if name == "date":
        t = F.datediff(t, F.lit("1970-01-01").cast("date"))
    elif name.startswith("timestamp"):
        t = F.unix_seconds(t.cast("timestamp")) / 86_400
    return F.floor(t / width).cast("bigint")


def asof(
    left: DataFrame,
    right: DataFrame,
    by: str,
    at: tuple[str, str],
    values: Sequence[str],
    *,
    direction: str = "backward",
    within_days: int | None = None,
    slice_width: int | None = 1461,
) -> DataFrame:
    """``left`` with ``values`` of the last (or next) right row of its key.

    Equal times match. ``right`` must be unique in (``by``, time). Both sides
    are one union, sorted once by key and time, and the values travel along
    the window, so no pair of rows is formed. A match further than
    ``within_days`` is none. Rows without key or time match nothing and never
    enter the window; the names in ``values`` must not be taken on the left.

    A key's rows are cut into stretches of ``slice_width`` days (for numbers:
    units; none with null), each a window of its own, so that a hot key is
    many tasks' work; each stretch is told by an aggregate what the ones
    before it end with. A match may lie any number of stretches away.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction is backward or forward, not {direction!r}")
    lt, rt = at
    forward = direction == "forward"
    kinds = [left.schema[lt].dataType, right.schema[rt].dataType]

    def sliced(t: str, kind: DataType) -> Column:
        return _slice_of(F.col(t), kind, slice_width) if slice_width else F.lit(0).cast("bigint")

    found = F.struct(F.col(rt).alias("_at"), *values)
    there = F.col(by).isNotNull() & F.col(lt).isNotNull()
    asked = left.where(there).select(
        F.col(by).alias("_k"), sliced(lt, kinds[0]).alias("_s"), F.col(lt).alias("_t"), F.lit(0 if forward else 1).alias("_side"), F.struct(*left.columns).alias("_l")
    )
    offered = right.where(F.col(by).isNotNull() & F.col(rt).isNotNull()).select(
        F.col(by).alias("_k"), sliced(rt, kinds[1]).alias("_s"), F.col(rt).alias("_t"), F.lit(1 if forward else 0).alias("_side"), found.alias("_r")
    )
    if slice_width:
        edge = (F.min_by if forward else F.max_by)("_r", "_t").alias("_r")
        stretches = asked.select("_k", "_s").unionByName(offered.select("_k", "_s", "_t", "_r"), allowMissingColumns=True).groupBy("_k", "_s").agg(edge)
        before = Window.partitionBy("_k").orderBy(F.col("_s").desc() if forward else F.col("_s")).rowsBetween(Window.unboundedPreceding, -1)
        carried = stretches.withColumn("_r", F.last("_r", ignorenulls=True).over(before)).where("_r IS NOT NULL")
        offered = offered.unionByName(carried, allowMissingColumns=True)
    # What is carried into a stretch has no time and comes first.
    order = [F.col("_t").desc_nulls_first(), F.col("_side").desc()] if forward else [F.col("_t").asc_nulls_first(), F.col("_side")]
    w = Window.partitionBy("_k", "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(offered, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    near = F.lit(True)
    if within_days is not None:
        near = F.abs(F.datediff("_t", "_m._at")) <= within_days
    aside = left.where(~there).select(*left.columns, *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values))
    return met.select("_l.*", *(F.when(near, F.col(f"_m.{v}")).alias(v) for v in values)).unionByName(aside)


def interval_lookup(left: DataFrame, right: DataFrame, by: str, at: str, start: str, end: str, values: Sequence[str]) -> DataFrame:
    """``left`` with ``values`` of the right interval of its key that holds ``at``.

    A null ``end`` is open. Intervals of one key must not overlap, so the
    interval that began last is the only one that can hold the time: the
    lookup is an as-of match followed by a test of the end.
    """
    met = asof(left, right, by, (at, start), [*values, end])
    holds = F.col(end).isNull() | (F.col(at) <= F.col(end))
    return met.select(*left.columns, *(F.when(holds, F.col(v)).alias(v) for v in values))


def multiset_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Each distinct row as often as in the frame that has it most often."""
    columns = frames[0].columns
    counted = None
    for i, frame in enumerate(frames):
        one = frame.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_i", F.lit(i))
        counted = one if counted is None else counted.unionByName(one)
    most = counted.groupBy(*columns).agg(F.max("_n").alias("_n"))
    return most.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_c")).drop("_c")
