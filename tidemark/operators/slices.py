"""Windows over one long series, split into slices that run side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, x: str, by: str, at: str, name: str) -> DataFrame:
    """The rows with a value, and ``name``: their number in the series, from 0.

    Numbers are counted within months and moved by the months before, whose
    counts are one small row each; no series is sorted in one task.
    """
    seen = df.where(F.col(x).isNotNull()).withColumn("_month", F.trunc(at, "month"))
    counts = seen.groupBy(by, "_month").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_month", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(by, "_month").orderBy(at)) - 1
    return seen.withColumn("_i", inside).join(starts, [by, "_month"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_i", "_start", "_month")


def in_slices(
    df: DataFrame,
    x: str,
    value: Callable[[str], Column],
    name: str,
    *,
    reach: int,
    by: str = "symbol",
    at: str = "session",
    length: int = 8192,
) -> DataFrame:
    """``df`` with ``name``: a kernel of ``x`` that looks back ``reach`` observations.

    ``value`` makes the kernel for a given partitioning column. A series is
    cut into slices of ``length`` observations, each with the last ``reach``
    of the one before it, and the kernel runs on (series, slice): the same
    values as over the whole series, but a hot symbol is spread over as many
    tasks as it has slices. Rows without a value keep a null. The series and
    time together must be unique, and the time must not be null.
    """
    if not 0 <= reach <= length:
        raise ValueError(f"a slice of {length} does not hold the {reach} observations before it")
    k = F.col("_k")
    wide = numbered(df, x, by, at, "_k").withColumn(
        "_slice", F.explode(F.sequence(F.floor(k / length), F.floor((k + reach) / length)))
    )
    parts = wide.withColumn("_part", F.struct(F.col(by), F.col("_slice")))
    done = parts.withColumn(name, value("_part")).where(F.col("_slice") == F.floor(k / length))
    rest = df.where(F.col(x).isNull()).withColumn(name, F.lit(None).cast("double"))
    return done.select(*df.columns, name).unionByName(rest)
