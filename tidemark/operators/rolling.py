"""Trailing totals by binary doubling over a dense calendar of positions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship


def daily_totals(
    df: DataFrame, entity: str, day: str, part: str, value: str, received: str
) -> DataFrame:
    """``entity, day, value``: sums over the parts, each part's latest delivery.

    The delivery with the latest ``received`` counts (null is the earliest; of
    equally late ones the larger value; a null value counts as zero). Rows
    without entity or day are left out. Both aggregations combine map-side,
    so copies of a row, or the parts of one day, do not meet in one task.
    """
    rows = df.select(
        F.col(entity).alias("_e"),
        F.col(day).alias("_d"),
        F.col(part).alias("_p"),
        F.struct(F.col(received).alias("r"), F.col(value).cast("double").alias("v")).alias("_x"),
    ).where("_e IS NOT NULL AND _d IS NOT NULL")
    latest = rows.groupBy("_e", "_d", "_p").agg(F.max("_x").alias("_x"))
    return latest.groupBy("_e", "_d").agg(
        F.sum(F.coalesce(F.nanvl("_x.v", F.lit(0.0)), F.lit(0.0))).alias("_v")
    ).select(F.col("_e").alias(entity), F.col("_d").alias(day), F.col("_v").alias(value))


def dense_series(days: DataFrame, entity: str, position: str, value: str, last: int | None = None) -> DataFrame:
    """One row per entity: ``entity, first_pos, series``.

    ``series[i]`` is the value at position ``first_pos + i``, zero where the
    entity has no row; it ends at position ``last``, or at the entity's last
    row where that is later or no ``last`` is given. An entity's array is
    bounded by the number of calendar positions, whatever the number of rows
    behind it.
    """
    packed = days.groupBy(entity).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col(position).cast("int").alias("p"), F.col(value).cast("double").alias("v")))
        ).alias("_x")
    )
    filled = F.transform(
        "_x",
        lambda x, i: F.concat(
            F.array_repeat(F.lit(0.0), F.when(i == 0, 0).otherwise(x.p - F.get(F.col("_x"), i - 1).p - 1)),
            F.array(F.coalesce(x.v, F.lit(0.0))),
        ),
    )
    series = F.flatten(filled)
    if last is not None:
        missing = F.greatest(F.lit(last) - F.element_at("_x", -1).p, F.lit(0))
        series = F.concat(series, F.array_repeat(F.lit(0.0), missing))
    return packed.select(entity, F.col("_x")[0].p.alias("first_pos"), series.alias("series"))


def shifted(series: Column, by: int) -> Column:
    """The array moved ``by`` places to the right, zeros moving in."""
    n = F.size(series)
    if by == 0:
        return series
    return F.slice(F.concat(F.array_repeat(F.lit(0.0), by), series), F.lit(1), n)


def added(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: x + y)


def with_doubling(df: DataFrame, series: str, levels: int, prefix: str) -> DataFrame:
    """Adds ``prefix0 .. prefix{levels}``: sums of 1, 2, 4 ... 2**levels places."""
    df = df.withColumn(f"{prefix}0", F.col(series))
    for k in range(levels):
        block = F.col(f"{prefix}{k}")
        df = df.withColumn(f"{prefix}{k + 1}", added(block, shifted(block, 2**k)))
    return df


def window_sum(prefix: str, length: int) -> Column:
    """The array of sums over the last ``length`` places, from shifted blocks."""
    if length < 1:
        raise ValueError(f"a window holds at least one place, not {length}")
    total, done = None, 0
    for k in reversed(range(length.bit_length())):
        if length >> k & 1:
            block = shifted(F.col(f"{prefix}{k}"), done)
            total, done = (block if total is None else added(total, block)), done + 2**k
    return total


def sum_at(prefix: str, levels: int, end: Column, length: Column) -> Column:
    """Sum over the ``length`` places that end at index ``end`` (from 0).

    ``end`` and ``length`` may differ from row to row; places before the
    array's first count as zero, and a length of zero or less gives zero.
    """
    total = F.lit(0.0)
    for k in range(levels + 1):
        # The blocks of the lower digits lie between this one and the end.
        at = end - length.bitwiseAND(F.lit(2**k - 1))
        taken = (length.bitwiseAND(F.lit(2**k)) != 0) & (length > 0) & (at >= 0)
        total = total + F.when(taken, F.coalesce(F.get(F.col(f"{prefix}{k}"), at), F.lit(0.0))).otherwise(0.0)
    return total


def trailing(
    days: DataFrame,
    entity: str,
    position: str,
    value: str,
    windows: Sequence[int] = (7, 30),
    last: int | None = None,
) -> DataFrame:
    """Total and mean of the last ``windows`` positions, for every position.

    Result: ``entity, position, value`` and for each window ``sum_{w}`` and
    ``mean_{w}``; every position from the entity's first row to ``last`` (its
    last row where that is later or no ``last`` is given), those without a row
    as zero. Positions before the first count as zero, so a mean divides by
    the whole window. Rows without entity or position
    are left out; a null value is zero; an empty table gives no rows. There
    must be one row per (entity, position).

    Sums of one, two, four, eight ... places are built by adding the series
    to itself shifted, and each window is the sum of the blocks of its binary
    digits, so a window of n places costs about 2 log2(n) additions instead
    of n. Everything runs in the JVM on arrays of one entity.
    """
    levels = max(windows).bit_length() - 1
    rows = days.where(F.col(entity).isNotNull() & F.col(position).isNotNull())
    wide = with_doubling(dense_series(rows, entity, position, value, last), "series", levels, "_d")
    wide = wide.withColumns({f"_w{w}": window_sum("_d", w) for w in windows})
    long = wide.select(
        entity,
        "first_pos",
        F.posexplode(F.arrays_zip("series", *(f"_w{w}" for w in windows))).alias("_i", "_z"),
    )
    return long.select(
        entity,
        (F.col("first_pos") + F.col("_i")).alias(position),
        F.col("_z.series").alias(value),
        *(F.col(f"_z._w{w}").alias(f"sum_{w}") for w in windows),
        *((F.col(f"_z._w{w}") / F.lit(float(w))).alias(f"mean_{w}") for w in windows),
    )


#: Rows of the output that a task computes at a time.
ROWS_AT_ONCE = 250_000


def doubled(series: np.ndarray, levels: int) -> list[np.ndarray]:
    """Sums of 1, 2, 4 ... 2**levels places that end at each place, along the last axis."""
    blocks = [series]
    for k in range(levels):
        more = blocks[-1].copy()
        more[..., 2**k :] += blocks[-1][..., : -(2**k)]
        blocks.append(more)
    return blocks


def window_sums(blocks: Sequence[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """Sums over the ``lengths[p]`` places that end at place ``p``, from shifted blocks.

    The window of each place is put together from the blocks of its length's
    binary digits, the largest at its end; places before the first are zero.
    """
    places = np.arange(blocks[0].shape[-1])
    total = np.zeros_like(blocks[0])
    for k, block in enumerate(blocks):
        # The blocks of the lower digits lie between this one and the end.
        at = places - (lengths & (2**k - 1))
        taken = np.flatnonzero((lengths >> k & 1 == 1) & (at >= 0))
        total[..., taken] += block[..., at[taken]]
    return total


def presence(days: DataFrame, entity: str, position: str, value: str, lengths: Mapping[str, Sequence[int]]) -> DataFrame:
    """Share of positions above zero in windows that differ from position to position.

    Result: ``entity, position`` and one column for each of ``lengths``, for
    every position from the entity's first row to the calendar's last.
    ``lengths[name][p]`` is the number of calendar positions in the window that
    ends at position ``p``; the share of an empty window is null. Rows without
    entity or position are left out; null and NaN are no presence; there is
    one row per (entity, position).

    The days above zero of an entity travel as one array no longer than the
    calendar; the counts come by binary doubling over them, on whole arrays of
    bounded numbers of entities.
    """
    names = list(lengths)
    spans = [np.asarray(lengths[n], dtype=np.int64) for n in names]
    size = len(spans[0]) if spans else 0
    levels = max(1, max((int(x.max(initial=1)) for x in spans), default=1)).bit_length() - 1
    ship(days.sparkSession)
    kind = "smallint" if size < 2**15 else "int"
    packed = (
        days.where(F.col(entity).isNotNull() & F.col(position).isNotNull())
        .groupBy(entity)
        .agg(
            F.min(position).cast("int").alias("_first"),
            F.collect_list(F.when((F.col(value) > 0) & ~F.isnan(value), F.col(position).cast(kind))).alias("_at"),
        )
    )
    fields = [days.schema[entity], T.StructField(position, T.IntegerType())]
    schema = T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def shares(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = batch.column(1).to_numpy(zero_copy_only=False)
        at = batch.column(2)
        one = np.zeros((batch.num_rows, size), dtype=np.int32)
        owner = np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
        one[owner, at.flatten().to_numpy(zero_copy_only=False)] = 1
        row, place = np.nonzero(np.arange(size) >= first[:, None])
        blocks = doubled(one, levels)
        columns = []
        for n in spans:
            with np.errstate(divide="ignore", invalid="ignore"):
                share = (window_sums(blocks, n) / n)[row, place]
            columns.append(pa.array(share, mask=~(n > 0)[place]))
        return pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(place.astype(np.int32)), *columns], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ROWS_AT_ONCE // max(1, size))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                yield shares(batch.slice(start, step))

    return packed.mapInArrow(run, schema)
