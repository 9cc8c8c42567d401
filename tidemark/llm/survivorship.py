"""One surviving record per duplicate group, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(
    df: DataFrame,
    group: Sequence[str],
    record: str,
    priority: Column,
    recorded: str,
    fields: Mapping[str, Column],
    *,
    least_records: int = 2,
) -> DataFrame:
    """One row per group of at least ``least_records`` different records.

    ``fields`` maps each attribute to its usable value, null where the record
    must not give it. For each attribute the result has the value, under its
    name, and the record it comes from, as ``{name}_from``: among records with
    a usable value the one with the smallest ``priority``, then the latest
    ``recorded`` (null last), then the smallest ``record``.

    Everything is one aggregation: per attribute the extreme of a composite
    struct (usable, priority, time, record, value), written so that the
    smallest struct is the best and unusable records contribute nothing. It
    combines map-side, so a hot group sends one row from each task.

    Group columns that are null form groups of their own; repeats count once,
    as do records without an id (none of which is counted or can survive); an
    attribute no record can give is null, as is its ``_from``; an empty table
    gives an empty result. ``priority`` must not be null.
    """
    order = F.coalesce(-F.unix_micros(F.col(recorded).cast("timestamp")), F.lit(2**63 - 1))
    base = df.where(F.col(record).isNotNull()).select(
        *group,
        F.col(record).alias("_id"),
        priority.alias("_p"),
        order.alias("_t"),
        *(value.alias(f"_v_{name}") for name, value in fields.items()),
    )
    best = {
        name: F.min(
            F.when(
                F.col(f"_v_{name}").isNotNull(),
                F.struct("_p", "_t", "_id", F.col(f"_v_{name}").alias("v")),
            )
        ).alias(f"_b_{name}")
        for name in fields
    }
    # Two different ids are there if the smallest and the largest differ, so
    # pairs need no set of ids; larger minimums count them.
    enough = (
        F.col("_least") < F.col("_most") if least_records == 2 else F.col("_n") >= least_records
    )
    counted = [] if least_records == 2 else [F.count_distinct("_id").alias("_n")]
    grouped = base.groupBy(*group).agg(
        F.min("_id").alias("_least"), F.max("_id").alias("_most"), *counted, *best.values()
    )
    return grouped.where(enough).select(
        *group,
        *(F.col(f"_b_{name}.v").alias(name) for name in fields),
        *(F.col(f"_b_{name}._id").alias(f"{name}_from") for name in fields),
    )
