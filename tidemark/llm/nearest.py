"""Matching records by nearest time, by expanding ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_by_tick(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: tuple[str, str],
    day: tuple[str, str],
    tolerance: int,
    matched: str = "matched",
    how: str = "left",
) -> DataFrame:
    """``left`` with the nearest day of ``right`` for the same entity.

    ``entity`` and ``day`` name the columns of the two sides; the tick is one
    day. Each right record is expanded to every tick within ``tolerance``,
    the nearest record of each (entity, tick) is kept, and the left records
    find theirs by an equi-join on (entity, tick). Of two equally near days
    the later one is taken. The result has the left columns and ``matched``;
    with ``how="inner"`` only left rows with a match.

    A null entity or day matches nothing; left rows (and their repeats) are
    kept as they are; repeated right rows count once; extra columns of the
    right side do not appear, so names cannot clash.

    Scale: a right row becomes ``2 * tolerance + 1`` narrow rows, reduced by
    map-side combine to one per (entity, tick). Both sides are hashed by
    entity and tick together, so a hot entity is spread over its ticks and
    no entity is gathered in one task; AQE splits a tick that is itself hot.
    """
    le, re_ = entity
    ld, rd = day
    days = (
        right.select(F.col(re_).alias("_e"), F.col(rd).cast("date").alias("_d"))
        .where("_e IS NOT NULL AND _d IS NOT NULL")
        .distinct()
    )
    ticks = days.select("_e", "_d", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("_off"))
    # One number orders the candidates of a tick: the distance first, then
    # the later day (the record lies after the tick where _off is negative).
    rank = F.abs("_off") * 2 + F.when(F.col("_off") > 0, 1).otherwise(0)
    best = (
        ticks.select("_e", F.date_add("_d", F.col("_off")).alias("_tick"), "_d", rank.alias("_rank"))
        .groupBy("_e", "_tick")
        .agg(F.min_by("_d", "_rank").alias(matched))
    )
    asked = left.withColumns({"_le": F.col(le), "_lt": F.col(ld).cast("date")})
    joined = asked.join(best, (F.col("_le") == F.col("_e")) & (F.col("_lt") == F.col("_tick")), how)
    return joined.select(*left.columns, best[matched])
