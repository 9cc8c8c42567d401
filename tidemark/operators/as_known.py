"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def _value(i: int, column: Column, types: Sequence[DataType]) -> Column:
    """The value of the i-th attribute, in a place of its own beside the others'."""
    return F.struct(*((column if j == i else F.lit(None).cast(t)).alias(f"v{j}") for j, t in enumerate(types)))


def change_histories(
    versions: DataFrame, entity: str, valid_from: str, known_from: str, attributes: Sequence[str]
) -> DataFrame:
    """A history for each attribute: ``_e, _attr, _since, _v``.

    From ``_since`` on (and until the next row of the entity and attribute)
    the attribute has the value of the version with the latest ``valid_from``,
    then the latest ``known_from``, among those with both dates reached. A
    history has a row only where its own attribute changes; a null value is a
    value. Of versions equal in both dates the same one counts for all
    attributes (that with the larger hash of them). ``_attr`` is the number of
    the attribute and ``_v`` holds its value in the field ``v{_attr}``.
    """
    types = [versions.schema[a].dataType for a in attributes]
    rank = F.struct(
        F.col(valid_from).alias("from"), F.col(known_from).alias("known"), F.xxhash64(*(c for a in attributes for c in (F.col(a).isNull(), F.col(a)))).alias("tie")
    )
    cells = [F.struct(F.lit(i).alias("_attr"), _value(i, F.col(a), types).alias("_v")) for i, a in enumerate(attributes)]
    rows = (
        versions.where(F.col(entity).isNotNull() & F.col(valid_from).isNotNull() & F.col(known_from).isNotNull())
        .withColumns({"_rank": rank, "_since": F.greatest(valid_from, known_from), "_cells": F.array(*cells)})
        .select(F.col(entity).alias("_e"), "_since", "_rank", F.inline("_cells"))
    )
    # One row per entity, attribute and day before any window: a history is
    # then bounded by the number of days.
    best = rows.groupBy("_e", "_attr", "_since").agg(F.max("_rank").alias("_rank"), F.max_by("_v", "_rank").alias("_v"))
    order = Window.partitionBy("_e", "_attr").orderBy("_since")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    state = best.select("_e", "_attr", "_since", F.max_by("_v", "_rank").over(upto).alias("_v"))
    changed = F.lag("_since").over(order).isNull() | ~F.lag("_v").over(order).eqNullSafe(F.col("_v"))
    return state.withColumn("_c", changed).where("_c").drop("_c")


def as_known(
    events: DataFrame,
    versions: DataFrame,
    *,
    entity: tuple[str, str],
    at: str,
    valid_from: str,
    known_from: str,
    attributes: Sequence[str],
) -> DataFrame:
    """``events`` with each attribute as it was valid and known at ``at``.

    Result: the columns of ``events`` plus one column per attribute (a
    leading ``known_`` where the name is taken) and ``has_version``, false
    where no version was valid and known by then. ``entity`` names the column
    in events and in versions.

    Each attribute has a change history of its own and its own last-known
    match, so attributes that change at different times do not need common
    wide versions: histories and matches are keyed by entity and attribute,
    and the answers of a day are pivoted back to columns at the end. Nothing
    that starts or becomes known after ``at`` can be seen. Events are first
    reduced to the distinct (entity, day) pairs, so the match of one entity
    and attribute is bounded by the number of days, however many events a hot
    entity has; the answer joins back on both columns, which spreads them.

    Events without entity or date keep their row with null attributes; exact
    repeats of versions count once; extra columns pass through. At least one
    attribute is asked for.
    """
    if not attributes:
        raise ValueError("at least one attribute is asked for")
    left, right = entity
    taken = set(events.columns)
    names = [f"known_{a}" if a in taken else a for a in attributes]
    n = range(len(attributes))
    history = change_histories(versions, right, valid_from, known_from, attributes)
    asked = (
        events.select(F.col(left).alias("_e"), F.col(at).cast("date").alias("_since"))
        .where("_e IS NOT NULL AND _since IS NOT NULL")
        .distinct()
        .select("*", F.explode(F.array(*map(F.lit, n))).alias("_attr"))
    )
    both = history.withColumn("_ask", F.lit(0)).unionByName(asked.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("_e", "_attr").orderBy("_since", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_ask = 1")
    answered = matched.groupBy("_e", "_since").agg(
        *(F.first(F.when(F.col("_attr") == i, F.col("_v")), ignorenulls=True).alias(f"_h{i}") for i in n)
    )
    tagged = events.withColumns({"_ke": F.col(left), "_kd": F.col(at).cast("date")})
    joined = tagged.join(
        answered, (F.col("_ke") == F.col("_e")) & (F.col("_kd") == F.col("_since")), "left"
    )
    return joined.select(
        *events.columns,
        *(F.col(f"_h{i}.v{i}").alias(names[i]) for i in n),
        F.col("_h0").isNotNull().alias("has_version"),
    )
