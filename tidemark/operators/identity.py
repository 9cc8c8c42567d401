"""Spans of identifiers, candidates for successors, and lookups at a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def spans(df: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """``by..., first_session, last_session, sessions`` of each identifier."""
    return df.groupBy(*by).agg(
        F.min(at).alias("first_session"), F.max(at).alias("last_session"), F.count_distinct(at).alias("sessions")
    )


def nodes(spanned: DataFrame, entity: str, label: str) -> DataFrame:
    """One row per entity with its life and its first and last label."""
    return spanned.groupBy(entity).agg(
        F.min("first_session").alias("first_session"),
        F.max("last_session").alias("last_session"),
        F.min_by(label, F.struct("first_session", label)).alias("first_label"),
        F.max_by(label, F.struct("last_session", label)).alias("last_label"),
    )


def successor_candidates(life: DataFrame, sessions: DataFrame, entity: str, kind: Column, most: int = 5) -> DataFrame:
    """``from_, to_, gap_sessions``: who starts 1 to ``most`` sessions after whom ends.

    Both of one kind. Ends are expanded to the ``most`` positions a successor
    may start at and met by equality, so no pair outside the gap is formed.
    """
    at = sessions.select(F.col("session").alias("_day"), F.col("pos").alias("_pos"))
    rows = life.withColumn("_kind", kind)
    ends = rows.join(at, F.col("last_session") == F.col("_day")).select(
        F.col(entity).alias("from_"), "_kind", "_pos", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("gap_sessions")
    )
    starts = rows.join(at, F.col("first_session") == F.col("_day")).select(F.col(entity).alias("to_"), "_kind", F.col("_pos").alias("_start"))
    met = ends.withColumn("_start", F.col("_pos") + F.col("gap_sessions")).join(starts, ["_kind", "_start"])
    return met.where("from_ <> to_").select("from_", "to_", "gap_sessions")


def judged_links(candidates: DataFrame) -> DataFrame:
    """``from_, to_, gap_sessions, linked`` of pairs judged one to one, the smallest gaps first.

    Gap by gap a pair is linked if both are still free and neither has
    another free partner at that gap; crowded ones are not, but stay free for
    larger gaps. A pair one of whose ends is linked at a smaller gap is not
    judged and has no row. Repeated pairs count once, pairs with a null are
    left out.

    Not all gaps need rounds of their own: a pair may be judged as soon as
    both ends, and all their partners at this gap, have nothing open at a
    smaller one. A round judges all such pairs at once (those of the smallest
    gap are always among them), so there are about as many rounds as the
    longest chain of pairs that wait for each other; each is checkpointed.
    Groups are aggregated, not gathered. Runs when it is called.
    """
    pair = ["from_", "to_", "gap_sessions"]
    open_ = cut_lineage(candidates.select(*pair).where("from_ IS NOT NULL AND to_ IS NOT NULL AND gap_sessions IS NOT NULL").distinct())
    every = None
    while every is None or not open_.isEmpty():
        lows = open_
        for end in ("from_", "to_"):
            lows = lows.join(open_.groupBy(end).agg(F.min("gap_sessions").alias(f"_{end}")), end)
        ready = (F.col("gap_sessions") == F.col("_from_")) & (F.col("gap_sessions") == F.col("_to_"))
        told = cut_lineage(lows.select(*pair, ready.alias("_ready")))
        judged = told.where("_ready")
        for end in ("from_", "to_"):
            level = told.groupBy(end, "gap_sessions").agg(F.count("*").alias(f"_n{end}"), F.bool_and("_ready").alias(f"_all{end}"))
            judged = judged.join(level, [end, "gap_sessions"])
        judged = cut_lineage(
            judged.where("_allfrom_ AND _allto_").select(*pair, ((F.col("_nfrom_") == 1) & (F.col("_nto_") == 1)).alias("linked"))
        )
        every = judged if every is None else every.unionByName(judged)
        taken = judged.where("linked")
        rest = open_.join(judged.select(*pair), pair, "left_anti")
        for end in ("from_", "to_"):
            rest = rest.join(taken.select(end), end, "left_anti")
        open_ = cut_lineage(rest)
    return every


def chosen_links(candidates: DataFrame) -> DataFrame:
    """The pairs of :func:`judged_links` that are linked: ``from_, to_, gap_sessions``."""
    return judged_links(candidates).where("linked").drop("linked")


def label_at(spanned: DataFrame, asked: DataFrame, entity: str, label: str, at: str) -> DataFrame:
    """``asked`` (entity, day) with the label in force, else the last one before.

    Spans of an entity may overlap or leave gaps; the one that began last is
    taken.
    """
    from tidemark.operators.joins import asof

    starts = spanned.groupBy(entity, "first_session").agg(F.max(label).alias(label))
    return asof(asked, starts, entity, (at, "first_session"), [label])


def relabelled(df: DataFrame, labels: DataFrame, entity: str, label: str) -> DataFrame:
    """Adds ``label``; one shared by several entities gets the entity behind it."""
    shared = F.count("*").over(Window.partitionBy(label)) > 1
    told = labels.select(entity, label).distinct().withColumn(
        label, F.when(shared, F.concat(label, F.lit(" ("), entity, F.lit(")"))).otherwise(F.col(label))
    )
    return df.join(told, entity, "left")


def one_row_per_label(df: DataFrame, label: str, at: str, weight: str, tie: str) -> DataFrame:
    """Of rows that share a label at a time the one with the larger weight."""
    w = Window.partitionBy(at, label).orderBy(F.col(weight).desc_nulls_last(), tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
