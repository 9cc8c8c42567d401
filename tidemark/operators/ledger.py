"""Events on the sessions of a market: runs of a number, placing, and merging of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import session_near
from tidemark.operators.joins import asof, islands
from tidemark.operators.matching import best_source, confirmations, match_by_ratio

# What became of an event.
MATCHED, NO_EX_SESSION, NOT_TRADED = "matched", "no_ex_session", "not_traded"


def distribution_runs(bars: DataFrame) -> DataFrame:
    """Each ISIN's sessions in runs of one distribution number.

    ``bars``: ``isin, session, distribution_number, ticker, open, close``, one
    row per ISIN and session. Result: ``isin, run, distribution_number,
    first_session, last_session, ticker, first_open, last_close``; ticker and
    open are those of the first session, the close that of the last. Rows
    without ISIN or session are left out.
    """
    rows = bars.where("isin IS NOT NULL AND session IS NOT NULL")
    marked = islands(rows, ["isin"], "session", F.col("distribution_number"), "run")
    return marked.groupBy("isin", "run").agg(
        F.min_by("distribution_number", "session").cast("bigint").alias("distribution_number"),
        F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
        F.min_by("ticker", "session").alias("ticker"),
        F.min_by("open", "session").alias("first_open"),
        F.max_by("close", "session").alias("last_close"),
    )


def ex_sessions(runs: DataFrame) -> DataFrame:
    """The sessions at which an ISIN first traded under another number.

    ``isin, ticker, session, previous_session, from_distribution,
    to_distribution, previous_close, open, open_ratio``.
    """
    w = Window.partitionBy("isin").orderBy("run")
    before = {c: F.lag(s).over(w) for c, s in (("previous_session", "last_session"), ("from_distribution", "distribution_number"), ("previous_close", "last_close"))}
    rows = runs.withColumns(before).where("previous_session IS NOT NULL")
    return rows.select(
        "isin",
        "ticker",
        F.col("first_session").alias("session"),
        "previous_session",
        "from_distribution",
        F.col("distribution_number").alias("to_distribution"),
        "previous_close",
        F.col("first_open").alias("open"),
        F.try_divide(F.col("first_open"), F.col("previous_close")).alias("open_ratio"),
    )


def _followed(runs: DataFrame) -> DataFrame:
    following = F.lead("first_session").over(Window.partitionBy("isin").orderBy("run"))
    return runs.select("isin", "distribution_number", "first_session", "last_session", following.alias("_next"))


def placed(events: DataFrame, runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """``events`` with ``placement, ex_session, ex_date, anchor_date``.

    ``events``: ``isin, last_cum_date, distribution_number`` and more. An
    event with a date goes to the change of number whose last session before
    lies on or before the date and whose session is after it: matched, no
    ex-session where the number went on past the date, or not traded. One
    without a date but with a number n goes to the change from a to b with a
    <= n < b. ``ex_date`` is the first session after the date, or the
    ex-session; the anchor is the ex-session, or else the ex-date. An event
    placed by its number gets the session before as ``last_cum_date``.

    All lookups are as-of matches along sorted unions.
    """
    runs = _followed(runs)
    dated = events.where("last_cum_date IS NOT NULL")
    by_start = runs.select("isin", "first_session", F.col("last_session").alias("_last"), F.col("_next").alias("_ex"))
    met = asof(dated, by_start, "isin", ("last_cum_date", "first_session"), ["_last", "_ex"])
    there = F.col("_last").isNotNull()
    after = F.col("_last") > F.col("last_cum_date")
    outcome = F.when(there & after, NO_EX_SESSION).when(there & F.col("_ex").isNotNull(), MATCHED).otherwise(NOT_TRADED)
    met = met.withColumn("placement", outcome).withColumn("ex_session", F.when(F.col("placement") == MATCHED, F.col("_ex"))).drop("_last", "_ex")
    met = session_near(met.withColumn("_day", F.date_add("last_cum_date", 1)), sessions, "_day", "forward", "ex_date").drop("_day")

    numbered = events.where("last_cum_date IS NULL")
    # Of several runs of one number the last counts.
    by_number = runs.groupBy("isin", F.col("distribution_number").alias("_n")).agg(F.max_by("_next", "first_session").alias("_ex"), F.max("first_session").alias("_f"))
    found = asof(numbered, by_number, "isin", ("distribution_number", "_n"), ["_ex"], slice_width=None)
    found = found.withColumn("placement", F.when(F.col("_ex").isNotNull(), MATCHED).otherwise(NOT_TRADED)).withColumnRenamed("_ex", "ex_session")
    found = session_near(found.withColumn("_day", F.date_sub("ex_session", 1)), sessions, "_day", "backward", "_cum").drop("_day")
    found = found.withColumns({"ex_date": F.col("ex_session"), "last_cum_date": F.col("_cum")})
    columns = [*events.columns, "placement", "ex_session", "ex_date"]
    every = met.select(*columns).unionByName(found.select(*columns))
    return every.withColumn("anchor_date", F.coalesce("ex_session", "ex_date"))


def placed_by_ratio(events: DataFrame, ex: DataFrame, sessions: DataFrame, *, days: int = 180, tolerance: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Events known by an approval and a ratio, with the ex-session their ratio points to; and the rest.

    ``events``: ``event_no, isin, approved_on, share_ratio``. Those placed get
    ``ex_session`` and, as ``last_cum_date``, the session before it.
    """
    met = match_by_ratio(events, ex, by="isin", event="event_no", at="approved_on", ratio="share_ratio", session="session", open_ratio="open_ratio", days=days, tolerance=tolerance)
    both = events.join(met.withColumnRenamed("matched_session", "ex_session"), "event_no", "left")
    found = session_near(both.where("ex_session IS NOT NULL").withColumn("_day", F.date_sub("ex_session", 1)), sessions, "_day", "backward", "_cum")
    kept = found.withColumn("last_cum_date", F.col("_cum")).drop("_cum", "_day")
    return kept, both.where("ex_session IS NULL").drop("ex_session")


def merged_sources(events: DataFrame, by: Sequence[str], rank: Column, record: str, amount: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The events of each group's best source, with the sources that confirm them; and the conflicts.

    ``events`` have ``source``. Each record of a lower source is paired with
    one of the best (see :func:`tidemark.operators.matching.confirmations`)
    and then named in its ``confirmed_by``; one that finds none is a
    conflict. Lower sources are paired each by themselves.
    """
    keys = list(by)
    ranked = events.withColumn("_rank", rank)
    best = best_source(ranked, keys, F.col("_rank"))
    lower = ranked.join(best.select(record).distinct(), record, "left_anti")
    # A source's records compete with each other, not with another source's.
    per = [*keys, "_source"]
    sources = lower.select(*keys, F.col("source").alias("_source")).distinct()
    offered = best.join(sources, keys).select(*per, record, amount)
    pairs = confirmations(offered, lower.withColumnRenamed("source", "_source"), per, record, amount, tolerance)
    told = pairs.where("best_id IS NOT NULL").groupBy("best_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("_source"))).alias("confirmed_by"))
    kept = best.drop("_rank").join(told, F.col(record).cast("string") == F.col("best_id"), "left").drop("best_id")
    conflicts = lower.drop("_rank").join(pairs.where("best_id IS NULL").select("other_id"), F.col(record).cast("string") == F.col("other_id"), "left_semi")
    return kept.withColumn("confirmed_by", F.coalesce("confirmed_by", F.lit(""))), conflicts


def counts_by_year(df: DataFrame, status: str, day: str) -> DataFrame:
    """``status, year, rows``."""
    return df.groupBy(F.col(status).alias("status"), F.year(day).alias("year")).agg(F.count("*").alias("rows"))
