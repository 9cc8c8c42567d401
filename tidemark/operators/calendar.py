"""Sessions with dense positions, alignment to them, and checks of bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import asof


def sessions_of(df: DataFrame, day: str) -> DataFrame:
    """``session, pos``: the distinct days of a table, numbered from 0.

    One row for each day there is; only that calendar is sorted in one task.
    """
    days = df.select(F.col(day).alias("session")).where("session IS NOT NULL").distinct()
    return days.withColumn("pos", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("session")) - 1).cast("int"))


def valid_sessions(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions from ``start`` to ``end``, both included."""
    return sessions.where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def offset_sessions(df: DataFrame, sessions: DataFrame, day: str, bars: int, name: str) -> DataFrame:
    """Adds ``name``: the session ``bars`` before that of ``day``.

    Clamped to the first and last session; null for a day that is none.
    """
    last = sessions.agg(F.max("pos").alias("_last"))
    here = sessions.select(F.col("session").alias(day), F.col("pos").alias("_p"))
    there = sessions.select(F.col("session").alias(name), F.col("pos").alias("_q"))
    n = last.first()[0] or 0
    moved = df.join(here, day, "left").withColumn("_q", F.when(F.col("_p").isNotNull(), F.greatest(F.least(F.col("_p") - bars, F.lit(n)), F.lit(0))))
    return moved.join(there, "_q", "left").drop("_p", "_q")


def align(df: DataFrame, sessions: DataFrame, by: str = "symbol", at: str = "session") -> DataFrame:
    """Each symbol's rows on every session from its first to its last.

    Sessions without a row have nulls; rows off the calendar are dropped (see
    :func:`off_calendar`), and so are rows without symbol. Each row is
    exploded to the sessions up to the symbol's next one, so the rows are gone
    through once and joined to nothing but the calendar.
    """
    return _filled(df.join(sessions.withColumnRenamed("session", at), at).drop(at), sessions.withColumnRenamed("session", at), [by], df.columns, at)


def _filled(on: DataFrame, calendar: DataFrame, keys: Sequence[str], columns: Sequence[str], at: str) -> DataFrame:
    """Rows with ``pos`` on all positions of their keys; the calendar gives back ``at``."""
    w = Window.partitionBy(*keys).orderBy("pos")
    upto = F.greatest(F.coalesce(F.lead("pos").over(w) - 1, F.col("pos")), F.col("pos"))
    rows = on.where(F.col(keys[0]).isNotNull()).withColumn("_p", upto)
    rest = [c for c in columns if c not in (*keys, at)]
    spread = rows.select(*keys, "pos", *rest, F.explode(F.sequence("pos", "_p")).alias("_q"))
    own = F.col("pos") == F.col("_q")
    spread = spread.select(*keys, F.col("_q").alias("pos"), *(F.when(own, F.col(c)).alias(c) for c in rest))
    return spread.join(calendar, [*keys[1:], "pos"]).select(*columns)


def off_calendar(df: DataFrame, sessions: DataFrame, at: str = "session") -> DataFrame:
    """The rows whose day is no session."""
    return df.join(sessions.select(F.col("session").alias(at)), at, "left_anti")


def session_near(rows: DataFrame, sessions: DataFrame, day: str, direction: str, name: str) -> DataFrame:
    """Adds ``name``, the last session up to (or first from) a day.

    The calendar is one key; it is met by the distinct days, whose number is
    that of the calendar, and the answer joins back.
    """
    days = rows.select(F.col(day).alias("_asked")).where("_asked IS NOT NULL").distinct().withColumn("_one", F.lit(1))
    calendar = sessions.select(F.lit(1).alias("_one"), F.col("session").alias("_at"), F.col("session").alias(name))
    found = asof(days, calendar, "_one", ("_asked", "_at"), [name], direction=direction).drop("_one")
    return rows.join(F.broadcast(found), F.col(day) == F.col("_asked"), "left").drop("_asked")


#: Rules on bars: name, columns, condition (fixed names).
RULES: Sequence[tuple[str, tuple[str, ...], str]] = (
    ("critical_high_below_low", ("high", "low"), "high < low"),
    ("critical_high_below_open", ("high", "open"), "high < open"),
    ("critical_high_below_close", ("high", "close"), "high < close"),
    ("critical_low_above_open", ("low", "open"), "low > open"),
    ("critical_low_above_close", ("low", "close"), "low > close"),
    ("critical_negative_volume", ("volume",), "volume < 0"),
)


def check_bars(df: DataFrame) -> DataFrame:
    """Adds one boolean per rule whose columns there are; reports, never fixes.

    A null makes no finding.
    """
    have = set(df.columns)
    found = {
        name: F.coalesce(F.expr(rule), F.lit(False)) for name, columns, rule in RULES if have >= set(columns)
    }
    prices = [c for c in ("open", "high", "low", "close") if c in have]
    if prices:
        negative: Column = F.lit(False)
        for c in prices:
            negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
        found["warning_negative_price"] = negative
    return df.withColumns(found)


def interior_gaps(df: DataFrame, x: str, by: str = "symbol", at: str = "session") -> DataFrame:
    """``symbol, has_gap``: a null between two observed values of a symbol."""
    w = Window.partitionBy(by).orderBy(at)
    numbered = df.withColumn("_n", F.row_number().over(w))
    seen = F.when(F.col(x).isNotNull(), F.col("_n"))
    return numbered.groupBy(by).agg((F.max(seen) - F.min(seen) + 1 > F.count(x)).alias("has_gap")).na.fill({"has_gap": False})


def rule_calendar(spark, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """``session, pos`` of all weekdays but the listed holidays (``session``)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session"))
    days = days.where(F.dayofweek("session").between(2, 6))
    if holidays is not None:
        days = days.join(holidays.select("session"), "session", "left_anti")
    return sessions_of(days, "session")


def align_each(df: DataFrame, calendars: DataFrame, of: DataFrame, by: str = "symbol", at: str = "session") -> DataFrame:
    """:func:`align` with a calendar per symbol.

    ``calendars`` are ``calendar, session, pos``, ``of`` names the calendar of
    each symbol; a symbol without one is an error when the rows are read.
    """
    missing = F.raise_error(F.concat(F.lit("no calendar for "), F.col(by))).cast("string")
    named = df.join(of.select(by, "calendar"), by, "left").withColumn("calendar", F.coalesce("calendar", missing))
    days = calendars.withColumnRenamed("session", at)
    return _filled(named.join(days, ["calendar", at]).drop(at), days, [by, "calendar"], [*df.columns, "calendar"], at).select(*df.columns)
