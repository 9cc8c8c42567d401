"""Universes as memberships: ``session, symbol`` tables and their algebra."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.calendar import session_near
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Universe:
    """Who is in at each session; ``|``, ``&`` and ``-`` combine per session."""

    members: DataFrame  # session, symbol

    def __or__(self, other: Universe) -> Universe:
        return Universe(self.members.unionByName(other.members).distinct())

    def __and__(self, other: Universe) -> Universe:
        return Universe(self.members.intersect(other.members.select(*self.members.columns)))

    def __sub__(self, other: Universe) -> Universe:
        return Universe(self.members.subtract(other.members.select(*self.members.columns)))


def constant(symbols: Sequence[str], sessions: DataFrame) -> Universe:
    """The listed symbols at every session."""
    listed = F.explode(F.array(*(F.lit(s) for s in dict.fromkeys(symbols))))
    return Universe(sessions.select("session", listed.alias("symbol")))


def whole_life(bars: DataFrame, symbols: Sequence[str], sessions: DataFrame) -> Universe:
    """Each listed symbol from its first to its last bar."""
    span = (
        bars.where(F.col("symbol").isin(list(symbols)))
        .join(sessions, "session")
        .groupBy("symbol")
        .agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    )
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("pos"))
    return Universe(days.join(sessions, "pos").select("session", "symbol"))


def four_month_periods(sessions: DataFrame) -> DataFrame:
    """``period, effective_from, effective_to, base_pos`` of Jan/May/Sep periods.

    A period is in force from the first session of its first month to the
    session before the next period; its base is three sessions before.
    """
    start = F.make_date(F.year("session"), F.floor((F.month("session") - 1) / 4).cast("int") * 4 + 1, F.lit(1))
    per = sessions.groupBy(start.alias("_s")).agg(
        F.min("session").alias("effective_from"), F.max("session").alias("effective_to"), F.min("pos").alias("_p")
    )
    return per.select(
        F.date_format("_s", "yyyy-MM").alias("period"),
        "effective_from",
        "effective_to",
        (F.col("_p") - 3).alias("base_pos"),
    )


def assign_periods(sessions: DataFrame, periods: DataFrame) -> DataFrame:
    """``session, period``: the period in force.

    Periods follow each other, so the sessions of one are a range of
    positions; sessions are matched by a running last over their union.
    """
    starts = periods.select(F.col("effective_from").alias("session"), "period", "effective_to")
    marked = sessions.join(starts, "session", "left")
    w = Window.partitionBy(F.lit(1)).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.withColumns(
        {"period": F.last("period", True).over(w), "_to": F.last("effective_to", True).over(w)}
    )
    return filled.select("session", F.when(F.col("session") <= F.col("_to"), F.col("period")).alias("period"))


def liquid(
    daily: DataFrame, sessions: DataFrame, periods: DataFrame, *, min_presence: float, top: int, lookback: int | None = None, months: int | None = None
) -> DataFrame:
    """``period, symbol, rank, median_value, presence`` of the most liquid.

    For each period, over the ``lookback`` sessions up to its base (or those
    of the last ``months`` up to it): symbols present on at least
    ``min_presence`` of them, by the median of their daily values with absent
    sessions as zero, ties by symbol. ``daily`` has one value per (session,
    symbol). Periods whose window begins before the calendar are left out. The
    values of a symbol and window are an array no longer than the window.
    """
    if (lookback is None) == (months is None):
        raise ValueError("give the lookback in sessions or in months")
    days = daily.where("traded_value > 0").join(sessions, "session").select("symbol", "pos", "traded_value")
    if lookback is not None:
        bounds = periods.where(F.col("base_pos") >= lookback - 1).select("period", (F.col("base_pos") - lookback + 1).alias("_from"), "base_pos")
    else:
        bounds = _months_back(periods, sessions, months)
    bounds = bounds.withColumn("_size", F.col("base_pos") - F.col("_from") + 1)
    windows = bounds.select("period", "_size", F.explode(F.sequence("_from", "base_pos")).alias("pos"))
    packed = days.join(windows, "pos").groupBy("period", "_size", "symbol").agg(F.sort_array(F.collect_list("traded_value")).alias("_v"))
    padded = F.concat(F.array_repeat(F.lit(0.0), F.col("_size") - F.size("_v")), F.col("_v"))
    low, high = ((F.col("_size") - 1) / 2).cast("int"), (F.col("_size") / 2).cast("int")
    scored = packed.select(
        "period",
        "symbol",
        (F.size("_v") / F.col("_size").cast("double")).alias("presence"),
        ((F.get(padded, low) + F.get(padded, high)) / F.lit(2.0)).alias("median_value"),
    ).where(F.col("presence") >= min_presence)
    order = Window.partitionBy("period").orderBy(F.col("median_value").desc(), "symbol")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _months_back(periods: DataFrame, sessions: DataFrame, months: int) -> DataFrame:
    """``period, _from, base_pos``: the sessions after the base's day so many months before."""
    first = F.min("session").over(Window.partitionBy(F.lit(1)))
    calendar = sessions.select(F.col("pos").alias("base_pos"), F.col("session").alias("_base"), first.alias("_first"))
    since = F.add_months("_base", -months)
    begun = periods.select("period", "base_pos").join(calendar, "base_pos").where(F.col("_first") <= since)
    near = session_near(begun.withColumn("_day", F.date_add(since, 1)), sessions, "_day", "forward", "_start")
    return near.join(sessions.select(F.col("session").alias("_start"), F.col("pos").alias("_from")), "_start").select("period", "_from", "base_pos")


def members_of(selected: DataFrame, sessions: DataFrame, periods: DataFrame) -> Universe:
    """The members of the period in force at each session."""
    labelled = assign_periods(sessions, periods)
    return Universe(labelled.join(selected.select("period", "symbol").distinct(), "period").select("session", "symbol"))


def exits(selected: DataFrame, bars: DataFrame, periods: DataFrame) -> DataFrame:
    """Members whose last bar lies before their period's end."""
    last = bars.groupBy("symbol").agg(F.max("session").alias("last_session"))
    return (
        selected.select("period", "symbol")
        .join(periods.select("period", "effective_from", "effective_to"), "period")
        .join(last, "symbol")
        .where(F.col("last_session") < F.col("effective_to"))
        .select("period", "symbol", "effective_to", "last_session")
    )


def fill_gaps(selected: DataFrame, ranked: DataFrame, periods: DataFrame) -> DataFrame:
    """``period, symbol, filled``: compositions, and ranked names where there are none.

    A period without a composition takes as many of its best ranked names as
    the nearest period with one has members (the earlier one on a tie).
    """
    sizes = selected.groupBy("period").agg(F.count_distinct("symbol").alias("_size"))
    w = Window.partitionBy(F.lit(1)).orderBy("effective_from")
    numbered = periods.select("period", F.row_number().over(w).alias("_i")).join(sizes, "period", "left")
    order = Window.partitionBy(F.lit(1)).orderBy("_i")
    near = numbered.withColumns(
        {
            side: F.last(F.when(F.col("_size").isNotNull(), F.struct("_i", "_size")), True).over(spec)
            for side, spec in (("_b", order.rowsBetween(Window.unboundedPreceding, 0)), ("_a", Window.partitionBy(F.lit(1)).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)))
        }
    )
    closer = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a._i") - F.col("_i") < F.col("_i") - F.col("_b._i")))
    need = near.where("_size IS NULL").select("period", F.when(closer, F.col("_a._size")).otherwise(F.col("_b._size")).alias("_need"))
    filled = ranked.join(need, "period").where("rank <= _need").select("period", "symbol", F.lit(True).alias("filled"))
    return selected.select("period", "symbol", F.lit(False).alias("filled")).distinct().unionByName(filled)


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """``period, share``: the part of the left members that the right has too."""
    both = left.select("period", "symbol").distinct().join(right.select("period", "symbol").distinct().withColumn("_in", F.lit(1)), ["period", "symbol"], "left")
    return both.groupBy("period").agg((F.count("_in") / F.count("*")).alias("share"))


def resolved(members: DataFrame, spans: DataFrame, label: str, at: str, entity: str) -> DataFrame:
    """``members`` with the one entity that has the label in force at a day.

    Null if there is none or several. Spans of a label are few; both sides
    meet on it.
    """
    held = spans.select(F.col(label), F.col(entity).alias("_e"), "first_session", "last_session")
    met = members.select(label, at).distinct().join(held, label).where(
        (F.col(at) >= F.col("first_session")) & (F.col("last_session").isNull() | (F.col(at) <= F.col("last_session")))
    )
    sole = met.groupBy(label, at).agg(F.min("_e").alias("_least"), F.max("_e").alias("_most"))
    sole = sole.select(label, at, F.when(F.col("_least") == F.col("_most"), F.col("_least")).alias(entity))
    return members.join(sole, [label, at], "left")


def with_nearest_event(left: DataFrame, events: DataFrame, at: str = "last_session", day: str = "day", event: str = "event", within: int = 31) -> DataFrame:
    """``left`` (symbol, day) with the event of its symbol nearest in time.

    The one before and the one after are two as-of matches; the nearer counts,
    the smaller on a tie, if it is at most ``within`` days off. Of events of
    one day the smallest counts.
    """
    from tidemark.operators.joins import asof

    one = events.groupBy("symbol", day).agg(F.min(event).alias(event))
    before = one.select("symbol", F.col(day).alias("_d0"), F.col(day).alias("_b"), F.col(event).alias("_eb"))
    after = one.select("symbol", F.col(day).alias("_d1"), F.col(day).alias("_a"), F.col(event).alias("_ea"))
    met = asof(left, before, "symbol", (at, "_d0"), ["_b", "_eb"], within_days=within)
    met = asof(met, after, "symbol", (at, "_d1"), ["_a", "_ea"], direction="forward", within_days=within)
    ahead, behind = F.struct(F.datediff("_a", at).alias("d"), F.col("_ea").alias("e")), F.struct(F.datediff(at, "_b").alias("d"), F.col("_eb").alias("e"))
    later = F.col("_a").isNotNull() & (F.col("_b").isNull() | (ahead < behind))
    return met.withColumn(event, F.when(later, F.col("_ea")).otherwise(F.col("_eb"))).drop("_a", "_b", "_ea", "_eb")


def one_file_each(members: DataFrame, by: Sequence[str] = ("index", "period", "source"), file: str = "source_file", member: str = "ticker") -> DataFrame:
    """Members of the first file of each (index, period, source).

    Files of one kind must list the same members, else reading them is an
    error: their member sets are compared by count and digest, not gathered.
    """
    keys = list(by)
    told = members.select(*keys, file, member).distinct().groupBy(*keys, file).agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64(member)).alias("_g"))
    per = told.groupBy(*keys).agg(F.min(file).alias("_file"), F.count_distinct("_n", "_g").alias("_kinds"))
    alike = F.when(F.col("_kinds") > 1, F.raise_error(F.concat(F.lit("files list different members: "), F.concat_ws(", ", *keys))).cast("string")).otherwise(F.col("_file"))
    return members.join(per.select(*keys, alike.alias(file)), [*keys, file], "left_semi")


def build_universe(
    members: DataFrame, periods: DataFrame, spans: DataFrame, ranked: DataFrame | None, bars: DataFrame, events: DataFrame | None, *, fill_index: str, rank: Column
) -> dict[str, DataFrame]:
    """The tables of a universe from the members that all sources list.

    ``members``: ``index, period, source, source_file, ticker, base_session``;
    ``rank`` tells which source is better. One file of each kind counts, the
    best source of each composition, and each ticker becomes the one security
    that carried it on the base session, or else when the period began.
    Periods of ``fill_index`` without a composition are filled from
    ``ranked`` (``period, symbol, rank``). Returns ``constituents`` (``index,
    period, ticker, symbol, source``), ``periods`` and ``exits``; both are
    computed and checkpointed when this is called.
    """
    from tidemark.operators.matching import best_source

    chosen = best_source(one_file_each(members), ["index", "period"], rank)
    held = chosen.join(periods.select("period", "effective_from"), "period")
    first = resolved(held, spans, "ticker", "base_session", "symbol").withColumnRenamed("symbol", "_one")
    both = resolved(first, spans, "ticker", "effective_from", "symbol")
    found = both.select("index", "period", "ticker", F.coalesce("_one", "symbol").alias("symbol"), "source")
    if ranked is not None:
        own = found.where(F.col("index") == fill_index).select("period", F.coalesce("symbol", "ticker").alias("symbol"))
        filled = fill_gaps(own, ranked, periods).where("filled").select(
            F.lit(fill_index).alias("index"), "period", F.lit("").alias("ticker"), "symbol", F.lit("liquidity_rule").alias("source")
        )
        found = found.unionByName(filled)
    found = cut_lineage(found)
    gone = exits(found.where("symbol IS NOT NULL"), bars, periods).distinct()
    gone = found.select("index", "period", "symbol", "ticker").join(gone, ["period", "symbol"])
    if events is not None:
        gone = with_nearest_event(gone, events)
    gone = cut_lineage(gone)
    return {"constituents": found, "periods": periods, "exits": gone}


def absent_at_start(constituents: DataFrame, periods: DataFrame, bars: DataFrame, gone: DataFrame) -> DataFrame:
    """``index, period, ticker`` of members without a bar when the period began that are no exits."""
    held = constituents.where("symbol IS NOT NULL").join(periods.select("period", F.col("effective_from").alias("session")), "period")
    traded = bars.select("symbol", "session").distinct()
    return held.join(traded, ["symbol", "session"], "left_anti").join(gone.select("index", "period", "symbol"), ["index", "period", "symbol"], "left_anti").select("index", "period", "ticker")
