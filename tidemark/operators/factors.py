"""Adjustment factors of ex-sessions from the events placed on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.common import missing_as_null
from tidemark.operators.joins import asof

#: What an event does to a holding (the kinds callers map their types to).
CASH, SHARES, RIGHTS, SPIN_OFF, CHAIN = "cash", "shares", "rights", "spin_off", "chain"


def target_closes(bars: DataFrame, targets: DataFrame, sessions: DataFrame, *, by: str = "isin", at: str = "session", lookahead: int = 5) -> DataFrame:
    """``by, at, close, earliest_ex`` of the targets' bars.

    ``earliest_ex`` is the session ``lookahead`` before the bar's (the first
    there is, if that is nearer): the earliest ex-session the close may price.
    ``targets`` holds the wanted ``by``; ``sessions`` are ``session, pos``.
    """
    rows = bars.select(by, at, "close").where(F.col("close").isNotNull()).join(targets.select(by).distinct(), by, "left_semi")
    here = sessions.select(F.col("session").alias(at), F.greatest(F.col("pos") - lookahead, F.lit(0)).alias("_p"))
    there = sessions.select(F.col("pos").alias("_p"), F.col("session").alias("earliest_ex"))
    return rows.join(here.join(there, "_p"), at).select(by, at, "close", "earliest_ex")


def event_factors(events: DataFrame, previous: DataFrame, kinds: Mapping[str, str], closes: DataFrame | None = None) -> DataFrame:
    """One row for each (security, ex-session) with events: its factors, or why it has none.

    ``events``: ``event_id, security_id, isin, ex_session, event_type,
    cash_amount, share_ratio, subscription_price, value_fraction,
    target_isin, target_security``; those without ex-session, and types not
    in ``kinds``, take no part (see :func:`ignored`). ``previous``: ``isin,
    session, close``, the close before each ex-session; ``closes``: what
    :func:`target_closes` returns.

    A paid amount counts as it is. Rights of ratio r at price s are worth
    ``r * max(close - s, 0) / (1 + r)``. A spin-off is worth its published
    fraction of the close, or else its ratio times the target's first close
    from the ex-session on that may still price it. Share events, and chains
    that stay within their security, multiply the number of shares.

    Result: ``security_id, isin, ex_date, previous_close, cash_value,
    share_ratio, f_total, f_splits, event_ids, reason`` with ``f_total = (1 -
    cash / close) / ratio`` and ``f_splits = 1 / ratio``, or a ``reason``
    (no_previous_close, no_target_price, value_exceeds_price) and no factors.
    Repeated events count once; missing or NaN amounts are worth nothing, a
    ratio that is missing or not above zero is one; ``event_ids`` come sorted.
    """
    kind = _kind(kinds)
    rows = events.dropDuplicates(["event_id"]).where("ex_session IS NOT NULL AND security_id IS NOT NULL").withColumn("_kind", kind)
    rows = rows.where(F.col("_kind").isin(CASH, SHARES, RIGHTS, SPIN_OFF) | _chained())
    before = previous.groupBy(F.col("isin"), F.col("session").alias("ex_session")).agg(F.max(missing_as_null("close")).alias("_p"))
    rows = rows.join(before, ["isin", "ex_session"], "left")
    amount = {c: missing_as_null(c) for c in ("cash_amount", "subscription_price", "value_fraction")}
    amount["share_ratio"] = F.when(F.col("share_ratio") > 0, missing_as_null("share_ratio"))
    rows = rows.withColumns(amount)
    if closes is None:
        rows = rows.withColumn("_target", F.lit(None).cast("double"))
    else:
        rows = _with_target(rows, closes)
    p, ratio = F.col("_p"), F.col("share_ratio")
    rights = ratio * F.greatest(p - F.col("subscription_price"), F.lit(0.0)) / (1 + ratio)
    worth = (
        F.when(F.col("_kind") == CASH, F.col("cash_amount"))
        .when(F.col("_kind") == RIGHTS, F.when(F.col("subscription_price").isNotNull(), rights))
        .when(F.col("_kind") == SPIN_OFF, F.coalesce(F.col("value_fraction") * p, ratio * F.col("_target")))
    )
    shares = F.when(F.col("_kind").isin(SHARES, CHAIN), F.coalesce(ratio, F.lit(1.0))).otherwise(F.lit(1.0))
    rows = rows.withColumns({"_worth": worth, "_shares": shares})
    lacking = (F.col("_kind") == SPIN_OFF) & F.col("_worth").isNull()
    found = rows.groupBy("security_id", F.col("ex_session").alias("ex_date")).agg(
        F.min("isin").alias("isin"),
        F.max("_p").alias("previous_close"),
        F.coalesce(F.sum("_worth"), F.lit(0.0)).alias("cash_value"),
        F.product("_shares").alias("share_ratio"),
        F.bool_or(lacking).alias("_lacking"),
        F.concat_ws(",", F.sort_array(F.collect_set("event_id"))).alias("event_ids"),
    )
    reason = (
        F.when(F.col("previous_close").isNull(), "no_previous_close")
        .when(F.col("_lacking"), "no_target_price")
        .when(F.col("cash_value") >= F.col("previous_close"), "value_exceeds_price")
    )
    kept = F.col("reason").isNull()
    return found.withColumn("reason", reason).select(
        "security_id",
        "isin",
        "ex_date",
        "previous_close",
        "cash_value",
        "share_ratio",
        F.when(kept, (1 - F.try_divide(F.col("cash_value"), F.col("previous_close"))) / F.col("share_ratio")).alias("f_total"),
        F.when(kept, 1 / F.col("share_ratio")).alias("f_splits"),
        "event_ids",
        "reason",
    )


def ignored(events: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """``event_type, events``: placed events that never take a factor."""
    rows = events.dropDuplicates(["event_id"]).where("ex_session IS NOT NULL").withColumn("_kind", _kind(kinds))
    taken = F.coalesce(F.col("_kind").isin(CASH, SHARES, RIGHTS, SPIN_OFF) | _chained(), F.lit(False))
    return rows.where(~taken).groupBy("event_type").agg(F.count("*").alias("events"))


def _kind(kinds: Mapping[str, str]) -> Column:
    found: Column = F.lit(None).cast("string")
    for event_type, kind in kinds.items():
        found = F.when(F.col("event_type") == event_type, kind).otherwise(found)
    return found


def _chained() -> Column:
    return F.coalesce((F.col("_kind") == CHAIN) & (F.col("target_security") == F.col("security_id")), F.lit(False))


def _with_target(rows: DataFrame, closes: DataFrame) -> DataFrame:
    """Adds ``_target``: the first close of the target that may price the event."""
    names: Sequence[str] = [c for c in closes.columns if c not in ("close", "earliest_ex")]
    target, at = names[0], names[1]
    offered = closes.select(F.col(target).alias("target_isin"), F.col(at).alias("_at"), F.col("close").alias("_close"), F.col("earliest_ex").alias("_first"))
    spin = rows.where(F.col("_kind") == SPIN_OFF)
    met = asof(spin, offered, "target_isin", ("ex_session", "_at"), ["_close", "_first"], direction="forward")
    priced = met.withColumn("_target", F.when(F.col("_first") <= F.col("ex_session"), F.col("_close"))).drop("_close", "_first")
    rest = rows.where(F.col("_kind") != SPIN_OFF).withColumn("_target", F.lit(None).cast("double"))
    return priced.unionByName(rest)
