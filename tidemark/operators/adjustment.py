"""Anchored adjustment of series by the events that follow each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import asof


#: Events that an adjusted series removes: none, those of shares, or all.
MODES = ("raw", "splits", "total_return")

PRICES = ("open", "high", "low", "close")


def factor_intervals(factors: DataFrame, by: str, ex: str, factor: str | Sequence[str], anchor: str | None = None) -> DataFrame:
    """``by, from_, upto, product``: what a row dated in [from_, upto) is multiplied by.

    ``product`` is that of all factors from ``upto`` (the next ex-date) on, as
    far as ``anchor``; factors of one day multiply. A suffix product over the
    events, so its size is that of the events. Several factors have their
    products beside each other, as ``product_{factor}``.
    """
    several = not isinstance(factor, str)
    names = {f: f"product_{f}" if several else "product" for f in (factor if several else [factor])}
    used = factors.where(F.col(ex) <= F.lit(anchor).cast("date")) if anchor else factors
    used = used.where(F.col(by).isNotNull() & F.col(ex).isNotNull())
    per_day = used.groupBy(by, ex).agg(*(F.product(f).alias(f"_f{i}") for i, f in enumerate(names)))
    w = Window.partitionBy(by).orderBy(ex)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    return per_day.select(
        by, F.lag(ex).over(w).alias("from_"), F.col(ex).alias("upto"), *(F.product(f"_f{i}").over(after).alias(n) for i, n in enumerate(names.values()))
    )


def adjusted(
    bars: DataFrame,
    factors: DataFrame,
    by: str = "symbol",
    at: str = "session",
    ex: str = "ex_date",
    factor: str | Sequence[str] = "factor",
    anchor: str | None = None,
) -> DataFrame:
    """``bars`` with ``adjustment``: the product of the factors ex after each row.

    Rows without a later event have 1. The interval that holds a row is the
    one with the next ``upto`` after its day: a forward as-of match, without
    pairs. Several factors give ``adjustment_{factor}`` each.
    """
    steps = factor_intervals(factors, by, ex, factor, anchor)
    names = {c: "adjustment" + c.removeprefix("product") for c in steps.columns if c.startswith("product")}
    ahead = steps.select(by, F.date_sub("upto", 1).alias("_upto"), *(F.col(c).alias(n) for c, n in names.items()))
    met = asof(bars, ahead, by, (at, "_upto"), list(names.values()), direction="forward")
    return met.withColumns({n: F.coalesce(n, F.lit(1.0)) for n in names.values()})


def adjust(
    bars: DataFrame,
    factors: DataFrame,
    anchor: str | None = None,
    mode: str = "total_return",
    *,
    by: str = "symbol",
    at: str = "session",
    ex: str = "ex_date",
) -> DataFrame:
    """Prices and volume of ``bars`` relative to an anchor.

    Events with an ex-date up to ``anchor`` are applied to the bars before
    them: prices are multiplied by ``f_total`` (``f_splits`` in mode splits),
    ``volume`` by ``share_ratio``, so that price times volume stays what it
    was across a split. Mode raw gives the bars back. Of the price and volume
    columns those that are there are adjusted; others pass through.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    if mode == "raw":
        return bars
    price = "f_total" if mode == "total_return" else "f_splits"
    found = adjusted(bars, factors, by, at, ex, (price, "share_ratio"), anchor)
    moved = {c: F.col(c) * F.col(f"adjustment_{price}") for c in PRICES if c in bars.columns}
    if "volume" in bars.columns:
        moved["volume"] = F.col("volume") * F.col("adjustment_share_ratio")
    return found.withColumns(moved).select(*bars.columns)


def drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, old, new`` of the keys whose value changed between two builds."""
    joined = before.select(key, F.col(value).alias("old")).join(after.select(key, F.col(value).alias("new")), key)
    return joined.where(~F.col("old").eqNullSafe(F.col("new")))
