"""Backtests: weights, the day-trade engine, and the position engine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import asof
from tidemark.session import cut_lineage, ship


def equal_weight(members: DataFrame) -> DataFrame:
    """``session, symbol, weight``: one over the number of members."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session"))
    return members.select("session", "symbol", (F.lit(1.0) / n).alias("weight"))


def day_trades(bars: DataFrame, orders: DataFrame, sessions: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """Trades of one session each, filled at the session after the decision.

    ``orders``: ``decision, symbol, size, buy_limit, sell_limit, side,
    buy_stop, sell_stop`` (all but the first three may be null). A buy limit
    fills if the low is below it, at the better of open and limit; a sell
    limit mirrors that; ``side`` (1 or -1) enters at the open. A long is
    stopped if the low reaches ``sell_stop``, at the worse of open and stop; a
    short mirrors that with ``buy_stop``; otherwise it is closed at the close.
    Fees are ``cost_bps`` of entry and exit. A session without a complete bar
    has no trade. Result: ``session, symbol, leg, size, entry, exit, stopped,
    gross, net, pnl``. A projection after two equi-joins; both legs of an
    order come from one pass.
    """
    day = sessions.select(F.col("session").alias("decision"), (F.col("pos") + 1).alias("pos"))
    placed = orders.where(F.col("size") > 0).join(day, "decision").join(sessions, "pos").drop("pos")
    whole = bars.select("session", "symbol", "open", "high", "low", "close").na.drop()
    met = placed.join(whole, ["session", "symbol"])
    long_at = F.when(F.col("side") == 1, F.col("open")).when(F.col("low") < F.col("buy_limit"), F.least("open", "buy_limit"))
    short_at = F.when(F.col("side") == -1, F.col("open")).when(F.col("high") > F.col("sell_limit"), F.greatest("open", "sell_limit"))
    long_stop = F.coalesce(F.col("low") <= F.col("sell_stop"), F.lit(False))
    short_stop = F.coalesce(F.col("high") >= F.col("buy_stop"), F.lit(False))

    def leg(name: str, entry: Column, stopped: Column, stop: Column) -> Column:
        return F.when(
            entry.isNotNull(),
            F.struct(
                F.lit(name).alias("leg"),
                entry.alias("entry"),
                F.when(stopped, stop).otherwise(F.col("close")).alias("exit"),
                stopped.alias("stopped"),
            ),
        )

    legs = F.array_compact(
        F.array(
            leg("long", long_at, long_stop, F.least("open", "sell_stop")),
            leg("short", short_at, short_stop, F.greatest("open", "buy_stop")),
        )
    )
    rows = met.select("session", "symbol", "size", F.inline(legs))
    move = F.col("exit") / F.col("entry")
    gross = F.when(F.col("leg") == "long", move - 1).otherwise(1 - move)
    cost = cost_bps / 10_000
    return (
        rows.withColumn("gross", gross)
        .withColumn("net", F.col("gross") - F.lit(cost) * (1 + move))
        .withColumn("pnl", F.col("size") * F.col("net"))
        .select("session", "symbol", "leg", "size", "entry", "exit", "stopped", "gross", "net", "pnl")
    )


def _asked_prices(asked: DataFrame, prices: DataFrame, execution: str) -> DataFrame:
    """``asked`` (.., symbol, pos) with ``p``, the price a trade of that session has.

    At the close: the last one up to the session. At the open: the session's
    own, or else the last close before it.
    """
    closes = prices.select("symbol", F.col("pos").alias("_at"), F.col("close").alias("p"))
    if execution == "close":
        return asof(asked, closes, "symbol", ("pos", "_at"), ["p"], slice_width=None)
    met = asof(asked.withColumn("_before", F.col("pos") - 1), closes, "symbol", ("_before", "_at"), ["p"], slice_width=None)
    opens = prices.where("open IS NOT NULL").select("symbol", "pos", F.col("open").alias("_o"))
    return met.join(opens, ["symbol", "pos"], "left").withColumn("p", F.coalesce("_o", "p")).drop("_o", "_before")


def simulate_weights(bars: DataFrame, weights: DataFrame, sessions: DataFrame, by: str = "portfolio", cost_bps: float = 0.0, execution: str = "close") -> DataFrame:
    """``portfolio, session, equity, r, cost, gross, net``: target weights held with drift.

    ``weights``: ``portfolio, decision, symbol, weight``; a decision is
    executed at the close of the next session (or, with ``execution="open"``,
    at its open, so that the way from the close before to the open belongs to
    the old positions), and positions drift until the next one. A symbol
    without a price then trades at its last close; one past its last bar is
    paid out at its last close, free, and may not be a target again; a target
    before the first price is an error. Costs are ``cost_bps`` of the traded
    share of equity; ``gross`` and ``net`` are the exposures at the close.
    There is a row for every session from a portfolio's first decision on.

    Only what follows from itself runs in order: from rebalance to rebalance a
    portfolio's value gives its new positions, on the prices of those sessions
    alone, in a stream of one portfolio's rebalances after the other. Between
    them positions stand still, so the worth of all sessions is one join of
    positions and filled prices by symbol and session, and one aggregation.
    """
    if execution not in ("close", "open"):
        raise ValueError(f"execution is at the close or the open, not {execution!r}")
    spark = bars.sparkSession
    ship(spark)
    end = sessions.agg(F.max("pos")).first()[0]
    opens = F.col("open").cast("double") if execution == "open" else F.lit(None).cast("double")
    held = weights.select("symbol").distinct()
    prices = (
        bars.select("session", "symbol", "close", opens.alias("open"))
        .where("close IS NOT NULL")
        .join(held, "symbol", "left_semi")
        .join(sessions, "session")
        .select("symbol", "pos", "close", "open")
    )
    day = sessions.select(F.col("session").alias("decision"), (F.col("pos") + 1).alias("pos"))
    plan = (
        weights.join(day, "decision")
        .where(F.col("pos") <= F.lit(end))
        .groupBy(by, "pos", "symbol")
        .agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    )
    # What a rebalance needs: its targets, and what the one before it left.
    turns = plan.select(by, "pos").distinct().withColumn("_next", F.lead("pos").over(Window.partitionBy(by).orderBy("pos")))
    left = plan.join(turns, [by, "pos"]).where("_next IS NOT NULL").select(by, F.col("_next").alias("pos"), "symbol")
    asked = plan.unionByName(left, allowMissingColumns=True).groupBy(by, "pos", "symbol").agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("w"))
    asked = _asked_prices(asked, prices, execution)
    life = prices.groupBy("symbol").agg(F.max("pos").alias("last"))
    asked = asked.join(life, "symbol", "left").select(
        F.col(by).cast("string").alias("k"), F.col("pos").cast("int").alias("pos"), "symbol", F.col("w").cast("double").alias("w"), "p", (F.coalesce("last", F.lit(-1)) < F.col("pos")).alias("gone")
    )
    ordered = asked.repartition("k").sortWithinPartitions("k", "pos", "symbol")
    taken = cut_lineage(ordered.mapInArrow(_rebalancer(cost_bps), "k string, pos int, symbol string, amount double, paid double"))

    # A row without symbol is the cash; each row stands until the next rebalance.
    ends = turns.select(F.col(by).cast("string").alias("k"), "pos", F.coalesce(F.col("_next") - 1, F.lit(end)).alias("_to"))
    standing = taken.join(ends, ["k", "pos"]).select("k", "symbol", "amount", "paid", F.col("pos").alias("_turn"), F.explode(F.sequence("pos", "_to")).alias("pos"))
    known = Window.partitionBy("symbol").orderBy("pos")
    upto = F.greatest(F.coalesce(F.lead("pos").over(known) - 1, F.lit(end)), F.col("pos"))
    filled = prices.withColumns({"_upto": upto, "last": F.max("pos").over(Window.partitionBy("symbol"))})
    filled = filled.select("symbol", "close", "last", F.explode(F.sequence("pos", "_upto")).alias("pos"))
    worth = standing.where("symbol IS NOT NULL").join(filled, ["symbol", "pos"]).select(
        "k", "pos", (F.col("amount") * F.col("close")).alias("worth"), (F.col("pos") <= F.col("last")).alias("live"), F.lit(None).cast("double").alias("paid")
    )
    cash = standing.where("symbol IS NULL").select(
        "k", "pos", F.col("amount").alias("worth"), F.lit(False).alias("live"), F.when(F.col("pos") == F.col("_turn"), F.col("paid")).alias("paid")
    )
    begin = weights.groupBy(F.col(by).cast("string").alias("k")).agg(F.min("decision").alias("session")).join(sessions, "session").select("k", F.col("pos").alias("_a"))
    first = turns.groupBy(F.col(by).cast("string").alias("k")).agg(F.min("pos").alias("_b"))
    waiting = begin.join(first, "k", "left").select("k", F.explode(F.sequence("_a", F.greatest(F.coalesce(F.col("_b") - 1, F.lit(end)), F.col("_a")))).alias("pos"))
    waiting = waiting.withColumns({"worth": F.lit(1.0), "live": F.lit(False), "paid": F.lit(None).cast("double")})
    live = F.when(F.col("live"), F.col("worth"))
    daily = worth.unionByName(cash).unionByName(waiting).groupBy("k", "pos").agg(
        F.sum("worth").alias("equity"), F.coalesce(F.sum("paid"), F.lit(0.0)).alias("paid"), F.coalesce(F.sum(F.abs(live)), F.lit(0.0)).alias("_gross"), F.coalesce(F.sum(live), F.lit(0.0)).alias("_net")
    )
    before = F.coalesce(F.lag("equity").over(Window.partitionBy("k").orderBy("pos")), F.lit(1.0))
    equity = F.col("equity")
    return daily.withColumn("_before", before).join(sessions, "pos").select(
        F.col("k").alias(by),
        "session",
        "equity",
        (F.try_divide(equity, F.col("_before")) - 1).alias("r"),
        F.try_divide(F.col("paid"), F.col("_before")).alias("cost"),
        F.try_divide(F.col("_gross"), equity).alias("gross"),
        F.try_divide(F.col("_net"), equity).alias("net"),
    )


class _Portfolio:
    """Units and cash of one portfolio after each of its rebalances."""

    def __init__(self, name: str, cost: float) -> None:
        self.name, self.cost, self.cash = name, cost, 1.0
        self.units: dict[str, float] = {}

    def rebalance(self, pos: int, symbols: list[str], want: np.ndarray, price: np.ndarray, gone: np.ndarray) -> list[tuple]:
        have = np.array([self.units.get(s, 0.0) for s in symbols])
        priced = np.nan_to_num(price)
        # What has left the market has been paid out at its last close.
        self.cash += float((have * priced)[gone].sum())
        have, want = np.where(gone, 0.0, have), np.where(gone, 0.0, want)
        if (np.isnan(price) & (want != 0)).any():
            raise ValueError(f"{self.name} has a target before a first price at position {pos}")
        value = self.cash + float((have * priced).sum())
        paid = self.cost * float(np.abs(want - have * priced / value).sum()) * value
        units = np.divide(want * value, priced, out=np.zeros(len(want)), where=want != 0)
        self.cash = value - float((units * priced).sum()) - paid
        self.units = {s: u for s, u in zip(symbols, units, strict=True) if u}
        return [(self.name, pos, None, self.cash, paid), *((self.name, pos, s, u, None) for s, u in self.units.items())]


def _rebalancer(cost_bps: float):
    """Follows portfolios through their rebalances, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Portfolio | None = None
        key: tuple | None = None
        open_: list[tuple] = []

        def close() -> list[tuple]:
            nonlocal current
            if key is None:
                return []
            if current is None or current.name != key[0]:
                current = _Portfolio(key[0], cost_bps / 10_000)
            symbols, want, price, gone = zip(*open_, strict=True)
            prices = np.array([np.nan if p is None else p for p in price], dtype=float)
            return current.rebalance(key[1], list(symbols), np.array(want, dtype=float), prices, np.array(gone, dtype=bool))

        for batch in batches:
            out: list[tuple] = []
            for k, pos, symbol, w, p, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, pos) != key:
                    out += close()
                    key, open_ = (k, pos), []
                open_.append((symbol, w, p, gone))
            if out:
                yield _table(out)
        if out := close():
            yield _table(out)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"k": pa.string(), "pos": pa.int32(), "symbol": pa.string(), "amount": pa.float64(), "paid": pa.float64()}
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def testable_span(sessions: DataFrame, train_months: int) -> tuple[str, str]:
    """First and last day that can be tested: the training months lie before the first."""
    first, last = sessions.agg(F.add_months(F.trunc(F.min("session"), "MM"), train_months), F.max("session")).first()
    if first is None or first > last:
        raise ValueError(f"no session follows {train_months} months of training")
    return str(first), str(last)


def walk_forward(sessions: DataFrame, start: str, end: str, train_months: int, test_months: int, step_months: int | None = None, expanding: bool = False) -> DataFrame:
    """Windows by months: ``window, train_start, train_end, test_start, test_end, decision_start, decision_end``.

    Decisions run from the last training session to the session before the
    last test session, since each is executed a session later. Windows whose
    test months hold no session are skipped; training before the calendar is
    an error.
    """
    step = step_months or test_months
    spark = sessions.sparkSession
    first = sessions.agg(F.min("session")).first()[0]
    base = spark.range(1).select(
        F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {step} month)")).alias("t0")
    )
    spans = base.select(
        "t0",
        F.add_months("t0", test_months).alias("t1"),
        (F.lit(start).cast("date") if expanding else F.col("t0")).alias("_t"),
    ).select("t0", F.least("t1", F.date_add(F.lit(end).cast("date"), 1)).alias("t1"), F.add_months("_t", -train_months).alias("r0"))
    lowest = spans.agg(F.min("r0")).first()[0]
    if first is not None and lowest is not None and lowest < first.replace(day=1):
        raise ValueError(f"training from {lowest} begins before the calendar, {first}")
    # A window's sessions are found month by month, not by comparing all.
    months = spans.select("t0", "t1", "r0", F.explode(F.expr("sequence(trunc(r0, 'MM'), trunc(t1, 'MM'), interval 1 month)")).alias("m"))
    days = sessions.withColumn("m", F.trunc("session", "MM"))
    met = months.join(days, "m").where((F.col("session") >= F.col("r0")) & (F.col("session") < F.col("t1")))
    train, test = F.col("session") < F.col("t0"), F.col("session") >= F.col("t0")
    found = met.groupBy("t0").agg(
        F.min(F.when(train, F.col("session"))).alias("train_start"),
        F.max(F.when(train, F.col("session"))).alias("train_end"),
        F.min(F.when(test, F.col("session"))).alias("test_start"),
        F.max(F.when(test, F.col("session"))).alias("test_end"),
        F.max(F.when(test, F.col("pos"))).alias("_p"),
    )
    before = sessions.select((F.col("pos") + 1).alias("_p"), F.col("session").alias("decision_end"))
    return (
        found.where("test_start IS NOT NULL")
        .join(before, "_p", "left")
        .select(
            F.date_format("t0", "yyyy-MM").alias("window"),
            "train_start",
            "train_end",
            "test_start",
            "test_end",
            F.col("train_end").alias("decision_start"),
            "decision_end",
        )
    )


__all__ = ["day_trades", "equal_weight", "simulate_weights", "walk_forward"]
