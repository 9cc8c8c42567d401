"""Hand-computed and looped checks of joins, panels, universes and backtests."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import analytics as A
from tidemark.functions import kernels as K
from tidemark.functions.identifiers import implied_factor, is_isin, snapped_ratio
from tidemark.operators import adjustment, backtest, calendar, joins, universe
from tidemark.operators.panel import Panel

D = dt.date(2024, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(day(i), i) for i in range(60)], "session date, pos int")


def test_gap_series(spark):
    prices = [30.0, 30.3, None, None, 31.5]
    df = spark.createDataFrame([("a", day(i), x) for i, x in enumerate(prices)], "symbol string, session date, close double")
    got = [r.v for r in df.withColumn("v", F.round(K.simple_returns("close"), 10)).orderBy("session").collect()]
    assert got == [None, 0.01, None, None, round(31.5 / 30.3 - 1, 10)]
    with pytest.raises(Exception, match="above zero"):
        df.withColumn("close", F.lit(-1.0)).select(K.log_returns("close")).collect()
    for bad in (lambda: K.lag("close", 0), lambda: K.rolling_std("close", 1), lambda: K.sma("close", True)):
        with pytest.raises(ValueError):
            bad()


def test_ranks_with_ties_and_mask(spark):
    rows = [("a", 1.0, True), ("b", 1.0, True), ("c", 3.0, True), ("d", 9.0, False), ("e", None, True)]
    df = spark.createDataFrame([(s, D, x, m) for s, x, m in rows], "symbol string, session date, x double, m boolean")
    got = {r.symbol: r.v for r in df.withColumn("v", K.cs_rank("x", "m")).collect()}
    assert got == {"a": 0.25, "b": 0.25, "c": 1.0, "d": None, "e": None}
    flat = df.withColumn("x", F.lit(2.0)).withColumn("v", K.cs_zscore("x"))
    assert all(r.v is None for r in flat.collect())


def test_total_loss_and_constant_series(spark):
    rows = [("loss", [0.1, -1.0, 0.5]), ("flat", [0.01] * 4), ("one", [0.02])]
    df = spark.createDataFrame([(s, day(i), r) for s, rs in rows for i, r in enumerate(rs)], "series string, session date, r double")
    got = {r.series: r for r in A.performance(df).collect()}
    assert got["loss"].total_return == -1.0 and got["loss"].max_drawdown == -1.0 and got["loss"].cagr == -1.0
    assert got["flat"].standard_deviation == 0.0 and got["flat"].sharpe_ratio is None and got["flat"].skewness is None
    assert got["one"].standard_deviation is None and got["one"].kurtosis is None
    eps = A.drawdown_periods(df).collect()
    assert [(e.series, e.peak, e.trough, e.recovery, e.depth) for e in eps] == [("loss", day(0), day(1), None, -1.0)]


def test_zero_trade_breaks_a_streak(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate([1.0, 1.0, 0.0, 1.0, -1.0, -1.0, -2.0])], "series string, seq bigint, result double")
    r = A.trade_metrics(df).first()
    assert (r.max_consecutive_wins, r.max_consecutive_losses, r.trade_count) == (2, 3, 7)
    assert r.profit_factor == 0.75


def test_trade_timing(spark, sessions):
    trades = spark.createDataFrame([("s", day(0), day(2)), ("s", day(1), day(4)), ("s", day(10), day(10))], "series string, entry date, exit date")
    r = A.trade_timing(trades, sessions).first()
    assert (r.trade_frequency, r.exposure) == (3 / 60, 6 / 60) and abs(r.average_holding_period - 8 / 3) < 1e-12
    late = spark.createDataFrame([("s", day(0), day(99))], "series string, entry date, exit date")
    with pytest.raises(Exception, match="outside the sessions"):
        A.trade_timing(late, sessions).collect()


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", day(5)), (2, "a", day(4)), (3, None, day(5)), (4, "b", None), (5, "a", day(30))], "n int, k string, t date")
    right = spark.createDataFrame([("a", day(5), 50), ("a", day(1), 10), (None, day(1), 99)], "k string, u date, v int")
    back = {r.n: r.v for r in joins.asof(left, right, "k", ("t", "u"), ["v"], within_days=10).collect()}
    assert back == {1: 50, 2: 10, 3: None, 4: None, 5: None}
    ahead = {r.n: r.v for r in joins.asof(left, right, "k", ("t", "u"), ["v"], direction="forward").collect()}
    assert ahead == {1: 50, 2: 50, 3: None, 4: None, 5: None}


@pytest.mark.parametrize("width", [None, 1, 3, 1461])
def test_asof_in_stretches_equals_a_loop(spark, width):
    rng = random.Random(4)
    lefts = [(n, rng.choice(["a", "b", None]), None if rng.random() < 0.1 else rng.randint(0, 60)) for n in range(200)]
    rights = {(rng.choice("ab"), rng.randint(0, 60)): i for i in range(25)}
    left = spark.createDataFrame([(n, k, t, None if t is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * t)) for n, k, t in lefts], "n int, k string, i int, t timestamp")
    right = spark.createDataFrame([(k, t, dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * t), v) for (k, t), v in rights.items()], "k string, j int, u timestamp, v int")
    for at in (("i", "j"), ("t", "u")):
        for direction, pick in (("backward", max), ("forward", min)):
            got = {r.n: r.v for r in joins.asof(left, right, "k", at, ["v"], direction=direction, slice_width=width).collect()}
            for n, k, t in lefts:
                ok = [u for h, u in rights if h == k and t is not None and (u <= t if pick is max else u >= t)]
                assert got[n] == (rights[k, pick(ok)] if ok else None)


def test_multiset_union(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "x string") for t in ("aab", "abbb"))
    assert sorted(r.x for r in joins.multiset_union([a, b]).collect()) == list("aabbb")


def test_identifiers(spark):
    codes = {"BRPETRACNPR6": True, "BRPETRACNPR7": False, "US0378331005": True, "ACESACON": False, "us0378331005": True, "": False}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r.c: r.v for r in df.withColumn("v", is_isin("c")).collect()} == codes
    ratios = spark.createDataFrame([(x,) for x in (2.02, 0.098, 1.2, -1.0, 9.97, 1.0982)], "r double")
    got = ratios.select(implied_factor("r"), F.round(snapped_ratio("r"), 6)).collect()
    assert [r[0] for r in got] == [2.0, 0.1, None, None, 10.0, None]
    assert [r[1] for r in got] == [2.02, 0.098, 1.2, -1.0, 10.0, 1.1]


def test_adjusted_returns_do_not_depend_on_the_anchor(spark):
    bars = spark.createDataFrame([("a", day(i), 100.0 / (2 if i >= 5 else 1) / (4 if i >= 8 else 1)) for i in range(12)], "symbol string, session date, close double")
    factors = spark.createDataFrame([("a", day(5), 0.5), ("a", day(8), 0.5), ("a", day(8), 0.5)], "symbol string, ex_date date, factor double")
    for anchor, level in ((None, 12.5), (str(day(6)), None)):
        rows = adjustment.adjusted(bars, factors, anchor=anchor).orderBy("session").collect()
        adjusted = [r.close * r.adjustment for r in rows]
        if level:
            assert adjusted == [level] * 12
        else:
            assert adjusted == [50.0] * 8 + [12.5] * 4


def test_panel(spark, sessions):
    bars = spark.createDataFrame([("b", day(1), 2.0, float("nan")), ("a", day(0), 1.0, 5.0)], "symbol string, session date, close double, volume double")
    p = Panel.from_bars(bars)
    assert p.fingerprint() == Panel.from_bars(bars.orderBy("session").select("volume", "close", "session", "symbol")).fingerprint()
    assert p.fingerprint() != Panel.from_bars(bars.withColumn("close", F.col("close") + 1)).fingerprint()
    assert p.field("volume").where("volume IS NULL").count() == 1
    wide = p.wide("close", ["a", "b"]).orderBy("session").collect()
    assert [(r.a, r.b) for r in wide] == [(1.0, None), (None, 2.0)]
    inside = p.with_universe(bars.where("symbol = 'a'")).rows
    assert {r.symbol: r.in_universe for r in inside.collect()} == {"a": True, "b": False}
    with pytest.raises(ValueError):
        Panel.from_bars(bars.union(bars))
    with pytest.raises(KeyError):
        p.field("open")


def test_align_and_offset(spark, sessions):
    bars = spark.createDataFrame([("a", day(2), 1.0), ("a", day(5), 2.0), ("a", day(99), 3.0)], "symbol string, session date, close double")
    got = sorted((r.session, r.close) for r in calendar.align(bars, sessions).collect())
    assert got == [(day(2), 1.0), (day(3), None), (day(4), None), (day(5), 2.0)]
    assert [r.session for r in calendar.off_calendar(bars, sessions).collect()] == [day(99)]
    asked = spark.createDataFrame([(day(3),), (day(1),), (day(99),)], "d date")
    assert {r.d: r.e for r in calendar.offset_sessions(asked, sessions, "d", 2, "e").collect()} == {day(3): day(1), day(1): day(0), day(99): None}
    assert calendar.valid_sessions(sessions, str(day(1)), str(day(3))).count() == 3


def test_universe_algebra(spark, sessions):
    few = sessions.where("pos < 2")
    a, b = universe.constant(["x", "y"], few), universe.constant(["y", "z"], few)
    assert [len((f(a, b)).members.collect()) for f in (lambda p, q: p | q, lambda p, q: p & q, lambda p, q: p - q)] == [6, 2, 2]


def test_day_trades_by_hand(spark, sessions):
    bars = spark.createDataFrame(
        [("a", day(1), 100.0, 105.0, 94.0, 103.0), ("b", day(1), 100.0, 112.0, 99.0, 110.0), ("c", day(1), 100.0, 101.0, None, 100.0)],
        "symbol string, session date, open double, high double, low double, close double",
    )
    o = "decision date, symbol string, size double, buy_limit double, sell_limit double, side int, buy_stop double, sell_stop double"
    orders = [
        (day(0), "a", 10.0, 98.0, None, None, None, 95.0),  # filled at 98, stopped at 95
        (day(0), "b", 10.0, None, 105.0, None, 111.0, None),  # short at 105, stopped at 111
        (day(0), "b", 5.0, None, None, 1, None, None),  # at the open, to the close
        (day(0), "a", 5.0, 94.0, None, None, None, None),  # the low only touches the limit
        (day(0), "c", 5.0, None, None, 1, None, None),  # no whole bar
    ]
    got = backtest.day_trades(bars, spark.createDataFrame(orders, o), sessions, cost_bps=10).collect()
    found = {(r.symbol, r.leg): r for r in got}
    assert len(got) == 3
    assert (found["a", "long"].entry, found["a", "long"].exit, found["a", "long"].stopped) == (98.0, 95.0, True)
    assert (found["b", "short"].entry, found["b", "short"].exit) == (105.0, 111.0)
    r = found["b", "long"]
    assert abs(r.gross - 0.1) < 1e-12 and abs(r.net - (0.1 - 0.001 * 2.1)) < 1e-12 and abs(r.pnl - 5 * r.net) < 1e-12


def loop(prices, opens, targets, days, cost):
    """Units and cash, one session after the other."""
    units, cash, equity, out = {}, 1.0, 1.0, []
    last = {s: max(p) for s, p in prices.items()}
    mark = {}
    for d in days:
        old = dict(mark)
        for s, p in prices.items():
            if d in p:
                mark[s] = p[d]
        for s in list(units):
            if d > last[s]:
                cash += units.pop(s) * mark[s]
        paid = 0.0
        if d in targets:
            at = {s: opens[s].get(d, old.get(s)) for s in prices} if opens else mark
            value = cash + sum(u * at[s] for s, u in units.items())
            want = {s: w for s, w in targets[d].items() if d <= last[s]}
            paid = cost * sum(abs(want.get(s, 0) - units.get(s, 0) * at[s] / value) for s in set(want) | set(units)) * value
            units = {s: w * value / at[s] for s, w in want.items()}
            cash = value * (1 - sum(want.values())) - paid
        value = cash + sum(u * mark[s] for s, u in units.items())
        out.append((value, value / equity - 1, paid / equity, sum(abs(u * mark[s]) for s, u in units.items()) / value))
        equity = value
    return out


@pytest.mark.parametrize("execution", ["close", "open"])
def test_simulated_weights_equal_a_loop(spark, sessions, execution):
    rng = random.Random(9)
    prices, opens = {}, {}
    for s in "abcd":
        p = 20.0
        prices[s], opens[s] = {}, {}
        for i in range(40 if s != "d" else 25):
            p *= 1 + rng.gauss(0, 0.03)
            if rng.random() > 0.1 or i < 3:
                prices[s][i] = p
                if rng.random() > 0.1:
                    opens[s][i] = p * (1 + rng.gauss(0, 0.01))
    decisions = {2: {"a": 0.5, "b": 0.4}, 9: {"b": 0.3, "c": -0.2, "d": 0.6}, 20: {"a": 0.25, "b": 0.25, "c": 0.25, "d": 0.25}, 30: {"a": 1.0}}
    bars = spark.createDataFrame(
        [(s, day(i), x, opens[s].get(i)) for s, p in prices.items() for i, x in p.items()], "symbol string, session date, close double, open double"
    )
    weights = spark.createDataFrame([("p", day(d), s, w) for d, t in decisions.items() for s, w in t.items()], "portfolio string, decision date, symbol string, weight double")
    got = backtest.simulate_weights(bars, weights, sessions, cost_bps=15, execution=execution).orderBy("session").collect()
    days = [(r.session - D).days for r in got]
    want = loop(prices, opens if execution == "open" else None, {d + 1: t for d, t in decisions.items()}, days, 0.0015)
    assert days[0] == 2
    for r, (e, x, c, g) in zip(got, want, strict=True):
        assert abs(r.equity - e) < 1e-12 and abs(r.r - x) < 1e-12 and abs(r.cost - c) < 1e-12 and abs(r.gross - g) < 1e-12
    early = spark.createDataFrame([("p", day(0), "late", 1.0)], weights.schema)
    late = bars.union(spark.createDataFrame([("late", day(9), 1.0, 1.0)], bars.schema))
    with pytest.raises(Exception, match="before a first price"):
        backtest.simulate_weights(late, early, sessions).collect()
    with pytest.raises(ValueError):
        backtest.simulate_weights(bars, weights, sessions, execution="noon")


def test_nearest_events(spark):
    left = spark.createDataFrame([("a", day(10)), ("a", day(50)), ("b", day(1)), ("a", day(100))], "symbol string, last_session date")
    events = spark.createDataFrame([("a", day(8), "x"), ("a", day(12), "y"), ("a", day(40), "z"), ("a", day(40), "w")], "symbol string, day date, event string")
    got = {(r.symbol, r.last_session): r.event for r in universe.with_nearest_event(left, events).collect()}
    assert got == {("a", day(10)): "x", ("a", day(50)): "w", ("b", day(1)): None, ("a", day(100)): None}


def test_walk_forward_errors(sessions):
    with pytest.raises(ValueError, match="before the calendar"):
        backtest.walk_forward(sessions, "2024-02-01", "2024-02-28", 6, 1)
    got = backtest.walk_forward(sessions, "2024-02-01", "2024-12-31", 1, 1).collect()
    assert [r.window for r in got] == ["2024-02"]
    assert got[0].train_end == dt.date(2024, 1, 31) and got[0].test_end == dt.date(2024, 2, 29) and got[0].decision_end == dt.date(2024, 2, 28)


@pytest.mark.parametrize("length", [5, 7, 64])
def test_slices_give_the_values_of_the_whole_series(spark, length):
    from tidemark.operators.slices import in_slices

    rng = random.Random(length)
    rows = [(s, day(i * 3), None if rng.random() < 0.2 else rng.uniform(1, 9)) for s in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "symbol string, session date, close double")
    for reach, kernel in ((4, lambda by: K.rolling_std("close", 5, by=by)), (3, lambda by: K.lag("close", 3, by=by)), (1, lambda by: K.log_returns("close", by=by))):
        whole = {(r.symbol, r.session): r.v for r in df.withColumn("v", kernel("symbol")).collect()}
        cut = in_slices(df, "close", kernel, "v", reach=reach, length=length)
        got = {(r.symbol, r.session): r.v for r in cut.collect()}
        assert cut.count() == len(rows) and got == whole
    with pytest.raises(ValueError):
        in_slices(df, "close", lambda by: K.lag("close", 9, by=by), "v", reach=9, length=5)
