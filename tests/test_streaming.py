"""States equal their batch kernels; the stream equals both."""

import datetime as dt
import random

import pytest

from tidemark.functions import kernels as K
from tidemark.streaming import states as S
from tidemark.streaming.processors import bars_of_events, stream_kernel

PAIRS = {
    "lag": (lambda: S.LagState(3), lambda: K.lag("close", 3)),
    "simple": (S.SimpleReturnState, lambda: K.simple_returns("close")),
    "log": (S.LogReturnState, lambda: K.log_returns("close")),
    "sum": (lambda: S.RollingSumState(10), lambda: K.rolling_sum("close", 10)),
    "sma": (lambda: S.SmaState(10), lambda: K.sma("close", 10)),
    "std": (lambda: S.RollingStdState(10), lambda: K.rolling_std("close", 10)),
    "std0": (lambda: S.HistoricalVolatilityState(10, 0), lambda: K.historical_volatility("close", 10, 0)),
    "zscore": (lambda: S.RollingZScoreState(10), lambda: K.rolling_zscore("close", 10)),
}


@pytest.fixture(scope="module")
def panel():
    rng = random.Random(12)
    rows = []
    for name in ("COMPLETE", "LISTED", "DELISTED", "SUSPENDED"):
        price = 30.0
        for i in range(250):
            price *= 1 + rng.gauss(0, 0.02)
            gone = (name == "LISTED" and i < 40) or (name == "DELISTED" and i >= 220) or (name == "SUSPENDED" and (100 <= i < 105 or i % 37 == 5))
            rows.append((name, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if gone else price))
    for i in range(30):
        rows.append(("FLAT", dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.1))
    return rows


def by_state(make, panel):
    found, states = {}, {}
    for name, day, x in panel:
        state = states.get(name) or make()
        states[name] = make().load(state.dump())  # as a state store would
        found[name, day] = states[name].update(x)
    return found


def same(got, want):
    assert got.keys() == want.keys()
    for k, x in want.items():
        y = got[k]
        assert (x is None) == (y is None), k
        assert x is None or abs(x - y) <= 1e-9 * abs(x) + 1e-12, k


@pytest.mark.parametrize("kind", list(PAIRS))
def test_states_equal_kernels(spark, panel, kind):
    make, kernel = PAIRS[kind]
    df = spark.createDataFrame(panel, "symbol string, session date, close double")
    batch = {(r.symbol, r.session): r.v for r in df.select("symbol", "session", kernel().alias("v")).collect()}
    same(by_state(make, panel), batch)


@pytest.mark.parametrize("alpha", [K.alpha_from_span(20), K.alpha_from_halflife(3), K.alpha_from_decay(0.94), 0.9, 0.002])
def test_exponential_states_equal_kernels(spark, panel, alpha):
    df = spark.createDataFrame(panel, "symbol string, session date, close double")
    ema = K.with_ema(df, "close", alpha, "v")
    same(by_state(lambda: S.EmaState(alpha), panel), {(r.symbol, r.session): r.v for r in ema.collect()})
    vol = K.with_ewma_volatility(df, "close", alpha, "v")
    same(by_state(lambda: S.EwmaVolatilityState(alpha), panel), {(r.symbol, r.session): r.v for r in vol.collect()})


def test_lookbacks():
    assert K.exponential_lookback(K.alpha_from_span(20)) == 70
    assert K.exponential_lookback(K.alpha_from_decay(0.94)) == 112
    for bad in (lambda: K.alpha_from_span(1), lambda: K.alpha_from_halflife(0), lambda: K.alpha_from_decay(1), lambda: S.LagState(-1)):
        with pytest.raises(ValueError):
            bad()


def test_gap_series():
    s = S.LogReturnState()
    import math

    got = [s.update(x) for x in (30.0, 30.3, None, float("nan"), 31.5)]
    assert got[0] is got[2] is got[3] is None
    assert got[1] == math.log(30.3 / 30) and got[4] == math.log(31.5 / 30.3)
    with pytest.raises(ValueError):
        s.update(0.0)


def test_kernel_along_a_stream(spark, panel, tmp_path):
    rows = [(n, dt.datetime.combine(d, dt.time()), x) for n, d, x in panel]
    schema = "symbol string, ts timestamp, close double"
    cut = dt.datetime(2024, 5, 1)
    for i, part in enumerate(([r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut], [("FLAT", dt.datetime(2023, 1, 1), 9.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found = stream_kernel(stream, lambda: S.SmaState(10), "close")
    q = found.writeStream.format("memory").queryName("smas").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("smas").collect()
    late = [r for r in got if r.late]
    assert [(r.symbol, r.value) for r in late] == [("FLAT", None)]
    # NaN is how pandas hands a missing value back.
    mine = {(r.symbol, r.ts.date()): None if r.value is None or r.value != r.value else r.value for r in got if not r.late}
    same(mine, by_state(lambda: S.SmaState(10), panel))


def test_event_time_bars(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), "a", float(v)) for m, v in ((5, 3), (1, 1), (59, 2), (61, 9), (400, 1))]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = bars_of_events(stream, "ts", "k", "v").writeStream.format("memory").queryName("hbars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.start.hour: (r.open, r.high, r.low, r.close, r.n) for r in spark.table("hbars").collect()}
    assert got[0] == (1.0, 3.0, 1.0, 2.0, 3) and got[1] == (9.0, 9.0, 9.0, 9.0, 1) and len(got) == 2
