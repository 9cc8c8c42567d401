"""What analytics take and refuse, and the series of hand-computed cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import analytics as A
from tidemark.functions import contracts as C

D = dt.date(2024, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def series(spark, **named):
    rows = [(s, day(i), x) for s, xs in named.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "series string, session date, r double")


def test_returns_may_lack_values_at_the_edges_only(spark):
    C.require_returns(series(spark, a=[None, None, 0.1, -1.0, None], b=[0.1] * 5))
    for bad, why in (
        ([0.1, None, 0.2], "gap inside"),
        ([0.1, -1.01], "at least -100%"),
        ([0.1, math.inf], "finite"),
        ([None, None], "no observation"),
    ):
        with pytest.raises(ValueError, match=why):
            C.require_returns(series(spark, a=[0.1], b=bad))
    twice = series(spark, a=[0.1]).union(series(spark, a=[0.1]))
    with pytest.raises(ValueError, match="repeat"):
        C.require_returns(twice)
    with pytest.raises(TypeError, match="numeric"):
        C.require_returns(series(spark, a=[0.1]).withColumn("r", F.lit("x")))
    with pytest.raises(ValueError, match="above zero"):
        C.require_equity(series(spark, a=[1.0, 0.0]), "r")
    with pytest.raises(ValueError, match="at least one"):
        C.require_observations(series(spark, a=[0.1]).limit(0))


def test_benchmark_trades_and_sessions(spark):
    rows = series(spark, a=[0.1, 0.2, 0.3])
    market = rows.select("session", F.col("r").alias("b"))
    assert C.require_benchmark(rows, market) is market
    with pytest.raises(ValueError, match="differ in their times"):
        C.require_benchmark(rows, market.where(F.col("session") > F.lit(D)))
    times = "entry date, exit date"
    C.require_trades(spark.createDataFrame([], times))
    with pytest.raises(ValueError, match="before its entry"):
        C.require_trades(spark.createDataFrame([(day(2), day(1))], times))
    with pytest.raises(ValueError, match="both times"):
        C.require_trades(spark.createDataFrame([(day(2), None)], times))
    with pytest.raises(ValueError, match="need the columns"):
        C.require_trades(rows)
    with pytest.raises(ValueError, match="repeat"):
        C.require_sessions(spark.createDataFrame([(D,), (D,)], "session date"))
    with pytest.raises(ValueError, match="missing"):
        C.require_trade_results(spark.createDataFrame([(None,)], "result double"))
    for value, error in ((True, TypeError), (252.0, TypeError), (0, ValueError)):
        with pytest.raises(error):
            C.integer("periods", value, 1)
    with pytest.raises(ValueError):
        C.real("confidence", 1.0, 0.0, 1.0)


def test_an_open_episode_lasts_to_the_end(spark):
    df = series(spark, open=[0.05, -0.01, -0.01, 0.0, -0.01, 0.0], again=[0.1, -0.2, 0.01, 0.01, 0.01, None], up=[0.01] * 3,
                healed=[-0.1, 0.2, -0.1, 0.2])
    longest = {r.series: r.max_drawdown_duration for r in A.performance(df).collect()}
    assert longest == {"open": 5, "again": 4, "up": 0, "healed": 2}
    found = {(r.series, r.peak): (r.trough, r.recovery, r.peak_to_trough, r.trough_to_recovery, r.duration) for r in A.drawdown_periods(df).collect()}
    assert found == {
        ("open", day(0)): (day(4), None, 4, None, 5),
        ("again", day(0)): (day(1), None, 1, None, 4),
        ("healed", day(0)): (day(0), day(1), 0, 1, 1),
        ("healed", day(1)): (day(2), day(3), 1, 1, 2),
    }


def test_a_window_with_a_missing_side_gives_nothing(spark):
    rows = series(spark, s=[0.01, 0.03, -0.02, 0.04, 0.02, -0.01, 0.05, 0.03]).withColumn(
        "b", F.when(F.col("session") != F.lit(day(3)), F.col("r") * 2 + F.dayofmonth("session") / 100)
    )
    got = rows.select("session", A.rolling_beta("r", "b", 3).alias("v"), A.rolling_correlation("r", "b", 3).alias("c")).orderBy("session").collect()
    assert [r.v is None for r in got] == [True, True, False, True, True, True, False, False]
    assert [r.c is None for r in got] == [r.v is None for r in got]
    shifted = rows.select("session", A.rolling_beta("r", "b", 3, 0.1).alias("v")).orderBy("session").collect()
    assert all(x.v is None or math.isclose(x.v, y.v) for x, y in zip(shifted, got, strict=True))


def test_risk_free_series(spark):
    rows = series(spark, a=[None, 0.02, 0.01, 0.03])
    rates = spark.createDataFrame([(day(i), 0.001 * i) for i in range(1, 4)], "session date, rf double")
    r = A.with_risk_free(rows, rates).agg(A.sharpe_ratio("r", "rf").alias("v"), A.sharpe_ratio(F.col("r") - F.col("rf")).alias("w")).first()
    assert math.isclose(r.v, r.w)
    with pytest.raises(Exception, match="no risk-free return"):
        A.with_risk_free(rows, rates.where(F.col("session") != F.lit(day(2)))).collect()


def test_summary_over_the_common_period(spark):
    df = series(spark, a=[None, 0.02, 0.01, 0.03, -0.01], b=[0.01, 0.02, -0.05, 0.03, None]).withColumn("m", F.lit(0.01) + F.dayofmonth("session") / 1000)
    got = {(r.series, r.metric): r.value for r in A.summary(df, benchmark="m", periods=3).collect()}
    assert {s for s, _ in got} == {"a", "b", "benchmark"} and len(got) == 3 * 23
    assert math.isclose(got["a", "total_return"], 1.02 * 1.01 * 1.03 - 1)
    assert got["benchmark", "beta"] is None and got["a", "beta"] is not None
    own = {(r.series, r.metric): r.value for r in A.summary(df, periods=3, common_period=False).collect()}
    assert math.isclose(own["a", "total_return"], 1.02 * 1.01 * 1.03 * 0.99 - 1) and len(own) == 2 * 15
    short = {(r.series, r.metric): r.value for r in A.summary(df, benchmark="m", periods=252).collect()}
    assert all(short["a", m] is None for m in A.NEEDS_A_YEAR) and short["a", "sharpe_ratio"] is not None
    apart = series(spark, a=[0.1, None], b=[None, 0.1])
    with pytest.raises(ValueError, match="in common"):
        A.summary(apart)
    assert set(A.UNITS) == {m for s in (A.SECTIONS, A.TRADE_SECTIONS) for ms in s.values() for m in ms}
