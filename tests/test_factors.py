"""Factors of events and the modes of adjustment, by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import adjustment
from tidemark.operators import factors as X

D = dt.date(2024, 1, 2)
BARS = "symbol string, session date, open double, close double, volume double"
FACTORS = "symbol string, ex_date date, f_total double, f_splits double, share_ratio double"
EVENTS = (
    "event_id string, security_id string, isin string, ex_session date, event_type string, cash_amount double, share_ratio double, "
    "subscription_price double, value_fraction double, target_isin string, target_security string"
)
KINDS = {"DIV": X.CASH, "SPLIT": X.SHARES, "RIGHTS": X.RIGHTS, "SPIN": X.SPIN_OFF, "SWAP": X.CHAIN}


def day(n):
    return D + dt.timedelta(days=n)


def event(no, kind, at=0, isin="a", cash=None, ratio=None, price=None, fraction=None, target=None, target_security=None):
    return (str(no), isin.upper(), isin, None if at is None else day(at), kind, cash, ratio, price, fraction, target, target_security)


def run(spark, events, closes=None, previous=10.0):
    before = spark.createDataFrame([("a", day(n), previous) for n in range(5)], "isin string, session date, close double")
    found = X.event_factors(spark.createDataFrame(events, EVENTS), before, KINDS, closes)
    return {(r.security_id, r.ex_date): r for r in found.collect()}


def test_amounts_shares_and_rights(spark):
    got = run(spark, [event(1, "DIV", cash=1.0), event(2, "SPLIT", ratio=2.0), event(2, "SPLIT", ratio=2.0), event(3, "DIV", 1, cash=float("nan")),
                      event(4, "RIGHTS", 2, ratio=0.5, price=7.0), event(5, "RIGHTS", 3, ratio=0.5, price=12.0), event(6, "DIV", None, cash=5.0), event(7, "SPLIT", 3, ratio=0.0)])
    one = got["A", day(0)]
    assert math.isclose(one.f_total, 0.9 / 2) and one.f_splits == 0.5 and one.share_ratio == 2.0 and one.event_ids == "1,2" and one.reason is None
    assert got["A", day(1)].f_total == 1.0
    assert math.isclose(got["A", day(2)].cash_value, 0.5 * 3 / 1.5) and got["A", day(3)].f_total == 1.0
    assert len(got) == 4


def test_events_without_a_factor(spark):
    rows = [event(1, "DIV", 0, cash=10.0), event(2, "DIV", 9, cash=1.0), event(3, "SPIN", 1, ratio=1.0, target="t"), event(4, "OTHER", 2), event(5, "SWAP", 3, ratio=2.0, target_security="B")]
    got = run(spark, rows)
    assert {k[1]: r.reason for k, r in got.items()} == {day(0): "value_exceeds_price", day(9): "no_previous_close", day(1): "no_target_price"}
    assert all(r.f_total is None and r.f_splits is None for r in got.values())
    told = X.ignored(spark.createDataFrame(rows, EVENTS), KINDS)
    assert {r.event_type: r.events for r in told.collect()} == {"OTHER": 1, "SWAP": 1}
    assert run(spark, [event(5, "SWAP", 3, ratio=2.0, target_security="A")])["A", day(3)].f_total == 0.5


def test_spin_offs_take_a_fraction_or_the_next_close_of_the_target(spark):
    sessions = spark.createDataFrame([(day(i), i) for i in range(30)], "session date, pos int")
    bars = spark.createDataFrame([("t", day(3), 4.0), ("t", day(9), 8.0), ("u", day(1), 1.0)], "isin string, session date, close double")
    closes = X.target_closes(bars, spark.createDataFrame([("t",)], "isin string"), sessions)
    rows = [event(1, "SPIN", 0, ratio=0.5, target="t"), event(2, "SPIN", 1, fraction=0.3, target="t"), event(3, "SPIN", 4, ratio=0.5, target="t"),
            event(4, "SPIN", 2, ratio=0.5, target="none")]
    got = run(spark, rows, closes)
    assert math.isclose(got["A", day(0)].f_total, 0.8) and math.isclose(got["A", day(1)].f_total, 0.7)
    assert math.isclose(got["A", day(4)].f_total, 0.6) and got["A", day(2)].reason == "no_target_price"
    late = X.target_closes(bars, spark.createDataFrame([("t",)], "isin string"), sessions, lookahead=2)
    assert run(spark, rows[:1], late)["A", day(0)].reason == "no_target_price"
    assert run(spark, [], closes) == {}


SERIES = [10.0, 9.0, 9.0, 4.5, 4.6]


def adjusted(spark, anchor, mode="total_return"):
    bars = spark.createDataFrame([(s, day(i), x, x, 100.0) for s in "ab" for i, x in enumerate(SERIES)], BARS)
    found = spark.createDataFrame([("a", day(1), 0.9, 1.0, 1.0), ("a", day(3), 0.5, 0.5, 2.0)], FACTORS)
    rows = adjustment.adjust(bars, found, str(day(anchor)), mode).orderBy("symbol", "session").collect()
    assert [r.close for r in rows if r.symbol == "b"] == SERIES and all(r.open == r.close for r in rows)
    return [round(r.close, 9) for r in rows if r.symbol == "a"], [r.volume for r in rows if r.symbol == "a"]


def test_modes(spark):
    assert adjusted(spark, 9) == ([4.5, 4.5, 4.5, 4.5, 4.6], [200.0, 200.0, 200.0, 100.0, 100.0])
    assert adjusted(spark, 9, "splits")[0] == [5.0, 4.5, 4.5, 4.5, 4.6]
    assert adjusted(spark, 9, "raw") == (SERIES, [100.0] * 5)
    assert adjusted(spark, 2) == ([9.0, 9.0, 9.0, 4.5, 4.6], [100.0] * 5)
    with pytest.raises(ValueError, match="mode"):
        adjusted(spark, 9, "dividends")
    few = spark.createDataFrame([("a", day(0), 1.0)], "symbol string, session date, close double")
    none = spark.createDataFrame([], FACTORS)
    assert adjustment.adjust(few, none).columns == few.columns and adjustment.adjust(few.where(F.lit(False)), none).count() == 0
