"""Runs, ex-sessions, placing and merging of events, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger

D = dt.date(2024, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def market(spark):
    rows = [("a", day(i), n, "T", 10.0 + i, 10.5 + i) for i, n in ((0, 1), (1, 1), (3, 2), (4, 2), (8, 5))] + [("b", day(0), 7, "U", 1.0, 2.0), ("b", day(5), None, "U", 1.0, 2.0), (None, day(0), 1, "x", 1.0, 1.0)]
    return spark.createDataFrame(rows, "isin string, session date, distribution_number int, ticker string, open double, close double")


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(day(i), i) for i in range(12) if i not in (6, 7)], "session date, pos int")


def test_runs_and_ex_sessions(market):
    runs = ledger.distribution_runs(market)
    got = sorted((r.isin, r.first_session, r.last_session, r.distribution_number or 0, r.first_open, r.last_close) for r in runs.collect())
    assert got == [("a", day(0), day(1), 1, 10.0, 11.5), ("a", day(3), day(4), 2, 13.0, 14.5), ("a", day(8), day(8), 5, 18.0, 18.5), ("b", day(0), day(0), 7, 1.0, 2.0), ("b", day(5), day(5), 0, 1.0, 2.0)]
    ex = {(r.isin, r.session): (r.previous_session, r.from_distribution, r.to_distribution, r.open_ratio) for r in ledger.ex_sessions(runs).collect()}
    assert ex["a", day(3)] == (day(1), 1, 2, 13.0 / 11.5) and set(ex) == {("a", day(3)), ("a", day(8)), ("b", day(5))}


def test_placing(spark, market, sessions):
    rows = [(1, "a", day(1), None), (2, "a", day(2), None), (3, "a", day(3), None), (4, "a", day(8), None), (5, "a", day(-1), None), (6, "zz", day(1), None), (7, None, day(1), None),
            (8, "a", None, 1), (9, "a", None, 4), (10, "a", None, 9), (11, "a", None, None), (12, "a", day(5), None)]
    events = spark.createDataFrame(rows, "event_no int, isin string, last_cum_date date, distribution_number int")
    got = {r.event_no: (r.placement, r.ex_session, r.ex_date, r.last_cum_date) for r in ledger.placed(events, ledger.distribution_runs(market), sessions).collect()}
    assert len(got) == 12
    assert got[1] == ("matched", day(3), day(2), day(1)) and got[2] == ("matched", day(3), day(3), day(2))
    assert got[3] == ("no_ex_session", None, day(4), day(3)) and got[4][0] == "not_traded" and got[5][0] == "not_traded" and got[6] == ("not_traded", None, day(2), day(1))
    assert got[7][0] == "not_traded" and got[12] == ("matched", day(8), day(8), day(5))
    assert got[8] == ("matched", day(3), day(3), day(2)) and got[9] == ("matched", day(8), day(8), day(5)) and got[10][0] == got[11][0] == "not_traded"


def test_placing_by_ratio(spark, market, sessions):
    ex = spark.createDataFrame([("a", day(3), 0.5), ("a", day(8), 1.1)], "isin string, session date, open_ratio double")
    events = spark.createDataFrame([(1, "a", day(0), 2.0), (2, "a", day(0), 5.0), (3, "a", None, 2.0)], "event_no int, isin string, approved_on date, share_ratio double")
    kept, rest = ledger.placed_by_ratio(events, ex, sessions)
    assert [(r.event_no, r.ex_session, r.last_cum_date) for r in kept.collect()] == [(1, day(3), day(2))]
    assert sorted(r.event_no for r in rest.collect()) == [2, 3]


def test_merging_sources(spark):
    rows = [("1", "x", "first", 1.0), ("2", "x", "first", 2.0), ("3", "x", "second", 1.001), ("4", "x", "third", 1.0), ("5", "x", "second", 9.0), ("6", "y", "second", 3.0), ("7", "x", "second", 1.0)]
    events = spark.createDataFrame(rows, "id string, g string, source string, amount double")
    rank = F.when(F.col("source") == "first", 0).when(F.col("source") == "second", 1).otherwise(2)
    kept, conflicts = ledger.merged_sources(events, ["g"], rank, "id", "amount", 0.005)
    assert {r.id: r.confirmed_by for r in kept.collect()} == {"1": "second,third", "2": "", "6": ""}
    assert sorted(r.id for r in conflicts.collect()) == ["3", "5"]
    told = ledger.counts_by_year(spark.createDataFrame([("a", D), ("a", D), ("b", day(400))], "s string, d date"), "s", "d")
    assert {tuple(r) for r in told.collect()} == {("a", 2024, 2), ("b", 2025, 1)}
