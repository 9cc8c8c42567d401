import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.rolling import daily_totals, dense_series, presence, sum_at, trailing, with_doubling


def brute(days, w):
    out = {}
    for e, rows in days.items():
        for p in range(min(rows), max(rows) + 1):
            out[e, p] = sum(rows.get(q, 0.0) or 0.0 for q in range(p - w + 1, p + 1))
    return out


def test_trailing_equals_brute_force(spark):
    rng = random.Random(4)
    days = {e: {p: rng.choice([None, 0.0, rng.uniform(1, 9)]) for p in rng.sample(range(100), 40)} for e in "abc"}
    df = spark.createDataFrame([(e, p, v, "extra") for e, r in days.items() for p, v in r.items()], "e string, p int, v double, series string")
    windows = (1, 2, 7, 13, 30)
    got = {(r.e, r.p): r for r in trailing(df, "e", "p", "v", windows).collect()}
    for w in windows:
        want = brute(days, w)
        assert set(got) == set(want)
        assert all(abs(got[k][f"sum_{w}"] - x) < 1e-9 and abs(got[k][f"mean_{w}"] - x / w) < 1e-9 for k, x in want.items())


def test_trailing_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None, 1, 2.0), ("a", None, 2.0)], "e string, p int, v double")
    assert trailing(df, "e", "p", "v").collect() == []
    assert trailing(df.limit(0), "e", "p", "v").collect() == []


def test_variable_windows(spark):
    rng = random.Random(5)
    rows = {p: float(rng.random() < 0.6) for p in range(3, 60)}
    df = spark.createDataFrame([("a", p, v) for p, v in rows.items()], "e string, p int, v double")
    lengths = [rng.randint(0, 33) for _ in range(60)]
    more = spark.createDataFrame([("b", 59, 1.0), ("b", 50, float("nan")), ("c", 7, None), (None, 3, 1.0), ("d", None, 1.0)], df.schema)
    found = presence(df.union(more), "e", "p", "v", {"x": lengths, "y": [5] * 60})
    assert found.columns == ["e", "p", "x", "y"]
    got = {(r.e, r.p): (r.x, r.y) for r in found.collect()}
    assert set(got) == {("a", p) for p in range(3, 60)} | {("b", p) for p in range(50, 60)} | {("c", p) for p in range(7, 60)}
    for (e, p), (x, y) in got.items():
        held = rows if e == "a" else {59: 1.0} if e == "b" else {}
        for share, n in ((x, lengths[p]), (y, 5)):
            assert share == (sum(held.get(q, 0) for q in range(p - n + 1, p + 1)) / n if n else None)
    assert presence(df.limit(0), "e", "p", "v", {"x": lengths}).collect() == []
    dense = with_doubling(dense_series(df, "e", "p", "v"), "series", 5, "_p")
    at = dense.select(sum_at("_p", 5, F.lit(20), F.lit(-3)), sum_at("_p", 5, F.lit(20), F.lit(50))).first()
    assert at[0] == 0 and at[1] == sum(rows[q] for q in range(3, 24))


def test_latest_delivery_counts(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("a", t.date(), 1, 5.0, t), ("a", t.date(), 1, 7.0, t + dt.timedelta(hours=1)), ("a", t.date(), 1, 9.0, None),
        ("a", t.date(), 2, 1.0, t), ("a", t.date(), 2, 1.0, t), ("a", t.date(), 3, None, t), ("a", t.date(), 4, 2.0, t), ("a", t.date(), 4, 3.0, t),
        (None, t.date(), 1, 1.0, t), ("a", None, 1, 1.0, t), ("b", t.date(), 1, float("nan"), t),
    ]
    df = spark.createDataFrame(rows, "e string, d date, part int, v double, r timestamp")
    got = {r.e: r.v for r in daily_totals(df, "e", "d", "part", "v", "r").collect()}
    assert got == {"a": 7.0 + 1.0 + 0.0 + 3.0, "b": 0.0}


def test_series_run_on_to_the_last_position(spark):
    df = spark.createDataFrame([("a", 3, 2.0), ("a", 5, 4.0), ("b", 11, 1.0)], "e string, p int, v double")
    got = {(r.e, r.p): (r.v, r.sum_7) for r in trailing(df, "e", "p", "v", (7,), last=10).collect()}
    assert set(got) == {("a", p) for p in range(3, 11)} | {("b", 11)}
    assert [got["a", p][1] for p in range(3, 11)] == [2, 2, 6, 6, 6, 6, 6, 4]
    assert all(got["a", p][0] == 0 for p in range(6, 11)) and got["b", 11] == (1, 1)


def test_p2_reaches_the_end_of_the_calendar(spark, tmp_path):
    from tidemark.plans import problems

    days = [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(60)]
    late = dt.datetime(2023, 6, 1)
    tables = {
        "trading_sessions": ([(d, i) for i, d in enumerate(days)], "session_date date, session_no bigint"),
        "liquidity_settings": ([(1, "x", 1, 0.5, days[-1])], "setting_id int, index_name string, lookback_months int, min_presence double, base_session date"),
        "traded_values": (
            [(days[2], "A", 1, 30.0, True, late), (days[4], "A", 1, 60.0, True, late), (days[59], "B", 1, 7.0, True, late)],
            "session_date date, security_id string, block_no int, traded_value double, eligible boolean, received_at timestamp",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    rolling = {(r.security_id, r.session_date): r for r in problems.p2_rolling(spark, str(tmp_path)).collect()}
    presence = {(r.security_id, r.session_date): r for r in problems.p2_presence(spark, str(tmp_path)).collect()}
    assert set(rolling) == set(presence) == {("A", d.isoformat()) for d in days[2:]} | {("B", days[59].isoformat())}
    at = lambda i: rolling["A", days[i].isoformat()]
    assert (at(4).sum_7, at(4).sum_30) == (90, 90) and (at(31).sum_7, at(31).sum_30) == (0, 90)
    assert (at(33).sum_30, at(34).sum_30, at(59).traded_value) == (60, 0, 0)
    assert presence["A", days[20].isoformat()].presence_1m == 2 / 21
    assert presence["A", days[59].isoformat()].presence_1m == 0
