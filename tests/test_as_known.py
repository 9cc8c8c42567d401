import datetime as dt
import random

from tidemark.operators.as_known import as_known

D = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else D + dt.timedelta(days=n)


def run(spark, events, versions):
    e = spark.createDataFrame([(n, i, day(t), "t") for n, i, t in events], "no int, id string, at date, ticker string")
    v = spark.createDataFrame([(i, day(f), day(k), a, day(b), "x") for i, f, k, a, b in versions], "key string, f date, k date, ticker string, until date, at string")
    got = as_known(e, v, entity=("id", "key"), at="at", valid_from="f", known_from="k", attributes=["ticker", "until"])
    assert got.columns == ["no", "id", "at", "ticker", "known_ticker", "until", "has_version"]
    return {r.no: (r.known_ticker, r.until, r.has_version) for r in got.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    versions = [
        (rng.choice("abc"), rng.randint(0, 60), rng.randint(0, 60), rng.choice(["X", "Y", None]), rng.choice([None, 5, 50])) for _ in range(90)
    ]
    versions = list({(v[0], v[1], v[2]): v for v in versions}.values())
    events = [(n, rng.choice("abcd"), rng.randint(-5, 70)) for n in range(300)]
    got = run(spark, events, versions + versions[:10])
    assert len(got) == len(events)
    for n, i, t in events:
        seen = [v for v in versions if v[0] == i and v[1] <= t and v[2] <= t]
        best = max(seen, key=lambda v: (v[1], v[2]), default=None)
        assert got[n] == ((best[3], day(best[4]), True) if best else (None, None, False)), (n, i, t)


def test_corrections_are_not_seen_early(spark):
    versions = [("a", 0, 0, "OLD", None), ("a", 0, 10, "NEW", None), ("a", 5, 20, "LATE", None)]
    got = run(spark, [(1, "a", 9), (2, "a", 10), (3, "a", 19), (4, "a", 20), (5, "a", -1), (6, None, 3), (7, "a", None)], versions)
    assert [got[n][0] for n in range(1, 8)] == ["OLD", "NEW", "NEW", "LATE", None, None, None]
    assert got[6][2] is False and got[7][2] is False


def test_empty_tables(spark):
    assert run(spark, [], [("a", 0, 0, "X", None)]) == {}
    assert run(spark, [(1, "a", 0)], []) == {1: (None, None, False)}


def test_histories_are_each_attributes_own(spark):
    from tidemark.operators.as_known import change_histories

    rows = [("a", day(0), day(0), "X", 1), ("a", day(1), day(1), "X", 2), ("a", day(2), day(2), "Y", 2), ("a", day(3), day(3), "Y", None)]
    v = spark.createDataFrame(rows, "key string, f date, k date, ticker string, n int")
    found = change_histories(v, "key", "f", "k", ["ticker", "n"]).collect()
    assert sorted((r._since, r._v.v0) for r in found if r._attr == 0) == [(day(0), "X"), (day(2), "Y")]
    assert [(r._since, r._v.v1) for r in sorted(found, key=lambda r: r._since) if r._attr == 1] == [(day(0), 1), (day(1), 2), (day(3), None)]


def test_a_tie_is_one_version_for_all_attributes(spark):
    versions = [("a", 0, 0, "P", 5), ("a", 0, 0, "Q", None), ("a", 0, 0, "R", 50)]
    got = run(spark, [(1, "a", 3)], versions)
    assert got[1][:2] in {("P", day(5)), ("Q", None), ("R", day(50))}
