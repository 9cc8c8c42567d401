import datetime as dt
import random

from tidemark.llm.nearest import nearest_by_tick

D = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else D + dt.timedelta(days=n)


def run(spark, left, right, how="left"):
    a = spark.createDataFrame([(n, e, day(t)) for n, e, t in left], "no int, id string, at date")
    b = spark.createDataFrame([(e, day(t), 1) for e, t in right], "id string, at date, no int")
    got = nearest_by_tick(a, b, entity=("id", "id"), day=("at", "at"), tolerance=5, how=how)
    assert got.columns == ["no", "id", "at", "matched"]
    return sorted((r.no, r.matched) for r in got.collect())


def test_equals_brute_force(spark):
    rng = random.Random(2)
    right = [(rng.choice("ab"), rng.randint(0, 200)) for _ in range(60)]
    left = [(n, rng.choice("abc"), rng.randint(-10, 210)) for n in range(200)]
    want = []
    for n, e, t in left:
        near = [r for x, r in right if x == e and abs(r - t) <= 5]
        want.append((n, day(min(near, key=lambda r: (abs(r - t), -r))) if near else None))
    assert run(spark, left, right + right[:5]) == want


def test_ties_bounds_and_nulls(spark):
    right = [("a", 0), ("a", 4), (None, 2), ("a", None)]
    left = [(1, "a", 2), (2, "a", 9), (3, "a", 10), (4, None, 2), (5, "a", None), (6, "a", 2)]
    assert run(spark, left, right) == [(1, day(4)), (2, day(4)), (3, None), (4, None), (5, None), (6, day(4))]
    assert run(spark, left, right, "inner") == [(1, day(4)), (2, day(4)), (6, day(4))]
    assert run(spark, [], right) == [] and run(spark, [(1, "a", 2)], []) == [(1, None)]
