import datetime as dt
import random

from tidemark.operators.spikes import flag_readings

SCHEMA = "isin string, day date, before double, after double, ratio double, isin_note string"


def series(n=40, seed=1, level=50.0, sd=0.01):
    rng = random.Random(seed)
    rows, price = [], level
    for i in range(n):
        before = price
        after = before * (1 + rng.gauss(0, sd))
        rows.append([dt.date(2020, 1, 1) + dt.timedelta(days=20 * i), before, after, after / before])
        price = after * (1 + rng.gauss(0, sd))
    return rows


def flags(spark, named, **options):
    data = [(name, *r, "x") for name, rows in named.items() for r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    found = flag_readings(df, "isin", "day", "before", "after", "ratio", **options).collect()
    return {(r.isin, r.day): {k for k in ("impossible", "stuck", "spike") if r[k]} for r in found}


def test_planted_cases(spark):
    spike, split, level, stuck, wild = series(seed=2), series(seed=3), series(seed=4), series(seed=5), series(seed=6, sd=0.08)
    spike[20][2] *= 1.5
    spike[20][3] = spike[20][2] / spike[20][1]
    for i in range(20, 40):
        split[i][2] /= 10
        if i > 20:
            split[i][1] /= 10
        split[i][3] = split[i][2] / split[i][1]
    level[10][1] *= 10
    level[10][2] *= 10
    for i in range(12, 17):
        stuck[i][2] = stuck[12][2]
        stuck[i][3] = stuck[i][2] / stuck[i][1]
    got = flags(spark, {"spike": spike, "split": split, "level": level, "stuck": stuck, "wild": wild})
    assert got["spike", spike[20][0]] == {"spike"}
    assert sum(bool(v) for (n, _), v in got.items() if n == "spike") == 1
    assert not any(v for (n, _), v in got.items() if n in ("split", "wild"))
    assert [d for (n, d), v in got.items() if n == "level" and v] == [level[10][0]]
    assert {d for (n, d), v in got.items() if n == "stuck" and "stuck" in v} == {stuck[i][0] for i in range(12, 17)}


def test_two_outliers_side_by_side(spark):
    rows = series(seed=7)
    for i in (10, 11):
        rows[i][1] *= 20
        rows[i][2] *= 20
    got = flags(spark, {"a": rows})
    assert {d for (_, d), v in got.items() if v} == {rows[10][0], rows[11][0]}


def test_impossible_and_nulls(spark):
    rows = series(seed=8)
    rows[3][2], rows[3][3] = 0.0, 0.0
    rows[5][3] = float("nan")
    rows[7][3] = float("inf")
    rows[9][3] *= 1.02
    rows[11][1] = None
    rows[12][3] = None
    rows[13][1], rows[13][2], rows[13][3] = None, None, None
    got = flags(spark, {"a": rows, None: series(5)})
    assert {d for (_, d), v in got.items() if "impossible" in v} == {rows[i][0] for i in (3, 5, 7, 9)}
    assert not got["a", rows[11][0]] and not got["a", rows[12][0]] and not got["a", rows[13][0]]
    assert all(n == "a" for n, _ in got)


def test_four_in_a_row_are_not_stuck_and_repeats_count_once(spark):
    rows = series(seed=9)
    for i in range(12, 16):
        rows[i][1] = rows[12][1]
        rows[i][3] = rows[i][2] / rows[i][1]
    got = flags(spark, {"a": rows + [rows[12]] * 5})
    assert not any("stuck" in v for v in got.values())
    assert len(got) == len(rows)


def test_short_flat_and_empty(spark):
    flat = [[dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i, 10.0 + i, 1.0] for i in range(12)]
    flat[6][2] = 16.004
    flat[6][3] = 1.00025
    assert not any(flags(spark, {"flat": flat, "short": series(3)}).values())
    assert flags(spark, {}) == {}
