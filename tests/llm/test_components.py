import random

import pytest

from tidemark.llm import components as C


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {v: find(v) for v in root}


def run(spark, pairs, **options):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a string, b string, vertex string")
    rows = C.components(df, "a", "b", **options).collect()
    got = {r.vertex: r.group for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("cell_edges", [10, 60, 250_000])
def test_equals_brute_force(spark, cell_edges):
    rng = random.Random(3)
    pairs = [(f"v{rng.randint(0, 400):03}", f"v{rng.randint(0, 400):03}") for _ in range(220)]
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]  # a chain
    pairs += [("hub", f"s{i}") for i in range(150)]  # a star
    rng.shuffle(pairs)
    assert run(spark, pairs + pairs[:9], cell_edges=cell_edges, max_rounds=12) == brute(pairs)


def test_bounded_portions(spark, monkeypatch):
    monkeypatch.setattr(C, "EDGES_AT_ONCE", 7)
    pairs = [(f"c{i:03}", f"c{(i * 7) % 90:03}") for i in range(90)]
    assert run(spark, pairs) == brute(pairs)


def test_nulls_loops_and_nothing(spark):
    assert run(spark, [(None, "a"), ("b", None), ("c", "c"), ("e", "d"), ("d", "e")]) == {"d": "d", "e": "d"}
    assert run(spark, []) == {}
    assert run(spark, [("c", "c")]) == {}
