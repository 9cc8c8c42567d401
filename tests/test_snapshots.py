import random

import numpy as np
import pytest

from tidemark.operators import snapshots
from tidemark.operators.snapshots import Tables, differing, snapshot_changes

SCHEMA = "s int, k1 string, k2 string, v double, w string, snapshot string"


def brute(rows):
    snaps = sorted({r[0] for r in rows if r[0] is not None})
    state = {s: {} for s in snaps}
    for s, a, b, v, w, _ in rows:
        if s is not None:
            state[s].setdefault((a, b), set()).add((v, w))
    out = set()
    for x, y in zip(snaps, snaps[1:]):
        for k in state[x].keys() | state[y].keys():
            old, new = state[x].get(k), state[y].get(k)
            if old != new:
                out.add((y, *k, "added" if old is None else "removed" if new is None else "changed"))
    return out


def made(seed, n=300, snaps=4):
    rng = random.Random(seed)
    live = {(f"k{i}", rng.choice(["x", None])): (rng.choice([1.0, 2.0, None]), "w") for i in range(n)}
    rows = []
    for s in range(snaps):
        for k in list(live):
            p = rng.random()
            if p < 0.05:
                del live[k]
            elif p < 0.15:
                live[k] = (rng.uniform(0, 9), rng.choice(["w", None]))
        live |= {(f"n{s}-{i}", "x"): (1.0, "w") for i in range(10)}
        rows += [(s, *k, *v, "note") for k, v in live.items()]
    return rows + rng.sample(rows, 20) + [(None, "k", "x", 1.0, "w", "note")]


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 32, "cells": 9}, {"bucket_rows": 64, "cells": 6, "max_rounds": 1}])
def test_changes_equal_brute_force(spark, options):
    rows = made(11)
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), "s", ["k1", "k2"], ["v", "w"], **options)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert got.count() == len(brute(rows))


def test_several_values_of_a_key(spark):
    rows = [(1, "a", "x", 1.0, "", ""), (1, "a", "x", 2.0, "", ""), (2, "a", "x", 1.0, "", ""), (3, "a", "x", 1.0, "", "")]
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), "s", ["k1", "k2"], ["v", "w"])
    assert [tuple(r) for r in got.collect()] == [(2, "a", "x", "changed")]


def test_one_snapshot_or_none(spark):
    one = spark.createDataFrame([(1, "a", "x", 1.0, "", "")], SCHEMA)
    for df in (one, one.limit(0)):
        assert snapshot_changes(df, "s", ["k1", "k2"], ["v", "w"]).collect() == []


def test_small_portions(spark, monkeypatch):
    rows = made(5)
    monkeypatch.setattr(snapshots, "PAIRS_AT_ONCE", 50)
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), "s", ["k1", "k2"], ["v", "w"], bucket_rows=20)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_a_key_with_many_values(spark):
    rows = [(s, "hot", "x", float(i), "", "") for s in (1, 2) for i in range(3000 + s)] + [(s, "still", "x", 1.0, "", "") for s in (1, 2)]
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), "s", ["k1", "k2"], ["v", "w"], bucket_rows=100)
    assert [tuple(r) for r in got.collect()] == [(2, "hot", "x", "changed")]


def test_peel_recovers_or_says_so():
    rng = np.random.default_rng(3)
    k, v = (rng.integers(-(2**62), 2**62, 60) for _ in range(2))
    s, t = rng.choice([-1, 1], 60), np.repeat([0, 2], 30)
    for cells, done in ((120, True), (15, False)):
        tables = Tables(3, cells, 0)
        tables.add(t, k, v, s)
        gt, gk, gv, gs, empty = tables.peel()
        assert empty.tolist() == [done, True, done]
        if done:
            assert set(zip(gt, gk, gv, gs)) == set(zip(t, k, v, s))


@pytest.mark.parametrize("cells,rounds", [(384, 5), (9, 3), (3, 1)])
def test_differences_of_whole_buckets(cells, rounds):
    rng = np.random.default_rng(cells)
    base = rng.integers(-(2**62), 2**62, (4000, 2))
    sides = [base[rng.random(4000) > 0.02] for _ in range(4)]
    number = np.concatenate([np.full(len(x), n) for n, x in enumerate(sides)])
    rows = np.concatenate(sides)
    bucket = (rows[:, 0] % 7).astype(np.int64)
    delta, key = differing(bucket, number, rows[:, 0].copy(), rows[:, 1].copy(), 3, cells, 4, rounds)
    have = [set(map(tuple, x)) for x in sides]
    want = {(d, k) for d in (1, 2, 3) for k, _ in have[d - 1] ^ have[d]}
    assert set(zip(delta.tolist(), key.tolist())) == want and len(delta) == len(want)
