from collections import Counter

import numpy as np
import pytest

from tidemark.llm import mixing as M
from tidemark.llm.tokenizer import encode_text, encoding, vocabulary_path

ENC = encoding(vocabulary_path())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    index = np.arange(n)
    there = M.permuted(index, n, 99)
    assert sorted(there) == list(range(n))
    assert (M.permuted(there, n, 99, inverse=True) == index).all()
    assert n < 20 or (there != M.permuted(index, n, 100)).any()


def plan(quotas, shard_blocks, seed=5, blocks=None):
    return M.Mixture(tuple(f"s{i}" for i in range(len(quotas))), tuple(blocks or quotas), tuple(quotas), shard_blocks, seed)


def test_draws_add_up():
    mixture = plan([500, 30, 0, 1471], 100)
    drawn = list(M.shard_counts(mixture, 0, mixture.shards))
    counts = np.array([c for _, _, c in drawn])
    assert counts.sum(axis=0).tolist() == list(mixture.quotas) and [s for s, _, _ in drawn] == list(range(21))
    assert counts.sum(axis=1).tolist() == [100] * 20 + [1]
    assert np.abs(counts[:20, 0] - 25).max() < 25
    assert all((b == counts[:s].sum(axis=0)).all() for s, b, _ in drawn)
    # Any range of shards is what it is in the whole.
    for s, b, c in M.shard_counts(mixture, 7, 12):
        assert 7 <= s < 12 and (b == drawn[s][1]).all() and (c == drawn[s][2]).all()
    assert list(M.shard_counts(plan([0, 0], 10), 0, 9)) == []


def test_draws_have_the_spread_of_a_multinomial():
    shares = np.array([0.2, 0.5, 0.3])
    counts = np.array([c for _, _, c in M.shard_counts(plan([20_000, 50_000, 30_000], 100), 0, 1000)])
    assert (np.abs(counts.mean(axis=0) - 100 * shares) < 1e-9).all()
    assert (np.abs(counts.var(axis=0) / (100 * shares * (1 - shares)) - 1) < 0.15).all()
    large = M.split_counts(np.array([3 * 10**12, 10**12]), 10**12, np.random.default_rng(1))
    assert large.sum() == 10**12 and abs(large[0] / 10**12 - 0.75) < 1e-5


def test_a_shard_of_a_million_is_found_at_once():
    import pickle
    import time

    mixture = plan([400_000_000, 24_000_000, 600_000_000], 1024)
    assert mixture.shards == 1_000_000 and len(pickle.dumps(mixture)) < 1000
    began = time.perf_counter()
    rows = [b for s in (0, 123_456, 999_999) for b in M.shard_slots(mixture, s, s + 1)]
    assert time.perf_counter() - began < 1 and [b.num_rows for b in rows] == [1024] * 3


def test_slots_take_every_block_once_an_epoch():
    mixture = plan([70, 45], 8, blocks=[70, 20])
    rows = [r for b in M.shard_slots(mixture, 0, mixture.shards) for r in b.to_pylist()]
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(i // 8, i % 8) for i in range(115)]
    uses = Counter((r["source"], r["epoch"], r["block"]) for r in rows)
    assert max(uses.values()) == 1
    assert {b for s, e, b in uses if (s, e) == ("s1", 1)} == set(range(20)) and sum(e == 2 for s, e, _ in uses if s == "s1") == 5
    assert {b for s, _, b in uses if s == "s0"} == set(range(70))


def test_wanted_tokens():
    assert M.wanted_tokens([0.5, 0.5], [100, 100], [1, 1], 100).tolist() == [50, 50]
    assert M.wanted_tokens([0.5, 0.5], [10, 1000], [2, 1], 200).tolist() == [20, 180]
    assert M.wanted_tokens([0.5, 0.5], [10, 20], [2, 1], 200).tolist() == [20, 20]
    assert M.wanted_tokens([0.9, 0.1], [0, 50], [3, 1], 50).tolist() == [0, 50]


def run(spark, rows, targets, **options):
    df = spark.createDataFrame([(s, t, "x") for s, t in rows], "source string, text string, ids string").repartition(3)
    settings = {"block_tokens": 16, "shard_blocks": 10} | options
    return M.mix_sources(df, "source", "text", targets, **settings).collect(), M.mixture_report(df, "source", "text", targets, **settings).collect()


def test_mixture(spark):
    rows = [("big", f"text number {i} of the big source, with words") for i in range(300)]
    rows += [("small", f"small {i}") for i in range(20)] + [("other", "unlisted")] + [(None, "no source"), ("big", None), ("big", "")]
    rows += [("big", " ".join(f"w{i}" for i in range(500)))]
    targets = [("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.0, 1), ("gone", 0.2, 2)]
    mixed, report = run(spark, rows, targets)
    have = {s: sum(len(encode_text(ENC, t)) for x, t in rows if x == s and t) for s in ("big", "small")}
    shares = {r.source: r for r in report}
    assert shares["big"].documents_tokens == have["big"] and shares["small"].documents_tokens == have["small"]
    assert shares["small"].times_used == 3.0 and shares["gone"].used_tokens == 0
    assert {r.source for r in mixed} == {"big", "small"}
    uses = Counter((r.source, r.block) for r in mixed)
    assert max(n for (s, _), n in uses.items() if s == "small") == 3
    assert max(n for (s, _), n in uses.items() if s == "big") == 1
    slots = sorted((r.shard, r.slot) for r in mixed)
    assert len(set(slots)) == len(slots)
    assert all(r.n_tokens == len(r.ids) <= 16 for r in mixed)
    by_shard = Counter(s for s, _ in slots)
    assert all(n == 10 for s, n in by_shard.items() if s != max(by_shard))
    assert all(sorted(x for k, x in slots if k == s) == list(range(n)) for s, n in by_shard.items())
    used = sum(len(r.ids) for r in mixed if r.source == "small")
    assert used == 3 * have["small"] == shares["small"].used_tokens


def test_every_token_is_packed(spark):
    rows = [("a", f"row {i} " * (i % 9)) for i in range(100)]
    mixed, _ = run(spark, rows, [("a", 1.0, 1)])
    got = Counter(i for r in mixed for i in r.ids)
    assert got == Counter(i for _, t in rows for i in encode_text(ENC, t))
    assert sum(r.n_tokens < 16 for r in mixed) <= 1


def test_targets_are_met_when_there_is_enough(spark):
    rows = [(s, f"{s} text {i} some more words here") for s in ("a", "b") for i in range(400)]
    _, report = run(spark, rows, [("a", 0.8, 4), ("b", 0.2, 1)])
    assert {r.source: round(r.actual_share, 2) for r in report} == {"a": 0.8, "b": 0.2}


def test_nothing(spark):
    mixed, report = run(spark, [], [("a", 1.0, 1)])
    assert mixed == [] and report[0].used_tokens == 0 and report[0].actual_share is None
    with pytest.raises(ValueError):
        run(spark, [("a", "x")], [("a", 0.5, 1), ("a", 0.5, 1)])


def test_more_tasks_give_the_same_mixture(spark, monkeypatch):
    rows = [("a", f"row {i} " * (i % 9)) for i in range(60)] + [("b", f"small {i}") for i in range(9)]
    targets = [("a", 0.7, 1), ("b", 0.3, 2)]
    one = sorted((r.shard, r.slot, r.source, r.block, r.epoch) for r in run(spark, rows, targets)[0])
    monkeypatch.setattr(M, "SLOTS_A_TASK", 5)
    assert one == sorted((r.shard, r.slot, r.source, r.block, r.epoch) for r in run(spark, rows, targets)[0])
