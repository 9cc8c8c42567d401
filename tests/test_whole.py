"""Queries that take the whole of their input."""

import math

from pyspark.sql import functions as F

from tidemark.operators.calendar import sessions_of
from tidemark.plans import analytics, domain, kernels, lineage
from tidemark.plans import market as M


def test_panel_fingerprint_covers_every_cell(spark, sf, monkeypatch):
    found = kernels.QUERIES["panel_fingerprint"](spark, sf).collect()
    assert len(found) == 1 and len(found[0].fingerprint) == 64
    real = kernels._aligned
    one = real(spark, sf).where("close IS NOT NULL").orderBy("symbol", "session").first()

    def bent(s, d):
        here = (F.col("symbol") == one.symbol) & (F.col("session") == F.lit(one.session))
        return real(s, d).withColumn("close", F.when(here, F.col("close") + 1).otherwise(F.col("close")))

    monkeypatch.setattr(kernels, "_aligned", lambda s, d: real(s, d).repartition(7))
    assert kernels.panel_fingerprint(spark, sf).first() == found[0]
    monkeypatch.setattr(kernels, "_aligned", bent)
    assert kernels.panel_fingerprint(spark, sf).first() != found[0]


def test_trade_timing_takes_every_bar(spark, sf):
    daily = M.bars(spark, sf)
    rows, n = daily.select("symbol", "session").collect(), daily.select("session").distinct().count()
    pos = {r.session: r.pos for r in sessions_of(daily, "session").collect()}
    held = {}
    for r in rows:
        held.setdefault(r.symbol, []).append((pos[r.session], min(pos[r.session] + pos[r.session] % 4, n - 1)))
    got = {r.series: r for r in analytics.trade_timing(spark, sf).collect()}
    assert set(got) == set(held)
    for k, spans in held.items():
        covered = {p for a, z in spans for p in range(a, z + 1)}
        want = (len(spans) / n, len(covered) / n, sum(z - a + 1 for a, z in spans) / len(spans))
        assert all(abs(x - y) < 1e-7 for x, y in zip((got[k].trade_frequency, got[k].exposure, got[k].average_holding_period), want))


def test_walk_forward_reaches_over_the_calendar(spark, sf):
    days = sorted(r.session for r in M.bars(spark, sf).select("session").distinct().collect())
    windows = sorted(domain.wf_schedule(spark, sf).collect(), key=lambda r: r.window)
    assert windows[0].train_start == days[0] and windows[-1].test_end == days[-1]
    tested = [d for w in windows for d in days if w.test_start <= d <= w.test_end]
    begin = 12 * days[0].year + days[0].month + 6
    assert tested == [d for d in days if 12 * d.year + d.month >= begin]
    assert {r.window for r in lineage.wf_folds(spark, sf).select("window").distinct().collect()} == {w.window for w in windows}


def test_relative_metrics_keep_up_capture(spark, sf):
    rows = {}
    for r in M.with_benchmark(M.returns(spark, sf)).where("b > 0").collect():
        rows.setdefault(r.series, []).append((r.r, r.b))
    got = {r.series: r.up_capture for r in analytics.relative_metrics(spark, sf).collect()}
    assert set(rows) <= set(got)
    for k, pairs in rows.items():
        grown = [math.expm1(math.fsum(math.log1p(p[i]) for p in pairs) * 252 / len(pairs)) for i in (0, 1)]
        assert got[k] and math.isclose(got[k], grown[0] / grown[1], rel_tol=1e-5)


def test_trade_summary_lists_all_metrics(spark, sf):
    wide = {r.series: r.asDict() for r in analytics.trade_metrics(spark, sf).collect()}
    rows = analytics.trade_summary(spark, sf).collect()
    got = {(r.series, r.metric): r.value for r in rows if r.section == "outcome"}
    want = {(s, m): v for s, r in wide.items() for m, v in r.items() if m != "series"}
    assert len(next(iter(wide.values()))) == 17 and got == want
    timing = {r.metric for r in rows if r.section == "timing"}
    assert timing == {"trade_frequency", "exposure", "average_holding_period"} and len(rows) == 19 * len(wide)
