import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tests.test_sources import archive, record
from tidemark import cli
from tidemark.dataset import Dataset
from tidemark.functions import analytics as A
from tidemark.operators import calendar, folds, identity, matching, universe
from tidemark.sources.archives import FormatError
from tidemark.sources.overrides import apply_decisions, load_overrides
from tidemark.sources.provider import StoreProvider
from tidemark.sources.store import Store, StoreError

D = dt.date(2023, 12, 28)


def day(n):
    return D + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    store = Store.initialize(str(tmp_path_factory.mktemp("lake")))
    rows = [
        (day(i).year, day(i), s, *([10.0 * k * (2 if i < 5 and s == "a" else 1)] * 4), 100.0)
        for i in range(10) for k, s in enumerate("abc", 1) if not (s == "b" and i in (3, 4))
    ]
    rows.append((2023, day(0), "a", 1.0, 1.0, 1.0, 1.0, 1.0))  # the smaller of two rows of a key
    bars = spark.createDataFrame(rows, "year int, session date, symbol string, open double, high double, low double, close double, volume double")
    store.replace_partitions(bars, "year", "curated", "bars")
    store.replace(spark.createDataFrame([("a", day(5), 0.5, 0.5, 2.0)], "symbol string, ex_date date, f_total double, f_splits double, share_ratio double"), "derived", "factors")
    store.replace(spark.createDataFrame([("a", "OLD", day(0)), ("a", "NEW", day(6))], "symbol string, label string, first_session date"), "curated", "spans")
    return store


def test_panel(spark, lake):
    data = Dataset.open(spark, lake.root)
    members = universe.Universe(data.sessions().where("pos >= 4 AND pos < 8").select("session", F.lit("a").alias("symbol"))) | universe.constant(["b"], data.sessions().where("pos = 9"))
    p = data.panel(members, str(day(4)), str(day(9)), warmup=2, fields=["close"])
    got = {(r.symbol, r.session): (r.close, r.in_universe) for r in p.rows.collect()}
    assert got["a", day(2)] == (10.0, False) and got["a", day(4)] == (10.0, True) and got["a", day(9)] == (10.0, False)
    assert got["b", day(3)] == (None, False) and got["b", day(9)] == (20.0, True)
    assert {s for s, _ in got} == {"a", "b"} and min(d for _, d in got) == day(2)
    raw = data.panel(["a"], str(day(0)), str(day(9)), fields=["close"], mode="raw").rows.where(F.col("session") == day(0)).first()
    assert raw.close == 20.0
    for bad in ((["a"], "2030-01-01", "2030-02-01"),):
        with pytest.raises(ValueError):
            data.panel(*bad)
    assert [r.label for r in data.label_history("a").collect()] == ["OLD", "NEW"]
    asked = spark.createDataFrame([("a", day(5)), ("a", day(6)), ("z", day(6))], "symbol string, at date")
    assert {(r.symbol, r["at"]): r.label for r in data.label_at(asked, "at").collect()} == {("a", day(5)): "OLD", ("a", day(6)): "NEW", ("z", day(6)): None}
    assert data.factors(["a"]).count() == 1
    with pytest.raises(StoreError):
        Dataset.open(spark, Store.initialize(lake.root + "/empty").root)


def test_scan_is_pruned(spark, lake):
    provider = StoreProvider(spark, lake)
    rows = provider.bars(["a"], "2024-01-01", "2024-01-05", ["close"], mode="raw")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "high" not in plan
    assert sorted(r.session for r in rows.collect()) == [day(i) for i in range(4, 9)]
    wide = provider.wide(["b", "c"], "2023-12-28", "2024-01-06").orderBy("session").collect()
    assert [r.b for r in wide][2:6] == [20.0, None, None, 20.0] and wide[0].c == 30.0
    for bad in (dict(symbols=[]), dict(symbols=["a"], fields=["x"]), dict(symbols=["a"], start="2025-01-01")):
        with pytest.raises(ValueError):
            provider.bars(**{"start": "2024-01-01", "end": "2024-01-05", **bad})


def test_tickers_follow_renames(spark, tmp_path):
    store = Store.initialize(str(tmp_path))
    bars = spark.createDataFrame([(2024, day(10 + i), s, 1.0 + i, 1.0) for i in range(6) for s in "ab"], "year int, session date, symbol string, close double, volume double")
    store.replace_partitions(bars, "year", "curated", "bars")
    spans = [("a", "OLD", day(10), day(12)), ("a", "NEW", day(13), day(15)), ("b", "OLD", day(14), day(15)), ("b", "B", day(10), day(13))]
    store.replace(spark.createDataFrame(spans, "symbol string, label string, first_session date, last_session date"), "curated", "spans")
    provider = StoreProvider(spark, store)
    rows = provider.by_label(["NEW"], str(day(10)), str(day(15)), ["close"], mode="raw").collect()
    assert {r.symbol for r in rows} == {"NEW"} and len(rows) == 6
    early = provider.by_label(["OLD", "B"], str(day(10)), str(day(12)), ["close"], mode="raw").collect()
    assert sorted((r.symbol, r.session) for r in early) == sorted((s, day(i)) for s in ("OLD", "B") for i in (10, 11, 12))
    with pytest.raises(ValueError, match="one security"):
        provider.by_label(["OLD", "B"], str(day(10)), str(day(15)), ["close"], mode="raw")
    with pytest.raises(ValueError, match="no security"):
        provider.by_label(["NEW"], str(day(10)), str(day(11)), ["close"], mode="raw")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("TIDEMARK_ROOT", raising=False)
    root = str(tmp_path / "lake")
    assert cli.main(["--root", root, "build"]) == 2
    assert cli.main(["--root", root, "init"]) == 0
    path = archive(tmp_path / "in", [record(), record(session="20240103", ticker="NEWP4")])
    assert cli.main(["--root", root, "ingest", str(tmp_path / "in" / "*.ZIP")]) == 0
    assert cli.main(["--root", root, "build"]) == 0
    spans = spark.read.parquet(f"{root}/curated/spans").collect()
    assert {(r.symbol, r.label, r.sessions) for r in spans} == {("BRPETRACNPR6", "PETR4", 1), ("BRPETRACNPR6", "NEWP4", 1)}
    from tidemark.sources.annual import pick_source, raw_years, read_manifest

    entry = read_manifest(Store.open(root))
    assert list(entry) == [2024] and entry[2024]["rows_kept"] == 2 and entry[2024]["sessions"] == 2 and len(entry[2024]["sha256"]) == 64
    shutil.copy(path, f"{root}/raw/")
    assert raw_years(Store.open(root)) == [2024] and cli.main(["--root", root, "build", "bars", "--years", "2024"]) == 0
    assert cli.main(["--root", root, "years"]) == 0 and "2 bars on 2 sessions" in capsys.readouterr().out
    assert cli.main(["--root", root, "build", "bars", "--years", "1999"]) == 2
    with pytest.raises(FormatError, match="several"):
        pick_source(["x_A2024.ZIP", "x_a2024.zip"], 2024)
    assert cli.main(["--root", root, "show", "curated", "bars"]) == 0 and "PETR4" in capsys.readouterr().out
    assert cli.main(["--root", root, "ingest", path + ".none"]) == 2
    assert cli.main(["init"]) == 2


def test_overrides(spark, tmp_path):
    p = tmp_path / "o.yaml"
    p.write_text("reject:\n- {record: '1', note: why}\nperiods:\n- {period: 2020-01, effective_from: 2020-01-07, note: late}\n")
    assert load_overrides(spark, str(p), "periods").first().effective_from == dt.date(2020, 1, 7)
    df = spark.createDataFrame([("1",), ("2",)], "record string")
    kept, out = apply_decisions(df, "record", load_overrides(spark, str(p), "reject"))
    assert [r[0] for r in kept.collect()] == ["2"] and [r[0] for r in out.collect()] == ["1"]
    assert load_overrides(spark, str(tmp_path / "none"), "links").count() == 0
    with pytest.raises(FormatError, match="unknown records"):
        apply_decisions(df.where("record = '2'"), "record", load_overrides(spark, str(p), "reject"))
    for bad in ("reject: [{record: 1, note: x}]", "reject: [{record: a}]", "other: []", "[]", "reject: [{record: a, note: x}, {record: a, note: y}]"):
        p.write_text(bad)
        with pytest.raises(FormatError):
            load_overrides(spark, str(p), "reject")


def test_rule_calendars(spark):
    holidays = spark.createDataFrame([(dt.date(2024, 1, 1),)], "session date")
    days = calendar.rule_calendar(spark, "2023-12-29", "2024-01-03", holidays)
    assert [(r.session.day, r.pos) for r in days.orderBy("pos").collect()] == [(29, 0), (2, 1), (3, 2)]
    both = days.withColumn("calendar", F.lit("x")).unionByName(days.where("pos <> 1").withColumn("calendar", F.lit("y")).withColumn("pos", F.when(F.col("pos") == 2, 1).otherwise(0)))
    rows = spark.createDataFrame([(s, dt.date(2023, 12, 29), 1.0) for s in "ab"] + [(s, dt.date(2024, 1, 3), 2.0) for s in "ab"], "symbol string, session date, close double")
    of = spark.createDataFrame([("a", "x"), ("b", "y")], "symbol string, calendar string")
    got = sorted((r.symbol, r.session.day, r.close) for r in calendar.align_each(rows, both, of).collect() if r.symbol == "a" or True)
    assert len([g for g in got if g[0] == "a"]) == 3 and len([g for g in got if g[0] == "b"]) == 2
    with pytest.raises(Exception, match="no calendar"):
        calendar.align_each(rows, both, of.where("symbol = 'a'")).collect()


def test_confirmations(spark):
    s = "g string, id string, v double"
    best = spark.createDataFrame([("x", "1", 1.0), ("x", "2", 1.001), ("x", "3", None), ("y", "4", 5.0)], s)
    other = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 1.0), ("x", "c", 1.0), ("x", "d", None), ("z", "e", 1.0)], s)
    got = {r.other_id: r.best_id for r in matching.confirmations(best, other, ["g"], "id", "v", 0.005).collect()}
    assert got == {"a": "1", "b": "2", "c": None, "d": "3", "e": None}


def test_nearest_free_equals_a_loop():
    rng = random.Random(2)
    for _ in range(300):
        free = sorted(rng.choice([1.0, 1.001, 1.002, 1.004, 2.0, -1.0, rng.uniform(0.9, 1.1)]) for _ in range(rng.randint(0, 9)))
        asked = sorted(rng.choice([1.0, 1.002, 1.003, 2.0, -1.0, 0.0, rng.uniform(0.9, 1.1)]) for _ in range(rng.randint(0, 9)))
        left, want = set(range(len(free))), []
        for x in asked:
            fit = [(abs(free[i] - x), i) for i in left if abs(free[i] - x) <= 0.005 * abs(x)]
            want.append(min(fit)[1] if fit else None)
            left.discard(want[-1])
        assert matching.nearest_free(free, asked, 0.005) == want, (free, asked)


def test_links(spark):
    s = "from_ string, to_ string, gap_sessions int"
    rows = [("a", "b", 1), ("a", "c", 2), ("d", "e", 2), ("f", "e", 2), ("g", "h", 3)]
    got = {(r.from_, r.to_) for r in identity.chosen_links(spark.createDataFrame(rows, s)).collect()}
    assert got == {("a", "b"), ("g", "h")}


def test_fill_overlap_and_resolve(spark):
    periods = spark.createDataFrame([(f"p{i}", day(i)) for i in range(4)], "period string, effective_from date")
    real = spark.createDataFrame([("p0", "a"), ("p3", "a"), ("p3", "b")], "period string, symbol string")
    ranked = spark.createDataFrame([(f"p{i}", s, k) for i in range(4) for k, s in enumerate("xyz", 1)], "period string, symbol string, rank int")
    got = sorted((r.period, r.symbol, r.filled) for r in universe.fill_gaps(real, ranked, periods).collect())
    assert got == [("p0", "a", False), ("p1", "x", True), ("p2", "x", True), ("p2", "y", True), ("p3", "a", False), ("p3", "b", False)]
    share = universe.overlap(real, spark.createDataFrame([("p3", "b"), ("p0", "z")], "period string, symbol string"))
    assert {r.period: r.share for r in share.collect()} == {"p0": 0.0, "p3": 0.5}
    spans = spark.createDataFrame([("T", "e1", day(0), day(3)), ("T", "e2", day(4), None), ("D", "e1", day(0), None), ("D", "e2", day(0), None)], "t string, e string, first_session date, last_session date")
    asked = spark.createDataFrame([("T", day(3)), ("T", day(4)), ("D", day(4)), ("N", day(1))], "t string, d date")
    assert {(r.t, r.d): r.e for r in universe.resolved(asked, spans, "t", "d", "e").collect()} == {("T", day(3)): "e1", ("T", day(4)): "e2", ("D", day(4)): None, ("N", day(1)): None}
    told = identity.relabelled(spark.createDataFrame([("e1",), ("e2",), ("e3",)], "e string"), spark.createDataFrame([("e1", "T"), ("e2", "T"), ("e3", "U")], "e string, t string"), "e", "t")
    assert {r.e: r.t for r in told.collect()} == {"e1": "T (e1)", "e2": "T (e2)", "e3": "U"}


def test_folds(spark):
    sessions = spark.createDataFrame([(day(i), i) for i in range(10)], "session date, pos int")
    windows = spark.createDataFrame([("w", day(0), day(4), day(4), day(8))], "window string, train_start date, train_end date, decision_start date, decision_end date")
    bars = spark.createDataFrame([(s, day(i), 1.0) for s, r in {"ok": range(10), "late": range(2, 10), "gone": range(3), "rare": (0, 9)}.items() for i in r], "symbol string, session date, close double")
    every = spark.createDataFrame([("w", s) for s in ("ok", "late", "gone", "rare", "never")], "window string, symbol string")
    found = folds.folds(windows, every, bars, sessions, [folds.HasHistory(), folds.StillTrading(), folds.MinimumPresence(0.8)])
    assert {r.symbol: r.reason for r in found.collect()} == {"ok": None, "late": "no history", "gone": "stopped trading", "rare": "too few sessions", "never": "no history"}
    assert sorted(r.session for r in folds.targets(found, windows, sessions).collect()) == [day(i) for i in range(4, 9)]


def test_text(spark):
    long = spark.createDataFrame([("a", "cagr", 0.12345), ("a", "observations", 12.0), ("b", "cagr", None), ("b", "observations", 3.0)], "series string, metric string, value double")
    assert A.as_text(long).splitlines() == ["                   a    b", "cagr          0.1235  n/a", "observations      12    3"] or "0.1234" in A.as_text(long)
