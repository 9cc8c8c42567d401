"""Links, chains, periods, universes and folds, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.dataset import Dataset
from tidemark.operators import backtest, folds, master, periods, universe
from tidemark.sources.store import Store, StoreError

D = dt.date(2024, 1, 1)
SPAN = "isin string, ticker string, market_type int, first_session date, last_session date"
A, B, C = "BRPETRACNPR6", "BRVALEACNOR0", "BRITUBACNPR1"


def day(n):
    return D + dt.timedelta(days=n)


def test_nodes_take_the_main_market_where_there_is_one(spark):
    rows = [("x", "T1", 10, day(5), day(9)), ("x", "T2", 10, day(2), day(4)), ("x", "F", 20, day(0), day(30)), ("y", "U", 20, day(1), day(2))]
    got = {r.isin: r for r in master.timed_nodes(spark.createDataFrame(rows, SPAN), F.col("market_type") == 10).collect()}
    assert (got["x"].first_session, got["x"].last_session, got["x"].first_ticker, got["x"].last_ticker) == (day(2), day(9), "T2", "T1")
    assert got["y"].first_ticker == "U"


def test_issuers_and_internal_codes(spark):
    rows = [(A, "PETR4", 10, day(0), day(400)), (B, "VALE3", 10, day(0), day(9)), ("OLD1", "PETR4", 10, day(-50), day(-9)), ("OLD0", "PETR4", 10, day(-90), day(-60)),
            ("OLD2", "BOTH", 10, day(-9), day(-5)), (A, "BOTH", 10, day(0), day(1)), (B, "BOTH", 10, day(3), day(4))]
    spans = spark.createDataFrame(rows, SPAN)
    fca = spark.createDataFrame([(2024, "PETR4", "1"), (2025, "PETR4", "1"), (2023, "PETR4", "9"), (2024, "VALE3", "2"), (2024, "VALE3", "3")], "reference_year int, ticker string, cnpj string")
    assert {(r.issuer, r.cnpj, r.ambiguous) for r in master.issuer_ids(fca, spans).collect()} == {("PETR", "1", False), ("VALE", None, True)}
    links, unclear = master.internal_code_links(spans)
    assert {tuple(r) for r in links.collect()} == {("OLD1", A)} and [r.isin for r in unclear.collect()] == ["OLD2"]


def test_decisions(spark):
    s = "from_ string, to_ string, gap_sessions int, from_cnpj string, to_cnpj string, ratio double"
    rows = [("a", "b", 1, "1", "1", 1.0), ("a", "c", 2, "1", "1", 1.0), ("d", "e", 1, "2", "2", 1.0), ("d", "f", 1, "2", "2", 1.0), ("g", "h", 1, "3", "4", 1.1),
            ("i", "j", 1, None, None, 2.0), ("k", "l", 1, "5", "5", 1.0), ("m", "n", 1, None, None, 1.0), ("o", "p", 3, None, None, None), ("q", "n", 2, None, None, 1.0)]
    pair = "from_ string, to_ string"
    hand, no = spark.createDataFrame([("i", "j")], pair), spark.createDataFrame([("k", "l")], pair)
    found = master.decided(spark.createDataFrame(rows, s), hand, hand, no)
    assert {(r.from_, r.to_): r.status for r in found.collect()} == {
        ("a", "b"): "linked_by_cnpj", ("a", "c"): "superseded", ("d", "e"): "conflict", ("d", "f"): "conflict", ("g", "h"): "likely",
        ("i", "j"): "linked_by_override", ("k", "l"): "rejected", ("m", "n"): "pending", ("o", "p"): "pending", ("q", "n"): "pending",
    }
    with pytest.raises(master.MasterError, match="no candidates"):
        master.decided(spark.createDataFrame(rows, s), hand, hand, spark.createDataFrame([("z", "z")], pair))


def test_chains_are_named_by_their_first_listing(spark):
    rows = [(f"i{n:02}", f"T{n}", 10, day(10 * n), day(10 * n + 9)) for n in range(20)] + [("i03", "T3X", 10, day(35), day(39))]
    spans = spark.createDataFrame(rows, SPAN)
    nodes = master.timed_nodes(spans, F.lit(True)).withColumn("cnpj", F.lit("1"))
    links = spark.createDataFrame([(f"i{n:02}", f"i{n + 1:02}", "cnpj") for n in range(12)], "from_ string, to_ string, rule string")
    got = {(r.isin, r.ticker): (r.security_id, r.link_rule) for r in master.security_master(spans, nodes, links).collect()}
    assert got["i12", "T12"] == ("i00", "cnpj") and got["i00", "T0"] == ("i00", "founding") and got["i15", "T15"] == ("i15", "founding")
    assert got["i03", "T3"] == ("i00", "cnpj") and got["i03", "T3X"] == ("i00", "same_isin") and len(got) == 21
    for bad, why in (([("i00", "i02"), ("i00", "i03")], "successors"), ([("i00", "i02"), ("i01", "i02")], "predecessors"), ([("i05", "i01")], "before"), ([("i00", "zz")], "unknown")):
        with pytest.raises(master.MasterError, match=why):
            master.require_chains(spark.createDataFrame(bad, "from_ string, to_ string"), nodes)
    with pytest.raises(master.MasterError, match="cycle"):
        master.chain_ids(nodes, spark.createDataFrame([("i00", "i01"), ("i01", "i02"), ("i02", "i00")], "from_ string, to_ string"), max_rounds=4)


def test_candidates_get_prices(spark):
    nodes = spark.createDataFrame([("a", day(0), day(3), "A1", "A2", "1"), ("b", day(4), day(9), "B1", "B2", "1")], "isin string, first_session date, last_session date, first_ticker string, last_ticker string, cnpj string")
    bars = spark.createDataFrame([("a", day(3), 9.0, 10.0), ("b", day(4), 5.0, 5.5)], "isin string, session date, open double, close double")
    pairs = spark.createDataFrame([("a", "b", 1)], "from_ string, to_ string, gap_sessions int")
    r = master.priced_candidates(pairs, nodes, bars).first()
    assert (r.from_ticker, r.to_ticker, r.old_close, r.new_open, r.ratio, r.implied_factor) == ("A2", "B1", 10.0, 5.0, 0.5, 0.5)


def test_period_rules(spark):
    assert periods.parse_period("2024-05") == (2024, 5) and periods.quadrimester(dt.date(2024, 8, 31)) == "2024-05"
    for bad in ("2024-02", "2024-5", "24-05", "x"):
        with pytest.raises(ValueError):
            periods.parse_period(bad)
    assert periods.parse_month("2024-02") == dt.date(2024, 2, 1)
    assert [periods.rule_for(p) for p in ("1999-01", "2011-05", "2011-09", "2026-09", "2027-01")] == ["first_session"] * 2 + ["first_monday"] * 2 + ["second_monday"]
    assert periods.rule_date(2024, 1, "first_monday") == dt.date(2024, 1, 1) and periods.rule_date(2024, 9, "second_monday") == dt.date(2024, 9, 9)
    days = [dt.date(2024, 3, 1) + dt.timedelta(days=i) for i in range(300)]
    days = [d for d in days if d.weekday() < 5 and d != dt.date(2024, 5, 6)]
    sessions = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "session date, pos int")
    got = {r.period: r for r in periods.index_periods(sessions).collect()}
    assert set(got) == {"2024-05", "2024-09"} and got["2024-05"].effective_from == dt.date(2024, 5, 7)
    assert got["2024-05"].effective_to == dt.date(2024, 8, 30) and got["2024-09"].effective_to == days[-1] and got["2024-05"].rule == "first_monday"
    assert got["2024-09"].base_pos == days.index(dt.date(2024, 9, 2)) - 3
    moved = spark.createDataFrame([("2024-05", dt.date(2024, 5, 9))], "period string, effective_from date")
    assert {r.period: (r.effective_from, r.rule) for r in periods.index_periods(sessions, moved).collect()}["2024-05"] == (dt.date(2024, 5, 9), "override")
    for d, why in ((dt.date(2024, 5, 6), "no session"), (dt.date(2024, 10, 1), "out of order")):
        with pytest.raises(ValueError, match=why):
            periods.index_periods(sessions, spark.createDataFrame([("2024-05", d)], moved.schema))
    assert periods.index_periods(sessions.limit(0)).count() == 0


def _members(spark, rows):
    return spark.createDataFrame(rows, "index string, period string, source string, source_file string, ticker string, base_session date")


def test_universe_build_and_lookups(spark, tmp_path):
    pers = spark.createDataFrame([("2024-01", day(0), day(9), 0), ("2024-05", day(10), day(19), 7), ("2024-09", day(20), day(29), 17)], "period string, effective_from date, effective_to date, base_pos int")
    rows = [("IX", "2024-01", "preview", "f1", "T1", day(0)), ("IX", "2024-01", "final", "f2", "T2", day(0)), ("IX", "2024-01", "final", "f2", "T3", None),
            ("IX", "2024-01", "final", "f3", "T2", day(0)), ("IX", "2024-01", "final", "f3", "T3", None), ("IX", "2024-09", "final", "f4", "T9", day(20))]
    spans = spark.createDataFrame([("T2", "s2", day(-9), day(5)), ("T3", "s3", day(-9), None), ("T9", "p", day(-9), None), ("T9", "q", day(-9), None)], "ticker string, symbol string, first_session date, last_session date")
    bars = spark.createDataFrame([(s, day(i), 1.0) for s, n in (("s2", 6), ("s3", 30)) for i in range(n)], "symbol string, session date, close double")
    ranked = spark.createDataFrame([("2024-05", s, k) for k, s in enumerate(["s3", "s2", "s9"], 1)], "period string, symbol string, rank int")
    events = spark.createDataFrame([("s2", day(8), "e2"), ("s2", day(2), "e1")], "symbol string, day date, event string")
    rank = F.when(F.col("source") == "final", 0).otherwise(1)
    made = universe.build_universe(_members(spark, rows), pers, spans, ranked, bars, events, fill_index="IX", rank=rank)
    got = {(r.period, r.ticker, r.symbol, r.source) for r in made["constituents"].collect()}
    assert got == {("2024-01", "T2", "s2", "final"), ("2024-01", "T3", "s3", "final"), ("2024-09", "T9", None, "final"), ("2024-05", "", "s3", "liquidity_rule"), ("2024-05", "", "s2", "liquidity_rule")}
    assert {(r.period, r.symbol, r.event) for r in made["exits"].collect()} == {("2024-01", "s2", "e1"), ("2024-05", "s2", "e1")}
    absent = universe.absent_at_start(made["constituents"], pers, bars.where("symbol <> 's3' OR session > date'2024-01-01'"), made["exits"])
    assert {(r.period, r.ticker) for r in absent.collect()} == {("2024-01", "T3")}
    with pytest.raises(Exception, match="different members"):
        universe.one_file_each(_members(spark, rows + [("IX", "2024-01", "final", "f5", "T2", day(0))])).collect()

    store = Store.initialize(str(tmp_path))
    store.replace_partitions(bars.withColumns({"year": F.year("session"), "volume": F.lit(1.0)}), "year", "curated", "bars")
    store.replace(spark.createDataFrame([], "symbol string, ex_date date, f_total double, f_splits double, share_ratio double"), "derived", "factors")
    store.replace(spark.createDataFrame([("s2", day(3), "x"), ("s2", day(1), "y")], "symbol string, ex_date date, event string"), "curated", "events")
    data = Dataset.open(spark, store.root)
    with pytest.raises(StoreError, match="has not been built"):
        data.constituents("IX", str(day(3)))
    for name, df in made.items():
        store.replace(df, "derived", name)
    assert {r.ticker for r in data.constituents("IX", str(day(3))).collect()} == {"T2", "T3"} and data.constituents("IX", "2023-01-01").count() == 0
    assert data.composition("IX", "2024-05").count() == 2 and data.constituents("NONE", str(day(3))).count() == 0
    for bad in ("2024-02", "2030-01"):
        with pytest.raises(ValueError):
            data.composition("IX", bad)
    assert {r.period for r in data.rebalance_dates("IX", str(day(1)), str(day(25))).collect()} == {"2024-05", "2024-09"}
    assert [r.event for r in data.events("s2").collect()] == ["y", "x"]
    assert {r.period for r in data.exits("IX", str(day(12)), str(day(15))).collect()} == {"2024-05"}
    panel = data.panel("IX", str(day(3)), str(day(12)), fields=["close"])
    assert {r.symbol for r in panel.rows.where("in_universe").select("symbol").distinct().collect()} == {"s2", "s3"}
    with pytest.raises(TypeError):
        data.as_universe([1, 2])


def test_folds_of_an_index(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(240)]
    sessions = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "session date, pos int")
    windows = backtest.walk_forward(sessions, "2024-04-01", "2024-06-30", 2, 3)
    members = spark.createDataFrame([("2024-01", "a"), ("2024-05", "b"), ("2024-05", "a")], "period string, symbol string")
    split = folds.IndexComposition(members)
    pieces = split.cut(windows, sessions)
    got = {r.window: (r.test_start, r.test_end, r.decision_start, r.decision_end) for r in pieces.collect()}
    assert got == {
        "2024-04": (dt.date(2024, 4, 1), dt.date(2024, 4, 30), dt.date(2024, 3, 31), dt.date(2024, 4, 29)),
        "2024-04/2024-05": (dt.date(2024, 5, 1), dt.date(2024, 6, 30), dt.date(2024, 4, 30), dt.date(2024, 6, 29)),
    }
    assert {tuple(r) for r in split.candidates(pieces, sessions).collect()} == {("2024-04", "a"), ("2024-04/2024-05", "a"), ("2024-04/2024-05", "b")}
    hold = folds.IndexComposition(members, "hold")
    assert {tuple(r) for r in hold.candidates(hold.cut(windows, sessions), sessions).collect()} == {("2024-04", "a")}
    with pytest.raises(Exception, match="no composition"):
        folds.IndexComposition(members.where("period = '2024-09'")).candidates(windows, sessions).collect()
    with pytest.raises(ValueError):
        folds.IndexComposition(members, "drop")
    static = folds.StaticUniverse(sessions.where("pos = 100").select("session", F.lit("z").alias("symbol")))
    assert {tuple(r) for r in static.candidates(pieces, sessions).collect()} == {("2024-04", "z")}
    bars = spark.createDataFrame([("a", d, 1.0) for d in days] + [("b", d, 1.0) for d in days[125:]], "symbol string, session date, close double")
    rules = [folds.HasHistory("test"), folds.MinimumPresence(0.9, "test")]
    chosen = folds.folds(pieces, split.candidates(pieces, sessions), bars, sessions, rules)
    assert {(r.window, r.symbol): r.reason for r in chosen.collect()} == {("2024-04", "a"): None, ("2024-04/2024-05", "a"): None, ("2024-04/2024-05", "b"): "no history"}
    each = folds.each_fold(pieces, chosen, warmup=5)
    assert [(f.window["window"], f.symbols, f.warmup) for f in each] == [("2024-04", ("a",), 5), ("2024-04/2024-05", ("a",), 5)]

    class Fake:
        def panel(self, symbols, start, end, **options):
            return symbols, start, end, options

    assert each[0].load_train(Fake()) == (["a"], "2024-02-01", "2024-03-31", {"warmup": 5, "mode": "total_return"})
    assert each[0].load_test(Fake(), ["close"], "raw") == (["a"], "2024-03-31", "2024-04-29", {"warmup": 5, "mode": "raw", "fields": ["close"]})
