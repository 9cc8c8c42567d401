"""Builds of a whole store."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import builds
from tidemark.operators import factors as X
from tidemark.sources.store import StaleError, Store

D = dt.date(2024, 1, 1)
OLD, NEW, OTHER = "BRPETRACNPR6", "BRPETSACNPR4", "BRVALEACNOR0"


def day(n):
    return D + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    from tidemark.functions.identifiers import is_isin

    codes = spark.createDataFrame([(f"BRPETSACNPR{d}",) for d in range(10)], "c string")
    new = codes.where(is_isin("c")).first().c
    found = Store.initialize(str(tmp_path_factory.mktemp("builds")))
    rows = [(OLD, "OLD4", day(i), 10.0) for i in range(10)] + [(new, "NEW4", day(i), 10.5) for i in range(11, 20)] + [(OTHER, "VALE3", day(i), 50.0) for i in range(20)]
    bars = spark.createDataFrame([(i, t, 10, s, p, p) for i, t, s, p in rows], "symbol string, label string, market_type int, session date, open double, close double")
    found.replace_partitions(bars.withColumn("year", F.year("session")), "year", "curated", "bars")
    found.replace(spark.createDataFrame([(2024, "OLD4", "1"), (2024, "VALE3", "2")], "reference_year int, ticker string, cnpj string"), "curated", "filings")
    return found, new


def test_master(spark, store, tmp_path):
    found, new = store
    told = builds.build_master(spark, found)
    assert (told["spans"], told["securities"], told["identifier_changes"]) == (3, 3, 0) and told["candidates"] == {"likely": 1}
    yaml = tmp_path / "o.yaml"
    yaml.write_text(f"links:\n- {{from_isin: {OLD}, to_isin: {new}, note: renamed}}\n")
    told = builds.build_master(spark, found, str(yaml))
    assert told["candidates"] == {"linked_by_override": 1} and told["links"] == {"founding": 2, "override": 1} and told["identifier_changes"] == 1
    got = {r.isin: (r.security_id, r.link_rule, r.cnpj) for r in found.read(spark, "curated", "master").collect()}
    assert got == {OLD: (OLD, "founding", "1"), new: (OLD, "override", None), OTHER: (OTHER, "founding", "2")}
    assert json.loads(found.read_text("curated", "master.summary.json"))["securities"] == 2
    # One company behind both issuer codes links them without a hand.
    found.replace(spark.createDataFrame([(2024, "OLD4", "1"), (2024, "NEW4", "1")], "reference_year int, ticker string, cnpj string"), "curated", "filings")
    told = builds.build_master(spark, found)
    assert told["candidates"] == {"linked_by_cnpj": 1} and told["links"]["cnpj"] == 1 and told["identifier_changes"] == 0


def test_factors(spark, store):
    found, _ = store
    columns = "event_id string, security_id string, isin string, ex_session date, event_type string, cash_amount double, share_ratio double, subscription_price double, value_fraction double, target_isin string, target_security string, status string"
    rows = [("1", OLD, OLD, day(5), "DIV", 1.0, None, None, None, None, None, "confirmed"), ("2", OLD, OLD, day(6), "SPIN", None, 0.1, None, None, OTHER, None, "inferred"),
            ("3", OLD, OLD, day(7), "DIV", 99.0, None, None, None, None, None, "confirmed"), ("4", OLD, OLD, day(8), "DIV", 1.0, None, None, None, None, None, "review"),
            ("5", OLD, OLD, day(8), "MISC", 1.0, None, None, None, None, None, "confirmed")]
    found.replace(spark.createDataFrame(rows, columns), "curated", "events")
    found.replace(spark.createDataFrame([(OLD, day(i), 10.0) for i in range(5, 9)], "isin string, session date, previous_close double"), "curated", "ex_sessions")
    kinds = {"DIV": X.CASH, "SPIN": X.SPIN_OFF}
    told = builds.build_factors(spark, found, kinds)
    assert told["factors"] == 2 and told["rejected"] == {"value_exceeds_price": 1} and told["ignored"] == {"MISC": 1}
    got = {r.ex_date: round(r.f_total, 9) for r in builds.read_factors(spark, found).collect()}
    assert got == {day(5): 0.9, day(6): 0.5}
    found.replace(spark.createDataFrame(rows[:2], columns), "curated", "events")
    with pytest.raises(StaleError):
        builds.read_factors(spark, found)
