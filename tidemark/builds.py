"""Tables of a store built from its other tables, each with a summary and a stamp of its inputs."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identifiers import is_isin
from tidemark.operators import factors, identity, master
from tidemark.operators.adjustment import drift
from tidemark.operators.calendar import sessions_of
from tidemark.sources.files import files
from tidemark.sources.overrides import load_overrides
from tidemark.sources.store import Store

# The market of round lots, the kinds of ISIN (characters 7 and
# 8) whose listings may follow each other, and within how many sessions.
ROUND_LOT = 10
LINKABLE = ("AC", "UN")
MAX_GAP = 5

#: Events in force.
APPLIED = ("confirmed", "inferred")


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order; one aggregation."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(df.columns)))
    found = df.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
    return "-".join(map(str, (*found, *sorted(df.columns))))


def _counts(df: DataFrame, column: str) -> dict[str, int]:
    return {str(r[0]): r[1] for r in df.groupBy(column).count().collect()}


def _write_summary(store: Store, content: Mapping[str, object], zone: str, name: str) -> dict:
    told = {**content, "built_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds")}
    store.write_text(json.dumps(told, indent=1, sort_keys=True), zone, f"{name}.summary.json")
    return told


def build_master(spark: SparkSession, store: Store, overrides: str | None = None) -> dict:
    """``curated/master`` and ``curated/candidates`` from ``curated/bars`` and ``curated/filings``.

    Bars have ``symbol`` (the ISIN), ``label`` (its ticker), ``market_type``,
    ``session, open, close``; filings, if there are any, ``reference_year,
    ticker, cnpj``. ``overrides`` is a YAML file whose ``links`` are made by
    hand. Returns the summary: spans, securities, links by rule, candidates by
    status, and how many identities differ from those of the build before.
    """
    bars = store.read(spark, "curated", "bars").select(F.col("symbol").alias("isin"), F.col("label").alias("ticker"), "market_type", "session", "open", "close")
    spans = identity.spans(bars, ["isin", "ticker", "market_type"], "session")
    main = F.col("market_type") == ROUND_LOT
    nodes = master.timed_nodes(spans, main)
    issuer = F.substring("isin", 3, 4)
    if files(spark).exists(store.path("curated", "filings")):
        companies = master.issuer_ids(store.read(spark, "curated", "filings"), spans.where(main)).select("issuer", "cnpj")
        nodes = nodes.withColumn("issuer", F.when(is_isin("isin"), issuer)).join(companies, "issuer", "left").drop("issuer")
    else:
        nodes = nodes.withColumn("cnpj", F.lit(None).cast("string"))
    hand = load_overrides(spark, overrides, "links").select(F.col("from_isin").alias("from_"), F.col("to_isin").alias("to_")) if overrides else spark.createDataFrame([], "from_ string, to_ string")
    internal, unclear = master.internal_code_links(spans.where(main))
    linkable = nodes.where(is_isin("isin") & F.substring("isin", 7, 2).isin(*LINKABLE))
    pairs = identity.successor_candidates(linkable, sessions_of(bars, "session"), "isin", F.substring("isin", 7, 5), MAX_GAP)
    priced = master.priced_candidates(pairs, nodes, bars.where(main))
    links = hand.withColumn("rule", F.lit(master.OVERRIDE)).unionByName(internal.join(hand, "from_", "left_anti").join(hand.select("to_"), "to_", "left_anti").withColumn("rule", F.lit(master.INTERNAL_CODE)).select("from_", "to_", "rule"))
    told = master.decided(priced, links, hand, spark.createDataFrame([], "from_ string, to_ string"))
    store.replace(told, "curated", "candidates")
    told = store.read(spark, "curated", "candidates")
    found = told.where(F.col("status") == master.LINKED_BY_CNPJ).select("from_", "to_", F.lit(master.CNPJ).alias("rule"))
    table = master.security_master(spans, nodes, links.unionByName(found))
    key = F.concat_ws("|", "isin", "ticker", F.col("market_type").cast("string"))
    changes = 0
    if files(spark).exists(store.path("curated", "master")):
        before = store.read(spark, "curated", "master").withColumn("_k", key)
        changes = drift(before, table.withColumn("_k", key), "_k", "security_id").count()
    store.replace(table, "curated", "master")
    table = store.read(spark, "curated", "master")
    return _write_summary(
        store,
        {
            "spans": table.count(),
            "securities": table.select("security_id").distinct().count(),
            "links": _counts(table.where(F.col("link_rule") != master.SAME_ISIN), "link_rule"),
            "candidates": _counts(told, "status"),
            "ambiguous_codes": unclear.count(),
            "identifier_changes": changes,
        },
        "curated",
        "master",
    )


def _ledger(spark: SparkSession, store: Store) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Events, ex-sessions, and what tells whether they have changed."""
    events, ex = (store.read(spark, "curated", t) for t in ("events", "ex_sessions"))
    return events, ex, {"events": fingerprint(events), "ex_sessions": fingerprint(ex)}


def build_factors(spark: SparkSession, store: Store, kinds: Mapping[str, str]) -> dict:
    """``derived/factors`` and ``derived/factors_rejected`` from the ledger.

    ``curated/events`` are as :func:`tidemark.operators.factors.event_factors`
    takes them, with ``status``; ``curated/ex_sessions`` hold ``isin, session,
    previous_close``; the closes of spin-off targets come from
    ``curated/bars``. ``kinds`` tells what each type of event does. The factors
    are stamped with the ledger they were built from, see :func:`read_factors`.
    """
    events, ex, built_from = _ledger(spark, store)
    applied = events.where(F.col("status").isin(*APPLIED))
    bars = store.read(spark, "curated", "bars").where(F.col("market_type") == ROUND_LOT).select(F.col("symbol").alias("isin"), "session", "close")
    spin = [t for t, k in kinds.items() if k == factors.SPIN_OFF]
    targets = applied.where(F.col("event_type").isin(spin)).select(F.col("target_isin").alias("isin"))
    closes = factors.target_closes(bars, targets, sessions_of(store.read(spark, "curated", "bars"), "session"))
    found = factors.event_factors(applied, ex.select("isin", "session", F.col("previous_close").alias("close")), kinds, closes)
    named = found.withColumnRenamed("security_id", "symbol")
    store.replace(named.where("reason IS NULL").drop("reason"), "derived", "factors")
    store.replace(named.where("reason IS NOT NULL").select("symbol", "isin", "ex_date", "reason", "event_ids"), "derived", "factors_rejected")
    store.stamp(built_from, "derived", "factors")
    rejected = store.read(spark, "derived", "factors_rejected")
    return _write_summary(
        store,
        {
            "factors": store.read(spark, "derived", "factors").count(),
            "rejected": _counts(rejected, "reason"),
            "ignored": {r.event_type: r.events for r in factors.ignored(applied, kinds).collect()},
        },
        "derived",
        "factors",
    )


def read_factors(spark: SparkSession, store: Store) -> DataFrame:
    """``derived/factors``, if the ledger is still the one they were built from."""
    store.require_fresh(_ledger(spark, store)[2], "derived", "factors")
    return store.read(spark, "derived", "factors")
