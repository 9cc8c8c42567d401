"""Building permanent identities: links between listings, and the chains they form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identifiers import implied_factor, is_isin
from tidemark.operators.identity import judged_links
from tidemark.session import cut_lineage

# How a link came about, and what became of a candidate.
INTERNAL_CODE, CNPJ, OVERRIDE = "internal_code", "cnpj", "override"
FOUNDING, SAME_ISIN = "founding", "same_isin"
LINKED_BY_CNPJ, LINKED_BY_OVERRIDE = "linked_by_cnpj", "linked_by_override"
REJECTED, CONFLICT, SUPERSEDED, PENDING, LIKELY = "rejected", "conflict", "superseded", "pending", "likely"


class MasterError(ValueError):
    """Links that cannot make chains."""


def timed_nodes(spans: DataFrame, main: Column) -> DataFrame:
    """One row per ISIN with its life and its first and last ticker.

    ``spans``: ``isin, ticker, first_session, last_session`` and what ``main``
    needs. Lives are those of the spans that ``main`` picks, of all spans
    where an ISIN has none of those. Ties go to the smaller ticker.
    """
    w = Window.partitionBy("isin")
    marked = spans.where("isin IS NOT NULL").withColumn("_m", F.coalesce(main, F.lit(False)))
    timed = marked.withColumn("_any", F.bool_or("_m").over(w)).where("_m OR NOT _any")
    return timed.groupBy("isin").agg(
        F.min("first_session").alias("first_session"),
        F.max("last_session").alias("last_session"),
        F.min_by("ticker", F.struct("first_session", "ticker")).alias("first_ticker"),
        F.max_by("ticker", F.struct("last_session", "ticker")).alias("last_ticker"),
    )


def issuer_ids(filings: DataFrame, spans: DataFrame) -> DataFrame:
    """``issuer, cnpj, ambiguous``: whom the filings of a year name behind an issuer code.

    ``filings``: ``reference_year, ticker, cnpj``; ``spans``: ``isin, ticker,
    first_session, last_session``. A filing speaks of the ISINs that carried
    its ticker at some day of its year; the issuer code is characters 3 to 6
    of a valid ISIN. Where several companies are named ``cnpj`` is null.
    Spans are exploded to their years, so both sides meet by equality.
    """
    years = spans.where(is_isin("isin")).select(
        "ticker", F.substring("isin", 3, 4).alias("issuer"), F.explode(F.sequence(F.year("first_session"), F.year("last_session"))).alias("_y")
    ).distinct()
    named = filings.select("ticker", F.col("reference_year").cast("int").alias("_y"), "cnpj").where("cnpj IS NOT NULL").distinct()
    met = years.join(named, ["ticker", "_y"]).groupBy("issuer").agg(F.min("cnpj").alias("a"), F.max("cnpj").alias("b"))
    return met.select("issuer", F.when(F.col("a") == F.col("b"), F.col("a")).alias("cnpj"), (F.col("a") != F.col("b")).alias("ambiguous"))


def internal_code_links(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes from before ISINs, and the only ISIN their ticker goes on under.

    A code that is no ISIN continues as the ISIN that carries its ticker
    later, if there is only one such. Returns the links ``from_, to_`` and the
    ambiguous codes ``isin``. An ISIN that several codes claim goes to the one
    that ended last (then the smaller), the others stay by themselves.
    """
    valid = spans.withColumn("_is", is_isin("isin"))
    old = valid.where("NOT _is").select(F.col("isin").alias("from_"), "ticker", F.col("last_session").alias("_end"))
    new = valid.where("_is").select(F.col("isin").alias("to_"), "ticker", F.col("first_session").alias("_start"))
    met = old.join(new, "ticker").where(F.col("_start") > F.col("_end"))
    per = met.groupBy("from_").agg(F.min("to_").alias("to_"), F.max("to_").alias("_other"), F.max("_end").alias("_end"))
    sole = per.where("to_ = _other")
    claimed = F.row_number().over(Window.partitionBy("to_").orderBy(F.col("_end").desc(), "from_"))
    return sole.withColumn("_n", claimed).where("_n = 1").select("from_", "to_"), per.where("to_ <> _other").select(F.col("from_").alias("isin"))


def priced_candidates(pairs: DataFrame, nodes: DataFrame, bars: DataFrame) -> DataFrame:
    """Candidate pairs ``from_, to_, gap_sessions`` with tickers, companies and prices.

    ``nodes`` as :func:`timed_nodes` with ``cnpj``; ``bars``: ``isin, session,
    open, close``. Adds ``from_ticker, from_last_session, to_ticker,
    to_first_session, from_cnpj, to_cnpj, old_close, new_open, ratio,
    implied_factor``: the last close, the first open, and what factor their
    ratio reads as.
    """
    old = nodes.select(F.col("isin").alias("from_"), F.col("last_ticker").alias("from_ticker"), F.col("last_session").alias("from_last_session"), F.col("cnpj").alias("from_cnpj"))
    new = nodes.select(F.col("isin").alias("to_"), F.col("first_ticker").alias("to_ticker"), F.col("first_session").alias("to_first_session"), F.col("cnpj").alias("to_cnpj"))
    closes = bars.groupBy(F.col("isin").alias("from_"), F.col("session").alias("from_last_session")).agg(F.max("close").alias("old_close"))
    opens = bars.groupBy(F.col("isin").alias("to_"), F.col("session").alias("to_first_session")).agg(F.max("open").alias("new_open"))
    met = pairs.join(old, "from_").join(new, "to_").join(closes, ["from_", "from_last_session"], "left").join(opens, ["to_", "to_first_session"], "left")
    ratio = F.try_divide(F.col("new_open"), F.col("old_close"))
    return met.withColumn("ratio", ratio).withColumn("implied_factor", implied_factor("ratio"))


def decided(candidates: DataFrame, links: DataFrame, overrides: DataFrame, rejections: DataFrame, likely: tuple[float, float] = (0.8, 1.25)) -> DataFrame:
    """``candidates`` with ``status``, one of the fixed words above.

    ``links`` (``from_, to_``) are those there already, of internal codes and
    overrides; ``overrides`` and ``rejections`` are pairs decided by hand,
    and a rejection of no candidate is an error. Pairs of one company are
    linked closest first (:func:`tidemark.operators.identity.judged_links`);
    crowded ones are conflicts. Of the rest those with a linked end are
    superseded, the others pending, and likely where neither end has another
    pending partner and the price goes on.
    """
    pair = ["from_", "to_"]
    known = candidates.select(*pair)
    stray = rejections.select(*pair).join(known, pair, "left_anti").limit(3).collect()
    if stray:
        raise MasterError(f"rejected pairs that are no candidates: {[tuple(r) for r in stray]}")
    by_hand = overrides.select(*pair).withColumn("_hand", F.lit(LINKED_BY_OVERRIDE)).unionByName(rejections.select(*pair).withColumn("_hand", F.lit(REJECTED)))
    by_hand = by_hand.groupBy(*pair).agg(F.min("_hand").alias("_hand"))
    rows = cut_lineage(candidates.join(by_hand, pair, "left"))
    taken = links.select(*pair).distinct()
    free = rows.where("_hand IS NULL")
    for end in pair:
        free = free.join(taken.select(end).distinct(), end, "left_anti")
    confirmed = free.where("from_cnpj IS NOT NULL AND from_cnpj = to_cnpj").select(*pair, "gap_sessions")
    judged = judged_links(confirmed)
    new = judged.where("linked")
    every = taken.unionByName(new.select(*pair)).distinct()
    marked = rows.join(new.select(*pair, F.lit(LINKED_BY_CNPJ).alias("_new")), pair, "left")
    for end in pair:
        marked = marked.join(every.select(F.col(end)).distinct().withColumn(f"_has{end}", F.lit(True)), end, "left")
    conflicts = judged.where("NOT linked").select(*pair, F.lit(CONFLICT).alias("_conflict"))
    marked = marked.join(conflicts, pair, "left")
    linked = F.coalesce(F.col("_hasfrom_"), F.col("_hasto_"), F.lit(False))
    status = (
        F.when(F.col("_hand").isNotNull(), F.col("_hand"))
        .when(F.col("_new").isNotNull(), F.col("_new"))
        .when(F.col("_conflict").isNotNull(), F.col("_conflict"))
        .when(linked, SUPERSEDED)
        .otherwise(PENDING)
    )
    told = marked.withColumn("status", status)
    waiting = F.when(F.col("status") == PENDING, 1).otherwise(0)
    alone = (F.sum(waiting).over(Window.partitionBy("from_")) == 1) & (F.sum(waiting).over(Window.partitionBy("to_")) == 1)
    goes_on = F.coalesce(F.col("ratio").between(*likely), F.lit(False))
    told = told.withColumn("status", F.when((F.col("status") == PENDING) & alone & goes_on, LIKELY).otherwise(F.col("status")))
    return told.select(*candidates.columns, "status")


def require_chains(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links`` (``from_, to_``) if each listing has one successor and one
    predecessor at most, both are known, and the new one began after the old
    one ended; else an error. Runs when it is called."""
    life = nodes.select("isin", "first_session", "last_session")
    met = links.join(life.select(F.col("isin").alias("from_"), F.col("last_session").alias("_end")), "from_", "left")
    met = met.join(life.select(F.col("isin").alias("to_"), F.col("first_session").alias("_start")), "to_", "left")
    told = F.when(F.col("_end").isNull() | F.col("_start").isNull(), "names an unknown listing").when(
        F.col("_start") <= F.col("_end"), "joins a listing that traded before the other ended"
    )
    forks = [
        links.groupBy(end).count().where("count > 1").select(F.concat(F.col(end), F.lit(f" has two {what}")).alias("m"))
        for end, what in (("from_", "successors"), ("to_", "predecessors"))
    ]
    bad = met.where(told.isNotNull()).select(F.concat("from_", F.lit(" -> "), "to_", F.lit(" "), told).alias("m"))
    found = bad.unionByName(forks[0]).unionByName(forks[1]).limit(1).collect()
    if found:
        raise MasterError(found[0][0])
    return links


def chain_ids(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``isin, security_id``: the earliest listing of each chain names the security.

    Every listing points to its predecessor and, round by round, to whatever
    that points to, so the way to the first one halves; the rounds are as many
    as the logarithm of the longest chain, each checkpointed. A cycle is an
    error. Runs when it is called.
    """
    before = links.select(F.col("to_").alias("isin"), F.col("from_").alias("up"))
    now = cut_lineage(nodes.select("isin").distinct().join(before, "isin", "left").select("isin", F.coalesce("up", "isin").alias("up")))
    for _ in range(max_rounds):
        above = now.select(F.col("isin").alias("up"), F.col("up").alias("_top"))
        moved = cut_lineage(now.join(above, "up", "left").select("isin", F.coalesce("_top", "up").alias("_to"), "up"))
        done = moved.where("_to <> up").isEmpty()
        now = moved.select("isin", F.col("_to").alias("up"))
        if done:
            return now.select("isin", F.col("up").alias("security_id"))
    raise MasterError(f"links form a cycle, or chains longer than 2^{max_rounds}")


def security_master(spans: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``spans`` with ``security_id, link_rule, cnpj``.

    ``links``: ``from_, to_, rule``. The first span of an ISIN (by first
    session, ticker, market) tells how the ISIN came to its security, the
    others that they are of the same ISIN.
    """
    require_chains(links.select("from_", "to_"), nodes)
    ids = chain_ids(nodes, links)
    rules = links.select(F.col("to_").alias("isin"), F.col("rule").alias("_rule"))
    order: Sequence[Column] = [F.col(c) for c in ("first_session", "ticker", "market_type") if c in spans.columns]
    first = F.row_number().over(Window.partitionBy("isin").orderBy(*order)) == 1
    met = spans.join(ids, "isin").join(rules, "isin", "left").join(nodes.select("isin", "cnpj"), "isin", "left")
    rule = F.when(F.col("_first"), F.coalesce("_rule", F.lit(FOUNDING))).otherwise(F.lit(SAME_ISIN))
    return met.withColumn("_first", first).withColumn("link_rule", rule).select(*spans.columns, "security_id", "link_rule", "cnpj")
