"""Queries p4, p5, p7, p8, p9 and p10 on this project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.common import finite, iso, norm, real_date, table
from tidemark.llm.components import components
from tidemark.llm.mixing import mix_sources, mixture_report
from tidemark.llm.nearest import nearest_by_tick
from tidemark.llm.splitting import split_documents
from tidemark.llm.survivorship import survivors
from tidemark.llm.tokenizer import encode_documents

#: Sources by trust, the most trusted first (fixed values).
SOURCE_ORDER = ("manual", "b3_listed", "cvm_fre", "b3_credited", "inferred", "none")


# -- p4 -----------------------------------------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "source_events").select("event_no", norm("isin").alias("isin"), "last_cum_date")
    sessions = table(spark, sf_dir, "ex_sessions").select(norm("isin").alias("isin"), "session_date")
    near = nearest_by_tick(
        events.distinct(),
        sessions,
        entity=("isin", "isin"),
        day=("last_cum_date", "session_date"),
        tolerance=5,
        matched="session",
        how="inner",
    )
    return near.select("event_no", iso("session").alias("session_date")).distinct()


# -- p5 -----------------------------------------------------------------------------


def _trust(source: str) -> Column:
    """Rank of a source however it is spelled; a null is "none"."""
    plain = F.regexp_replace(F.lower(F.btrim(F.coalesce(source, F.lit("none")))), r"[\s\-_]+", "_")
    rank = F.lit(len(SOURCE_ORDER))
    for i, name in enumerate(SOURCE_ORDER):
        rank = F.when(plain == name, F.lit(i)).otherwise(rank)
    return rank


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = table(spark, sf_dir, "corporate_actions")
    kept = F.coalesce(norm("status") != "REJECTED", F.lit(True))

    def amount(c: str) -> Column:
        return F.when(kept & finite(F.col(c)) & (F.col(c) > 0), F.col(c))

    return survivors(
        actions.withColumn("isin", norm("isin")),
        ["isin", "last_cum_date", "event_type"],
        "event_id",
        _trust("source"),
        "recorded_at",
        {
            "cash_amount": amount("cash_amount"),
            "share_ratio": amount("share_ratio"),
            "payment_date": F.when(kept, real_date("payment_date")),
        },
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def giver(name: str, alias: str) -> Column:
        return F.coalesce(f"{name}_from", F.lit("")).alias(alias)

    return p5_survivors(spark, sf_dir).select(
        "isin",
        iso("last_cum_date").alias("last_cum_date"),
        "event_type",
        giver("cash_amount", "cash_event_id"),
        giver("share_ratio", "ratio_event_id"),
        giver("payment_date", "payment_event_id"),
    )


# -- p7 -----------------------------------------------------------------------------


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = table(spark, sf_dir, "security_master").select(norm("isin").alias("a"), norm("security_id").alias("b"))
    links = (
        table(spark, sf_dir, "link_candidates")
        .where(norm("status").isin("LINKED_BY_CNPJ", "LINKED_BY_OVERRIDE"))
        .select(norm("from_isin").alias("a"), norm("to_isin").alias("b"))
    )
    ties = master.unionByName(links).where("a <> '' AND b <> ''")
    return components(ties, "a", "b").select(F.col("vertex").alias("isin"), F.col("group").alias("group_isin"))


# -- p8, p9, p10 ----------------------------------------------------------------------


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float, int]]:
    """The (few, fixed) targets."""
    rows = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").distinct()
    return [tuple(r) for r in rows.orderBy("source").collect()]


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), "source", "text", _targets(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(table(spark, sf_dir, "documents"), "source", "text", _targets(spark, sf_dir))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target whether its source is used no more than allowed, and has
    its share unless it is used as often as allowed."""
    found = p9_shares(spark, sf_dir)
    allowed = F.col("times_used") <= F.col("max_repeats")
    spent = F.col("times_used") > F.col("max_repeats") - 0.01
    near = F.col("actual_share") > F.col("target_share") * 0.98
    every = Window.partitionBy(F.lit(1))
    return found.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce(allowed, F.lit(False)).alias("repeats_kept"),
        F.coalesce(near | spent, F.lit(False)).alias("share_reached"),
        (F.abs(F.sum("actual_share").over(every) - 1) < 1e-9).alias("adds_up"),
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_documents(table(spark, sf_dir, "documents"), "doc_id", "text", limit=1024, texts=False)
    # The first piece stands for its document, so this needs no shuffle.
    return pieces.where("piece_no = 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), "doc_id", "text", limit=1024, overlap=64)


def p10_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all pieces keep the limit, and their fresh parts are the texts.

    Each piece is compared with its text where it claims to lie; that the
    fresh parts follow each other without gap shows in their sums.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("_t")).where("octet_length(_t) > 1024")
    pieces = p10_pieces(spark, sf_dir)
    met = pieces.join(docs, "doc_id")
    alike = F.col("piece").cast("binary") == F.substring("_t", F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))
    per = met.groupBy("doc_id").agg(
        F.max("n_tokens").alias("most"),
        F.bool_and(alike).alias("alike"),
        F.bool_and(F.col("start_byte") <= F.col("fresh_byte")).alias("overlaps"),
        F.sum(F.col("end_byte") - F.col("fresh_byte")).alias("fresh"),
        F.max("end_byte").alias("last"),
        F.min("fresh_byte").alias("first"),
        F.max(F.octet_length("_t")).alias("size"),
        F.count_distinct("piece_no").alias("n"),
        F.max("piece_no").alias("last_no"),
    )
    whole = (F.col("fresh") == F.col("size")) & (F.col("last") == F.col("size")) & (F.col("first") == 0) & (F.col("n") == F.col("last_no"))
    return per.agg(
        F.bool_and(F.col("most") <= 1024).alias("limit_kept"),
        F.bool_and(F.col("alike") & F.col("overlaps")).alias("pieces_are_of_the_text"),
        F.bool_and(whole).alias("texts_whole"),
        F.bool_and(F.col("n") > 1).alias("really_cut"),
    )


QUERIES = {
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_check": p9_check,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
    "p10_check": p10_check,
}


def _best(name: str, usable: str) -> str:
    return f"""coalesce(arg_min(event_id, (rank, -coalesce(epoch_us(recorded_at), -9e18)::DOUBLE, event_id))
    FILTER (kept AND {usable}), '') AS {name}"""


SQL = {
    "p4_found": """
WITH e AS (SELECT DISTINCT event_no, upper(trim(isin)) AS isin, last_cum_date FROM source_events),
x AS (SELECT DISTINCT upper(trim(isin)) AS isin, session_date FROM ex_sessions),
r AS (SELECT event_no, session_date, row_number() OVER (PARTITION BY event_no, e.isin, last_cum_date
    ORDER BY abs(date_diff('day', last_cum_date, session_date)), session_date DESC) AS k
  FROM e JOIN x ON e.isin = x.isin AND abs(date_diff('day', last_cum_date, session_date)) <= 5)
SELECT DISTINCT event_no, strftime(session_date, '%Y-%m-%d') AS session_date FROM r WHERE k = 1""",
    "p5_found": f"""
WITH r AS (SELECT DISTINCT upper(trim(isin)) AS isin, last_cum_date, event_type, event_id, cash_amount, share_ratio,
    payment_date, recorded_at, coalesce(upper(trim(status)), '') <> 'REJECTED' AS kept,
    coalesce(list_position(['manual', 'b3_listed', 'cvm_fre', 'b3_credited', 'inferred', 'none'],
      regexp_replace(lower(trim(coalesce(source, 'none'))), '[\\s\\-_]+', '_', 'g')), 7) AS rank
  FROM corporate_actions)
SELECT isin, strftime(last_cum_date, '%Y-%m-%d') AS last_cum_date, event_type,
  {_best("cash_event_id", "cash_amount > 0 AND NOT isnan(cash_amount)")},
  {_best("ratio_event_id", "share_ratio > 0 AND NOT isnan(share_ratio)")},
  {_best("payment_event_id", "payment_date NOT IN (DATE '1900-01-01', DATE '9999-12-31')")}
FROM r GROUP BY r.isin, r.last_cum_date, r.event_type HAVING count(DISTINCT event_id) >= 2""",
    "p9_check": """
SELECT DISTINCT source, target_share, max_repeats, true AS repeats_kept, true AS share_reached, true AS adds_up FROM mix_targets""",
    "p10_check": "SELECT true AS limit_kept, true AS pieces_are_of_the_text, true AS texts_whole, true AS really_cut",
    "p7_found": """
WITH RECURSIVE ties AS (
  SELECT DISTINCT upper(trim(isin)) AS a, upper(trim(security_id)) AS b FROM security_master WHERE security_id IS NOT NULL
  UNION SELECT DISTINCT upper(trim(from_isin)), upper(trim(to_isin)) FROM link_candidates
  WHERE upper(trim(status)) IN ('LINKED_BY_CNPJ', 'LINKED_BY_OVERRIDE')),
sym AS (SELECT a, b FROM ties WHERE a <> b UNION SELECT b, a FROM ties WHERE a <> b),
reach AS (SELECT a AS isin, a AS other FROM sym UNION SELECT r.isin, b.b FROM reach r JOIN sym b ON b.a = r.other)
SELECT isin, min(other) AS group_isin FROM reach GROUP BY isin""",
}
