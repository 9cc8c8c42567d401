"""Delimited and JSON feeds, and snapshots of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.common import real_date
from tidemark.sources.archives import FormatError


def local_number(text: Column, comma: Column | bool = True) -> Column:
    """``1.234,56`` (or, without ``comma``, ``1234.56``) as a double."""
    plain = F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    chosen = F.when(comma, plain).otherwise(F.trim(text)) if isinstance(comma, Column) else (plain if comma else F.trim(text))
    return chosen.try_cast("double")


def local_date(text: Column) -> Column:
    """``DD/MM/YYYY`` or ``YYYY-MM-DD``; placeholders and blanks are null."""
    text = F.trim(text)
    parsed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).otherwise(F.try_to_date(text, "dd/MM/yyyy"))
    return real_date(parsed)


# -- credits, one file per day -------------------------------------------------------


def read_credits(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Credits of files named ``YYYY-MM-DD.csv``, in either of two languages.

    The header's first cell tells the language: ``Issuer`` (decimal point,
    month first) or ``Emissor`` (decimal comma, day first). Result:
    ``credit_date, isin, distribution_number, label, value, approved_on,
    issuer, source_file``. A file without header, an ISIN without its number,
    and a credit date other than the file's are errors when the rows are read.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_name").alias("source_file"), F.split(F.ltrim(F.regexp_replace("value", "^﻿", "")), ";").alias("c")
    )
    cells = lines.where(F.size("c") == 6).withColumn("c", F.transform("c", lambda x: F.trim(x)))
    head = F.col("c")[0].isin("Issuer", "Emissor")
    comma = cells.where(head).groupBy("source_file").agg((F.min(F.col("c")[0]) == "Emissor").alias("comma"))
    rows = cells.where(~head).join(comma, "source_file", "left")
    day = F.try_to_date(F.regexp_extract("source_file", r"^(\d{4}-\d{2}-\d{2})\.csv$", 1), "yyyy-MM-dd")
    credit = F.when(F.col("comma"), F.try_to_date(F.col("c")[5], "dd/MM/yyyy")).otherwise(F.try_to_date(F.col("c")[5], "MM/dd/yyyy"))
    code = F.split(F.col("c")[1], r"\s+")

    def wrong(what: str, kind: str) -> Column:
        return F.raise_error(F.concat("source_file", F.lit(f": {what}"))).cast(kind)

    return rows.select(
        F.when(F.col("comma").isNull(), wrong("no header", "date")).when(credit.eqNullSafe(day), credit).otherwise(wrong("another credit date than the name", "date")).alias("credit_date"),
        code[0].alias("isin"),
        F.when(F.size(code) == 2, F.get(code, F.lit(1)).try_cast("bigint")).otherwise(wrong("an ISIN without distribution number", "bigint")).alias("distribution_number"),
        F.upper(F.col("c")[2]).alias("label"),
        local_number(F.col("c")[4], F.col("comma")).alias("value"),
        F.try_to_date(F.col("c")[3], "dd/MM/yyyy").alias("approved_on"),
        F.col("c")[0].alias("issuer"),
        "source_file",
    )


# -- company answers, full snapshots of JSON pages -------------------------------------


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# The field names of the feed's documents.
_SUPPLEMENT = T.StructType(
    [
        T.StructField("stockDividends", T.ArrayType(_text("isinCode", "assetIssued", "label", "factor", "lastDatePrior", "approvedOn"))),
        T.StructField("cashDividends", T.ArrayType(_text("isinCode", "label", "rate", "lastDatePrior", "approvedOn", "paymentDate", "relatedTo"))),
        T.StructField("subscriptions", T.ArrayType(_text("isinCode", "assetIssued", "label", "percentage", "priceUnit", "lastDatePrior", "approvedOn", "subscriptionDate"))),
    ]
)
_PAGE = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(_text("typeStock", "corporateAction", "valueCash", "quotedPerShares", "lastDatePriorEx", "dateApproval", "closingPricePriorExDate")),
        )
    ]
)


def _json(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """``path`` and the fields of one JSON document per file; bad JSON is an error."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    return reader.json(list(paths)).select(F.col("_metadata.file_path").alias("path"), "*")


def _from_path(pattern: str) -> Column:
    return F.regexp_extract("path", pattern, 1)


_SNAPSHOT = r"/(\d{4}-\d{2}-\d{2})/"


def read_supplements(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """Tables ``stock``, ``cash_recent`` and ``subscriptions`` of the supplements.

    ``paths`` are ``.../YYYY-MM-DD/supplement/CODE.json``.
    """
    data = _json(spark, paths, _SUPPLEMENT)
    base = [F.to_date(_from_path(_SNAPSHOT)).alias("snapshot"), _from_path(r"/([^/]+)\.json$").alias("code")]

    def items(field: str) -> DataFrame:
        return data.select(*base, F.inline(field))

    stock = items("stockDividends").select(
        "snapshot",
        "code",
        F.trim("isinCode").alias("isin"),
        F.trim(F.coalesce("assetIssued", F.lit(""))).alias("target_isin"),
        F.trim("label").alias("label"),
        local_number(F.col("factor")).alias("factor"),
        local_date(F.col("lastDatePrior")).alias("last_cum_date"),
        local_date(F.col("approvedOn")).alias("approved_on"),
    )
    cash = items("cashDividends").select(
        "snapshot",
        "code",
        F.trim("isinCode").alias("isin"),
        F.trim("label").alias("label"),
        local_number(F.col("rate")).alias("cash_amount"),
        local_date(F.col("lastDatePrior")).alias("last_cum_date"),
        local_date(F.col("approvedOn")).alias("approved_on"),
        local_date(F.col("paymentDate")).alias("payment_date"),
        F.trim("relatedTo").alias("related_to"),
    )
    subscriptions = items("subscriptions").select(
        "snapshot",
        "code",
        F.trim("isinCode").alias("isin"),
        F.trim(F.coalesce("assetIssued", F.lit(""))).alias("target_isin"),
        F.trim("label").alias("label"),
        local_number(F.col("percentage")).alias("percentage"),
        local_number(F.col("priceUnit")).alias("price"),
        local_date(F.col("lastDatePrior")).alias("last_cum_date"),
        local_date(F.col("approvedOn")).alias("approved_on"),
        local_date(F.col("subscriptionDate")).alias("subscription_date"),
    )
    return {name: merge_snapshots(df.withColumn("answer", F.lit(""))) for name, df in (("stock", stock), ("cash_recent", cash), ("subscriptions", subscriptions))}


def read_cash_pages(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``cash_history`` of ``.../YYYY-MM-DD/cash_dividends/CODE/page-[NAME-]NNN.json``."""
    rows = _json(spark, paths, _PAGE).select(
        F.to_date(_from_path(_SNAPSHOT)).alias("snapshot"),
        _from_path(r"/cash_dividends/([^/]+)/").alias("code"),
        _from_path(r"/page-(?:(.*)-)?[^-/]*\.json$").alias("answer"),
        F.inline("results"),
    )
    quoted = F.greatest(F.coalesce(F.col("quotedPerShares").try_cast("double"), F.lit(1.0)), F.lit(1.0))
    found = rows.select(
        "snapshot",
        "code",
        F.trim("typeStock").alias("share_class"),
        F.trim("corporateAction").alias("label"),
        (local_number(F.col("valueCash")) / quoted).alias("cash_amount"),
        local_date(F.col("lastDatePriorEx")).alias("last_cum_date"),
        local_date(F.col("dateApproval")).alias("approved_on"),
        (F.coalesce(local_number(F.col("closingPricePriorExDate")), F.lit(0.0)) / quoted).alias("closing_price"),
        "answer",
    )
    return merge_snapshots(found)


def merge_snapshots(df: DataFrame, snapshot: str = "snapshot", answer: str = "answer") -> DataFrame:
    """Each distinct row as often as the answer that lists it most has it.

    Repeats inside one answer are rows of their own (instalments); the same
    row in several answers or snapshots is one. The latest snapshot that has
    it stays. Counting replaces numbering, so a hot row is combined map-side.
    """
    content = [c for c in df.columns if c not in (snapshot, answer)]
    counted = df.groupBy(snapshot, answer, *content).agg(F.count("*").alias("_n"))
    # Copy i is last seen in the latest snapshot in which an answer has i of it.
    copies = counted.select(snapshot, *content, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"))
    return copies.groupBy(*content, "_copy").agg(F.max(snapshot).alias(snapshot)).select(snapshot, *content)


# -- retroactive compositions ------------------------------------------------------------


def read_compositions(spark: SparkSession, path: str) -> DataFrame:
    """``period, ticker, name, share_class, weight_pct`` of a CSV; checked."""
    columns = ["period", "ticker", "name", "share_class", "weight_pct"]
    raw = spark.read.csv(path, header=True)
    if missing := sorted(set(columns) - set(raw.columns)):
        raise FormatError(f"{path}: no column {', '.join(missing)}")
    rows = raw.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in columns))
    weight = F.col("weight_pct").try_cast("double")
    again = F.count("*").over(Window.partitionBy("period", "ticker")) > 1
    problem = (
        F.when(~F.col("period").rlike(r"^\d{4}-(01|05|09)$"), "a malformed period")
        .when(~F.col("ticker").rlike(r"^[A-Z0-9]{4}\d{1,2}$"), "a malformed ticker")
        .when(weight.isNull(), "a weight that is no number")
        .when(again, "a repeated (period, ticker)")
    )
    broken = rows.withColumn("problem", problem).where("problem IS NOT NULL").limit(5).collect()
    if broken:
        raise FormatError(f"{path}: " + "; ".join(f"{r.problem}: {r.period} {r.ticker}" for r in broken))
    return rows.withColumn("weight_pct", weight)
