"""Annual files of fixed-width trading records, one ZIP per year."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.archives import FormatError, zipped_lines

RECORD = 245

#: First and last position of each field, from 1 (fixed values).
FIELDS = {
    "session_date": (3, 10),
    "bdi_code": (11, 12),
    "ticker": (13, 24),
    "market_type": (25, 27),
    "company_name": (28, 39),
    "specification": (40, 49),
    "currency": (53, 56),
    "open": (57, 69),
    "high": (70, 82),
    "low": (83, 95),
    "average": (96, 108),
    "close": (109, 121),
    "best_bid": (122, 134),
    "best_ask": (135, 147),
    "trades": (148, 152),
    "volume_shares": (153, 170),
    "traded_value": (171, 188),
    "quotation_factor": (211, 217),
    "isin": (231, 242),
    "distribution_number": (243, 245),
}
PRICES = ("open", "high", "low", "average", "close", "best_bid", "best_ask")
FIRST_SESSION = "1994-07-01"
MARKETS = ("010", "020")


def _cut(name: str) -> Column:
    first, last = FIELDS[name]
    return F.substring("line", first, last - first + 1)


def _repaired() -> Column:
    """A line of the wrong length that is UTF-8 inside Latin-1, put right."""
    again = F.decode(F.encode("line", "ISO-8859-1"), "UTF-8")
    return F.when(F.length("line") != RECORD, again).otherwise(F.col("line"))


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, year, line_no, line, repaired`` of annual archives."""
    lines = zipped_lines(spark, paths)
    year = F.regexp_extract("file", r"(?i)A(\d{4})\.ZIP$", 1).try_cast("int")
    return lines.withColumn("_r", _repaired()).select(
        "file", year.alias("year"), "line_no", F.col("_r").alias("line"), (F.col("_r") != F.col("line")).alias("repaired")
    )


def file_report(lines: DataFrame) -> DataFrame:
    """One row per file with its counts, and ``problem`` where it is broken.

    The first record is the header (00) and the last the trailer (99); there
    is no other of either; every record has 245 characters and a known type;
    the header's year is that of the name; the trailer counts all records or
    the details only.
    """
    kind = F.substring("line", 1, 2)
    per = lines.groupBy("file").agg(
        F.first("year").alias("year"),
        F.count("*").alias("records_read"),
        F.sum(F.col("repaired").cast("int")).alias("rows_repaired"),
        F.min_by("line", "line_no").alias("_head"),
        F.max_by("line", "line_no").alias("_tail"),
        F.sum((kind == "00").cast("int")).alias("_heads"),
        F.sum((kind == "99").cast("int")).alias("_tails"),
        F.min(F.when(F.length("line") != RECORD, F.col("line_no"))).alias("_short"),
        F.min(F.when(~kind.isin("00", "01", "99"), F.col("line_no"))).alias("_unknown"),
    )
    counted = F.substring("_tail", 32, 11).try_cast("bigint")
    n = F.col("records_read")
    problem = (
        F.when(F.col("year").isNull(), "the name has no year")
        .when(F.col("_short").isNotNull(), F.concat(F.lit("wrong length in line "), F.col("_short")))
        .when(F.col("_unknown").isNotNull(), F.concat(F.lit("unknown record in line "), F.col("_unknown")))
        .when((F.substring("_head", 1, 2) != "00") | (F.col("_heads") != 1), "not one header, in front")
        .when((F.substring("_tail", 1, 2) != "99") | (F.col("_tails") != 1), "not one trailer, at the end")
        .when(F.substring("_head", 12, 4).try_cast("int") != F.col("year"), "the header has another year than the name")
        .when(~F.coalesce(counted.isin(n, n - 2), F.lit(False)), "the trailer counts other records")
    )
    convention = F.when(counted == n, "all_records").otherwise("detail_records")
    return per.select("file", "year", "records_read", "rows_repaired", convention.alias("trailer_counts"), problem.alias("problem"))


def decode(lines: DataFrame) -> DataFrame:
    """The detail records of cash markets as typed rows.

    A field that should be digits and is not, a quotation factor of zero, or
    another currency stops the query. Prices are per single share.
    """
    rows = lines.where((F.substring("line", 1, 2) == "01") & _cut("market_type").isin(*MARKETS))

    def number(name: str, kind: str = "bigint") -> Column:
        text = _cut(name)
        wrong = F.raise_error(F.concat("file", F.lit(", line "), F.col("line_no").cast("string"), F.lit(f": {name} is no number")))
        return F.when(text.rlike("^[0-9]+$"), text.cast(kind)).otherwise(wrong.cast(kind))

    day = F.try_to_date(_cut("session_date"), "yyyyMMdd")
    factor = F.when(number("quotation_factor", "int") > 0, number("quotation_factor", "int")).otherwise(
        F.raise_error(F.lit("a quotation factor of zero")).cast("int")
    )
    typed = rows.withColumn("_f", factor).select(
        "file",
        "line_no",
        F.when(day.isNotNull(), day).otherwise(F.raise_error(F.lit("no session date")).cast("date")).alias("session_date"),
        F.trim(_cut("ticker")).alias("ticker"),
        F.trim(_cut("isin")).alias("isin"),
        number("market_type", "smallint").alias("market_type"),
        number("bdi_code", "smallint").alias("bdi_code"),
        F.trim(_cut("specification")).alias("specification"),
        F.trim(_cut("company_name")).alias("company_name"),
        number("distribution_number", "smallint").alias("distribution_number"),
        *((number(c).cast("double") / F.lit(100.0) / F.col("_f")).alias(c) for c in PRICES),
        number("trades").alias("trades"),
        number("volume_shares").alias("volume_shares"),
        (number("traded_value").cast("double") / F.lit(100.0)).alias("traded_value"),
        F.col("_f").alias("quotation_factor"),
        _cut("currency").alias("_currency"),
    )
    kept = typed.where(F.col("session_date") >= F.lit(FIRST_SESSION).cast("date"))
    other = F.raise_error(F.concat(F.lit("another currency than R$: "), F.col("_currency"))).cast("string")
    return kept.withColumn("ticker", F.when(F.trim("_currency") == "R$", F.col("ticker")).otherwise(other)).drop("_currency")


KEY = ["session_date", "ticker", "market_type", "isin"]


def read_annual(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Checked rows of annual archives; a broken file or repeated key is an error."""
    named = [p for p in paths if not re.search(r"A\d{4}\.ZIP$", p, re.IGNORECASE)]
    if named:
        raise FormatError(f"not the name of an annual archive: {named}")
    lines = read_lines(spark, paths)
    broken = file_report(lines).where("problem IS NOT NULL").select("file", "problem").collect()
    if broken:
        raise FormatError("; ".join(f"{r.file}: {r.problem}" for r in broken))
    rows = decode(lines)
    again = rows.groupBy(*KEY).count().where("count > 1").limit(1).collect()
    if again:
        raise FormatError(f"a repeated key: {again[0].asDict()}")
    return rows.drop("file", "line_no")
