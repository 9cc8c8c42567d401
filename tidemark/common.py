"""Small column helpers shared by all modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dates that stand for "unknown" in the feeds (fixed values).
PLACEHOLDER_DATES = ("1900-01-01", "9999-12-31")

SPACES = " \t\r\n\x0b\x0c\xa0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm(column: Column | str) -> Column:
    """Trimmed, upper-case text; identifiers are compared in this form."""
    column = F.col(column) if isinstance(column, str) else column
    return F.upper(F.btrim(column, F.lit(SPACES)))


def iso(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def real_date(column: Column | str) -> Column:
    """The date, or null for a placeholder date."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~column.isin(*(F.lit(d).cast("date") for d in PLACEHOLDER_DATES)), column)


def finite(column: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def missing_as_null(column: Column | str) -> Column:
    """NaN and infinities as null: null is the only missing marker inside."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(finite(column), column)
