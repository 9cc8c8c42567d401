"""Bars, returns and trades derived from the test tables, in Spark and in SQL.

``bars`` are daily bars of each brand (with natural gaps), ``dense`` those of
each part type (nearly none). The SQL texts are common table expressions for
the queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.common import table
from tidemark.functions.kernels import simple_returns
from tidemark.session import cut_lineage


def bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    """``symbol, session, open, high, low, close, volume, traded_value``.

    One price per line, in the total order of the line's keys; first and last
    price are ordered aggregates, so the lines are shuffled once.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.to_date("l_shipdate").alias("session"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        "l_extendedprice",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"),
    )
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("symbol", "session")
        .agg(
            F.min_by("px", "k").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "k").alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("traded_value"),
        )
    )


def bars_once(spark: SparkSession, sf_dir: str, *columns: str, symbol: str = "p_brand") -> DataFrame:
    """Bars that a query uses more than once, computed and kept when this is called.

    The lines are read once; what is kept is a row for each symbol and session.
    """
    found = bars(spark, sf_dir, symbol)
    return cut_lineage(found.select(*columns) if columns else found)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series, session, r``: simple returns of each part type's close."""
    closes = bars(spark, sf_dir, "p_type").select(F.col("symbol").alias("series"), "session", "close")
    return closes.select("series", "session", simple_returns("close", "series").alias("r")).where("r IS NOT NULL")


def with_benchmark(rows: DataFrame) -> DataFrame:
    """Adds ``b``, the mean return of all series of the session."""
    return rows.withColumn("b", F.avg("r").over(Window.partitionBy("session")))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series, seq, result``: open-to-close results of each type's days."""
    return bars(spark, sf_dir, "p_type").select(
        F.col("symbol").alias("series"),
        F.datediff("session", F.lit("1970-01-01").cast("date")).cast("bigint").alias("seq"),
        F.round(F.col("close") / F.col("open") - 1, 2).alias("result"),
    )


def _bars_sql(symbol: str) -> str:
    return f"""
px AS (SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS session, l_extendedprice / l_quantity AS px,
    l_quantity, l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT symbol, session, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) AS traded_value
  FROM px GROUP BY symbol, session)"""


BARS = _bars_sql("p_brand")
DENSE = _bars_sql("p_type")
RETURNS = f"""{DENSE},
rets AS (SELECT series, session, r FROM (
    SELECT symbol AS series, session, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS r FROM bars)
  WHERE r IS NOT NULL)"""
PAIRED = f"""{RETURNS},
paired AS (SELECT *, avg(r) OVER (PARTITION BY session) AS b FROM rets)"""
TRADES = f"""{DENSE},
trades AS (SELECT symbol AS series, date_diff('day', DATE '1970-01-01', session) AS seq,
    round(close / open - 1, 2) AS result FROM bars)"""
