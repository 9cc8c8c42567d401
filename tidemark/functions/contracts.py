"""Contracts of the inputs of analytics, checked in one pass over the rows.

Each function returns its table unchanged or raises ``ValueError``; each runs
a Spark job when it is called, an aggregation of the rows per series of which
only the first fault reaches the driver. Missing values are allowed at the
edges of a series only: a hole inside is a fault upstream, and filling it
would hide that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _numeric(df: DataFrame, column: str, name: str) -> None:
    if column not in df.columns:
        raise ValueError(f"{name} needs a column {column}")
    if not isinstance(df.schema[column].dataType, NumericType):
        raise TypeError(f"{name} must be numeric, not {df.schema[column].dataType.simpleString()}")


def _fault(df: DataFrame, told: Column) -> str | None:
    """The first of the messages that are not null."""
    found = df.select(told.alias("m")).where("m IS NOT NULL").limit(1).collect()
    return found[0][0] if found else None


def _series(df: DataFrame, value: str, by: str, at: str, name: str, bad: Column, why: str) -> DataFrame:
    _numeric(df, value, name)
    x = F.col(value)
    seen = x.isNotNull() & ~F.isnan(x.cast("double"))
    # Copies of a time show in the first aggregation, which combines map-side.
    times = df.groupBy(by, at).agg(
        F.count("*").alias("n"),
        F.count_if(seen).alias("seen"),
        F.count_if(seen & (F.abs(x.cast("double")) == float("inf"))).alias("infinite"),
        F.count_if(seen & bad).alias("bad"),
    )
    per = times.groupBy(by).agg(
        F.max("n").alias("n"),
        F.sum("seen").alias("seen"),
        F.sum("infinite").alias("infinite"),
        F.sum("bad").alias("bad"),
        F.count_if(F.col(at).isNull()).alias("timeless"),
        F.min(F.when(F.col("seen") > 0, F.col(at))).alias("first"),
        F.max(F.when(F.col("seen") > 0, F.col(at))).alias("last"),
    )
    who = F.concat(F.lit(f"{name} of "), F.coalesce(F.col(by).cast("string"), F.lit("null")))
    rules = [
        (F.col("timeless") > 0, "have a row without time"),
        (F.col("n") > 1, "repeat a time"),
        (F.col("seen") == 0, "have no observation"),
        (F.col("infinite") > 0, "must be finite"),
        (F.col("bad") > 0, why),
    ]
    told = F.coalesce(*(F.when(c, F.concat(who, F.lit(f" {m}"))) for c, m in rules))
    if message := _fault(per, told):
        raise ValueError(message)
    # Only rows without a value are compared with their series' edges.
    holes = times.where("seen = 0").join(per.select(by, "first", "last"), by).where(
        (F.col(at) > F.col("first")) & (F.col(at) < F.col("last"))
    )
    inside = F.concat(who, F.lit(" have a gap inside their history, at "), F.col(at).cast("string"))
    if message := _fault(holes, inside):
        raise ValueError(message)
    return df


def require_returns(df: DataFrame, r: str = "r", by: str = "series", at: str = "session", name: str = "returns") -> DataFrame:
    """Finite numbers of at least -1, one a time, without gaps inside a series."""
    return _series(df, r, by, at, name, F.col(r) < -1.0, "must be at least -100%")


def require_equity(df: DataFrame, value: str = "equity", by: str = "series", at: str = "session", name: str = "equity") -> DataFrame:
    """As returns, but above zero."""
    return _series(df, value, by, at, name, F.col(value) <= 0, "must be above zero")


def require_observations(df: DataFrame, name: str = "returns") -> DataFrame:
    """At least one row."""
    if df.isEmpty():
        raise ValueError(f"{name} must have at least one observation")
    return df


def require_benchmark(df: DataFrame, benchmark: DataFrame, b: str = "b", by: str = "series", at: str = "session") -> DataFrame:
    """``benchmark`` (``at, b``) holds returns at exactly the times of ``df``."""
    market = benchmark.select(F.lit("benchmark").alias(by), at, F.col(b).alias("r"))
    require_returns(market, "r", by, at, "benchmark")
    mine, its = df.select(at).distinct(), benchmark.select(at).distinct()
    lone = mine.withColumn("_a", F.lit(1)).join(its.withColumn("_b", F.lit(1)), at, "full").where("_a IS NULL OR _b IS NULL")
    if message := _fault(lone, F.concat(F.lit("benchmark and returns differ in their times, at "), F.col(at).cast("string"))):
        raise ValueError(message)
    return benchmark


def require_trade_results(df: DataFrame, result: str = "result", name: str = "trade results") -> DataFrame:
    """One finite number per trade; none at all is allowed."""
    _numeric(df, result, name)
    x = F.col(result).cast("double")
    told = F.when(x.isNull() | F.isnan(x), f"{name} must not be missing").when(F.abs(x) == float("inf"), f"{name} must be finite")
    if message := _fault(df, told):
        raise ValueError(message)
    return df


def require_trades(df: DataFrame, entry: str = "entry", exit: str = "exit", name: str = "trades") -> DataFrame:
    """Times of entry and exit, the exit not before the entry; none at all is allowed."""
    lacking = [c for c in (entry, exit) if c not in df.columns]
    if lacking:
        raise ValueError(f"{name} need the columns {lacking}")
    for c in (entry, exit):
        if df.schema[c].dataType.typeName() not in ("date", "timestamp", "timestamp_ntz"):
            raise TypeError(f"{name} have times in {c}, not {df.schema[c].dataType.simpleString()}")
    told = F.when(F.col(entry).isNull() | F.col(exit).isNull(), f"{name} must have both times").when(
        F.col(exit) < F.col(entry), f"{name} have an exit before its entry"
    )
    if message := _fault(df, told):
        raise ValueError(message)
    return df


def require_sessions(df: DataFrame, at: str = "session", name: str = "sessions") -> DataFrame:
    """At least one session, each once."""
    require_observations(df, name)
    days = df.groupBy(at).count()
    told = F.when(F.col(at).isNull(), f"{name} have a row without time").when(
        F.col("count") > 1, F.concat(F.lit(f"{name} repeat "), F.col(at).cast("string"))
    )
    if message := _fault(days, told):
        raise ValueError(message)
    return df


def integer(name: str, value: object, minimum: int | None = None) -> int:
    """A whole number (no boolean), at least ``minimum``."""
    if isinstance(value, bool) or not hasattr(value, "__index__"):
        raise TypeError(f"{name} must be an integer, not {value!r}")
    found = value.__index__()
    if minimum is not None and found < minimum:
        raise ValueError(f"{name} must be at least {minimum}, not {found}")
    return found


def real(name: str, value: object, above: float | None = None, below: float | None = None) -> float:
    """A finite number (no boolean) within open bounds."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{name} must be a number, not {value!r}")
    found = float(value)
    if found - found != 0.0:
        raise ValueError(f"{name} must be finite, not {found}")
    if above is not None and found <= above or below is not None and found >= below:
        raise ValueError(f"{name} must lie between {above} and {below}, not {found}")
    return found
