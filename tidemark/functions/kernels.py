"""Time-series and cross-sectional kernels as lazy column expressions.

Time-series kernels run in observation time: a symbol's rows whose value is
null are passed over, never filled, and the result is null there. Windows are
therefore partitioned by (symbol, value is null): null rows lie in a partition
of their own, and no join back to the grid is needed. All kernels of one value
column share one shuffle and one sort.

``by`` is the symbol column and ``at`` the time column. Values must hold no
NaN; null is the only missing marker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def observed(x: str, by: str = "symbol", at: str = "session") -> WindowSpec:
    """The window of a symbol's own observations of ``x``, in time order."""
    return Window.partitionBy(by, F.col(x).isNull()).orderBy(at)


def _seen(x: str, result: Column) -> Column:
    return F.when(F.col(x).isNotNull(), result)


def _whole(name: str, value: int, least: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {value!r}")


def _full(x: str, w: int, result: Column, by: str, at: str) -> Column:
    """``result`` where ``w`` observations are in the frame."""
    frame = observed(x, by, at).rowsBetween(-(w - 1), 0)
    return _seen(x, F.when(F.count(x).over(frame) == w, result))


def lag(x: str, periods: int = 1, by: str = "symbol", at: str = "session") -> Column:
    """The value ``periods`` observations earlier."""
    _whole("periods", periods, 1)
    return _seen(x, F.lag(x, periods).over(observed(x, by, at)))


def _positive(x: str) -> Column:
    """The value; a value that is not above zero stops the query."""
    return F.when(F.col(x) > 0, F.col(x)).when(
        F.col(x).isNotNull(), F.raise_error(F.concat(F.lit(f"{x} must be above zero, not "), F.col(x).cast("string"))).cast("double")
    )


def simple_returns(x: str, by: str = "symbol", at: str = "session") -> Column:
    """``p / p before - 1``; prices that are not above zero are an error."""
    return _seen(x, F.try_divide(_positive(x), F.lag(x).over(observed(x, by, at))) - 1)


def log_returns(x: str, by: str = "symbol", at: str = "session") -> Column:
    """``ln(p / p before)``; prices that are not above zero are an error."""
    return _seen(x, F.log(F.try_divide(_positive(x), F.lag(x).over(observed(x, by, at)))))


def rolling_sum(x: str, w: int, by: str = "symbol", at: str = "session") -> Column:
    """Sum of the last ``w`` observations."""
    _whole("window", w, 1)
    return _full(x, w, F.sum(x).over(observed(x, by, at).rowsBetween(-(w - 1), 0)), by, at)


def sma(x: str, w: int, by: str = "symbol", at: str = "session") -> Column:
    """Mean of the last ``w`` observations."""
    _whole("window", w, 1)
    return _full(x, w, F.avg(x).over(observed(x, by, at).rowsBetween(-(w - 1), 0)), by, at)


def rolling_std(x: str, w: int, ddof: int = 1, by: str = "symbol", at: str = "session") -> Column:
    """Standard deviation of the last ``w``; exactly zero if they are equal."""
    _whole("ddof", ddof, 0)
    _whole("window", w, ddof + 1)
    frame = observed(x, by, at).rowsBetween(-(w - 1), 0)
    if ddof == 1:
        std = F.stddev_samp(x).over(frame)
    else:
        std = F.sqrt(F.var_pop(x).over(frame) * F.lit(w / (w - ddof)))
    flat = F.max(x).over(frame) == F.min(x).over(frame)
    return _full(x, w, F.when(flat, F.lit(0.0)).otherwise(std), by, at)


def rolling_zscore(x: str, w: int, ddof: int = 1, by: str = "symbol", at: str = "session") -> Column:
    """``(x - mean) / std`` over the last ``w``; null if they are equal."""
    mean = F.avg(x).over(observed(x, by, at).rowsBetween(-(w - 1), 0))
    return F.try_divide(F.col(x) - mean, rolling_std(x, w, ddof, by, at))


def historical_volatility(r: str, w: int, ddof: int = 1, by: str = "symbol", at: str = "session") -> Column:
    """Rolling standard deviation of returns, not annualised."""
    return rolling_std(r, w, ddof, by, at)


# -- exponential smoothing ---------------------------------------------------------


def alpha_from_span(span: float) -> float:
    if not span > 1:
        raise ValueError(f"span must be above 1, not {span!r}")
    return 2.0 / (span + 1.0)


def alpha_from_halflife(halflife: float) -> float:
    if not halflife > 0:
        raise ValueError(f"halflife must be above 0, not {halflife!r}")
    return 1.0 - 0.5 ** (1.0 / halflife)


def alpha_from_decay(decay: float) -> float:
    if not 0 < decay < 1:
        raise ValueError(f"decay must lie between 0 and 1, not {decay!r}")
    return 1.0 - decay


def exponential_lookback(alpha: float, tolerance: float = 1e-3) -> int:
    """Observations after which the seed weighs at most ``tolerance``."""
    if not 0 < alpha < 1 or not 0 < tolerance < 1:
        raise ValueError("alpha and tolerance must lie between 0 and 1")
    q = 1.0 - alpha
    n = max(1, math.ceil(math.log(tolerance) / math.log(q)))
    while n > 1 and q ** (n - 1) <= tolerance:
        n -= 1
    while q**n > tolerance:
        n += 1
    return n


def with_ema(
    df: DataFrame,
    x: str,
    alpha: float,
    name: str,
    tolerance: float = 1e-3,
    by: str = "symbol",
    at: str = "session",
) -> DataFrame:
    """Adds ``e = alpha * x + (1 - alpha) * e before``, seeded by the first x.

    Null for a symbol's first :func:`exponential_lookback` observations.

    The recursion is written as a sum: within blocks of so many observations
    that a weight falls to 1e-18, each value is a running sum of scaled terms
    (no scale leaves 1e18), and what comes from before a block is the end of
    the block before it, decayed. Earlier blocks weigh less than a double can
    hold beside it (one more is carried all the same). No Python, no
    recursion, and a symbol's windows after the first are split into blocks.
    """
    lookback = exponential_lookback(alpha, tolerance)
    q = 1.0 - alpha
    length = max(2, math.ceil(math.log(1e-18) / math.log(q)))
    lq = F.lit(math.log(q))
    seen = observed(x, by, at)
    rows = df.withColumn("_k", F.row_number().over(seen) - 1).withColumns(
        {"_blk": F.floor(F.col("_k") / length), "_p": F.col("_k") % length}
    )
    term = F.when(F.col("_k") == 0, F.col(x)).otherwise(F.lit(alpha) * F.col(x)) * F.exp(-lq * F.col("_p"))
    inside = Window.partitionBy(by, F.col(x).isNull(), "_blk").orderBy("_k")
    rows = rows.withColumn(
        "_s", F.sum(term).over(inside.rowsBetween(Window.unboundedPreceding, 0)) * F.exp(lq * F.col("_p"))
    )
    blocks = Window.partitionBy(by, F.col(x).isNull()).orderBy("_blk")

    def end_of(back: int) -> Column:
        return F.coalesce(F.max_by("_s", "_k").over(blocks.rangeBetween(-back, -back)), F.lit(0.0))

    before = end_of(1) + end_of(2) * F.exp(lq * length)
    value = F.col("_s") + before * F.exp(lq * (F.col("_p") + 1))
    return rows.withColumn(name, _seen(x, F.when(F.col("_k") >= lookback, value))).drop("_k", "_blk", "_p", "_s")


def with_ewma_volatility(
    df: DataFrame, r: str, alpha: float, name: str, tolerance: float = 1e-3, by: str = "symbol", at: str = "session"
) -> DataFrame:
    """Adds the root of the exponentially smoothed squared returns."""
    squared = df.withColumn("_sq", F.col(r) * F.col(r))
    return with_ema(squared, "_sq", alpha, name, tolerance, by, at).withColumn(name, F.sqrt(name)).drop("_sq")


# -- across symbols -----------------------------------------------------------------


def _members(x: str, mask: str | None, at: str) -> tuple[Column, WindowSpec]:
    inside = F.col(x).isNotNull()
    if mask is not None:
        inside = inside & F.coalesce(F.col(mask), F.lit(False))
    return inside, Window.partitionBy(at, inside)


def cs_rank(x: str, mask: str | None = None, at: str = "session") -> Column:
    """Rank among the members at a time, 0 (smallest) to 1, ties averaged.

    Null outside the universe, where the value is missing, and where fewer
    than two members have one.
    """
    inside, members = _members(x, mask, at)
    ties = Window.partitionBy(at, inside, x)
    n = F.count(x).over(members).cast("double")
    rank = F.rank().over(members.orderBy(x)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return F.when(inside & (n > 1), (rank - 1) / (n - 1))


def cs_zscore(x: str, mask: str | None = None, ddof: int = 1, at: str = "session") -> Column:
    """Standard score among the members at a time; null if they are equal."""
    _whole("ddof", ddof, 0)
    inside, members = _members(x, mask, at)
    n = F.count(x).over(members)
    std = F.sqrt(F.try_divide(F.var_pop(x).over(members) * n, (n - ddof).cast("double")))
    usable = (n >= max(2, ddof + 1)) & (F.max(x).over(members) > F.min(x).over(members))
    return F.when(inside & usable, F.try_divide(F.col(x) - F.avg(x).over(members), std))
