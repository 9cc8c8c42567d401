"""Return transformations and performance metrics on long tables.

A table of returns holds ``series, session, r`` (simple returns of at least
-1, no interior gaps); statistics are aggregates to be used in
``groupBy(series).agg(...)``. Undefined results are null, never infinite:
every ratio goes through ``try_divide``. Standard deviations have one degree
of freedom less than observations and are exactly zero if all are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.contracts import (
    integer,
    real,
    require_observations,
    require_returns,
    require_sessions,
    require_trade_results,
    require_trades,
)
from tidemark.operators.joins import islands
from tidemark.session import cut_lineage


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _order(by: str, at: str) -> WindowSpec:
    return Window.partitionBy(by).orderBy(at)


def _sofar(by: str, at: str) -> WindowSpec:
    return _order(by, at).rowsBetween(Window.unboundedPreceding, 0)


# -- return transformations ------------------------------------------------------------


def equity_curve(r: str, initial: float = 1.0, by: str = "series", at: str = "session") -> Column:
    """``initial`` times the running product of ``1 + r``; -100 % is legal."""
    return F.product(1 + F.col(r)).over(_sofar(by, at)) * F.lit(float(initial))


def cumulative_returns(r: str, by: str = "series", at: str = "session") -> Column:
    return equity_curve(r, 1.0, by, at) - 1


def returns_from_equity(v: str, by: str = "series", at: str = "session") -> Column:
    return F.try_divide(F.col(v), F.lag(v).over(_order(by, at))) - 1


def with_drawdown(df: DataFrame, r: str = "r", by: str = "series", at: str = "session") -> DataFrame:
    """Adds ``equity`` and ``drawdown``, the fall from the running peak.

    The peak starts at the initial capital of 1.
    """
    grown = df.withColumn("equity", equity_curve(r, 1.0, by, at))
    peak = F.greatest(F.max("equity").over(_sofar(by, at)), F.lit(1.0))
    return grown.withColumn("drawdown", F.try_divide(F.col("equity"), peak) - 1)


def drawdown_periods(df: DataFrame, r: str = "r", by: str = "series", at: str = "session") -> DataFrame:
    """One row per episode below the peak.

    ``series, peak, trough, recovery, depth, peak_to_trough,
    trough_to_recovery, duration``: the peak is the row before the episode
    (the first row of the series for an episode that starts there), the trough
    the first minimum, the recovery the first row back at the peak. An episode
    still open has no recovery and no ``trough_to_recovery``, and its duration
    runs to the last row of the series. Lengths count rows; rows without a
    return (the edges of a series) are left out.
    """
    order = _order(by, at)
    seen = df.where(F.col(r).isNotNull())
    rows = with_drawdown(seen, r, by, at).withColumns(
        {"_n": F.row_number().over(order), "_before": F.lag(at).over(order), "_next": F.lead(at).over(order)}
    )
    marked = islands(rows, [by], at, F.col("drawdown") < 0, "_isl").where("drawdown < 0")
    low = F.min(F.struct("drawdown", "_n", F.col(at).alias("t")))
    found = marked.groupBy(by, "_isl").agg(
        F.min_by(F.coalesce("_before", at), "_n").alias("peak"),
        low.alias("_low"),
        F.max_by("_next", "_n").alias("recovery"),
        F.greatest(F.min("_n") - 1, F.lit(1)).alias("_from"),
        F.max("_n").alias("_to"),
    )
    back = F.col("recovery").isNotNull()
    end = F.col("_to") + F.when(back, 1).otherwise(0)
    return found.select(
        by,
        "peak",
        F.col("_low.t").alias("trough"),
        "recovery",
        F.col("_low.drawdown").alias("depth"),
        (F.col("_low._n") - F.col("_from")).cast("bigint").alias("peak_to_trough"),
        F.when(back, end - F.col("_low._n")).cast("bigint").alias("trough_to_recovery"),
        (end - F.col("_from")).cast("bigint").alias("duration"),
    )


def period_returns(df: DataFrame, period: str, r: str = "r", by: str = "series", at: str = "session") -> DataFrame:
    """``series, period_end, r``: compounded per calendar month, quarter or year.

    Labelled by the period's last day; a period without returns between two
    with some has a null return.
    """
    months = {"month": 1, "quarter": 3, "year": 12}[period]
    start = F.trunc(at, period).alias("_p")
    summed = df.groupBy(by, start).agg((F.product(1 + F.col(r)) - 1).alias("r"))
    bounds = summed.groupBy(by).agg(F.min("_p").alias("a"), F.max("_p").alias("b"))
    spine = bounds.select(by, F.explode(F.expr(f"sequence(a, b, interval {months} month)")).alias("_p"))
    label = F.last_day(F.add_months("_p", months - 1))
    return spine.join(summed, [by, "_p"], "left").select(by, label.alias("period_end"), "r")


def monthly_table(df: DataFrame, r: str = "r", by: str = "series", at: str = "session") -> DataFrame:
    """``series, year, m1 .. m12, total``."""
    grown = F.product(1 + F.col(r)) - 1
    return (
        df.withColumns({"year": F.year(at), "_m": F.month(at)})
        .groupBy(by, "year")
        .agg(
            *((F.product(F.when(F.col("_m") == m, 1 + F.col(r))) - 1).alias(f"m{m}") for m in range(1, 13)),
            grown.alias("total"),
        )
    )


def rate_per_period(annual: float, periods: int) -> float:
    """The periodic rate that compounds to an annual one."""
    return (1.0 + annual) ** (1.0 / periods) - 1.0


def excess_returns(r: Column | str, risk_free: float | str = 0.0, periods: int = 252) -> Column:
    """``r`` less the risk-free return of the period.

    A number is an annual rate, converted geometrically; a string names a
    column of periodic risk-free returns (see :func:`with_risk_free`).
    """
    if isinstance(risk_free, str):
        return _c(r) - F.col(risk_free)
    return _c(r) - F.lit(rate_per_period(risk_free, periods))


def with_risk_free(df: DataFrame, rates: DataFrame, name: str = "rf", r: str = "r", at: str = "session") -> DataFrame:
    """Adds the periodic risk-free return of each session from ``rates`` (``session, name``).

    A session with a return but without a rate is an error when it is read.
    ``rates`` has a row per session, so it is as small as the calendar.
    """
    known = rates.select(at, F.col(name).cast("double").alias("_rf"))
    met = df.join(F.broadcast(known), at, "left")
    lacking = F.col(r).isNotNull() & F.col("_rf").isNull()
    told = F.raise_error(F.concat(F.lit("no risk-free return at "), F.col(at).cast("string"))).cast("double")
    return met.select(*df.columns, F.when(lacking, told).otherwise(F.col("_rf")).alias(name))


# -- aggregates --------------------------------------------------------------------------


def is_constant(x: Column | str) -> Column:
    return F.max(_c(x)) == F.min(_c(x))


def sample_std(x: Column | str) -> Column:
    x = _c(x)
    return F.when(F.count(x) < 2, None).when(is_constant(x), F.lit(0.0)).otherwise(F.stddev_samp(x))


def total_return(r: Column | str) -> Column:
    return F.product(1 + _c(r)) - 1


def cagr(r: Column | str, periods: int = 252) -> Column:
    return F.pow(F.product(1 + _c(r)), F.try_divide(F.lit(float(periods)), F.count(_c(r)).cast("double"))) - 1


def annualized_volatility(r: Column | str, periods: int = 252) -> Column:
    return sample_std(r) * F.lit(periods**0.5)


def sharpe_ratio(r: Column | str, risk_free: float | str = 0.0, periods: int = 252) -> Column:
    e = excess_returns(r, risk_free, periods)
    return F.try_divide(F.avg(e), sample_std(e)) * F.lit(periods**0.5)


def sortino_ratio(r: Column | str, risk_free: float | str = 0.0, periods: int = 252) -> Column:
    e = excess_returns(r, risk_free, periods)
    downside = F.sqrt(F.avg(F.pow(F.least(e, F.lit(0.0)), F.lit(2.0))))
    return F.try_divide(F.avg(e), downside) * F.lit(periods**0.5)


def skewness(r: Column | str) -> Column:
    """Bias-adjusted; needs three observations that are not all equal."""
    x, n = _c(r), F.count(_c(r)).cast("double")
    adjusted = F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2)
    return F.when((n >= 3) & ~is_constant(x), adjusted)


def kurtosis(r: Column | str) -> Column:
    """Bias-adjusted excess kurtosis; needs four observations not all equal."""
    x, n = _c(r), F.count(_c(r)).cast("double")
    adjusted = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when((n >= 4) & ~is_constant(x), adjusted)


def quantile(r: Column | str, q: float) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(_c(r), q)


def positive_ratio(r: Column | str) -> Column:
    return F.avg((_c(r) > 0).cast("double"))


def negative_ratio(r: Column | str) -> Column:
    return F.avg((_c(r) < 0).cast("double"))


def value_at_risk(r: Column | str, confidence: float = 0.95) -> Column:
    return quantile(r, 1 - confidence)


def performance(df: DataFrame, r: str = "r", by: str = "series", at: str = "session", risk_free: float | str = 0.0, periods: int = 252, confidence: float = 0.95) -> DataFrame:
    """All absolute metrics, one row per series.

    One shuffle by series: drawdowns, the length of the episode a row lies in
    and the quantile are windows of it, and the metrics, the tail mean among
    them, one aggregation. Rows without a return are left out; a series
    without any does not appear. ``max_drawdown_duration`` counts an episode
    still open to the end of the series.
    """
    seen = df.where(F.col(r).isNotNull())
    order, whole = _order(by, at), Window.partitionBy(by)
    down = F.col("drawdown") < 0
    rows = with_drawdown(seen, r, by, at).withColumn("_n", F.row_number().over(order))
    # The last row at the peak before this one; the first row where there is none.
    peak = F.coalesce(F.max(F.when(~down, F.col("_n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    in_episode = down | F.coalesce(F.lag(down).over(order), F.lit(False))
    rows = rows.withColumns(
        {"_length": F.when(in_episode, F.col("_n") - peak), "_var": value_at_risk(r, confidence).over(whole)}
    )
    main = rows.groupBy(by).agg(
        F.count(r).alias("observations"),
        total_return(r).alias("total_return"),
        cagr(r, periods).alias("cagr"),
        annualized_volatility(r, periods).alias("annualized_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.max("_length"), F.lit(0)).cast("bigint").alias("max_drawdown_duration"),
        sharpe_ratio(r, risk_free, periods).alias("sharpe_ratio"),
        sortino_ratio(r, risk_free, periods).alias("sortino_ratio"),
        F.avg(r).alias("mean_return"),
        sample_std(r).alias("standard_deviation"),
        skewness(r).alias("skewness"),
        kurtosis(r).alias("kurtosis"),
        F.max(r).alias("best_period"),
        F.min(r).alias("worst_period"),
        positive_ratio(r).alias("positive_ratio"),
        negative_ratio(r).alias("negative_ratio"),
        F.max("_var").alias("value_at_risk"),
        F.avg(F.when(F.col(r) <= F.col("_var"), F.col(r))).alias("conditional_value_at_risk"),
    )
    return main.withColumn("calmar_ratio", F.try_divide(F.col("cagr"), F.abs("max_drawdown")))


#: Sections and metrics of a summary, in order (fixed values).
SECTIONS = {
    "return": ("total_return", "cagr"),
    "risk": ("annualized_volatility", "max_drawdown", "max_drawdown_duration"),
    "risk_adjusted": ("sharpe_ratio", "sortino_ratio", "calmar_ratio"),
    "distribution": (
        "skewness",
        "kurtosis",
        "value_at_risk",
        "conditional_value_at_risk",
        "best_period",
        "worst_period",
        "positive_ratio",
    ),
    "benchmark": (
        "beta",
        "alpha",
        "correlation",
        "tracking_error",
        "information_ratio",
        "up_capture",
        "down_capture",
        "excess_cagr",
    ),
}

#: Growth a year; not told of less than a year of observations (fixed values).
NEEDS_A_YEAR = ("cagr", "excess_cagr", "calmar_ratio")


def _long(wide: DataFrame, by: str, sections: dict[str, tuple[str, ...]]) -> DataFrame:
    """``by, section, metric, value``, one row for each metric of a row."""
    cells = [
        F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for s, metrics in sections.items()
        for m in metrics
    ]
    return wide.select(by, F.inline(F.array(*cells)))


def in_common(df: DataFrame, r: str = "r", b: str | None = None, by: str = "series", at: str = "session") -> DataFrame:
    """The rows of the sessions at which every series (and the benchmark) has a return.

    Counts the series (one small job).
    """
    seen = df.where(F.col(r).isNotNull())
    if b is not None:
        seen = seen.where(F.col(b).isNotNull())
    n = df.where(F.col(r).isNotNull()).select(by).distinct().count()
    every = seen.groupBy(at).agg(F.count_distinct(by).alias("_n")).where(F.col("_n") == n).select(at)
    return seen.join(every, at, "left_semi")


def summary(
    df: DataFrame,
    r: str = "r",
    by: str = "series",
    at: str = "session",
    *,
    benchmark: str | None = None,
    benchmark_name: str = "benchmark",
    risk_free: float | str = 0.0,
    periods: int = 252,
    confidence: float = 0.95,
    common_period: bool = True,
    check: bool = True,
) -> DataFrame:
    """``series, section, metric, value``: the metrics of :data:`SECTIONS`.

    ``benchmark`` names a column with the benchmark's return of the row's
    session; it adds the section ``benchmark`` and a series of its own, named
    ``benchmark_name``. With ``common_period`` all series are measured over
    the sessions they all have (none is an error). Growth a year of a series
    of less than a year is null. With ``check`` the returns are held to their
    contract first. The rows are kept in the checkpoint folder and checked
    when this is called; the rest is lazy.
    """
    integer("periods", periods, 1), real("confidence", confidence, 0.0, 1.0)
    keep = [risk_free] if isinstance(risk_free, str) else []
    # Several passes follow; the rows are made once.
    df = cut_lineage(df.select(by, at, r, *([benchmark] if benchmark else []), *keep))
    if check:
        require_returns(require_observations(df), r, by, at)
    if common_period:
        df = in_common(df, r, benchmark, by, at)
        if df.isEmpty():
            raise ValueError("the series have no session in common")
    rows, sections = df.select(by, at, F.col(r).alias("r"), *keep), dict(SECTIONS)
    if benchmark is None:
        del sections["benchmark"]
    else:
        market = df.where(F.col(benchmark).isNotNull()).groupBy(at).agg(
            F.max(benchmark).alias("r"), *(F.max(c).alias(c) for c in keep)
        )
        rows = rows.unionByName(market.select(F.lit(benchmark_name).alias(by), at, "r", *keep))
    wide = performance(rows, "r", by, at, risk_free, periods, confidence)
    if benchmark is not None:
        wide = wide.join(relative(df, r, benchmark, by, risk_free, periods), by, "left")
    short = F.col("observations") < periods
    wide = wide.withColumns({c: F.when(~short, F.col(c)) for c in NEEDS_A_YEAR if c in wide.columns})
    return _long(wide, by, sections)


# -- against a benchmark -------------------------------------------------------------------


def relative(df: DataFrame, r: str = "r", b: str = "b", by: str = "series", risk_free: float | str = 0.0, periods: int = 252) -> DataFrame:
    """All metrics against a benchmark, one row per series; rows with both only."""
    both = df.where(F.col(r).isNotNull() & F.col(b).isNotNull())
    x, y = excess_returns(b, risk_free, periods), excess_returns(r, risk_free, periods)
    active = F.col(r) - F.col(b)
    beta = F.when(~is_constant(x), F.try_divide(F.covar_samp(y, x), F.var_samp(x)))

    def capture(side: Column) -> Column:
        n = F.count(F.when(side, 1)).cast("double")

        def grown(c: str) -> Column:
            # By logarithms, as a long product leaves the range of doubles.
            logs = F.sum(F.when(side & (F.col(c) > -1), F.log1p(c)).when(side, F.lit(0.0)))
            lost = F.max(F.when(side, F.col(c) <= -1))
            return F.when(lost, F.lit(-1.0)).otherwise(F.expm1(logs * F.try_divide(F.lit(float(periods)), n)))

        return F.try_divide(grown(r), grown(b))

    constant = is_constant(r) | is_constant(b)
    return both.groupBy(by).agg(
        F.when(~constant, F.corr(r, b)).alias("correlation"),
        beta.alias("beta"),
        ((F.avg(y) - beta * F.avg(x)) * F.lit(float(periods))).alias("alpha"),
        (sample_std(active) * F.lit(periods**0.5)).alias("tracking_error"),
        (F.try_divide(F.avg(active), sample_std(active)) * F.lit(periods**0.5)).alias("information_ratio"),
        capture(F.col(b) > 0).alias("up_capture"),
        capture(F.col(b) < 0).alias("down_capture"),
        (cagr(r, periods) - cagr(b, periods)).alias("excess_cagr"),
    )


# -- rolling ---------------------------------------------------------------------------------


def _frame(w: int, by: str, at: str) -> WindowSpec:
    return _order(by, at).rowsBetween(-(w - 1), 0)


def _strict(x: str, w: int, value: Column, by: str, at: str) -> Column:
    return F.when(F.count(x).over(_frame(w, by, at)) == w, value)


def rolling_return(r: str, w: int, by: str = "series", at: str = "session") -> Column:
    return _strict(r, w, F.product(1 + F.col(r)).over(_frame(w, by, at)) - 1, by, at)


def _rolling_std(x: Column, frame: WindowSpec) -> Column:
    return F.when(F.max(x).over(frame) == F.min(x).over(frame), F.lit(0.0)).otherwise(F.stddev_samp(x).over(frame))


def rolling_volatility(r: str, w: int, periods: int = 252, by: str = "series", at: str = "session") -> Column:
    return _strict(r, w, _rolling_std(F.col(r), _frame(w, by, at)) * F.lit(periods**0.5), by, at)


def rolling_sharpe(r: str, w: int, risk_free: float | str = 0.0, periods: int = 252, by: str = "series", at: str = "session") -> Column:
    e, frame = excess_returns(r, risk_free, periods), _frame(w, by, at)
    return _strict(r, w, F.try_divide(F.avg(e).over(frame), _rolling_std(e, frame)) * F.lit(periods**0.5), by, at)


def rolling_sortino(r: str, w: int, risk_free: float | str = 0.0, periods: int = 252, by: str = "series", at: str = "session") -> Column:
    """Null where no row of the window is below the target."""
    e, frame = excess_returns(r, risk_free, periods), _frame(w, by, at)
    down = F.sqrt(F.avg(F.pow(F.least(e, F.lit(0.0)), F.lit(2.0))).over(frame))
    some = F.sum(F.when(e < 0, 1).otherwise(0)).over(frame) > 0
    return _strict(r, w, F.when(some, F.try_divide(F.avg(e).over(frame), down) * F.lit(periods**0.5)), by, at)


def _both(x: Column, y: Column) -> tuple[Column, Column]:
    """The two where both are there, else null: a window counts the same rows of either."""
    there = x.isNotNull() & y.isNotNull()
    return F.when(there, x), F.when(there, y)


def _full(x: Column, w: int, value: Column, frame: WindowSpec) -> Column:
    return F.when(F.count(x).over(frame) == w, value)


def rolling_beta(r: str, b: str, w: int, risk_free: float | str = 0.0, periods: int = 252, by: str = "series", at: str = "session") -> Column:
    """Of windows with ``w`` rows that have both returns; null where the benchmark is constant."""
    frame = _frame(w, by, at)
    y, x = _both(excess_returns(r, risk_free, periods), excess_returns(b, risk_free, periods))
    moves = F.max(x).over(frame) > F.min(x).over(frame)
    return _full(x, w, F.when(moves, F.try_divide(F.covar_samp(y, x).over(frame), F.var_samp(x).over(frame))), frame)


def rolling_correlation(r: str, b: str, w: int, by: str = "series", at: str = "session") -> Column:
    """Of windows with ``w`` rows that have both returns; null where either is constant."""
    frame = _frame(w, by, at)
    y, x = _both(F.col(r), F.col(b))
    moves = (F.max(x).over(frame) > F.min(x).over(frame)) & (F.max(y).over(frame) > F.min(y).over(frame))
    return _full(x, w, F.when(moves, F.corr(y, x).over(frame)), frame)


# -- trades -----------------------------------------------------------------------------------


def trade_metrics(df: DataFrame, result: str = "result", by: str = "series", order: str = "seq") -> DataFrame:
    """All outcome metrics of trades, one row per series; zero is neither win nor loss.

    One shuffle by series: a row's place in its run of wins or losses is a
    window, the metrics one aggregation.
    """
    x = F.col(result)
    w = _order(by, order)
    n = F.row_number().over(w)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_n", n)

    def run(side: Column) -> Column:
        """Rows since the last one of another kind; zero on such a row."""
        return F.col("_n") - F.coalesce(F.max(F.when(~F.coalesce(side, F.lit(False)), F.col("_n"))).over(sofar), F.lit(0))

    marked = marked.withColumns({"_w": run(x > 0), "_l": run(x < 0)})
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    std = sample_std(x)
    return marked.groupBy(by).agg(
        F.count(x).alias("trade_count"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.avg((x < 0).cast("double")).alias("loss_rate"),
        F.avg(x).alias("expectancy"),
        std.alias("trade_standard_deviation"),
        (F.try_divide(F.avg(x), std) * F.sqrt(F.count(x).cast("double"))).alias("expectancy_t_stat"),
        F.avg(win).alias("average_win"),
        F.avg(loss).alias("average_loss"),
        F.try_divide(F.avg(win), F.abs(F.avg(loss))).alias("payoff_ratio"),
        F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(loss), F.lit(0.0)).alias("gross_loss"),
        F.try_divide(F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.sum(loss))).alias("profit_factor"),
        F.max(x).alias("best_trade"),
        F.min(x).alias("worst_trade"),
        F.coalesce(F.max("_w"), F.lit(0)).cast("bigint").alias("max_consecutive_wins"),
        F.coalesce(F.max("_l"), F.lit(0)).cast("bigint").alias("max_consecutive_losses"),
    )


def trade_timing(trades: DataFrame, sessions: DataFrame, by: str = "series", annualized: bool = False, periods: int | None = None) -> DataFrame:
    """Frequency (a session, or a year), exposure and mean holding period of trades, per series.

    ``trades`` hold ``series, entry, exit`` as dates of ``sessions``
    (``session, pos``). Exposure is the share of sessions that at least one
    trade covers: each series' trades are merged into runs without overlap by
    a running maximum of the exits, so no trade is joined to all its sessions.
    """
    if annualized != (periods is not None):
        raise ValueError("sessions a year are given if and only if the frequency is a year's")
    entry = sessions.select(F.col("session").alias("entry"), F.col("pos").alias("_a"))
    exit_ = sessions.select(F.col("session").alias("exit"), F.col("pos").alias("_b"))
    placed = trades.join(entry, "entry", "left").join(exit_, "exit", "left").withColumns(
        {c: F.coalesce(c, F.raise_error(F.lit("a trade lies outside the sessions")).cast("int")) for c in ("_a", "_b")}
    )
    order = Window.partitionBy(by).orderBy("_a", "_b")
    reached = F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("_b") - F.greatest(F.col("_a") - 1, F.coalesce("_r", F.lit(-1))), F.lit(0))
    total = sessions.agg(F.count("*").alias("_all"))
    per = placed.withColumn("_r", reached).groupBy(by).agg(
        F.count("*").alias("trades"),
        F.sum(fresh).alias("_covered"),
        F.avg((F.col("_b") - F.col("_a") + 1).cast("double")).alias("average_holding_period"),
    )
    n = total.first()[0]
    return per.select(
        by,
        F.try_divide(F.col("trades").cast("double") * F.lit(float(periods or 1)), F.lit(float(n))).alias("trade_frequency"),
        F.try_divide(F.col("_covered").cast("double"), F.lit(float(n))).alias("exposure"),
        "average_holding_period",
    )


#: Sections and metrics of a summary of trades, in order (fixed values).
TRADE_SECTIONS = {
    "outcome": (
        "trade_count",
        "win_rate",
        "loss_rate",
        "expectancy",
        "trade_standard_deviation",
        "expectancy_t_stat",
        "average_win",
        "average_loss",
        "payoff_ratio",
        "gross_profit",
        "gross_loss",
        "profit_factor",
        "best_trade",
        "worst_trade",
        "max_consecutive_wins",
        "max_consecutive_losses",
    ),
    "timing": ("trade_frequency", "exposure", "average_holding_period"),
}


def trade_summary(
    results: DataFrame,
    trades: DataFrame | None = None,
    sessions: DataFrame | None = None,
    *,
    result: str = "result",
    by: str = "series",
    order: str = "seq",
    annualized: bool = False,
    periods: int | None = None,
    check: bool = True,
) -> DataFrame:
    """``series, section, metric, value``: :func:`trade_metrics` and, with the
    trades' times and the sessions, :func:`trade_timing` of each series. With
    ``check`` all of them are held to their contracts first."""
    if (trades is None) != (sessions is None):
        raise ValueError("trades and sessions are given together")
    if check:
        require_trade_results(results, result)
        if trades is not None:
            require_trades(trades), require_sessions(sessions)
    found = _long(trade_metrics(results, result, by, order), by, {"outcome": TRADE_SECTIONS["outcome"]})
    if trades is not None:
        timing = trade_timing(trades, sessions, by, annualized, periods)
        found = found.unionByName(_long(timing, by, {"timing": TRADE_SECTIONS["timing"]}))
    return found


# -- text --------------------------------------------------------------------------------------

#: What each metric is measured in (fixed values): percent is a share, periods
#: are rows, result is the unit of the trades' results, rate is trades a session.
_IN = {
    "percent": (
        "total_return cagr annualized_volatility max_drawdown value_at_risk conditional_value_at_risk best_period worst_period "
        "positive_ratio alpha tracking_error excess_cagr win_rate loss_rate exposure"
    ),
    "ratio": "sharpe_ratio sortino_ratio calmar_ratio beta correlation information_ratio up_capture down_capture payoff_ratio profit_factor",
    "number": "skewness kurtosis expectancy_t_stat",
    "count": "trade_count max_consecutive_wins max_consecutive_losses",
    "periods": "max_drawdown_duration average_holding_period",
    "result": "expectancy trade_standard_deviation average_win average_loss gross_profit gross_loss best_trade worst_trade",
    "rate": "trade_frequency",
}
UNITS = {name: unit for unit, names in _IN.items() for name in names.split()}


def as_text(long: DataFrame, by: str = "series", metric: str = "metric", value: str = "value") -> str:
    """A plain table of a summary, one column per series; missing as n/a.

    Meant for a summary, whose rows are metrics times series.
    """
    rows = long.select(by, metric, value).collect()
    series = sorted({r[0] for r in rows})
    metrics = list(dict.fromkeys(r[1] for r in rows))
    found = {(r[1], r[0]): r[2] for r in rows}

    def cell(m: str, s: str) -> str:
        v = found.get((m, s))
        return "n/a" if v is None else f"{v:.0f}" if m == "observations" or UNITS.get(m) == "count" else f"{v:.4f}"

    table = [["", *series], *([m, *(cell(m, s) for s in series)] for m in metrics)]
    widths = [max(len(r[i]) for r in table) for i in range(len(series) + 1)]
    return "\n".join("  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, widths, strict=True))).rstrip() for r in table)
