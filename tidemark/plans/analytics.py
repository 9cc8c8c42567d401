"""Queries of return, benchmark, rolling and trade analytics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import analytics as A
from tidemark.operators.calendar import sessions_of
from tidemark.plans import market as M
from tidemark.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_W = "(PARTITION BY series ORDER BY session)"
_UP = "(PARTITION BY series ORDER BY session ROWS UNBOUNDED PRECEDING)"


def _frame(w: int) -> str:
    return f"(PARTITION BY series ORDER BY session ROWS {w - 1} PRECEDING)"


def _query(name: str, sql: str) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _rounded(df: DataFrame, places: int = 8) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes))


def _digits(c: str | Column, n: int = 6) -> Column:
    """Rounded to ``n`` significant digits, for values of any size."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string(f"%.{n - 1}e", c)).cast("double")


def _digits_sql(c: str, n: int = 6) -> str:
    return f"CAST(format('{{:.{n - 1}e}}', ({c})::DOUBLE) AS DOUBLE)"


def _column(name: str, value: Callable, sql: str, base: str = "r") -> None:
    """One value for each row of the returns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = M.returns(spark, sf_dir)
        if base == "b":
            rows = M.with_benchmark(rows)
        return rows.select("series", "session", F.round(value(), 8).alias("value"))

    QUERIES[name] = run
    cte, t = (M.PAIRED, "paired") if base == "b" else (M.RETURNS, "rets")
    SQL[name] = f"WITH {cte} SELECT series, session, round({sql}, 8) AS value FROM {t}"


_column("equity_curve", lambda: A.equity_curve("r", 100.0), f"100 * product(1 + r) OVER {_UP}")
_column("cumulative_returns", lambda: A.cumulative_returns("r"), f"product(1 + r) OVER {_UP} - 1")
_column("excess_returns", lambda: A.excess_returns("r", 0.05), "r - (pow(1.05, 1.0 / 252) - 1)")


@_query(
    "returns_from_equity",
    f"""WITH {M.RETURNS}, e AS (SELECT series, session, product(1 + r) OVER {_UP} AS v FROM rets)
SELECT series, session, round(v / NULLIF(lag(v) OVER {_W}, 0) - 1, 8) AS value FROM e""",
)
def returns_from_equity(spark, sf_dir):
    rows = M.returns(spark, sf_dir).withColumn("v", A.equity_curve("r"))
    return rows.select("series", "session", F.round(A.returns_from_equity("v"), 8).alias("value"))


def _drawdowns(rows: str) -> str:
    """Equity and drawdown of the rows (series, session, r), as tables of a query."""
    return f"""eq AS (SELECT series, session, r, product(1 + r) OVER {_UP} AS e FROM {rows}),
dd AS (SELECT *, e / greatest(max(e) OVER {_UP}, 1) - 1 AS d FROM eq)"""


#: Episodes below the peak; an open one lasts to the last row of its series.
_EPISODES = f"""
n AS (SELECT *, row_number() OVER {_W} AS k, count(*) OVER (PARTITION BY series) AS rows_, d < 0 AS low FROM dd),
g AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER {_UP} AS isl FROM n),
ep AS (SELECT series, min(d) AS depth, arg_min(k, (d, k)) AS tk, greatest(min(k) - 1, 1) AS a, max(k) + 1 AS z, any_value(rows_) AS rows_
  FROM g WHERE low GROUP BY series, isl)"""


@_query("drawdown", f"WITH {M.RETURNS}, {_drawdowns('rets')} SELECT series, session, round(d, 8) AS drawdown FROM dd")
def drawdown(spark, sf_dir):
    return A.with_drawdown(M.returns(spark, sf_dir)).select("series", "session", F.round("drawdown", 8).alias("drawdown"))


@_query(
    "drawdown_periods",
    f"""WITH {M.RETURNS}, {_drawdowns('rets')}, {_EPISODES}
SELECT ep.series, p.session AS peak, t.session AS trough, c.session AS recovery, round(depth, 8) AS depth, tk - a AS peak_to_trough,
  CASE WHEN z <= ep.rows_ THEN z - tk END AS trough_to_recovery, least(z, ep.rows_) - a AS duration
FROM ep JOIN n p ON p.series = ep.series AND p.k = a JOIN n t ON t.series = ep.series AND t.k = tk
  LEFT JOIN n c ON c.series = ep.series AND c.k = z""",
)
def drawdown_periods(spark, sf_dir):
    return _rounded(A.drawdown_periods(M.returns(spark, sf_dir)))


def _period(period: str, months: int) -> None:
    QUERIES[f"period_returns_{period}"] = lambda spark, sf_dir: _rounded(
        A.period_returns(M.returns(spark, sf_dir), period)
    )
    SQL[f"period_returns_{period}"] = f"""WITH {M.RETURNS},
p AS (SELECT series, date_trunc('{period}', session)::DATE AS s, product(1 + r) - 1 AS r FROM rets GROUP BY 1, 2),
sp AS (SELECT series, unnest(generate_series(min(s), max(s), INTERVAL {months} MONTH))::DATE AS s FROM p GROUP BY series)
SELECT series, last_day((s + INTERVAL {months - 1} MONTH)::DATE) AS period_end, round(r, 8) AS r FROM sp LEFT JOIN p USING (series, s)"""


for _p, _m in (("month", 1), ("quarter", 3), ("year", 12)):
    _period(_p, _m)


@_query(
    "monthly_table",
    f"""WITH {M.RETURNS} SELECT series, year(session) AS year,
  {", ".join(f"round(product(1 + r) FILTER (month(session) = {m}) - 1, 8) AS m{m}" for m in range(1, 13))},
  round(product(1 + r) - 1, 8) AS total FROM rets GROUP BY 1, 2""",
)
def monthly_table(spark, sf_dir):
    return _rounded(A.monthly_table(M.returns(spark, sf_dir))).withColumn("year", F.col("year").cast("bigint"))


_N = "sqrt(252)"
_STD = "CASE WHEN max(r) = min(r) THEN 0 ELSE stddev_samp(r) END"
_METRICS = {
    "observations": "count(r)",
    "total_return": "product(1 + r) - 1",
    "cagr": "pow(product(1 + r), 252.0 / count(r)) - 1",
    "annualized_volatility": f"({_STD}) * {_N}",
    "max_drawdown": "min(d)",
    "sharpe_ratio": f"avg(r) / NULLIF({_STD}, 0) * {_N}",
    "sortino_ratio": f"avg(r) / NULLIF(sqrt(avg(pow(least(r, 0), 2))), 0) * {_N}",
    "mean_return": "avg(r)",
    "standard_deviation": _STD,
    "skewness": "skewness(r)",
    "kurtosis": "kurtosis(r)",
    "best_period": "max(r)",
    "worst_period": "min(r)",
    "positive_ratio": "avg((r > 0)::INT)",
    "negative_ratio": "avg((r < 0)::INT)",
    "value_at_risk": "quantile_cont(r, 0.05)",
}
_PERF = f"""{_EPISODES}, mets AS (SELECT series, {", ".join(f"{v} AS {k}" for k, v in _METRICS.items())} FROM dd GROUP BY series),
tails AS (SELECT series, avg(r) AS conditional_value_at_risk FROM dd JOIN mets USING (series) WHERE r <= value_at_risk GROUP BY series),
longs AS (SELECT series, max(least(z, rows_) - a) AS longest FROM ep GROUP BY series),
perf AS (SELECT m.*, cagr / NULLIF(abs(max_drawdown), 0) AS calmar_ratio, conditional_value_at_risk, coalesce(longest, 0)::BIGINT AS max_drawdown_duration
  FROM mets m LEFT JOIN tails USING (series) LEFT JOIN longs USING (series))"""
_NAMES = [*_METRICS, "calmar_ratio", "conditional_value_at_risk", "max_drawdown_duration"]


@_query(
    "performance_metrics",
    f"""WITH {M.RETURNS}, {_drawdowns('rets')}, {_PERF}
SELECT series, {', '.join(f'round({c}, 7) AS {c}' if c not in ('observations', 'max_drawdown_duration') else c for c in _NAMES)} FROM perf""",
)
def performance_metrics(spark, sf_dir):
    return _rounded(A.performance(M.returns(spark, sf_dir)), 7)


def _grown(c: str, where: str) -> str:
    """Growth a year over the rows of a regime, by logarithms (all returns lie above -1)."""
    return f"(exp(sum(ln(1 + {c})) FILTER ({where}) * 252.0 / count(*) FILTER ({where})) - 1)"


#: Against the benchmark, from rows (series, r, b); the risk-free rate is zero.
_RELATIVE = {
    "correlation": "corr(r, b)",
    "beta": "covar_samp(r, b) / NULLIF(var_samp(b), 0)",
    "alpha": "(avg(r) - covar_samp(r, b) / NULLIF(var_samp(b), 0) * avg(b)) * 252",
    "tracking_error": f"stddev_samp(r - b) * {_N}",
    "information_ratio": f"avg(r - b) / NULLIF(stddev_samp(r - b), 0) * {_N}",
    "up_capture": f"{_grown('r', 'b > 0')} / NULLIF({_grown('b', 'b > 0')}, 0)",
    "down_capture": f"{_grown('r', 'b < 0')} / NULLIF({_grown('b', 'b < 0')}, 0)",
    "excess_cagr": "pow(product(1 + r), 252.0 / count(*)) - pow(product(1 + b), 252.0 / count(*))",
}
_SHORT = ("cagr", "excess_cagr", "calmar_ratio")
_SECTIONS = ", ".join(f"('{s}', '{m}')" for s, metrics in A.SECTIONS.items() for m in metrics)


@_query(
    "performance_summary",
    f"""WITH {M.PAIRED}, full_ AS (SELECT session FROM paired GROUP BY session HAVING count(*) = (SELECT count(DISTINCT series) FROM paired)),
both_ AS (SELECT series, session, r, b FROM paired SEMI JOIN full_ USING (session)),
src AS (SELECT series, session, r FROM both_ UNION ALL SELECT DISTINCT 'benchmark', session, b FROM both_),
{_drawdowns('src')}, {_PERF}, rel AS (SELECT series, {", ".join(f"{v} AS {k}" for k, v in _RELATIVE.items())} FROM both_ GROUP BY series),
wide AS (SELECT series, {", ".join(f"{'CASE WHEN observations >= 252 THEN ' + m + ' END' if m in _SHORT else m}::DOUBLE AS {m}" for ms in A.SECTIONS.values() for m in ms)}
  FROM perf LEFT JOIN rel USING (series)),
long_ AS (SELECT series, metric, value FROM wide UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(m for ms in A.SECTIONS.values() for m in ms)})))
SELECT series, section, metric, {_digits_sql("value")} AS value FROM long_ JOIN (VALUES {_SECTIONS}) v(section, metric) USING (metric)""",
)
def performance_summary(spark, sf_dir):
    found = A.summary(M.with_benchmark(M.returns(spark, sf_dir)), benchmark="b")
    return found.withColumn("value", _digits("value"))


@_query(
    "relative_metrics",
    f"""WITH {M.PAIRED} SELECT series, {", ".join(f"{_digits_sql(v)} AS {k}" for k, v in _RELATIVE.items())} FROM paired GROUP BY series""",
)
def relative_metrics(spark, sf_dir):
    found = A.relative(M.with_benchmark(M.returns(spark, sf_dir)))
    return found.select("series", *(_digits(c).alias(c) for c in found.columns if c != "series"))


@_query(
    "active_returns", f"WITH {M.PAIRED} SELECT series, session, round(r - b, 8) AS value FROM paired"
)
def active_returns(spark, sf_dir):
    rows = M.with_benchmark(M.returns(spark, sf_dir))
    return rows.select("series", "session", F.round(F.col("r") - F.col("b"), 8).alias("value"))


def _strict(w: int, sql: str) -> str:
    return f"CASE WHEN count(r) OVER {_frame(w)} = {w} THEN {sql} END"


_F = _frame(30)
_RSTD = f"(CASE WHEN max(r) OVER {_F} = min(r) OVER {_F} THEN 0 ELSE stddev_samp(r) OVER {_F} END)"
_column("rolling_return", lambda: A.rolling_return("r", 30), _strict(30, f"product(1 + r) OVER {_F} - 1"))
_column("rolling_volatility", lambda: A.rolling_volatility("r", 30), _strict(30, f"{_RSTD} * {_N}"))
_column("rolling_sharpe", lambda: A.rolling_sharpe("r", 30), _strict(30, f"avg(r) OVER {_F} / NULLIF({_RSTD}, 0) * {_N}"))
_column(
    "rolling_sortino",
    lambda: A.rolling_sortino("r", 30),
    _strict(
        30,
        f"CASE WHEN sum((r < 0)::INT) OVER {_F} > 0 THEN avg(r) OVER {_F} / NULLIF(sqrt(avg(pow(least(r, 0), 2)) OVER {_F}), 0) * {_N} END",
    ),
)
def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired returns whose benchmark is missing on every Friday."""
    rows = M.with_benchmark(M.returns(spark, sf_dir))
    return rows.withColumn("b", F.when(F.dayofweek("session") != 6, F.col("b")))


def _pair(name: str, value: Callable, sql: str, w: int = 4) -> None:
    """A rolling statistic of pairs; a window with a missing side gives nothing."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _gapped(spark, sf_dir).select("series", "session", F.round(value(w), 6).alias("value"))

    QUERIES[name] = run
    f = _frame(w)
    SQL[name] = f"""WITH {M.PAIRED}, gapped AS (SELECT series, session, CASE WHEN dayofweek(session) <> 5 THEN r END AS y,
    CASE WHEN dayofweek(session) <> 5 THEN b END AS x FROM paired)
SELECT series, session, round(CASE WHEN count(x) OVER {f} = {w} THEN {sql.format(f=f)} END, 6) AS value FROM gapped"""


_pair("rolling_beta", lambda w: A.rolling_beta("r", "b", w, 0.03), "covar_samp(y, x) OVER {f} / NULLIF(var_samp(x) OVER {f}, 0)")
_pair("rolling_correlation", lambda w: A.rolling_correlation("r", "b", w), "corr(y, x) OVER {f}")


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A risk-free return of each session, from its day of the month."""
    days = M.returns(spark, sf_dir).select("session").distinct()
    return days.withColumn("rf", F.dayofmonth("session") / F.lit(1e5))


@_query(
    "risk_free_series",
    f"""WITH {M.RETURNS}, x AS (SELECT series, r - day(session) / 1e5 AS e FROM rets)
SELECT series, round(avg(e) / NULLIF(stddev_samp(e), 0) * {_N}, 6) AS sharpe_ratio,
  round(avg(e) / NULLIF(sqrt(avg(pow(least(e, 0), 2))), 0) * {_N}, 6) AS sortino_ratio FROM x GROUP BY series""",
)
def risk_free_series(spark, sf_dir):
    """Ratios over a risk-free return that differs from session to session."""
    rows = A.with_risk_free(M.returns(spark, sf_dir), _rates(spark, sf_dir))
    found = rows.groupBy("series").agg(
        A.sharpe_ratio("r", "rf").alias("sharpe_ratio"), A.sortino_ratio("r", "rf").alias("sortino_ratio")
    )
    return _rounded(found, 6)


_OUTCOME = f"""f AS (SELECT *, sign(result)::INT AS s FROM trades),
c AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY seq) - row_number() OVER (PARTITION BY series, s ORDER BY seq) AS isl FROM f),
runs AS (SELECT series, s, isl, count(*) AS n FROM c GROUP BY ALL),
st AS (SELECT series, coalesce(max(n) FILTER (s > 0), 0) AS max_consecutive_wins, coalesce(max(n) FILTER (s < 0), 0) AS max_consecutive_losses FROM runs GROUP BY series),
g AS (SELECT series, count(*) AS trade_count, avg((result > 0)::INT) AS win_rate, avg((result < 0)::INT) AS loss_rate, avg(result) AS expectancy,
  stddev_samp(result) AS trade_standard_deviation, avg(result) / NULLIF(stddev_samp(result), 0) * sqrt(count(*)) AS expectancy_t_stat,
  avg(result) FILTER (result > 0) AS average_win, avg(result) FILTER (result < 0) AS average_loss,
  avg(result) FILTER (result > 0) / abs(avg(result) FILTER (result < 0)) AS payoff_ratio,
  coalesce(sum(result) FILTER (result > 0), 0) AS gross_profit, coalesce(sum(result) FILTER (result < 0), 0) AS gross_loss,
  coalesce(sum(result) FILTER (result > 0), 0) / abs(sum(result) FILTER (result < 0)) AS profit_factor,
  max(result) AS best_trade, min(result) AS worst_trade FROM trades GROUP BY series),
outcome AS (SELECT * FROM g JOIN st USING (series))"""
_COUNTS = ("trade_count", "max_consecutive_wins", "max_consecutive_losses")


@_query(
    "trade_metrics",
    f"""WITH {M.TRADES}, {_OUTCOME}
SELECT series, {", ".join(c if c in _COUNTS else f"round({c}, 6) AS {c}" for c in A.TRADE_SECTIONS["outcome"])} FROM outcome""",
)
def trade_metrics(spark, sf_dir):
    return _rounded(A.trade_metrics(M.trades(spark, sf_dir)), 6)


#: A position opened on every bar and held for up to three more sessions.
_TIMING = """cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS pos FROM (SELECT DISTINCT session FROM bars)),
held AS (SELECT b.symbol AS series, c.pos AS a, least(c.pos + c.pos % 4, (SELECT max(pos) FROM cal)) AS z FROM bars b JOIN cal c USING (session)),
cov AS (SELECT series, count(DISTINCT pos) AS n FROM held JOIN cal ON pos BETWEEN a AND z GROUP BY series),
tm AS (SELECT series, count(*) AS k, avg(z - a + 1) AS average_holding_period FROM held GROUP BY series),
timing AS (SELECT series, k / (SELECT count(*) FROM cal) AS trade_frequency, n / (SELECT count(*) FROM cal) AS exposure, average_holding_period
  FROM tm JOIN cov USING (series))"""


def _held(daily: DataFrame, sessions: DataFrame) -> DataFrame:
    last = F.max("pos").over(Window.partitionBy(F.lit(1)))
    ends = sessions.select(F.col("session").alias("entry"), F.least(F.col("pos") + F.col("pos") % 4, last).alias("_z"))
    ends = ends.join(sessions.select(F.col("session").alias("exit"), F.col("pos").alias("_z")), "_z")
    return daily.select(F.col("symbol").alias("series"), F.col("session").alias("entry")).join(ends.select("entry", "exit"), "entry")


@_query(
    "trade_timing",
    f"""WITH {M.BARS}, {_TIMING} SELECT series, round(trade_frequency, 8) AS trade_frequency, round(exposure, 8) AS exposure,
  round(average_holding_period, 8) AS average_holding_period FROM timing""",
)
def trade_timing(spark, sf_dir):
    """Positions opened on every bar and held for up to three more sessions."""
    daily = M.bars_once(spark, sf_dir, "symbol", "session")
    sessions = sessions_of(daily, "session")
    return _rounded(A.trade_timing(_held(daily, sessions), sessions))


_TRADE_ROWS = ", ".join(f"('{s}', '{m}')" for s, metrics in A.TRADE_SECTIONS.items() for m in metrics)
_TRADE_NAMES = [m for metrics in A.TRADE_SECTIONS.values() for m in metrics]


@_query(
    "trade_summary",
    f"""WITH {M.TRADES}, {_OUTCOME}, {_TIMING},
wide AS (SELECT series, {", ".join(f"{m}::DOUBLE AS {m}" for m in _TRADE_NAMES)} FROM outcome JOIN timing USING (series)),
long_ AS (SELECT series, metric, value FROM wide UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(_TRADE_NAMES)})))
SELECT series, section, metric, round(value, 6) AS value FROM long_ JOIN (VALUES {_TRADE_ROWS}) v(section, metric) USING (metric)""",
)
def trade_summary(spark, sf_dir):
    daily = M.bars_once(spark, sf_dir, "symbol", "session", symbol="p_type")
    sessions = cut_lineage(sessions_of(daily, "session"))
    return _rounded(A.trade_summary(M.trades(spark, sf_dir), _held(daily, sessions), sessions), 6)
