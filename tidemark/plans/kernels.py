"""Queries of bars, calendar and kernels, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.operators import calendar as C
from tidemark.operators.panel import Panel
from tidemark.operators.slices import in_slices
from tidemark.plans import market as M
from tidemark.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_W = "(PARTITION BY symbol ORDER BY session)"


def _frame(w: int) -> str:
    return f"(PARTITION BY symbol ORDER BY session ROWS {w - 1} PRECEDING)"


def _query(name: str, sql: str) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


@_query(
    "bars_ohlcv",
    f"""WITH {M.BARS}
SELECT symbol, session, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close,
  round(volume, 4) AS volume, round(traded_value, 2) AS traded_value FROM bars""",
)
def bars_ohlcv(spark, sf_dir):
    places = {"open": 8, "high": 8, "low": 8, "close": 8, "volume": 4, "traded_value": 2}
    return M.bars(spark, sf_dir).select("symbol", "session", *(F.round(c, n).alias(c) for c, n in places.items()))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand bars on every session, with nulls in the gaps."""
    daily = M.bars_once(spark, sf_dir)
    return C.align(daily, C.sessions_of(daily, "session"))


_ALIGNED = f"""{M.BARS},
cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS pos FROM (SELECT DISTINCT session FROM bars)),
span AS (SELECT symbol, min(session) AS a, max(session) AS b FROM bars GROUP BY symbol),
aligned AS (SELECT s.symbol, c.session, c.pos, b.* EXCLUDE (symbol, session)
  FROM span s JOIN cal c ON c.session BETWEEN s.a AND s.b
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.session = c.session)"""


@_query(
    "align_calendar",
    f"WITH {_ALIGNED} SELECT symbol, session, round(close, 8) AS close, round(volume, 4) AS volume FROM aligned",
)
def align_calendar(spark, sf_dir):
    return _aligned(spark, sf_dir).select(
        "symbol", "session", F.round("close", 8).alias("close"), F.round("volume", 4).alias("volume")
    )


@_query(
    "check_bars",
    f"""WITH {_ALIGNED}, bent AS (SELECT symbol, session, open, high * (CASE WHEN pos % 7 = 0 THEN 0.5 ELSE 1 END) AS high,
  low, close, volume * (CASE WHEN pos % 11 = 0 THEN -1 ELSE 1 END) AS volume FROM aligned)
SELECT symbol, session, coalesce(high < low, false) AS critical_high_below_low,
  coalesce(high < open, false) AS critical_high_below_open, coalesce(high < close, false) AS critical_high_below_close,
  coalesce(low > open, false) AS critical_low_above_open, coalesce(low > close, false) AS critical_low_above_close,
  coalesce(volume < 0, false) AS critical_negative_volume,
  coalesce(open < 0 OR high < 0 OR low < 0 OR close < 0, false) AS warning_negative_price FROM bent""",
)
def check_bars(spark, sf_dir):
    """The rules on bars of which some are bent on purpose."""
    daily = M.bars_once(spark, sf_dir)
    sessions = C.sessions_of(daily, "session")
    bent = C.align(daily, sessions).join(sessions, "session").select(
        "symbol",
        "session",
        "open",
        (F.col("high") * F.when(F.col("pos") % 7 == 0, 0.5).otherwise(1.0)).alias("high"),
        "low",
        "close",
        (F.col("volume") * F.when(F.col("pos") % 11 == 0, -1.0).otherwise(1.0)).alias("volume"),
    )
    found = C.check_bars(bent)
    return found.select("symbol", "session", *(c for c in found.columns if c.startswith(("critical", "warning"))))


@_query(
    "interior_gaps",
    f"""WITH {_ALIGNED} SELECT symbol, bool_or(close IS NULL) AS has_gap FROM aligned GROUP BY symbol""",
)
def interior_gaps(spark, sf_dir):
    return C.interior_gaps(_aligned(spark, sf_dir), "close")


@_query(
    "calendar_offset",
    f"""WITH {_ALIGNED} SELECT c.session, d.session AS before
FROM cal c JOIN cal d ON d.pos = greatest(c.pos - 5, 0)""",
)
def calendar_offset(spark, sf_dir):
    sessions = cut_lineage(C.sessions_of(M.bars(spark, sf_dir), "session"))
    return C.offset_sessions(sessions.select("session"), sessions, "session", 5, "before").select("session", "before")


def panel_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all aligned bars; sums of prices count to the cent, whatever their order."""
    rows = _aligned(spark, sf_dir)
    if "traded_value" in rows.columns:
        rows = rows.withColumn("traded_value", F.round("traded_value", 2))
    return spark.createDataFrame([(Panel.from_bars(rows).fingerprint(),)], "fingerprint string")


QUERIES["panel_fingerprint"] = panel_fingerprint


def _kernel(name: str, value: Callable[[], Column], sql: str, on_returns: bool = False) -> None:
    """A kernel of the close (or its log return) on the aligned bars."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _aligned(spark, sf_dir)
        if on_returns:
            rows = rows.withColumn("ret", K.log_returns("close"))
        return rows.select("symbol", "session", F.round(value(), 8).alias("value"))

    obs = "SELECT symbol, session, close AS x FROM aligned WHERE close IS NOT NULL"
    if on_returns:
        obs = f"SELECT * FROM (SELECT symbol, session, ln(close / lag(close) OVER {_W}) AS x FROM ({obs.replace('close AS x', 'close')})) WHERE x IS NOT NULL"
    QUERIES[name] = run
    SQL[name] = f"""WITH {_ALIGNED}, obs AS ({obs}), k AS (SELECT symbol, session, {sql} AS v FROM obs)
SELECT symbol, session, round(v, 8) AS value FROM aligned LEFT JOIN k USING (symbol, session)"""


def _strict(w: int, sql: str) -> str:
    return f"CASE WHEN count(x) OVER {_frame(w)} = {w} THEN {sql} END"


_STD = f"CASE WHEN max(x) OVER {_frame(20)} = min(x) OVER {_frame(20)} THEN 0 ELSE stddev_samp(x) OVER {_frame(20)} END"
_kernel("lag_5", lambda: K.lag("close", 5), f"lag(x, 5) OVER {_W}")
_kernel("simple_returns", lambda: K.simple_returns("close"), f"x / lag(x) OVER {_W} - 1")
_kernel("log_returns", lambda: K.log_returns("close"), f"ln(x / lag(x) OVER {_W})")
_kernel("rolling_sum_20", lambda: K.rolling_sum("close", 20), _strict(20, f"sum(x) OVER {_frame(20)}"))
_kernel("sma_20", lambda: K.sma("close", 20), _strict(20, f"avg(x) OVER {_frame(20)}"))
_kernel("rolling_std_20", lambda: K.rolling_std("close", 20), _strict(20, _STD))
_kernel(
    "rolling_std_ddof0_10",
    lambda: K.rolling_std("close", 10, 0),
    _strict(10, f"CASE WHEN max(x) OVER {_frame(10)} = min(x) OVER {_frame(10)} THEN 0 ELSE stddev_pop(x) OVER {_frame(10)} END"),
)
_kernel(
    "rolling_zscore_20",
    lambda: K.rolling_zscore("close", 20),
    _strict(20, f"(x - avg(x) OVER {_frame(20)}) / NULLIF({_STD}, 0)"),
)
@_query("rolling_std_sliced", SQL["rolling_std_20"])
def rolling_std_sliced(spark, sf_dir):
    """The same in slices of 256 observations, as for a hot symbol."""
    rows = _aligned(spark, sf_dir).select("symbol", "session", "close")
    cut = in_slices(rows, "close", lambda by: K.rolling_std("close", 20, by=by), "value", reach=19, length=256)
    return cut.select("symbol", "session", F.round("value", 8).alias("value"))


_kernel("hist_vol_20", lambda: K.historical_volatility("ret", 20), _strict(20, _STD), on_returns=True)


def _smoothed(name: str, alpha: float, of_returns: bool) -> None:
    lookback = K.exponential_lookback(alpha)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = M.bars(spark, sf_dir, "p_type").select("symbol", "session", "close")
        if of_returns:
            rows = rows.withColumn("ret", K.log_returns("close"))
            rows = K.with_ewma_volatility(rows, "ret", alpha, "value")
        else:
            rows = K.with_ema(rows, "close", alpha, "value")
        return rows.select("symbol", "session", F.round("value", 8).alias("value"))

    x = f"pow(ln(close / lag(close) OVER {_W}), 2)" if of_returns else "close"
    out = "sqrt(e)" if of_returns else "e"
    QUERIES[name] = run
    SQL[name] = f"""WITH RECURSIVE {M.DENSE}, xs AS (SELECT symbol, session, {x} AS x FROM bars),
n AS (SELECT symbol, session, x, row_number() OVER {_W} AS k FROM xs WHERE x IS NOT NULL),
ema AS (SELECT symbol, session, k, x AS e FROM n WHERE k = 1
  UNION ALL SELECT n.symbol, n.session, n.k, {alpha!r} * n.x + {1 - alpha!r} * ema.e FROM ema JOIN n ON n.symbol = ema.symbol AND n.k = ema.k + 1)
SELECT symbol, session, round(CASE WHEN k > {lookback} THEN {out} END, 8) AS value
FROM bars LEFT JOIN ema USING (symbol, session)"""


_smoothed("ema_span20", K.alpha_from_span(20), False)
_smoothed("ewma_vol_094", K.alpha_from_decay(0.94), True)


@_query(
    "cs_rank",
    f"""WITH {M.BARS}, m AS (SELECT *, volume > 20 AS inside FROM bars), p AS (SELECT * FROM m WHERE inside AND close IS NOT NULL),
r AS (SELECT symbol, session, count(*) OVER (PARTITION BY session) AS n, rank() OVER (PARTITION BY session ORDER BY volume) AS rk,
  count(*) OVER (PARTITION BY session, volume) AS ties FROM p)
SELECT symbol, session, round(CASE WHEN n > 1 THEN (rk + (ties - 1) / 2.0 - 1) / (n - 1) END, 8) AS value
FROM bars LEFT JOIN r USING (symbol, session)""",
)
def cs_rank(spark, sf_dir):
    rows = M.bars(spark, sf_dir).withColumn("inside", F.col("volume") > 20)
    return rows.select("symbol", "session", F.round(K.cs_rank("volume", "inside"), 8).alias("value"))


@_query(
    "cs_zscore",
    f"""WITH {M.BARS}, p AS (SELECT * FROM bars WHERE volume > 20),
r AS (SELECT symbol, session, count(*) OVER w AS n, (close - avg(close) OVER w) / NULLIF(stddev_samp(close) OVER w, 0) AS z,
  max(close) OVER w > min(close) OVER w AS moves FROM p WINDOW w AS (PARTITION BY session))
SELECT symbol, session, round(CASE WHEN n >= 2 AND moves THEN z END, 8) AS value FROM bars LEFT JOIN r USING (symbol, session)""",
)
def cs_zscore(spark, sf_dir):
    rows = M.bars(spark, sf_dir).withColumn("inside", F.col("volume") > 20)
    return rows.select("symbol", "session", F.round(K.cs_zscore("close", "inside"), 8).alias("value"))


@_query(
    "flagship",
    f"""WITH {M.BARS}, r AS (SELECT symbol, session, ln(close / lag(close) OVER {_W}) AS x,
    avg(traded_value) OVER {_frame(60)} AS liquidity FROM bars),
obs AS (SELECT *, CASE WHEN count(x) OVER {_frame(20)} = 20 THEN {_STD} END AS vol FROM r WHERE x IS NOT NULL),
top AS (SELECT symbol, session, row_number() OVER (PARTITION BY session ORDER BY round(liquidity, 4) DESC, symbol) <= 15 AS inside FROM r),
p AS (SELECT o.symbol, o.session, o.vol FROM obs o JOIN top USING (symbol, session) WHERE inside AND vol IS NOT NULL),
k AS (SELECT symbol, session, count(*) OVER (PARTITION BY session) AS n, rank() OVER (PARTITION BY session ORDER BY vol) AS rk,
  count(*) OVER (PARTITION BY session, vol) AS ties FROM p)
SELECT symbol, session, round(vol, 8) AS vol, round(CASE WHEN n > 1 THEN (rk + (ties - 1) / 2.0 - 1) / (n - 1) END, 8) AS score
FROM p JOIN k USING (symbol, session)""",
)
def flagship(spark, sf_dir):
    """Bars -> log returns -> volatility -> liquid universe -> rank."""
    w = Window.partitionBy("symbol").orderBy("session")
    rows = M.bars(spark, sf_dir).select("symbol", "session", "close", "traded_value").withColumns(
        {"ret": K.log_returns("close"), "liquidity": F.avg("traded_value").over(w.rowsBetween(-59, 0))}
    )
    rows = rows.withColumn("vol", K.rolling_std("ret", 20))
    top = Window.partitionBy("session").orderBy(F.round("liquidity", 4).desc(), "symbol")
    rows = rows.withColumn("inside", F.row_number().over(top) <= 15)
    return rows.withColumn("score", K.cs_rank("vol", "inside")).where("inside AND vol IS NOT NULL").select(
        "symbol", "session", F.round("vol", 8).alias("vol"), F.round("score", 8).alias("score")
    )
