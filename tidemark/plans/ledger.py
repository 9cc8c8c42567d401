"""Queries of runs, ex-sessions and the placing of events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.common import missing_as_null, norm, table
from tidemark.operators import ledger
from tidemark.operators.calendar import sessions_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ex-sessions as a market of their own, a bar for each ISIN and session."""
    rows = table(spark, sf_dir, "ex_sessions").select(
        norm("isin").alias("isin"), F.col("session_date").alias("session"), (F.col("to_distribution") - F.col("to_distribution") % 2).alias("distribution_number"),
        norm("ticker").alias("ticker"), missing_as_null("open").alias("open"), missing_as_null("previous_close").alias("close"),
    )
    return rows.groupBy("isin", "session").agg(*(F.max(c).alias(c) for c in ("distribution_number", "ticker", "open", "close")))


_RUNS = """t AS (SELECT upper(trim(isin)) AS isin, session_date AS session, max(to_distribution - to_distribution % 2) AS n, max(upper(trim(ticker))) AS ticker,
    max(open) FILTER (isfinite(open)) AS open, max(previous_close) FILTER (isfinite(previous_close)) AS close FROM ex_sessions GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN n IS NOT DISTINCT FROM lag(n) OVER w AND lag(session) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM t WHERE isin IS NOT NULL AND session IS NOT NULL
  WINDOW w AS (PARTITION BY isin ORDER BY session)),
g AS (SELECT *, sum(new) OVER (PARTITION BY isin ORDER BY session ROWS UNBOUNDED PRECEDING) AS run FROM f),
runs AS (SELECT isin, run::BIGINT AS run, any_value(n) AS n, min(session) AS a, max(session) AS z, arg_min(ticker, session) AS ticker,
    (list(open ORDER BY session))[1] AS open, (list(close ORDER BY session DESC))[1] AS close FROM g GROUP BY isin, run),
nx AS (SELECT *, lead(a) OVER (PARTITION BY isin ORDER BY run) AS ex, lag(n) OVER (PARTITION BY isin ORDER BY run) AS n0,
    lag(z) OVER (PARTITION BY isin ORDER BY run) AS z0, lag(close) OVER (PARTITION BY isin ORDER BY run) AS c0 FROM runs)"""


@_query(
    "distribution_runs",
    f"""WITH {_RUNS} SELECT isin, run, n AS distribution_number, a AS first_session, z AS last_session, ticker, open AS first_open, close AS last_close FROM runs""",
)
def distribution_runs(spark, sf_dir):
    return ledger.distribution_runs(_traded(spark, sf_dir))


@_query(
    "ledger_ex_sessions",
    f"""WITH {_RUNS} SELECT isin, ticker, a AS session, z0 AS previous_session, n0 AS from_distribution, n AS to_distribution, c0 AS previous_close, open,
  round(open / nullif(c0, 0), 8) AS open_ratio FROM nx WHERE z0 IS NOT NULL""",
)
def ledger_ex_sessions(spark, sf_dir):
    return ledger.ex_sessions(ledger.distribution_runs(_traded(spark, sf_dir))).withColumn("open_ratio", F.round("open_ratio", 8))


@_query(
    "event_placement",
    f"""WITH {_RUNS}, cal AS (SELECT DISTINCT session_date AS session FROM trading_sessions),
e AS (SELECT DISTINCT event_no, upper(trim(isin)) AS isin, last_cum_date AS d, distribution_number AS k FROM source_events),
m AS (SELECT e.*, nx.z, nx.ex FROM e ASOF LEFT JOIN nx ON e.isin = nx.isin AND e.d >= nx.a WHERE e.d IS NOT NULL),
md AS (SELECT event_no, isin, d, CASE WHEN z > d THEN 'no_ex_session' WHEN z IS NOT NULL AND ex IS NOT NULL THEN 'matched' ELSE 'not_traded' END AS placement,
    CASE WHEN z <= d THEN ex END AS ex_session FROM m),
mx AS (SELECT md.*, c.session AS ex_date FROM md ASOF LEFT JOIN cal c ON c.session > md.d),
nn AS (SELECT isin, n, arg_max(coalesce(ex, DATE '1000-01-01'), a) AS ex FROM nx GROUP BY isin, n),
mn AS (SELECT e.event_no, e.isin, nullif(nn.ex, DATE '1000-01-01') AS ex FROM e ASOF LEFT JOIN nn ON e.isin = nn.isin AND e.k >= nn.n WHERE e.d IS NULL),
my AS (SELECT mn.*, c.session AS cum FROM mn ASOF LEFT JOIN cal c ON c.session < mn.ex)
SELECT event_no, isin, d AS last_cum_date, placement, ex_session, ex_date, coalesce(ex_session, ex_date) AS anchor_date FROM mx
UNION ALL SELECT event_no, isin, cum, CASE WHEN ex IS NULL THEN 'not_traded' ELSE 'matched' END, ex, ex, ex FROM my""",
)
def event_placement(spark, sf_dir):
    """Events on the changes of number: by their date, those without one by their number."""
    events = table(spark, sf_dir, "source_events").select("event_no", norm("isin").alias("isin"), "last_cum_date", "distribution_number")
    days = sessions_of(table(spark, sf_dir, "trading_sessions"), "session_date")
    found = ledger.placed(events.distinct(), ledger.distribution_runs(_traded(spark, sf_dir)), days)
    return found.select("event_no", "isin", "last_cum_date", "placement", "ex_session", "ex_date", "anchor_date")
