"""Queries of ordered joins, adjustment, universes and backtests, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.common import norm, table
from tidemark.functions.identifiers import FACTOR_BASES, implied_factor, is_isin, snapped_ratio
from tidemark.operators import adjustment, backtest, factors, joins, universe
from tidemark.operators.calendar import sessions_of
from tidemark.plans import market as M
from tidemark.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# -- ordered joins ------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_events").select("event_no", norm("isin").alias("isin"), "last_cum_date").distinct()


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ex_sessions").select(
        norm("isin").alias("isin"), "session_date", "from_distribution", "to_distribution"
    )
    return rows.groupBy("isin", "session_date").agg(
        F.max("from_distribution").alias("from_distribution"), F.max("to_distribution").alias("to_distribution")
    )


_EVENTS = """
e AS (SELECT DISTINCT event_no, upper(trim(isin)) AS isin, last_cum_date FROM source_events),
x AS (SELECT upper(trim(isin)) AS isin, session_date, max(from_distribution) AS from_distribution,
    max(to_distribution) AS to_distribution FROM ex_sessions GROUP BY 1, 2)"""


@_query(
    "asof_backward",
    f"""WITH {_EVENTS} SELECT e.event_no, e.isin, e.last_cum_date, x.session_date, x.to_distribution
FROM e ASOF LEFT JOIN x ON e.isin = x.isin AND e.last_cum_date >= x.session_date""",
)
def asof_backward(spark, sf_dir):
    days = _sessions(spark, sf_dir)
    return joins.asof(_events(spark, sf_dir), days, "isin", ("last_cum_date", "session_date"), ["session_date", "to_distribution"])


@_query(
    "asof_forward",
    f"""WITH {_EVENTS}, m AS (SELECT e.event_no, e.isin, e.last_cum_date, x.session_date
  FROM e ASOF LEFT JOIN x ON e.isin = x.isin AND e.last_cum_date <= x.session_date)
SELECT event_no, isin, last_cum_date, CASE WHEN session_date - last_cum_date <= 5 THEN session_date END AS session_date FROM m""",
)
def asof_forward(spark, sf_dir):
    days = _sessions(spark, sf_dir)
    return joins.asof(
        _events(spark, sf_dir), days, "isin", ("last_cum_date", "session_date"), ["session_date"], direction="forward", within_days=5
    )


@_query(
    "interval_lookup",
    f"""WITH {_EVENTS}, iv AS (SELECT isin, session_date AS a, to_distribution AS d,
    lead(session_date) OVER (PARTITION BY isin ORDER BY session_date) - 1 AS b FROM x)
SELECT e.event_no, e.isin, e.last_cum_date, iv.d AS distribution FROM e LEFT JOIN iv
  ON e.isin = iv.isin AND e.last_cum_date >= iv.a AND (iv.b IS NULL OR e.last_cum_date <= iv.b)""",
)
def interval_lookup(spark, sf_dir):
    w = Window.partitionBy("isin").orderBy("session_date")
    spans = _sessions(spark, sf_dir).select(
        "isin", F.col("session_date").alias("a"), F.date_sub(F.lead("session_date").over(w), 1).alias("b"), F.col("to_distribution").alias("distribution")
    )
    return joins.interval_lookup(_events(spark, sf_dir), spans, "isin", "last_cum_date", "a", "b", ["distribution"])


@_query(
    "multiset_union",
    """WITH r AS (SELECT upper(trim(isin)) AS isin, event_type, source FROM source_events WHERE source IN ('b3_listed', 'b3_credited', 'cvm_fre')),
n AS (SELECT isin, event_type, source, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT isin, event_type, max(n) AS n FROM n GROUP BY ALL)
SELECT isin, event_type FROM m, generate_series(1, m.n)""",
)
def multiset_union(spark, sf_dir):
    rows = table(spark, sf_dir, "source_events").select(norm("isin").alias("isin"), "event_type", "source")
    parts = [rows.where(F.col("source") == s).drop("source") for s in ("b3_listed", "b3_credited", "cvm_fre")]
    return joins.multiset_union(parts)


@_query(
    "value_runs",
    """WITH f AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n
FROM g GROUP BY user_id, run""",
)
def value_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    marked = joins.islands(rows, ["user_id"], "event_id", F.col("event_type"), "run")
    return marked.groupBy("user_id", "run").agg(
        F.first("event_type").alias("event_type"),
        F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"),
        F.count("*").alias("n"),
    )


@_query(
    "distribution_steps",
    f"""WITH {_EVENTS}, p AS (SELECT *, lag(to_distribution) OVER (PARTITION BY isin ORDER BY session_date) AS before FROM x)
SELECT isin, session_date, from_distribution, to_distribution, before IS NOT NULL AND before <> from_distribution AS broken FROM p""",
)
def distribution_steps(spark, sf_dir):
    """Whether an ex-session goes on from the one before it."""
    w = Window.partitionBy("isin").orderBy("session_date")
    before = F.lag("to_distribution").over(w)
    return _sessions(spark, sf_dir).withColumn("broken", before.isNotNull() & (before != F.col("from_distribution")))


# -- identifiers --------------------------------------------------------------------


@_query(
    "isin_check",
    """WITH c AS (SELECT DISTINCT upper(trim(isin)) AS isin FROM security_master),
d AS (SELECT isin, list_reverse(string_split(list_aggregate(list_transform(string_split(left(isin, 11), ''),
    lambda ch: CASE WHEN ch BETWEEN '0' AND '9' THEN ch ELSE CAST(ascii(ch) - 55 AS VARCHAR) END), 'string_agg', ''), '')) AS ds FROM c),
s AS (SELECT isin, list_sum(list_transform(ds, lambda v, i: CASE WHEN i % 2 = 0 THEN v::INT ELSE (v::INT * 2) // 10 + (v::INT * 2) % 10 END)) AS t FROM d)
SELECT isin, CASE WHEN regexp_full_match(isin, '[A-Z]{2}[A-Z0-9]{9}[0-9]') THEN (10 - t % 10) % 10 = right(isin, 1)::INT ELSE false END AS valid FROM s""",
)
def isin_check(spark, sf_dir):
    codes = table(spark, sf_dir, "security_master").select(norm("isin").alias("isin")).distinct()
    return codes.select("isin", is_isin("isin").alias("valid"))


_FACTORS = ", ".join(repr(f) for f in sorted({f for b in FACTOR_BASES for f in (b, 1.0 / b)}))


@_query(
    "implied_factors",
    f"""WITH r AS (SELECT DISTINCT upper(trim(from_isin)) AS from_isin, upper(trim(to_isin)) AS to_isin, ratio FROM link_candidates WHERE ratio > 0),
f AS (SELECT unnest([{_FACTORS}]::DOUBLE[]) AS f),
n AS (SELECT from_isin, to_isin, ratio, min(abs(ln(ratio / f))) AS d, arg_min(f, abs(ln(ratio / f))) AS f FROM r, f GROUP BY ALL)
SELECT from_isin, to_isin, ratio, round(CASE WHEN d <= ln(1.05) THEN f END, 8) AS implied,
  round(CASE WHEN abs(ratio / f - 1) <= 0.005 THEN f WHEN abs(ratio / round(ratio, 2) - 1) <= 0.005 THEN round(ratio, 2) ELSE ratio END, 8) AS snapped FROM n""",
)
def implied_factors(spark, sf_dir):
    rows = table(spark, sf_dir, "link_candidates").select(norm("from_isin").alias("from_isin"), norm("to_isin").alias("to_isin"), "ratio")
    return rows.where("ratio > 0").distinct().withColumns(
        {"implied": F.round(implied_factor("ratio"), 8), "snapped": F.round(snapped_ratio("ratio"), 8)}
    )


# -- adjustment ---------------------------------------------------------------------


def _factors(daily: DataFrame) -> DataFrame:
    """Factors on the first session of each quarter, from the quarter's number; a split each January."""
    first = daily.groupBy("symbol", F.trunc("session", "quarter").alias("q")).agg(F.min("session").alias("ex_date"))
    shares = F.when(F.month("q") == 1, 2.0).otherwise(1.0)
    paid = F.lit(1.0) - (F.month("q") + F.year("q") % 7) / F.lit(200.0)
    return first.select(
        "symbol", "ex_date", paid.alias("factor"), (paid / shares).alias("f_total"), (1 / shares).alias("f_splits"), shares.alias("share_ratio")
    )


_LEDGER = f"""{M.BARS}, led AS (SELECT *, factor / share_ratio AS f_total, 1 / share_ratio AS f_splits FROM (
    SELECT symbol, min(session) AS ex_date, 1.0::DOUBLE - (month(date_trunc('quarter', session)) + year(session) % 7) / 200.0::DOUBLE AS factor,
      CASE WHEN month(date_trunc('quarter', session)) = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS share_ratio
    FROM bars GROUP BY symbol, date_trunc('quarter', session), year(session)))"""


def _adjusted(name: str, mode: str, anchor: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        daily = M.bars_once(spark, sf_dir, "symbol", "session", "open", "close", "volume")
        rows = adjustment.adjust(daily, _factors(daily), anchor, mode)
        return rows.select("symbol", "session", F.round("open", 8).alias("open"), F.round("close", 8).alias("close"), F.round("volume", 4).alias("volume"))

    limit = f"AND l.ex_date <= DATE '{anchor}'" if anchor else ""
    price = "f_total" if mode == "total_return" else "f_splits"
    QUERIES[name] = run
    SQL[name] = f"""WITH {_LEDGER} SELECT b.symbol, b.session, round(any_value(b.open) * coalesce(product(l.{price}), 1), 8) AS open,
  round(any_value(b.close) * coalesce(product(l.{price}), 1), 8) AS close, round(any_value(b.volume) * coalesce(product(l.share_ratio), 1), 4) AS volume
FROM bars b LEFT JOIN led l ON l.symbol = b.symbol AND b.session < l.ex_date {limit} GROUP BY b.symbol, b.session"""


_adjusted("adjust_all", "total_return", None)
_adjusted("adjust_anchored", "total_return", "1996-06-28")
_adjusted("adjust_splits", "splits", "1998-03-31")


#: What an event of each type does to a holding.
_KINDS = {
    "CASH_DIVIDEND": factors.CASH,
    "INTEREST_ON_CAPITAL": factors.CASH,
    "INCOME": factors.CASH,
    "RETURN_OF_CAPITAL": factors.CASH,
    "SPLIT": factors.SHARES,
    "REVERSE_SPLIT": factors.SHARES,
    "STOCK_BONUS": factors.SHARES,
    "SUBSCRIPTION": factors.RIGHTS,
}


def _of_kind(kind: str) -> str:
    return "(" + ", ".join(f"'{t}'" for t, k in _KINDS.items() if k == kind) + ")"


@_query(
    "event_factors",
    f"""WITH ev AS (SELECT DISTINCT event_id, upper(trim(security_id)) AS security_id, upper(trim(isin)) AS isin, ex_session, event_type,
    CASE WHEN isfinite(cash_amount) THEN cash_amount END AS cash, CASE WHEN isfinite(share_ratio) AND share_ratio > 0 THEN share_ratio END AS ratio,
    CASE WHEN isfinite(subscription_price) THEN subscription_price END AS price
  FROM corporate_actions WHERE upper(trim(status)) IN ('CONFIRMED', 'INFERRED') AND ex_session IS NOT NULL AND security_id IS NOT NULL),
pc AS (SELECT upper(trim(isin)) AS isin, session_date, max(previous_close) FILTER (isfinite(previous_close)) AS p FROM ex_sessions GROUP BY 1, 2),
w AS (SELECT ev.*, pc.p, CASE WHEN event_type IN {_of_kind(factors.CASH)} THEN cash
    WHEN event_type IN {_of_kind(factors.RIGHTS)} THEN ratio * greatest(p - price, 0) / (1 + ratio) END AS worth,
    CASE WHEN event_type IN {_of_kind(factors.SHARES)} THEN coalesce(ratio, 1) ELSE 1 END AS shares
  FROM ev LEFT JOIN pc ON pc.isin = ev.isin AND pc.session_date = ev.ex_session),
g AS (SELECT security_id, ex_session AS ex_date, min(isin) AS isin, max(p) AS p, coalesce(sum(worth), 0) AS v, product(shares) AS ratio,
    string_agg(event_id, ',' ORDER BY event_id) AS event_ids FROM w GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN p IS NULL THEN 'no_previous_close' WHEN v >= p THEN 'value_exceeds_price' END AS reason FROM g)
SELECT security_id, isin, ex_date, round(p, 8) AS previous_close, round(v, 8) AS cash_value, round(ratio, 8) AS share_ratio,
  round(CASE WHEN reason IS NULL THEN (1 - v / p) / ratio END, 8) AS f_total, round(CASE WHEN reason IS NULL THEN 1 / ratio END, 8) AS f_splits,
  event_ids, reason FROM r""",
)
def event_factors(spark, sf_dir):
    """The factor of each ex-session of the ledger, or why it has none."""
    events = table(spark, sf_dir, "corporate_actions").where(norm("status").isin("CONFIRMED", "INFERRED"))
    named = {c: norm(c) for c in ("security_id", "isin", "target_isin")}
    events = events.withColumns(named).withColumn("target_security", F.lit(None).cast("string"))
    before = table(spark, sf_dir, "ex_sessions").select(norm("isin").alias("isin"), F.col("session_date").alias("session"), F.col("previous_close").alias("close"))
    found = factors.event_factors(events, before, _KINDS)
    return found.select(*(F.round(c, 8).alias(c) if t == "double" else c for c, t in found.dtypes))


@_query(
    "adjustment_intervals",
    f"""WITH {_LEDGER} SELECT symbol, lag(ex_date) OVER w AS from_, ex_date AS upto,
  round(product(factor) OVER (PARTITION BY symbol ORDER BY ex_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS product
FROM led WINDOW w AS (PARTITION BY symbol ORDER BY ex_date)""",
)
def adjustment_intervals(spark, sf_dir):
    steps = adjustment.factor_intervals(_factors(M.bars(spark, sf_dir)), "symbol", "ex_date", "factor")
    return steps.withColumn("product", F.round("product", 8))


# -- universes ------------------------------------------------------------------------


def _market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    daily = M.bars_once(spark, sf_dir, "symbol", "session", "close", "traded_value")
    sessions = cut_lineage(sessions_of(daily, "session"))
    return daily, sessions, universe.four_month_periods(sessions)


_PERIODS = f"""{M.BARS},
cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS pos FROM (SELECT DISTINCT session FROM bars)),
per AS (SELECT strftime(make_date(year(session), ((month(session) - 1) // 4 * 4 + 1)::BIGINT, 1), '%Y-%m') AS period,
    min(session) AS effective_from, max(session) AS effective_to, min(pos) - 3 AS base_pos FROM cal GROUP BY 1)"""


def _liquid_sql(top: int, name: str, lookback: int = 120, presence: float = 0.5) -> str:
    return f"""
{name}_v AS (SELECT p.period, b.symbol, list(b.traded_value) AS v FROM per p JOIN cal c ON c.pos BETWEEN p.base_pos - {lookback - 1} AND p.base_pos
  JOIN bars b ON b.session = c.session AND b.traded_value > 0 WHERE p.base_pos >= {lookback - 1} GROUP BY 1, 2),
{name}_m AS (SELECT period, symbol, len(v) / {lookback} AS presence,
    list_aggregate(list_concat(v, list_transform(range({lookback} - len(v)), lambda i: 0.0::DOUBLE)), 'median') AS median_value FROM {name}_v),
{name} AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY median_value DESC, symbol) AS rank FROM {name}_m WHERE presence >= {presence}
  QUALIFY rank <= {top})"""


def _liquid(daily: DataFrame, sessions: DataFrame, periods: DataFrame, top: int) -> DataFrame:
    return universe.liquid(daily, sessions, periods, lookback=120, min_presence=0.5, top=top)


@_query("index_periods", f"WITH {_PERIODS} SELECT period, effective_from, effective_to, base_pos FROM per")
def index_periods(spark, sf_dir):
    return _market(spark, sf_dir)[2].withColumn("base_pos", F.col("base_pos").cast("bigint"))


@_query("assign_periods", f"WITH {_PERIODS} SELECT session, period FROM cal JOIN per ON session BETWEEN effective_from AND effective_to")
def assign_periods(spark, sf_dir):
    _, sessions, periods = _market(spark, sf_dir)
    return universe.assign_periods(sessions, periods)


@_query(
    "universe_liquidity",
    f"WITH {_PERIODS}, {_liquid_sql(10, 'sel')} SELECT period, symbol, rank, round(median_value, 6) AS median_value, round(presence, 8) AS presence FROM sel",
)
def universe_liquidity(spark, sf_dir):
    found = _liquid(*_market(spark, sf_dir), top=10)
    return found.select(
        "period",
        "symbol",
        F.col("rank").cast("bigint").alias("rank"),
        F.round("median_value", 6).alias("median_value"),
        F.round("presence", 8).alias("presence"),
    )


@_query(
    "universe_liquidity_months",
    f"""WITH {_PERIODS}, bs AS (SELECT p.period, p.base_pos, c.session AS base FROM per p JOIN cal c ON c.pos = p.base_pos),
win AS (SELECT period, count(*) AS n FROM bs JOIN cal ON cal.session > base - INTERVAL 4 MONTH AND cal.session <= base
  WHERE base - INTERVAL 4 MONTH >= (SELECT min(session) FROM cal) GROUP BY period),
v AS (SELECT period, n, symbol, list(traded_value) AS v FROM win JOIN bs USING (period) JOIN bars b ON b.session > base - INTERVAL 4 MONTH AND b.session <= base
  WHERE traded_value > 0 GROUP BY ALL),
m AS (SELECT period, symbol, len(v) / n AS presence, list_aggregate(list_concat(v, list_transform(range(n - len(v)), lambda i: 0.0::DOUBLE)), 'median') AS median_value FROM v)
SELECT period, symbol, row_number() OVER (PARTITION BY period ORDER BY median_value DESC, symbol) AS rank, round(median_value, 6) AS median_value, round(presence, 8) AS presence
FROM m WHERE presence >= 0.5 QUALIFY rank <= 12""",
)
def universe_liquidity_months(spark, sf_dir):
    """Windows of four months up to the base, whose number of sessions differs."""
    found = universe.liquid(*_market(spark, sf_dir), months=4, min_presence=0.5, top=12)
    return found.select(
        "period", "symbol", F.col("rank").cast("bigint").alias("rank"), F.round("median_value", 6).alias("median_value"), F.round("presence", 8).alias("presence")
    )


_NAMED = ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22")
_BOTH = f"""{_PERIODS}, {_liquid_sql(10, 'sel')},
ua AS (SELECT session, symbol FROM cal JOIN per ON session BETWEEN effective_from AND effective_to JOIN sel USING (period)),
ub AS (SELECT c.session, s.symbol FROM (SELECT symbol, min(session) AS a, max(session) AS b FROM bars WHERE symbol IN {_NAMED} GROUP BY symbol) s
  JOIN cal c ON c.session BETWEEN s.a AND s.b)"""


def _algebra(name: str, sql: str, combine: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        daily, sessions, periods = _market(spark, sf_dir)
        one = universe.members_of(_liquid(daily, sessions, periods, 10), sessions, periods)
        other = universe.whole_life(daily, _NAMED, sessions)
        return combine(one, other).members.select("session", "symbol")

    QUERIES[name] = run
    SQL[name] = f"WITH {_BOTH} SELECT session, symbol FROM ua {sql} SELECT session, symbol FROM ub"


_algebra("universe_union", "UNION", lambda a, b: a | b)
_algebra("universe_intersect", "INTERSECT", lambda a, b: a & b)
_algebra("universe_except", "EXCEPT", lambda a, b: a - b)


@_query(
    "index_exits",
    f"""WITH {_PERIODS}, {_liquid_sql(10, 'sel')}, lst AS (SELECT symbol, max(session) AS last_session FROM bars GROUP BY symbol)
SELECT period, symbol, effective_to, last_session FROM sel JOIN per USING (period) JOIN lst USING (symbol) WHERE last_session < effective_to""",
)
def index_exits(spark, sf_dir):
    daily, sessions, periods = _market(spark, sf_dir)
    return universe.exits(_liquid(daily, sessions, periods, 10), daily, periods)


# -- backtests --------------------------------------------------------------------------


@_query(
    "equal_weight",
    f"WITH {_BOTH} SELECT session, symbol, round(1.0 / count(*) OVER (PARTITION BY session), 8) AS weight FROM ua",
)
def equal_weight(spark, sf_dir):
    daily, sessions, periods = _market(spark, sf_dir)
    members = universe.members_of(_liquid(daily, sessions, periods, 10), sessions, periods).members
    return backtest.equal_weight(members).withColumn("weight", F.round("weight", 8))


@_query(
    "wf_schedule",
    f"""WITH {_PERIODS}, ends AS (SELECT (date_trunc('month', min(session)) + INTERVAL 6 MONTH)::DATE AS first_, max(session) AS last_ FROM cal),
w AS (SELECT t::DATE AS t0, least((t + INTERVAL 3 MONTH)::DATE, last_ + 1) AS t1, (t - INTERVAL 6 MONTH)::DATE AS r0
  FROM ends, generate_series(first_, last_, INTERVAL 3 MONTH) g(t))
SELECT strftime(t0, '%Y-%m') AS "window", min(session) FILTER (session < t0) AS train_start, max(session) FILTER (session < t0) AS train_end,
  min(session) FILTER (session >= t0) AS test_start, max(session) FILTER (session >= t0) AS test_end,
  max(session) FILTER (session < t0) AS decision_start, (SELECT d.session FROM cal d WHERE d.pos = max(cal.pos) - 1) AS decision_end
FROM w JOIN cal ON session >= r0 AND session < t1 GROUP BY t0 HAVING count(*) FILTER (session >= t0) > 0""",
)
def wf_schedule(spark, sf_dir):
    sessions = _market(spark, sf_dir)[1]
    return backtest.walk_forward(sessions, *backtest.testable_span(sessions, 6), 6, 3)


_ORDERS = """
ord AS (SELECT b.symbol, b.session AS decision, c.pos + 1 AS pos, 1000.0::DOUBLE AS size,
    CASE WHEN c.pos % 3 = 0 THEN b.close * 0.97 END AS buy_limit, CASE WHEN c.pos % 3 = 1 THEN b.close * 1.03 END AS sell_limit,
    CASE WHEN c.pos % 3 = 2 THEN CASE WHEN c.pos % 2 = 0 THEN 1 ELSE -1 END END AS side,
    b.close * 1.10 AS buy_stop, b.close * 0.90 AS sell_stop FROM bars b JOIN cal c USING (session)),
met AS (SELECT o.*, c.session, b.open, b.high, b.low, b.close FROM ord o JOIN cal c ON c.pos = o.pos JOIN bars b ON b.symbol = o.symbol AND b.session = c.session),
legs AS (SELECT session, symbol, size, 'long' AS leg, CASE WHEN side = 1 THEN open WHEN low < buy_limit THEN least(open, buy_limit) END AS entry,
    low <= sell_stop AS stopped, CASE WHEN low <= sell_stop THEN least(open, sell_stop) ELSE close END AS exit FROM met
  UNION ALL SELECT session, symbol, size, 'short', CASE WHEN side = -1 THEN open WHEN high > sell_limit THEN greatest(open, sell_limit) END,
    high >= buy_stop, CASE WHEN high >= buy_stop THEN greatest(open, buy_stop) ELSE close END FROM met)"""


@_query(
    "day_trades",
    f"""WITH {_PERIODS}, {_ORDERS}, t AS (SELECT *, CASE WHEN leg = 'long' THEN exit / entry - 1 ELSE 1 - exit / entry END AS gross FROM legs WHERE entry IS NOT NULL)
SELECT session, symbol, leg, size, round(entry, 8) AS entry, round(exit, 8) AS exit, stopped, round(gross, 8) AS gross,
  round(gross - 0.001 * (1 + exit / entry), 8) AS net, round(size * (gross - 0.001 * (1 + exit / entry)), 6) AS pnl FROM t""",
)
def day_trades(spark, sf_dir):
    daily = M.bars_once(spark, sf_dir, "symbol", "session", "open", "high", "low", "close")
    sessions = sessions_of(daily, "session")
    p = F.col("pos")
    orders = daily.join(sessions, "session").select(
        "symbol",
        F.col("session").alias("decision"),
        F.lit(1000.0).alias("size"),
        F.when(p % 3 == 0, F.col("close") * 0.97).alias("buy_limit"),
        F.when(p % 3 == 1, F.col("close") * 1.03).alias("sell_limit"),
        F.when(p % 3 == 2, F.when(p % 2 == 0, 1).otherwise(-1)).alias("side"),
        (F.col("close") * 1.10).alias("buy_stop"),
        (F.col("close") * 0.90).alias("sell_stop"),
    )
    found = backtest.day_trades(daily, orders, sessions, cost_bps=10.0)
    return found.select(
        "session", "symbol", "leg", "size", *(F.round(c, 8).alias(c) for c in ("entry", "exit")), "stopped",
        *(F.round(c, 8).alias(c) for c in ("gross", "net")), F.round("pnl", 6).alias("pnl"),
    )


@_query(
    "simulate_weights",
    f"""WITH RECURSIVE {_PERIODS}, {_liquid_sql(10, 'sel')},
tg AS (SELECT symbol, c.pos + 1 AS pos, 1.0 / count(*) OVER (PARTITION BY period) AS w
  FROM sel JOIN per USING (period) JOIN cal c ON c.session = effective_from WHERE c.pos + 1 <= (SELECT max(pos) FROM cal)),
held AS (SELECT b.symbol, min(c.pos) AS a, max(c.pos) AS z FROM bars b JOIN cal c USING (session) WHERE b.symbol IN (SELECT symbol FROM tg) GROUP BY b.symbol),
fl AS (SELECT h.symbol, c.pos, h.z, last_value(b.close IGNORE NULLS) OVER (PARTITION BY h.symbol ORDER BY c.pos) AS p
  FROM held h JOIN cal c ON c.pos >= h.a LEFT JOIN bars b ON b.symbol = h.symbol AND b.session = c.session),
turn AS (SELECT pos, row_number() OVER (ORDER BY pos) AS j, lead(pos, 1, (SELECT max(pos) + 1 FROM cal)) OVER (ORDER BY pos) AS nxt FROM (SELECT DISTINCT pos FROM tg)),
ask AS (SELECT t.j, t.pos, fl.symbol, fl.p, fl.z < t.pos AS gone, CASE WHEN fl.z < t.pos THEN 0 ELSE coalesce(tg.w, 0) END AS w
  FROM turn t JOIN fl ON fl.pos = t.pos LEFT JOIN tg ON tg.pos = t.pos AND tg.symbol = fl.symbol),
st AS (SELECT 0::BIGINT AS j, symbol, 0.0::DOUBLE AS u, 1.0::DOUBLE AS cash, 0.0::DOUBLE AS paid FROM held
  UNION ALL
  SELECT j, symbol, u2, v - sum(u2 * p) OVER () - paid, paid FROM (
    SELECT *, 0.001 * sum(abs(w - u1 * p / v)) OVER () * v AS paid, w * v / p AS u2 FROM (
      SELECT *, c1 + sum(u1 * p) OVER () AS v FROM (
        SELECT st.j + 1 AS j, st.symbol, coalesce(ask.p, 1) AS p, coalesce(ask.w, 0) AS w, CASE WHEN ask.gone THEN 0 ELSE st.u END AS u1,
          st.cash + coalesce(sum(CASE WHEN ask.gone THEN st.u * ask.p END) OVER (), 0) AS c1
        FROM st LEFT JOIN ask ON ask.j = st.j + 1 AND ask.symbol = st.symbol WHERE st.j < (SELECT max(j) FROM turn)) q1) q2) q3),
eq AS (SELECT fl.pos, any_value(st.cash) + sum(st.u * fl.p) AS equity, max(CASE WHEN fl.pos = t.pos THEN st.paid ELSE 0 END) AS paid
  FROM st JOIN turn t ON t.j = st.j JOIN fl ON fl.symbol = st.symbol AND fl.pos >= t.pos AND fl.pos < t.nxt GROUP BY fl.pos
  UNION ALL SELECT pos, 1.0, 0.0 FROM cal WHERE pos = (SELECT min(pos) - 1 FROM tg))
SELECT 'liquid' AS portfolio, session, round(equity, 8) AS equity, round(equity / lag(equity, 1, 1.0) OVER (ORDER BY pos) - 1, 8) AS r,
  round(paid / lag(equity, 1, 1.0) OVER (ORDER BY pos), 8) AS cost FROM eq JOIN cal USING (pos)""",
)
def simulate_weights(spark, sf_dir):
    """The liquid universe at equal weights, rebalanced when it changes."""
    daily, sessions, periods = _market(spark, sf_dir)
    chosen = _liquid(daily, sessions, periods, 10).join(periods.select("period", "effective_from"), "period")
    members = chosen.select(F.col("effective_from").alias("session"), "symbol")
    weights = backtest.equal_weight(members).select(F.lit("liquid").alias("portfolio"), F.col("session").alias("decision"), "symbol", "weight")
    found = backtest.simulate_weights(daily, cut_lineage(weights), sessions, cost_bps=10.0)
    return found.select("portfolio", "session", *(F.round(c, 8).alias(c) for c in ("equity", "r", "cost")))
