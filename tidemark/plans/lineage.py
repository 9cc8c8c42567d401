"""Queries of matching, identity and folds, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.common import missing_as_null, norm, table
from tidemark.operators import backtest, folds, identity, joins, matching
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


#: Sources by trust, the most trusted first (fixed values).
_RANK = {"manual": 0, "b3_listed": 1, "cvm_fre": 2, "b3_credited": 3, "inferred": 4}
_RANK_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in _RANK.items()) + " END"


def _rank():
    out = F.lit(None).cast("int")
    for s, n in _RANK.items():
        out = F.when(F.col("source") == s, n).otherwise(out)
    return out


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "source_events")
        .select("event_no", norm("isin").alias("isin"), "last_cum_date", "distribution_number", "event_type", "cash_amount", "share_ratio", "source", norm("label").alias("label"))
        .distinct()
    )


_E = """e AS (SELECT DISTINCT event_no, upper(trim(isin)) AS isin, last_cum_date, distribution_number, event_type, cash_amount, share_ratio,
    source, upper(trim(label)) AS label FROM source_events),
x AS (SELECT upper(trim(isin)) AS isin, session_date, max(to_distribution) AS to_distribution, max(open_ratio) FILTER (isfinite(open_ratio) AND open_ratio > 0) AS open_ratio
  FROM ex_sessions GROUP BY 1, 2)"""


def _ex(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = F.when((F.col("open_ratio") > 0) & ~F.isnan("open_ratio") & (F.col("open_ratio") < float("inf")), F.col("open_ratio"))
    return (
        table(spark, sf_dir, "ex_sessions")
        .select(norm("isin").alias("isin"), "session_date", "to_distribution", usable.alias("open_ratio"))
        .groupBy("isin", "session_date")
        .agg(F.max("to_distribution").alias("to_distribution"), F.max("open_ratio").alias("open_ratio"))
    )


@_query(
    "match_by_ratio",
    f"""WITH {_E}, c AS (SELECT event_no, session_date, abs(ln(open_ratio * share_ratio)) AS off, share_ratio FROM e JOIN x ON e.isin = x.isin
    AND session_date > last_cum_date AND session_date - last_cum_date <= 180 WHERE share_ratio > 0 AND open_ratio > 0)
SELECT event_no, min(session_date) AS matched_session FROM c WHERE off <= 0.1 AND off <= abs(ln(share_ratio)) / 2 GROUP BY event_no""",
)
def match_by_ratio(spark, sf_dir):
    return matching.match_by_ratio(
        _events(spark, sf_dir), _ex(spark, sf_dir), by="isin", event="event_no", at="last_cum_date", ratio="share_ratio", session="session_date", open_ratio="open_ratio"
    )


@_query(
    "match_by_distribution",
    f"""WITH {_E}, d AS (SELECT isin, to_distribution, min(session_date) AS session_date FROM x GROUP BY 1, 2)
SELECT e.event_no, e.isin, e.distribution_number, d.session_date FROM e ASOF LEFT JOIN d ON e.isin = d.isin AND e.distribution_number >= d.to_distribution""",
)
def match_by_distribution(spark, sf_dir):
    """The session that brought the latest distribution up to an event's."""
    first = _ex(spark, sf_dir).groupBy("isin", "to_distribution").agg(F.min("session_date").alias("session_date"))
    events = _events(spark, sf_dir).select("event_no", "isin", "distribution_number")
    return joins.asof(events, first, "isin", ("distribution_number", "to_distribution"), ["session_date"])


@_query(
    "best_source",
    f"""WITH {_E}, r AS (SELECT *, {_RANK_SQL} AS rank FROM e)
SELECT event_no, isin, last_cum_date, event_type, source FROM r
QUALIFY rank = min(rank) OVER (PARTITION BY isin, last_cum_date, event_type)""",
)
def best_source(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_no", "isin", "last_cum_date", "event_type", "source")
    return matching.best_source(rows, ["isin", "last_cum_date", "event_type"], _rank())


@_query(
    "source_confirmations",
    f"""WITH RECURSIVE {_E}, r AS (SELECT isin, strftime(last_cum_date, '%Y-%m') AS "month", event_type, event_no::VARCHAR AS id, source,
    CASE WHEN isfinite(cash_amount) THEN cash_amount END AS v FROM e WHERE isin IS NOT NULL AND last_cum_date IS NOT NULL AND event_type IS NOT NULL),
grp AS (SELECT isin, "month", event_type, coalesce(list({{'v': v, 'id': id}} ORDER BY v NULLS LAST, id) FILTER (source = 'b3_listed'), []) AS b,
    list({{'v': v, 'id': id}} ORDER BY v NULLS LAST, id) FILTER (source = 'b3_credited') AS o FROM r GROUP BY ALL HAVING count(*) FILTER (source = 'b3_credited') > 0),
st AS (SELECT isin, "month", event_type, b, o, 0 AS n, []::BIGINT[] AS used FROM grp
  UNION ALL
  SELECT isin, "month", event_type, b, o, n + 1, list_append(used, coalesce(list_sort(list_transform(list_filter(range(1, len(b) + 1),
      lambda i: NOT list_contains(used, i) AND CASE WHEN o[n + 1].v IS NULL THEN b[i].v IS NULL ELSE coalesce(abs(b[i].v - o[n + 1].v) <= 0.005 * abs(o[n + 1].v), false) END),
      lambda i: {{'d': coalesce(abs(b[i].v - o[n + 1].v), 0), 'i': i}}))[1].i, 0))
  FROM st WHERE n < len(o)),
done AS (SELECT isin, "month", event_type, b, unnest(o).id AS other_id, unnest(used) AS i FROM st WHERE n = len(o))
SELECT isin, "month", event_type, CASE WHEN i > 0 THEN b[i].id END AS best_id, other_id FROM done""",
)
def source_confirmations(spark, sf_dir):
    """Credited records paired one to one with listed ones of the same month."""
    rows = _events(spark, sf_dir).select(
        "isin", F.date_format("last_cum_date", "yyyy-MM").alias("month"), "event_type", "event_no", missing_as_null("cash_amount").alias("cash_amount"), "source"
    )
    listed, credited = (rows.where(F.col("source") == s) for s in ("b3_listed", "b3_credited"))
    return matching.confirmations(listed, credited, ["isin", "month", "event_type"], "event_no", "cash_amount", 0.005)


@_query(
    "stable_ids",
    f"""WITH {_E}, r AS (SELECT event_no, isin, coalesce(strftime(last_cum_date, '%Y-%m-%d'), '') AS d, event_type, label,
    row_number() OVER (PARTITION BY isin, last_cum_date, event_type, label ORDER BY event_no) AS n FROM e)
SELECT event_no, left(sha1(isin || '|' || d || '|' || event_type || '|' || label || '|' || n), 16) AS record_key FROM r""",
)
def stable_ids(spark, sf_dir):
    return matching.with_stable_id(_events(spark, sf_dir), ["isin", "last_cum_date", "event_type", "label"], ["event_no"]).select("event_no", "record_key")


# -- identity ---------------------------------------------------------------------------


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ex_sessions").select(norm("isin").alias("isin"), norm("ticker").alias("ticker"), "session_date")


_SPANS = """sp AS (SELECT upper(trim(isin)) AS isin, upper(trim(ticker)) AS ticker, min(session_date) AS first_session, max(session_date) AS last_session,
    count(DISTINCT session_date) AS sessions FROM ex_sessions GROUP BY 1, 2)"""


@_query("security_spans", f"WITH {_SPANS} SELECT isin, ticker, first_session, last_session, sessions FROM sp")
def security_spans(spark, sf_dir):
    return identity.spans(_listed(spark, sf_dir), ["isin", "ticker"], "session_date")


@_query(
    "security_nodes",
    f"""WITH {_SPANS} SELECT isin, min(first_session) AS first_session, max(last_session) AS last_session,
  arg_min(ticker, (first_session, ticker)) AS first_label, arg_max(ticker, (last_session, ticker)) AS last_label FROM sp GROUP BY isin""",
)
def security_nodes(spark, sf_dir):
    return identity.nodes(identity.spans(_listed(spark, sf_dir), ["isin", "ticker"], "session_date"), "isin", "ticker")


_LIVES = """cal AS (SELECT session_date AS session, (row_number() OVER (ORDER BY session_date) - 1)::INT AS pos FROM (SELECT DISTINCT session_date FROM trading_sessions)),
lf AS (SELECT upper(trim(isin)) AS isin, min(first_session) AS a, max(last_session) AS b FROM security_master GROUP BY 1),
cand AS (SELECT f.isin AS from_, t.isin AS to_, (ct.pos - cf.pos)::INT AS gap_sessions FROM lf f JOIN cal cf ON cf.session = f.b
  JOIN lf t ON f.isin <> t.isin AND substr(t.isin, 7, 3) = substr(f.isin, 7, 3) JOIN cal ct ON ct.session = t.a AND ct.pos - cf.pos BETWEEN 1 AND 40)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = table(spark, sf_dir, "security_master").select(norm("isin").alias("isin"), "first_session", "last_session")
    life = master.groupBy("isin").agg(F.min("first_session").alias("first_session"), F.max("last_session").alias("last_session"))
    days = sessions_of(table(spark, sf_dir, "trading_sessions"), "session_date")
    return identity.successor_candidates(life, days, "isin", F.substring("isin", 7, 3), most=40)


@_query("successor_candidates", f"WITH {_LIVES} SELECT from_, to_, gap_sessions FROM cand")
def successor_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@_query(
    "successor_links",
    f"""WITH RECURSIVE {_LIVES},
state AS (SELECT 0 AS g, []::VARCHAR[] AS f, []::VARCHAR[] AS t
  UNION ALL
  SELECT g + 1, list_concat(any_value(f), coalesce(list(from_ ORDER BY from_) FILTER (sole), [])), list_concat(any_value(t), coalesce(list(to_ ORDER BY from_) FILTER (sole), []))
  FROM (SELECT s.g, s.f, s.t, c.from_, c.to_,
      coalesce(c.from_ IS NOT NULL AND count(*) OVER (PARTITION BY c.from_) = 1 AND count(*) OVER (PARTITION BY c.to_) = 1, false) AS sole
    FROM state s LEFT JOIN cand c ON c.gap_sessions = s.g + 1 AND NOT list_contains(s.f, c.from_) AND NOT list_contains(s.t, c.to_)
    WHERE s.g < 40) x GROUP BY g),
linked AS (SELECT unnest(f) AS from_, unnest(t) AS to_ FROM state WHERE g = 40)
SELECT from_, to_, gap_sessions FROM linked JOIN cand USING (from_, to_)""",
)
def successor_links(spark, sf_dir):
    return identity.chosen_links(_candidates(spark, sf_dir))


@_query(
    "ticker_at",
    f"""WITH {_SPANS}, {_E}, st AS (SELECT isin, first_session, max(ticker) AS ticker FROM sp GROUP BY 1, 2)
SELECT e.event_no, e.isin, e.last_cum_date, st.ticker FROM e ASOF LEFT JOIN st ON e.isin = st.isin AND e.last_cum_date >= st.first_session""",
)
def ticker_at(spark, sf_dir):
    spanned = identity.spans(_listed(spark, sf_dir), ["isin", "ticker"], "session_date")
    asked = _events(spark, sf_dir).select("event_no", "isin", "last_cum_date")
    return identity.label_at(spanned, asked, "isin", "ticker", "last_cum_date")


@_query(
    "label_dedupe",
    f"""WITH {M.BARS}, l AS (SELECT *, left(symbol, 7) AS label FROM bars)
SELECT label, session, symbol, round(close, 8) AS close FROM l QUALIFY row_number() OVER (PARTITION BY session, label ORDER BY volume DESC, symbol) = 1""",
)
def label_dedupe(spark, sf_dir):
    rows = M.bars(spark, sf_dir).withColumn("label", F.substring("symbol", 1, 7))
    kept = identity.one_row_per_label(rows, "label", "session", "volume", "symbol")
    return kept.select("label", "session", "symbol", F.round("close", 8).alias("close"))


# -- folds --------------------------------------------------------------------


@_query(
    "wf_folds",
    f"""WITH {M.BARS}, cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS pos FROM (SELECT DISTINCT session FROM bars)),
ends AS (SELECT (date_trunc('month', min(session)) + INTERVAL 6 MONTH)::DATE AS first_, max(session) AS last_ FROM cal),
w AS (SELECT t::DATE AS t0, least((t + INTERVAL 3 MONTH)::DATE, last_ + 1) AS t1, (t - INTERVAL 6 MONTH)::DATE AS r0
  FROM ends, generate_series(first_, last_, INTERVAL 3 MONTH) g(t)),
f AS (SELECT strftime(t0, '%Y-%m') AS "window", t0, min(session) FILTER (session < t0) AS a, max(session) FILTER (session < t0) AS b,
    count(*) FILTER (session < t0) AS n FROM w JOIN cal ON session >= r0 AND session < t1 GROUP BY t0),
life AS (SELECT symbol, min(session) AS f0, max(session) AS l0 FROM bars GROUP BY symbol),
p AS (SELECT f."window", b.symbol, count(*) AS k FROM f JOIN bars b ON b.session BETWEEN f.a AND f.b GROUP BY ALL)
SELECT f."window", life.symbol, CASE WHEN NOT f0 <= f.a THEN 'no history' WHEN NOT l0 >= f.b THEN 'stopped trading'
  WHEN NOT coalesce(k, 0) / n >= 0.62 THEN 'too few sessions' END AS reason
FROM f CROSS JOIN life LEFT JOIN p ON p."window" = f."window" AND p.symbol = life.symbol""",
)
def wf_folds(spark, sf_dir):
    daily = M.bars_once(spark, sf_dir, "symbol", "session", "close")
    sessions = cut_lineage(sessions_of(daily, "session"))
    windows = backtest.walk_forward(sessions, *backtest.testable_span(sessions, 6), 6, 3)
    names = [r[0] for r in windows.select("window").orderBy("window").collect()]
    every = daily.select("symbol").distinct().withColumn("window", F.explode(F.array(*map(F.lit, names))))
    rules = [folds.HasHistory(), folds.StillTrading(), folds.MinimumPresence(0.62)]
    return folds.folds(windows, every, daily, sessions, rules)
