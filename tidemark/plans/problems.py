"""Queries p1, p2, p3 and p6: the core's operators on this project's tables."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.common import iso, norm, real_date, table
from tidemark.operators.as_known import as_known
from tidemark.operators.rolling import (
    daily_totals,
    dense_series,
    presence,
    sum_at,
    trailing,
    window_sum,
    with_doubling,
)
from tidemark.operators.snapshots import snapshot_changes
from tidemark.operators.spikes import flag_readings


# -- p1 ---------------------------------------------------------------------


def p1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "ex_sessions").withColumn("isin", norm("isin"))
    flags = flag_readings(sessions, "isin", "session_date", "previous_close", "open", "open_ratio")
    return flags.withColumn("session_date", iso("session_date"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_flags(spark, sf_dir).where("impossible OR stuck OR spike").select("isin", "session_date")


# -- p2 ---------------------------------------------------------------------


def _calendar(spark: SparkSession, sf_dir: str) -> tuple[list, DataFrame]:
    """All sessions in order, and them with their positions.

    The calendar is a fixed table, one row for each session there has been.
    """
    days = table(spark, sf_dir, "trading_sessions").select("session_date").distinct().orderBy("session_date")
    sessions = [r[0] for r in days.collect() if r[0] is not None]
    return sessions, spark.createDataFrame(list(enumerate(sessions)), "pos int, session_date date")


def _named(calendar: DataFrame) -> DataFrame:
    """The positions with their dates as text, so that no row writes its own."""
    return calendar.select("pos", iso("session_date").alias("session_date"))


def _to_places(c: Column | str, places: int) -> Column:
    """Rounded in binary arithmetic, for numbers that lie far from a tie."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * F.lit(10.0**places)) / F.lit(10.0**places)


def _settings(spark: SparkSession, sf_dir: str, sessions: list) -> list[dict]:
    """The (few, fixed) settings with their windows as calendar positions."""
    rows = (
        table(spark, sf_dir, "liquidity_settings")
        .select("setting_id", "lookback_months", "min_presence", "base_session")
        .withColumn("after", F.expr("add_months(base_session, -lookback_months)"))
        .distinct()
        .orderBy("setting_id")
        .collect()
    )
    out = []
    for r in rows:
        end = bisect_right(sessions, r.base_session) - 1
        out.append({**r.asDict(), "end": end, "length": end - (bisect_right(sessions, r.after) - 1)})
    return out


def _traded_days(spark: SparkSession, sf_dir: str, calendar: DataFrame) -> DataFrame:
    rows = table(spark, sf_dir, "traded_values").withColumn("security_id", norm("security_id"))
    days = daily_totals(rows, "security_id", "session_date", "block_no", "traded_value", "received_at")
    return days.join(F.broadcast(calendar), "session_date").select("security_id", "pos", "traded_value")


def _first(positive: Column) -> Column:
    return (F.array_position(positive, True) - 1).cast("int")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, calendar = _calendar(spark, sf_dir)
    settings = _settings(spark, sf_dir, sessions)
    days = _traded_days(spark, sf_dir, calendar).where("traded_value <> 0")
    dense = with_doubling(dense_series(days, "security_id", "pos", "traded_value"), "series", 4, "_d")
    size = F.size("series")
    dense = dense.withColumns({"_w7": window_sum("_d", 7), "_w30": window_sum("_d", 30)}).withColumn(
        "_up", F.transform("series", lambda x: x > 0)
    )
    start = _first(F.col("_up")) + 29
    end = size - 1 - _first(F.reverse("_up"))
    surges = F.filter(
        F.when(F.array_contains("_up", True) & (start <= end), F.sequence(start, end)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.get(F.col("_w7"), i) / 7.0 > 3.0 * (F.get(F.col("_w30"), i) / 30.0),
    )
    longest = max((s["length"] for s in settings), default=1)
    levels = max(1, longest).bit_length() - 1
    dense = dense.withColumn("_one", F.transform("_up", lambda x: F.when(x, 1.0).otherwise(0.0)))
    dense = with_doubling(dense, "_one", levels, "_p")
    thin = []
    for s in settings:
        # The window cut to the series: beyond its last place all is zero.
        at = F.least(F.lit(s["end"]) - F.col("first_pos"), size - 1)
        length = F.lit(s["length"]) - (F.lit(s["end"]) - F.col("first_pos") - at)
        n = sum_at("_p", levels, at, length)
        low = (n > 0) & (n / F.lit(float(max(1, s["length"]))) < F.lit(float(s["min_presence"])))
        thin.append(
            F.when(
                low & F.lit(s["length"] > 0),
                F.struct(F.lit(s["end"]).alias("pos"), F.lit(f"thin_{s['setting_id']}").alias("measure")),
            )
        )
    cases = F.concat(
        F.transform(
            surges, lambda i: F.struct((F.col("first_pos") + i).alias("pos"), F.lit("surge").alias("measure"))
        ),
        F.array_compact(F.array(*thin)) if thin else F.array().cast("array<struct<pos:int,measure:string>>"),
    )
    found = dense.select("security_id", F.inline(cases))
    return found.join(F.broadcast(_named(calendar)), "pos").select("security_id", "session_date", "measure")


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and means over 7 and 30 sessions for every security and session.

    A security's sessions run from its first row to the end of the calendar.
    """
    sessions, calendar = _calendar(spark, sf_dir)
    days = _traded_days(spark, sf_dir, calendar)
    totals = trailing(days, "security_id", "pos", "traded_value", (7, 30), last=len(sessions) - 1)
    return totals.join(F.broadcast(_named(calendar)), "pos").select(
        "security_id",
        "session_date",
        *(_to_places(c, 2).alias(c) for c in ("traded_value", "sum_7", "sum_30")),
        *(_to_places(_to_places(f"sum_{w}", 2) / F.lit(float(w)), 6).alias(f"mean_{w}") for w in (7, 30)),
    )


def p2_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence over each lookback for every security and session, as in p2_rolling."""
    sessions, calendar = _calendar(spark, sf_dir)
    months = sorted({s["lookback_months"] for s in _settings(spark, sf_dir, sessions)})
    starts = calendar.select(
        "pos", *(F.expr(f"add_months(session_date, -{m})").alias(f"m{m}") for m in months)
    ).orderBy("pos")
    lengths = {m: [] for m in months}
    for r in starts.collect():
        for m in months:
            lengths[m].append(r["pos"] - (bisect_right(sessions, r[f"m{m}"]) - 1))
    days = _traded_days(spark, sf_dir, calendar)
    rows = presence(days, "security_id", "pos", "traded_value", {f"presence_{m}m": lengths[m] for m in months})
    return rows.join(F.broadcast(_named(calendar)), "pos").select(
        "security_id", "session_date", *(f"presence_{m}m" for m in months)
    )


# -- p3 ---------------------------------------------------------------------


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rounded(c: str) -> Column:
        return (F.round(F.col(c).cast("double"), 8) + F.lit(0.0)).alias(c)

    cash = table(spark, sf_dir, "cash_history").select(
        "snapshot",
        norm("code").alias("code"),
        norm("share_class").alias("item"),
        norm("label").alias("label"),
        real_date("last_cum_date").alias("last_cum_date"),
        rounded("cash_amount"),
        real_date("approved_on").alias("approved_on"),
        rounded("closing_price"),
    )
    target = norm("target_isin")
    stock = table(spark, sf_dir, "stock_events").select(
        "snapshot",
        norm("code").alias("code"),
        norm("isin").alias("item"),
        norm("label").alias("label"),
        real_date("last_cum_date").alias("last_cum_date"),
        rounded("factor"),
        real_date("approved_on").alias("approved_on"),
        F.when(target != "", target).alias("target_isin"),
    )
    key = ["code", "item", "label", "last_cum_date"]
    feeds = {
        "cash_history": (cash, ["cash_amount", "approved_on", "closing_price"]),
        "stock_events": (stock, ["factor", "approved_on", "target_isin"]),
    }
    parts = [
        snapshot_changes(rows, "snapshot", key, values).select(
            F.lit(feed).alias("feed"),
            iso("snapshot").alias("snapshot"),
            "code",
            "item",
            "label",
            iso("last_cum_date").alias("last_cum_date"),
            "change_kind",
        )
        for feed, (rows, values) in feeds.items()
    ]
    return parts[0].unionByName(parts[1])


# -- p6 ---------------------------------------------------------------------


def p6_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "source_events").select("event_no", norm("isin").alias("isin"), "last_cum_date")
    master = (
        table(spark, sf_dir, "security_master")
        .where("market_type = 10")
        .select(norm("isin").alias("isin"), "ticker", "last_session", "first_session", "recorded_on")
    )
    return as_known(
        events.distinct(),
        master,
        entity=("isin", "isin"),
        at="last_cum_date",
        valid_from="first_session",
        known_from="recorded_on",
        attributes=["ticker", "last_session"],
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = p6_known(spark, sf_dir)
    open_then = F.col("last_session").isNull() | (F.col("last_session") >= F.col("last_cum_date"))
    return (
        known.where(F.col("has_version") & open_then)
        .select("event_no", norm("ticker").alias("ticker"))
        .distinct()
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_flags": p1_flags,
    "p2_found": p2_found,
    "p2_rolling": p2_rolling,
    "p2_presence": p2_presence,
    "p3_found": p3_found,
    "p6_found": p6_found,
}

_DAYS = """
latest AS (
  SELECT upper(trim(security_id)) AS security_id, session_date, block_no,
         arg_max(coalesce(traded_value, 0), received_at) AS v
  FROM traded_values GROUP BY ALL),
daily AS (SELECT security_id, session_date, sum(v) AS v FROM latest GROUP BY ALL),
cal AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS pos FROM trading_sessions)"""


def _p3_sql(feed: str, item: str, one: str, two: str, three: str) -> str:
    def d(c: str) -> str:
        return f"CASE WHEN {c} NOT IN (DATE '1900-01-01', DATE '9999-12-31') THEN {c} END"

    return f"""
  SELECT '{feed}' AS feed, coalesce(a.snap, b.next) AS snapshot, coalesce(a.code, b.code) AS code,
         coalesce(a.item, b.item) AS item, coalesce(a.label, b.label) AS label,
         strftime(coalesce(a.lcd, b.lcd), '%Y-%m-%d') AS last_cum_date,
         CASE WHEN b.code IS NULL THEN 'added' WHEN a.code IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM (SELECT * FROM {feed}_r WHERE n > 1) a
  FULL JOIN (SELECT * FROM {feed}_r WHERE next IS NOT NULL) b
    ON a.n = b.n + 1 AND a.code = b.code AND a.item = b.item AND a.label = b.label AND a.lcd IS NOT DISTINCT FROM b.lcd
  WHERE a.code IS NULL OR b.code IS NULL OR a.x IS DISTINCT FROM b.x OR a.y IS DISTINCT FROM b.y OR a.z IS DISTINCT FROM b.z""", f"""
{feed}_s AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS n, lead(snapshot) OVER (ORDER BY snapshot) AS next
  FROM (SELECT DISTINCT snapshot FROM {feed})),
{feed}_r AS (SELECT DISTINCT n, strftime(snapshot, '%Y-%m-%d') AS snap, strftime(next, '%Y-%m-%d') AS next,
    upper(trim(code)) AS code, upper(trim({item})) AS item, upper(trim(label)) AS label, {d('last_cum_date')} AS lcd,
    {one} AS x, {d(two)} AS y, {three} AS z
  FROM {feed} JOIN {feed}_s USING (snapshot))"""


_CASH = _p3_sql("cash_history", "share_class", "round(cash_amount, 8)", "approved_on", "round(closing_price, 8)")
_STOCK = _p3_sql("stock_events", "isin", "round(factor, 8)", "approved_on", "nullif(upper(trim(target_isin)), '')")

_SPIKES = """
r AS (SELECT upper(trim(isin)) AS isin, session_date AS d, previous_close AS b, open AS a, open_ratio AS q FROM ex_sessions),
f AS (SELECT isin, d, a, b,
    coalesce(NOT isfinite(b) OR b <= 0, false) OR coalesce(NOT isfinite(a) OR a <= 0, false) OR coalesce(NOT isfinite(q) OR q <= 0, false)
      OR coalesce(isfinite(a) AND a > 0 AND isfinite(b) AND b > 0 AND isfinite(q) AND abs(q - a / b) > 0.01 * a / b, false) AS bad FROM r),
g AS (SELECT isin, d, max(a) AS a, max(b) AS b, bool_or(bad) AS bad FROM f WHERE isin IS NOT NULL AND d IS NOT NULL GROUP BY isin, d),
k AS (SELECT isin, d, bad, CASE WHEN isfinite(a) AND a > 0 THEN a END AS a, CASE WHEN isfinite(b) AND b > 0 THEN b END AS b FROM g),
m AS (SELECT *, ln(a / b) AS m, abs(ln(b / lag(a) OVER (PARTITION BY isin ORDER BY d))) AS gap FROM k),
w AS (SELECT *, list(gap) FILTER (gap IS NOT NULL) OVER (o ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS gs, list(m) FILTER (m IS NOT NULL) OVER (o ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS ms,
    (count(a) OVER (o ROWS 4 PRECEDING) = 5 AND min(a) OVER (o ROWS 4 PRECEDING) = max(a) OVER (o ROWS 4 PRECEDING))
      OR (count(b) OVER (o ROWS 4 PRECEDING) = 5 AND min(b) OVER (o ROWS 4 PRECEDING) = max(b) OVER (o ROWS 4 PRECEDING)) AS ends,
    list(coalesce(a, b)) FILTER (coalesce(a, b) IS NOT NULL) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS nb,
    list(coalesce(b, a)) FILTER (coalesce(b, a) IS NOT NULL) OVER (o ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS na
  FROM m WINDOW o AS (PARTITION BY isin ORDER BY d)),
x AS (SELECT *, 2 * pow(greatest(1.4826 * list_aggregate(gs, 'median'), 0.001), 2) AS sc, list_aggregate(ms, 'median') AS med, list_aggregate(nb, 'median') AS mb, list_aggregate(na, 'median') AS ma,
    coalesce(bool_or(ends) OVER (PARTITION BY isin ORDER BY d ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), false) AS stuck,
    least(a, b) AS lo, greatest(a, b) AS hi,
    lag(coalesce(a, b), 1 IGNORE NULLS) OVER (PARTITION BY isin ORDER BY d) AS p1,
    lead(coalesce(b, a), 1 IGNORE NULLS) OVER (PARTITION BY isin ORDER BY d) AS n1 FROM w),
y AS (SELECT *, coalesce(len(ms) >= 5 AND abs(m - med) > 8 * greatest(1.4826 * list_aggregate(list_transform(ms, lambda v: abs(v - med)), 'median'), 0.001), false) AS far FROM x),
z AS (SELECT *, bad OR {one} OR {two} AS suspect FROM y),
u AS (SELECT *, lag(CASE WHEN NOT suspect THEN coalesce(a, b) END, 1 IGNORE NULLS) OVER (PARTITION BY isin ORDER BY d) AS p2,
    lead(CASE WHEN NOT suspect THEN coalesce(b, a) END, 1 IGNORE NULLS) OVER (PARTITION BY isin ORDER BY d) AS n2 FROM z),
flags AS (SELECT isin, strftime(d, '%Y-%m-%d') AS session_date, bad AS impossible, stuck, {last} AS spike FROM u)"""


def _spike_sql(p: str, n: str) -> str:
    return f"""(coalesce((lo > 3 * {p} AND lo > 3 * {n}) OR (hi * 3 < {p} AND hi * 3 < {n}), false)
      OR (far AND NOT coalesce(m * (m + 2 * ln(b / coalesce({p}, b))) / sc > 3 AND m * (m + 2 * ln({n} / a)) / sc > 3, false)))"""


_FLAGS = _SPIKES.format(one=_spike_sql("p1", "n1"), two=_spike_sql("mb", "ma"), last=_spike_sql("p2", "n2"))

SQL = {
    "p1_flags": f"WITH {_FLAGS} SELECT isin, session_date, impossible, stuck, spike FROM flags",
    "p1_found": f"WITH {_FLAGS} SELECT isin, session_date FROM flags WHERE impossible OR stuck OR spike",
    "p2_presence": f"""
WITH {_DAYS},
span AS (SELECT security_id, min(session_date) AS f FROM daily JOIN cal USING (session_date) GROUP BY ALL),
grid AS (SELECT s.security_id, c.session_date FROM span s JOIN cal c ON c.session_date >= s.f),
hits AS (SELECT g.security_id, g.session_date, {", ".join(f"count(*) FILTER (d.session_date > g.session_date - INTERVAL {m} MONTH) AS k{m}" for m in (1, 2, 3, 4, 6, 12))}
  FROM grid g JOIN daily d ON d.security_id = g.security_id AND d.v > 0 AND d.session_date <= g.session_date
    AND d.session_date > g.session_date - INTERVAL 12 MONTH GROUP BY ALL),
spans AS (SELECT a.session_date, {", ".join(f"count(*) FILTER (b.session_date > a.session_date - INTERVAL {m} MONTH) AS n{m}" for m in (1, 2, 3, 4, 6, 12))}
  FROM cal a JOIN cal b ON b.session_date <= a.session_date AND b.session_date > a.session_date - INTERVAL 12 MONTH GROUP BY ALL)
SELECT g.security_id, strftime(g.session_date, '%Y-%m-%d') AS session_date,
  {", ".join(f"coalesce(k{m}, 0) / n{m} AS presence_{m}m" for m in (1, 2, 3, 4, 6, 12))}
FROM grid g JOIN spans USING (session_date) LEFT JOIN hits h ON h.security_id = g.security_id AND h.session_date = g.session_date""",
    "p2_found": f"""
WITH {_DAYS},
span AS (SELECT security_id, min(pos) FILTER (v > 0) AS f, max(pos) FILTER (v > 0) AS l
  FROM daily JOIN cal USING (session_date) GROUP BY ALL),
grid AS (SELECT s.security_id, c.session_date, c.pos, s.f, coalesce(d.v, 0) AS v
  FROM span s JOIN cal c ON c.pos BETWEEN s.f AND s.l
  LEFT JOIN daily d ON d.security_id = s.security_id AND d.session_date = c.session_date),
w AS (SELECT *, sum(v) OVER (PARTITION BY security_id ORDER BY pos ROWS 6 PRECEDING) AS s7,
  sum(v) OVER (PARTITION BY security_id ORDER BY pos ROWS 29 PRECEDING) AS s30 FROM grid),
thin AS (SELECT d.security_id, b.base_session, b.setting_id, b.min_presence, count(*) FILTER (d.v > 0) AS k,
    (SELECT count(*) FROM cal WHERE cal.session_date > b.base_session - to_months(b.lookback_months) AND cal.session_date <= b.base_session) AS n
  FROM daily d JOIN (SELECT DISTINCT * FROM liquidity_settings) b
    ON d.session_date > b.base_session - to_months(b.lookback_months) AND d.session_date <= b.base_session
  GROUP BY ALL)
SELECT security_id, strftime(session_date, '%Y-%m-%d') AS session_date, 'surge' AS measure
FROM w WHERE pos >= f + 29 AND s7 / 7 > 3 * (s30 / 30)
UNION ALL
SELECT security_id, strftime(base_session, '%Y-%m-%d'), 'thin_' || setting_id FROM thin WHERE k > 0 AND k / n < min_presence""",
    "p2_rolling": f"""
WITH {_DAYS},
span AS (SELECT security_id, min(pos) AS f FROM daily JOIN cal USING (session_date) GROUP BY ALL),
grid AS (SELECT s.security_id, c.session_date, c.pos, coalesce(d.v, 0) AS v
  FROM span s JOIN cal c ON c.pos >= s.f
  LEFT JOIN daily d ON d.security_id = s.security_id AND d.session_date = c.session_date),
w AS (SELECT *, sum(v) OVER (PARTITION BY security_id ORDER BY pos ROWS 6 PRECEDING) AS s7,
  sum(v) OVER (PARTITION BY security_id ORDER BY pos ROWS 29 PRECEDING) AS s30 FROM grid)
SELECT security_id, strftime(session_date, '%Y-%m-%d') AS session_date, round(v, 2) AS traded_value,
  round(s7, 2) AS sum_7, round(s30, 2) AS sum_30, round(round(s7, 2) / 7, 6) AS mean_7, round(round(s30, 2) / 30, 6) AS mean_30 FROM w""",
    "p3_found": f"WITH {_CASH[1]}, {_STOCK[1]} {_CASH[0]} UNION ALL {_STOCK[0]}",
    "p6_found": """
WITH m AS (SELECT DISTINCT upper(trim(isin)) AS isin, upper(trim(ticker)) AS ticker, first_session, last_session, recorded_on
  FROM security_master WHERE market_type = 10),
e AS (SELECT DISTINCT event_no, upper(trim(isin)) AS isin, last_cum_date FROM source_events),
r AS (SELECT e.event_no, e.last_cum_date, m.ticker, m.last_session,
    row_number() OVER (PARTITION BY e.event_no, e.isin, e.last_cum_date ORDER BY m.first_session DESC, m.recorded_on DESC) AS k
  FROM e JOIN m ON m.isin = e.isin AND m.first_session <= e.last_cum_date AND m.recorded_on <= e.last_cum_date)
SELECT DISTINCT event_no, ticker FROM r WHERE k = 1 AND (last_session IS NULL OR last_session >= last_cum_date)""",
}
