"""Implausible readings per source: Hampel filter, stuck runs, physical bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.common import finite


def _middle(sorted_values: Column) -> Column:
    """Median of a sorted array; null for an empty one."""
    n = F.size(sorted_values)
    low = F.get(sorted_values, F.floor((n - 1) / F.lit(2)).cast("int"))
    high = F.get(sorted_values, F.floor(n / F.lit(2)).cast("int"))
    return F.when(n > 0, (low + high) / F.lit(2.0))


def flag_readings(
    df: DataFrame,
    source: str,
    order: str,
    before: str,
    after: str,
    ratio: str,
    *,
    half_window: int = 30,
    deviations: float = 8.0,
    level: float = 3.0,
    run: int = 5,
    ratio_tolerance: float = 0.01,
    min_observations: int = 5,
    min_deviation: float = 1e-3,
    evidence: float = 3.0,
) -> DataFrame:
    """One row per (source, order) with the flags of its readings.

    Result: ``source, order, impossible, stuck, spike`` (the first two under
    the given names). ``before`` and ``after`` are two positive readings of
    one row and ``ratio`` is ``after / before`` as delivered.

    * impossible: a reading that is not null but not finite or not above
      zero, or a ratio more than ``ratio_tolerance`` off ``after / before``.
    * stuck: the same ``after`` (or ``before``) on ``run`` rows in a row; a
      null ends a run; every row of the run is flagged.
    * spike: ``ln(after / before)`` is more than ``deviations`` scaled median
      absolute deviations off the rolling median of the source's moves
      (``half_window`` rows on either side), unless the readings stay at the
      new level; or the readings lie more than ``level`` times above, or
      below, the sound ones on both sides. Which neighbours are sound is
      settled by a first pass of the same tests. A move counts as staying if
      the gaps to both neighbours are likelier, by ``evidence`` in log odds,
      with the new level kept than with it undone, gaps being normal with the
      source's usual one (scaled median in the same window).

    Nulls: a row without source or order gives no result; a null reading is
    no case and is passed over. Exact repeats count once; of contradicting
    rows of one key the largest value of each reading is judged, and the key
    is impossible if any of them is. An empty table gives an empty result.
    Where fewer than ``min_observations`` moves are in the window no move is
    a spike; ``min_deviation`` bounds the usual deviation from below, so that
    a flat series does not flag rounding noise.

    Scale: one shuffle by (source, order) with map-side combine, one by
    source. All windows share a single sort, and all frames are bounded, so
    a source's rows stream through its task and spill if they must; a source
    has at most one row for each date there is.
    """
    b, a, r = (F.col(c).cast("double") for c in (before, after, ratio))

    def broken(x: Column) -> Column:
        return x.isNotNull() & (~finite(x) | (x <= 0))

    keyed = (
        df.select(F.col(source).alias("_s"), F.col(order).alias("_o"), b.alias("_b"), a.alias("_a"), r.alias("_r"))
        .where("_s IS NOT NULL AND _o IS NOT NULL")
        .select(
            "_s",
            "_o",
            "_b",
            "_a",
            F.coalesce(
                broken(F.col("_b")) | broken(F.col("_a")) | broken(F.col("_r")) | _off("_a", "_b", "_r", ratio_tolerance),
                F.lit(False),
            ).alias("_bad"),
        )
        .groupBy("_s", "_o")
        .agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"), F.max("_bad").alias("_bad"))
        .withColumns({c: F.when(finite(F.col(c)) & (F.col(c) > 0), F.col(c)) for c in ("_b", "_a")})
        .withColumn("_m", F.log(F.col("_a") / F.col("_b")))
    )
    w = Window.partitionBy("_s").orderBy("_o")
    keyed = keyed.withColumn("_gap", F.abs(F.log(F.col("_b") / F.lag("_a").over(w))))
    around = w.rowsBetween(-half_window, half_window)

    def repeated(c: str) -> Column:
        back = w.rowsBetween(-(run - 1), 0)
        return (F.count(c).over(back) == run) & (F.min(c).over(back) == F.max(c).over(back))

    near_before = F.sort_array(F.collect_list(F.coalesce("_a", "_b")).over(w.rowsBetween(-3, -1)))
    near_after = F.sort_array(F.collect_list(F.coalesce("_b", "_a")).over(w.rowsBetween(1, 3)))
    judged = (
        keyed.withColumns(
            {
                "_moves": F.sort_array(F.collect_list("_m").over(around)),
                "_gaps": F.sort_array(F.collect_list("_gap").over(around)),
                "_end_a": repeated("_a"),
                "_end_b": repeated("_b"),
                "_near_b": near_before,
                "_near_a": near_after,
            }
        )
        .withColumns(
            {
                "_med": _middle(F.col("_moves")),
                "_drift": F.greatest(F.lit(1.4826) * _middle(F.col("_gaps")), F.lit(min_deviation)),
                "_stuck": F.max(F.col("_end_a") | F.col("_end_b")).over(w.rowsBetween(0, run - 1)),
                "_low": F.least("_a", "_b"),
                "_high": F.greatest("_a", "_b"),
            }
        )
        .withColumn("_devs", F.sort_array(F.transform("_moves", lambda x: F.abs(x - F.col("_med")))))
        .withColumn("_dev", F.greatest(F.lit(1.4826) * _middle(F.col("_devs")), F.lit(min_deviation)))
        .withColumn(
            "_far",
            F.coalesce(
                (F.size("_moves") >= min_observations)
                & (F.abs(F.col("_m") - F.col("_med")) > deviations * F.col("_dev")),
                F.lit(False),
            ),
        )
        .drop("_moves", "_gaps", "_devs", "_end_a", "_end_b")
    )

    def spike(prior: str, following: str) -> Column:
        p, n = F.col(prior), F.col(following)
        beyond = ((F.col("_low") > level * p) & (F.col("_low") > level * n)) | (
            (F.col("_high") * level < p) & (F.col("_high") * level < n)
        )
        # Log odds of each gap as it is against the gap with the move undone.
        m, scale = F.col("_m"), 2 * F.col("_drift") * F.col("_drift")
        arrived = F.log(F.col("_b") / F.coalesce(p, F.col("_b")))
        left = F.log(n / F.col("_a"))
        stays = (m * (m + 2 * arrived) / scale > evidence) & (m * (m + 2 * left) / scale > evidence)
        return F.coalesce(beyond, F.lit(False)) | (F.col("_far") & ~F.coalesce(stays, F.lit(False)))

    def neighbours(sound: str, prior: str, following: str) -> list[str]:
        over = "OVER (PARTITION BY _s ORDER BY _o)"
        return [
            "*",
            f"lag(CASE WHEN {sound} THEN coalesce(_a, _b) END, 1) IGNORE NULLS {over} AS {prior}",
            f"lead(CASE WHEN {sound} THEN coalesce(_b, _a) END, 1) IGNORE NULLS {over} AS {following}",
        ]

    first = (
        judged.withColumns({"_mid_b": _middle(F.col("_near_b")), "_mid_a": _middle(F.col("_near_a"))})
        .selectExpr(*neighbours("true", "_p1", "_n1"))
        .withColumn("_suspect", F.col("_bad") | spike("_p1", "_n1") | spike("_mid_b", "_mid_a"))
    )
    second = first.selectExpr(*neighbours("NOT _suspect", "_p2", "_n2"))
    return second.select(
        F.col("_s").alias(source),
        F.col("_o").alias(order),
        F.col("_bad").alias("impossible"),
        F.coalesce("_stuck", F.lit(False)).alias("stuck"),
        spike("_p2", "_n2").alias("spike"),
    )


def _off(after: str, before: str, ratio: str, tolerance: float) -> Column:
    """The delivered ratio is more than ``tolerance`` off the computed one."""
    a, b, r = F.col(after), F.col(before), F.col(ratio)
    usable = finite(a) & (a > 0) & finite(b) & (b > 0) & finite(r)
    return usable & (F.abs(r - F.try_divide(a, b)) > tolerance * F.try_divide(a, b))
