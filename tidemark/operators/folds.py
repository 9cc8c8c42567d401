"""Folds of a walk-forward: who may be traded in each window, and why not."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tidemark.dataset import Dataset
    from tidemark.operators.panel import Panel


class Rule:
    """A test of candidates; null means passed, else the reason."""

    def reason(self) -> Column:
        raise NotImplementedError


def _covered(cover: str) -> str:
    if cover not in ("train", "test"):
        raise ValueError(f"a rule covers train or test, not {cover!r}")
    return cover


@dataclass(frozen=True)
class HasHistory(Rule):
    """Trades since the first training session (or, to cover the test, since its decision)."""

    cover: str = "train"

    def reason(self) -> Column:
        since = {"train": "train_start", "test": "decision_start"}[_covered(self.cover)]
        return F.when(~F.coalesce(F.col("first_seen") <= F.col(since), F.lit(False)), "no history")


@dataclass(frozen=True)
class StillTrading(Rule):
    """Trades at the decision or after."""

    def reason(self) -> Column:
        return F.when(~F.coalesce(F.col("last_seen") >= F.col("decision_start"), F.lit(False)), "stopped trading")


@dataclass(frozen=True)
class MinimumPresence(Rule):
    """Has a price on at least a share of the training (or test) sessions."""

    fraction: float
    cover: str = "train"

    def reason(self) -> Column:
        seen, of = {"train": ("present", "train_sessions"), "test": ("present_test", "test_sessions")}[_covered(self.cover)]
        share = F.try_divide(F.col(seen).cast("double"), F.col(of).cast("double"))
        return F.when(~F.coalesce(share >= self.fraction, F.lit(False)), "too few sessions")


def folds(windows: DataFrame, candidates: DataFrame, bars: DataFrame, sessions: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``window, symbol, reason``: null for those who are in.

    ``candidates`` are (window, symbol). The first rule that fails gives the
    reason. Training days are found by a range of positions per window that
    is exploded and met by equality; presence is then one aggregation.
    """
    pos = sessions.select(F.col("session").alias("_d"), F.col("pos").alias("_p"))
    bounds = (
        windows.join(pos.withColumnsRenamed({"_d": "train_start", "_p": "_a"}), "train_start")
        .join(pos.withColumnsRenamed({"_d": "train_end", "_p": "_b"}), "train_end")
        # A decision is executed, and so tested, a session later.
        .join(pos.select(F.col("_d").alias("decision_start"), (F.col("_p") + 1).alias("_c")), "decision_start")
        .join(pos.select(F.col("_d").alias("decision_end"), (F.col("_p") + 1).alias("_z")), "decision_end")
        .select(
            "window", "train_start", "decision_start", "_a", "_b", "_c", "_z",
            (F.col("_b") - F.col("_a") + 1).alias("train_sessions"), (F.col("_z") - F.col("_c") + 1).alias("test_sessions"),
        )
    )
    spans = F.concat(
        F.transform(F.sequence("_a", "_b"), lambda p: F.struct(p.alias("pos"), F.lit(True).alias("_train"))),
        F.transform(F.sequence("_c", "_z"), lambda p: F.struct(p.alias("pos"), F.lit(False).alias("_train"))),
    )
    days = bounds.select("window", F.inline(spans)).join(sessions, "pos")
    priced = bars.where("close IS NOT NULL").select("symbol", "session").distinct()
    present = days.join(priced, "session").groupBy("window", "symbol").agg(F.count_if("_train").alias("present"), F.count_if(~F.col("_train")).alias("present_test"))
    life = priced.groupBy("symbol").agg(F.min("session").alias("first_seen"), F.max("session").alias("last_seen"))
    rows = candidates.join(bounds, "window").join(life, "symbol", "left").join(present, ["window", "symbol"], "left").na.fill(0, ["present", "present_test"])
    return rows.select("window", "symbol", F.coalesce(*(r.reason() for r in rules), F.lit(None).cast("string")).alias("reason"))


def targets(selected: DataFrame, windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Those who are in, with each decision session of their window."""
    pos = sessions.select(F.col("session").alias("_d"), F.col("pos").alias("_p"))
    span = windows.join(pos.withColumnsRenamed({"_d": "decision_start", "_p": "_a"}), "decision_start").join(
        pos.withColumnsRenamed({"_d": "decision_end", "_p": "_b"}), "decision_end"
    )
    days = span.where("_a <= _b").select("window", F.explode(F.sequence("_a", "_b")).alias("pos")).join(sessions, "pos")
    return selected.where("reason IS NULL").select("window", "symbol").join(days.select("window", "session"), "window")


@dataclass(frozen=True)
class StaticUniverse:
    """Everyone who is in a universe on some test session of a window."""

    members: DataFrame  # session, symbol

    def candidates(self, windows: DataFrame, sessions: DataFrame) -> DataFrame:
        """``window, symbol``; test windows do not overlap, so a session has one."""
        pos = sessions.select(F.col("session").alias("_d"), F.col("pos").alias("_p"))
        span = windows.join(pos.withColumnsRenamed({"_d": "test_start", "_p": "_a"}), "test_start").join(pos.withColumnsRenamed({"_d": "test_end", "_p": "_b"}), "test_end")
        days = span.select("window", F.explode(F.sequence("_a", "_b")).alias("pos")).join(sessions, "pos")
        return days.join(self.members, "session").select("window", "symbol").distinct()


@dataclass(frozen=True)
class IndexComposition:
    """The members of an index in the period that a test window begins in.

    ``members``: ``period, symbol``. With ``split`` a test window is cut at
    each period start inside it, and every piece has its own composition;
    with ``hold`` that of its start holds to its end.
    """

    members: DataFrame
    at_rebalance: str = "split"

    def __post_init__(self) -> None:
        if self.at_rebalance not in ("split", "hold"):
            raise ValueError(f"at a rebalance a window is split or held, not {self.at_rebalance!r}")

    def cut(self, windows: DataFrame, sessions: DataFrame) -> DataFrame:
        """The windows, in pieces where they are split (``2024-03``, then ``2024-03/2024-05``)."""
        if self.at_rebalance == "hold":
            return windows
        label = _quadrimester(F.col("session"))
        pos = sessions.select(F.col("session").alias("_d"), F.col("pos").alias("_p"))
        span = windows.join(pos.withColumnsRenamed({"_d": "test_start", "_p": "_a"}), "test_start").join(pos.withColumnsRenamed({"_d": "test_end", "_p": "_b"}), "test_end")
        days = span.select("window", "train_start", "train_end", "_a", F.explode(F.sequence("_a", "_b")).alias("pos")).join(sessions, "pos").withColumn("_q", label)
        pieces = days.groupBy("window", "train_start", "train_end", "_a", "_q").agg(
            F.min("session").alias("test_start"), F.max("session").alias("test_end"), F.min("pos").alias("_c"), F.max("pos").alias("_z")
        )
        before = [pos.select(F.col("_d").alias(name), (F.col("_p") + 1).alias(at)) for name, at in (("decision_start", "_c"), ("decision_end", "_z"))]
        named = F.when(F.col("_c") == F.col("_a"), F.col("window")).otherwise(F.concat_ws("/", "window", "_q"))
        return pieces.join(before[0], "_c").join(before[1], "_z").select(named.alias("window"), "train_start", "train_end", "test_start", "test_end", "decision_start", "decision_end")

    def candidates(self, windows: DataFrame, sessions: DataFrame) -> DataFrame:
        """``window, symbol``; a window whose period has no composition is an error when it is read."""
        asked = windows.select("window", _quadrimester(F.col("test_start")).alias("period"))
        met = asked.join(self.members.select("period", "symbol"), "period", "left")
        lacking = F.raise_error(F.concat(F.lit("no composition in period "), F.col("period"))).cast("string")
        return met.select("window", F.when(F.col("symbol").isNull(), lacking).otherwise(F.col("symbol")).alias("symbol")).distinct()


def _quadrimester(day: Column) -> Column:
    return F.concat_ws("-", F.year(day).cast("string"), F.lpad((F.floor((F.month(day) - 1) / 4) * 4 + 1).cast("string"), 2, "0"))


@dataclass(frozen=True)
class Fold:
    """One window and who may be traded in it, with the panels to fit and to test on."""

    window: dict  # a row of the windows
    symbols: tuple[str, ...]
    warmup: int = 0

    def load_train(self, dataset: Dataset, fields: Sequence[str] | None = None, mode: str = "total_return") -> Panel:
        """The fold's symbols over the training sessions, adjusted relative to their end."""
        return self._panel(dataset, "train_start", "train_end", fields, mode)

    def load_test(self, dataset: Dataset, fields: Sequence[str] | None = None, mode: str = "total_return") -> Panel:
        """The same over the decision sessions: what the orders of the test may know."""
        return self._panel(dataset, "decision_start", "decision_end", fields, mode)

    def _panel(self, dataset: Dataset, start: str, end: str, fields: Sequence[str] | None, mode: str) -> Panel:
        more = {} if fields is None else {"fields": list(fields)}
        return dataset.panel(list(self.symbols), str(self.window[start]), str(self.window[end]), warmup=self.warmup, mode=mode, **more)


def each_fold(windows: DataFrame, selected: DataFrame, warmup: int = 0) -> list[Fold]:
    """The folds of a walk-forward in order, with the symbols that are in.

    A fold's panel is loaded by its symbols, so they, a list for each window,
    come to the driver.
    """
    inside = selected.where("reason IS NULL").groupBy("window").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
    rows = windows.join(inside, "window", "left").orderBy("test_start").collect()
    return [Fold({k: v for k, v in r.asDict().items() if k != "symbols"}, tuple(r.symbols or ()), warmup) for r in rows]
