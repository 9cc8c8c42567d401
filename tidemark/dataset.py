"""One entrance to a store: panels, members and labels at a point in time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calendar, identity, universe
from tidemark.operators.panel import Panel
from tidemark.operators.periods import parse_period
from tidemark.sources.provider import FIELDS, StoreProvider
from tidemark.sources.store import Store, StoreError

TABLES = (("curated", "bars"), ("derived", "factors"))


@dataclass(frozen=True)
class Dataset:
    """Tables of one store, read lazily; nothing is cached between calls."""

    spark: SparkSession
    store: Store

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Dataset:
        found = cls(spark, Store.open(root))
        for zone, name in TABLES:
            try:
                found.store.read(spark, zone, name).schema
            except Exception as error:
                raise StoreError(f"{zone}/{name} has not been built") from error
        return found

    def sessions(self) -> DataFrame:
        """All sessions; only the date column of the bars is read."""
        return calendar.sessions_of(self.store.read(self.spark, "curated", "bars"), "session")

    def members(self, chosen: universe.Universe, start: str, end: str) -> DataFrame:
        return chosen.members.where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    def as_universe(self, chosen: universe.Universe | str | Sequence[str], days: DataFrame | None = None) -> universe.Universe:
        """A universe as it is, an index by its code, or listed symbols at every session."""
        if isinstance(chosen, universe.Universe):
            return chosen
        if isinstance(chosen, str):
            return self.index_universe(chosen)
        if not all(isinstance(s, str) for s in chosen):
            raise TypeError("a universe is named by an index code or by symbols")
        return universe.constant(list(chosen), self.sessions() if days is None else days)

    def panel(
        self,
        chosen: universe.Universe | str | Sequence[str],
        start: str,
        end: str,
        *,
        warmup: int = 0,
        fields: Sequence[str] = FIELDS,
        anchor: str | None = None,
        mode: str = "total_return",
    ) -> Panel:
        """Aligned, adjusted bars of everyone ever in, marked where they are in.

        ``warmup`` sessions before ``start`` are there too, outside the
        universe. The symbols of a universe reach the scan as a list, which is
        as long as the universe has names.
        """
        days = self.sessions()
        chosen = self.as_universe(chosen, days)
        inside = self.members(chosen, start, end)
        symbols = [r[0] for r in inside.select("symbol").distinct().orderBy("symbol").collect()]
        if not symbols:
            raise ValueError(f"the universe has no member from {start} to {end}")
        first = calendar.valid_sessions(days, start, end).agg(F.min("pos")).first()[0]
        if first is None:
            raise ValueError(f"there is no session from {start} to {end}")
        early = days.where(F.col("pos") == max(0, first - warmup)).first()["session"]
        rows = StoreProvider(self.spark, self.store).bars(symbols, str(early), end, fields, anchor=anchor, mode=mode)
        span = days.where(F.col("session").between(F.lit(early), F.lit(end).cast("date")))
        return Panel.from_bars(calendar.align(rows, span), fields).with_universe(inside)

    # -- compositions of indexes ---------------------------------------------------------

    def _derived(self, name: str) -> DataFrame:
        try:
            return self.store.read(self.spark, "derived", name)
        except Exception as error:
            raise StoreError(f"derived/{name} has not been built") from error

    def constituents(self, index: str, as_of: str) -> DataFrame:
        """``symbol, ticker, source, period`` of the period in force on a day; none before the first."""
        day = F.lit(as_of).cast("date")
        now = self._derived("periods").where(F.col("effective_from") <= day).agg(F.max_by("period", "effective_from").alias("period"))
        return self._members(index).join(now, "period").select("symbol", "ticker", "source", "period")

    def composition(self, index: str, period: str) -> DataFrame:
        """The members in one period, by its label; an unknown period is an error."""
        parse_period(period)
        if self._derived("periods").where(F.col("period") == period).isEmpty():
            raise ValueError(f"{period} is no period of the store")
        return self._members(index).where(F.col("period") == period).select("symbol", "ticker", "source", "period")

    def _members(self, index: str) -> DataFrame:
        return self._derived("constituents").where(F.col("index") == index)

    def rebalance_dates(self, index: str, start: str, end: str) -> DataFrame:
        """``period, session``: the starts, in a range, of periods that the index has a composition for."""
        starts = self._derived("periods").select("period", F.col("effective_from").alias("session"))
        held = self._members(index).select("period").distinct()
        return starts.where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(held, "period", "left_semi")

    def index_universe(self, index: str) -> universe.Universe:
        """The members of an index at every session."""
        selected = self._members(index).where("symbol IS NOT NULL").select("period", "symbol")
        return universe.members_of(selected, self.sessions(), self._derived("periods"))

    def events(self, symbol: str) -> DataFrame:
        """The events of a security, by ex-date."""
        return self.store.read(self.spark, "curated", "events").where(F.col("symbol") == symbol).orderBy("ex_date")

    def exits(self, index: str, start: str, end: str) -> DataFrame:
        """Members that stop trading in a period that overlaps a range."""
        first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
        over = self._derived("periods").where((F.col("effective_from") <= last) & (F.col("effective_to") >= first)).select("period")
        return self._derived("exits").where(F.col("index") == index).join(over, "period", "left_semi")

    def factors(self, symbols: Sequence[str] | None = None) -> DataFrame:
        rows = self.store.read(self.spark, "derived", "factors")
        return rows.where(F.col("symbol").isin(list(symbols))) if symbols else rows

    def label_history(self, entity: str) -> DataFrame:
        """The labels of one security in order, of ``curated/spans``."""
        return self.store.read(self.spark, "curated", "spans").where(F.col("symbol") == entity).orderBy("first_session")

    def label_at(self, asked: DataFrame, at: str) -> DataFrame:
        """``asked`` (symbol, day) with the label of that day."""
        return identity.label_at(self.store.read(self.spark, "curated", "spans"), asked, "symbol", "label", at)
