"""Where bars come from: an interface, and one over the store's tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.adjustment import adjust
from tidemark.operators.identity import one_row_per_label
from tidemark.sources.store import Store

FIELDS = ("open", "high", "low", "close", "volume")


class BarsProvider(ABC):
    """Long bars ``session, symbol`` and fields, one row per key."""

    @abstractmethod
    def bars(self, symbols: Sequence[str], start: str, end: str, fields: Sequence[str] = FIELDS, *, anchor: str | None = None, mode: str = "total_return") -> DataFrame:
        """The bars of ``symbols`` from ``start`` to ``end``, both included.

        Adjusted relative to ``anchor`` (the end, if none is given) in one of
        the modes of :func:`tidemark.operators.adjustment.adjust`.
        """

    def wide(self, symbols: Sequence[str], start: str, end: str, field: str = "close", **options: object) -> DataFrame:
        """One column per symbol."""
        rows = self.bars(symbols, start, end, [field], **options)
        return rows.groupBy("session").pivot("symbol", list(symbols)).agg(F.first(field))


class StoreProvider(BarsProvider):
    """Bars of ``curated/bars`` (partitioned by year), factors of ``derived/factors``.

    Years, symbols and columns reach the scan, so only the files and columns
    asked for are read. Of rows that share a symbol and session the one with
    the larger volume counts.
    """

    def __init__(self, spark: SparkSession, store: Store) -> None:
        self.spark, self.store = spark, store

    def bars(self, symbols, start, end, fields=FIELDS, *, anchor=None, mode="total_return"):
        if not symbols:
            raise ValueError("name at least one symbol")
        if start > end:
            raise ValueError(f"{start} lies after {end}")
        raw = self.store.read(self.spark, "curated", "bars")
        if unknown := sorted(set(fields) - set(raw.columns)):
            raise ValueError(f"no field {', '.join(unknown)}")
        rows = raw.where(
            F.col("year").between(int(start[:4]), int(end[:4]))
            & F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
            & F.col("symbol").isin(list(symbols))
        ).select("session", "symbol", *dict.fromkeys([*fields, "volume"]))
        rows = one_row_per_label(rows, "symbol", "session", "volume", "session")
        if mode != "raw":
            factors = self.store.read(self.spark, "derived", "factors").where(F.col("symbol").isin(list(symbols)))
            rows = adjust(rows, factors, anchor or end, mode)
        return rows.select("session", "symbol", *fields)

    def by_label(self, labels: Sequence[str], start: str, end: str, fields: Sequence[str] = FIELDS, **options: object) -> DataFrame:
        """Bars by ticker, following renames: ``session, symbol`` (the ticker asked for) and fields.

        Each ticker stands for the security that carried it last on or before
        the end (``curated/spans``: ``symbol, label, first_session,
        last_session``), whose whole history in the range comes under that
        ticker. Unknown tickers, and two tickers of one security, are errors.
        The tickers are few; what they stand for comes to the driver.
        """
        last = F.lit(end).cast("date")
        spans = self.store.read(self.spark, "curated", "spans").where(F.col("label").isin(list(labels)) & (F.col("first_session") <= last))
        carried = spans.groupBy("label").agg(F.max_by("symbol", F.struct(F.least("last_session", last), "first_session", "symbol")).alias("symbol"))
        found = {r.label: r.symbol for r in carried.collect()}
        if unknown := sorted(set(labels) - set(found)):
            raise ValueError(f"no security carried {', '.join(unknown)} by {end}")
        if len(set(found.values())) < len(found):
            raise ValueError("two of the tickers are one security")
        rows = self.bars(list(found.values()), start, end, fields, **options)
        named = F.create_map(*(F.lit(x) for label, symbol in found.items() for x in (symbol, label)))
        return rows.withColumn("symbol", named[F.col("symbol")])
