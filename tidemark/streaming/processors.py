"""Kernels on streams: states by symbol, cross sections by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.kernels import cs_rank
from tidemark.session import ship
from tidemark.streaming.states import State


def stream_kernel(stream: DataFrame, make: Callable[[], State], x: str, by: str = "symbol", at: str = "ts") -> DataFrame:
    """``by, at, x, value, late``: a kernel's state run along a stream.

    Each symbol's rows of a micro-batch are taken in time order. A row that is
    not later than the last one its symbol has had comes too late for the
    state: it is passed on with ``late`` set and no value. A null in ``x``
    leaves the state unchanged. The state of a symbol is a short text in the
    state store, so it survives the loss of an executor.
    """
    ship(stream.sparkSession)
    rows = stream.select(F.col(by).cast("string").alias(by), F.col(at).cast("timestamp").alias(at), F.col(x).cast("double").alias(x))

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, last = make(), pd.NaT
        if kept.exists:
            text, stamp = kept.get
            state.load(text)
            last = pd.Timestamp(stamp) if stamp else pd.NaT
        new = pd.concat(list(batches)).sort_values(at, kind="stable")
        values, late = [], []
        for t, v in zip(new[at], new[x], strict=True):
            behind = not pd.isna(last) and t <= last
            late.append(behind)
            values.append(None if behind else state.update(v))
            if not behind:
                last = t
        kept.update((state.dump(), "" if pd.isna(last) else last.isoformat()))
        yield pd.DataFrame({by: key[0], at: new[at].to_numpy(), x: new[x].to_numpy(), "value": values, "late": late}).astype({"value": "float64"})

    return rows.groupBy(by).applyInPandasWithState(
        run, f"{by} string, {at} timestamp, {x} double, value double, late boolean", "state string, last string", "append", GroupStateTimeout.NoTimeout
    )


def stream_ranks(stream: DataFrame, x: str, path: str, by: str = "symbol", at: str = "ts", mask: str | None = None):
    """Writes cross-sectional ranks of each micro-batch to parquet at ``path``.

    All symbols of a time must arrive in one micro-batch. Each batch replaces
    its own folder, so a batch that is run again does not double its rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.select("*", cs_rank(x, mask, at).alias("rank")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run)


def bars_of_events(stream: DataFrame, at: str, by: str, value: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Open, high, low, close and count of event-time windows, with a watermark."""
    order = F.struct(at, value)
    return (
        stream.withWatermark(at, delay)
        .groupBy(F.window(at, width), by)
        .agg(
            F.min_by(value, order).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, order).alias("close"),
            F.count("*").alias("n"),
        )
        .select(by, F.col("window.start").alias("start"), "open", "high", "low", "close", "n")
    )
