"""Structured Streaming twins of the batch operators.

Late rows are explicit: a row is late when its window was sealed before it came, and late rows leave by a branch of
their own ahead of any stateful operator, which would drop them in silence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def sealed_windows(stream: DataFrame, time: str, period: str, lateness: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Tumbling windows that are emitted once, when the watermark has passed their end by the lateness (append mode)."""
    rows = stream.withWatermark(time, lateness).groupBy(F.window(time, period).alias("window"), *keys)
    return rows.agg(*(c.alias(n) for n, c in aggregates.items())).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, lateness: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Sessions by key: a silence of ``gap`` closes one."""
    rows = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("session"), *keys)
    return rows.agg(*(c.alias(n) for n, c in aggregates.items())).select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *keys, *aggregates)


def deduplicated(stream: DataFrame, time: str, lateness: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark: replays of a partition fall out."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, within: str, lateness: str) -> DataFrame:
    """Stream-stream join: right rows that follow a left row of the same key within a time. State is bounded by both."""
    l, r = left.withWatermark(left_time, lateness).alias("l"), right.withWatermark(right_time, lateness).alias("r")
    match = F.expr(f"r.{right_time} > l.{left_time} AND r.{right_time} <= l.{left_time} + INTERVAL {within}")
    for k in on:
        match = match & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, match)


class ClockGuard(StatefulProcessor):
    """Event clock by source: a row too far ahead of the clock is refused and doesn't move it; others do. The state is
    one number a source; rows of a micro-batch are taken in order of (t, seq)."""

    def __init__(self, max_skew_ns: int) -> None:
        self.max_skew_ns = max_skew_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "t long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable")
        clock = self.clock.get()[0] if self.clock.exists() else None
        refused = []
        for t in frame["t"]:
            far = clock is not None and t > clock + self.max_skew_ns
            refused.append(far)
            if not far:
                clock = t if clock is None else max(clock, t)
        if clock is not None:
            self.clock.update((int(clock),))
        yield frame.assign(clock_refused=refused)

    def close(self) -> None:
        pass


def guarded(stream: DataFrame, source: str, max_skew_ns: int) -> DataFrame:
    """stream with clock_refused; needs the RocksDB state store."""
    schema = stream.select("*", F.lit(True).alias("clock_refused")).schema
    return stream.groupBy(source).transformWithStateInPandas(statefulProcessor=ClockGuard(max_skew_ns), outputStructType=schema, outputMode="Append", timeMode="None")


def split_late(batch: DataFrame, watermark_ns: int, period_ns: int, lateness_ns: int) -> tuple[DataFrame, DataFrame]:
    """Inside foreachBatch: (rows in time, late rows) against the watermark before the batch."""
    end = (F.floor(F.col("t") / period_ns) + 1) * period_ns
    late = end + lateness_ns <= F.lit(watermark_ns)
    return batch.where(~late), batch.where(late)
