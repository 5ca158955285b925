"""Merging the partitions of a topic into one event-time order, by the least frontier.

A partition delivers its rows in event-time order; partitions come interleaved in any way. Its frontier is the latest time it has
delivered. Rows before the least frontier of all partitions can have no earlier row behind them, so they leave in total
order (time, topic partition, offset); the others wait. A row whose offset its partition has already passed is a replay and is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestream.operators.feeds import latest

PENDING = "t long, partition string, offset long, payload string"
ORDER = ["t", "partition", "offset"]


class PartitionMerge(StatefulProcessor):
    """Keyed state of a shard: one frontier and offset a partition, the rows that wait, and the time up to which rows have left.

    ``expected`` partitions must have delivered before any row leaves. A partition whose frontier is more than ``max_lag_ns`` behind the
    greatest one is idle and holds nobody back (a rule on event time, so a replay decides alike; without it a silent
    partition would stop its shard for ever); what it delivers afterwards leaves at once, marked late. Rows without a time leave at once.
    """

    def __init__(self, expected: int, max_lag_ns: int | None) -> None:
        self.expected, self.max_lag_ns = expected, max_lag_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", PENDING)
        self.marks = handle.getMapState("marks", "partition string", "latest long, offset long")
        self.through = handle.getValueState("through", "t long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [c.split()[0] for c in PENDING.split(", ")]
        marks = {k[0]: list(v) for k, v in self.marks.iterator()}
        through = self.through.get()[0] if self.through.exists() else None
        own = [tuple(None if pd.isna(v) else v for v in r) for f in rows for r in f[names].itertuples(index=False)]
        wait = [(*r, False) for r in self.pending.get()] if self.pending.exists() else []
        for t, partition, offset, payload in sorted(own, key=lambda r: (str(r[1]), -1 if r[2] is None else r[2])):
            mark = marks.setdefault(partition, [None, None])
            if offset is not None:
                if mark[1] is not None and offset <= mark[1]:
                    continue
                mark[1] = int(offset)
            late = t is not None and through is not None and t < through
            if t is not None:
                mark[0] = int(t) if mark[0] is None else max(mark[0], int(t))
            wait.append((None if t is None else int(t), partition, None if offset is None else int(offset), payload, late))
        fronts = [m[0] for m in marks.values() if m[0] is not None]
        if len(fronts) >= self.expected and fronts:
            live = [f for f in fronts if self.max_lag_ns is None or f >= max(fronts) - self.max_lag_ns]
            through = min(live) if through is None else max(through, min(live))
        go = [r for r in wait if r[0] is None or (through is not None and r[0] < through)]
        held = [r[:4] for r in wait if not (r[0] is None or (through is not None and r[0] < through))]
        for partition, mark in marks.items():
            self.marks.updateValue((partition,), tuple(mark))
        if through is not None:
            self.through.update((through,))
        if held:
            self.pending.put(held)
        else:
            self.pending.clear()
        first = lambda x: (x is not None, x or 0)  # noqa: E731  rows without one come first
        go.sort(key=lambda r: (first(r[0]), str(r[1]), first(r[2])))
        out = pd.DataFrame(go, columns=[*names, "late"]).astype({"t": "Int64", "offset": "Int64", "late": bool})
        yield out.assign(shard=key[0], place=range(len(out)))

    def close(self) -> None:
        pass


def merged(stream: DataFrame, shard: str, partition: str, offset: str, time_ns: str, expected: int, max_lag_ns: int | None = None) -> DataFrame:
    """The stream's rows in the order in which they may leave, with late and place (the order within a shard and micro-batch).

    ``shard`` spreads the topic's entities over tasks; the order holds within it, which is all that work by entity needs. Needs
    the RocksDB state store; rows wait as JSON, so columns must have a JSON form.
    """
    packed = stream.select(F.col(shard).alias("shard"), F.col(time_ns).cast("long").alias("t"), F.col(partition).cast("string").alias("partition"), F.col(offset).cast("long").alias("offset"), F.to_json(F.struct(*stream.columns)).alias("payload"))
    shape = packed.select("t", "partition", "offset", "payload", F.lit(True).alias("late"), "shard", F.lit(0).cast("long").alias("place")).schema
    out = packed.groupBy("shard").transformWithStateInPandas(statefulProcessor=PartitionMerge(expected, max_lag_ns), outputStructType=shape, outputMode="Append", timeMode="None")
    return out.select(F.from_json("payload", stream.schema).alias("r"), "late", "place").select("r.*", "late", "place")


def _running_max(df: DataFrame, keys: list[str], value: str, seq: str, block: int, name: str) -> DataFrame:
    """df with ``name``: the greatest value of the keys' rows before the row's own seq, within blocks of seq and across them."""
    out = df.withColumn("_block", F.floor(F.col(seq) / block).cast("long"))
    ends = out.groupBy(*keys, "_block").agg(F.max(value).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.max("_end").over(before)).drop("_end")
    inside = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_own", F.max(value).over(inside)).join(ends, [*keys, "_block"])
    return out.withColumn(name, F.greatest("_own", "_before")).drop("_block", "_own", "_before")


def release_schedule(df: DataFrame, partition: str, offset: str, batch: str, time_ns: str, seq: str, expected: int, block: int = 65536, slice_ns: int = 3_600_000_000_000) -> DataFrame:
    """What the merge does with a stored stream: the rows without replays, with late and released_in, the batch (a number) with which a row
    leaves; null if it still waits at the end. ``seq`` is the order of arrival.

    Frontiers are one row a (batch, partition); rows find the first batch that passes their time by a running value within slices of time.
    """
    own = _running_max(df, [partition], offset, seq, block, "_passed").where(F.col("_passed").isNull() | (F.col(offset) > F.col("_passed"))).drop("_passed")
    fronts = own.where(F.col(time_ns).isNotNull()).groupBy(partition, batch).agg(F.max(time_ns).alias("_front"))
    by_partition = Window.partitionBy(partition).orderBy(batch)
    last = own.agg(F.max(batch).alias("_last"))  # one row
    fronts = fronts.withColumns({"_front": F.max("_front").over(by_partition.rowsBetween(Window.unboundedPreceding, 0)), "_until": F.lead(batch).over(by_partition) - 1})
    fronts = fronts.join(F.broadcast(last)).withColumn(batch, F.explode(F.sequence(F.col(batch), F.coalesce("_until", "_last"))))
    steps = fronts.groupBy(batch).agg(F.when(F.count("*") >= expected, F.min("_front")).alias("_w"))
    # few rows: one a batch
    order = Window.orderBy(batch)
    steps = steps.withColumn("_through", F.max("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("_earlier", F.lag("_through").over(order)).select(F.col(batch).alias("_batch"), "_through", "_earlier")
    out = own.join(steps.select("_batch", "_earlier"), F.col(batch) == F.col("_batch"), "left").drop("_batch")
    rises = steps.where("_through IS NOT NULL").groupBy("_through").agg(F.min("_batch").alias("_batch"))
    # the least frontier over a row's time is the last one in descending order
    rows = out.withColumnRenamed(seq, "_arrival").withColumn("seq", -F.col(time_ns) - 1)
    facts = rises.withColumn("seq", -F.col("_through"))
    out = latest(rows, F.lit("all"), facts, F.lit("all"), F.col("_batch"), "_found", slice_ns).drop("seq").withColumnRenamed("_arrival", seq)
    known = F.when(F.col(time_ns).isNull(), F.col(batch)).otherwise(F.greatest(F.col("_found"), F.when(F.col("_found").isNotNull(), F.col(batch))))
    return out.withColumns({"late": F.coalesce(F.col(time_ns) < F.col("_earlier"), F.lit(False)), "released_in": known}).drop("_earlier", "_found")
