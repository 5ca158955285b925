"""Unusual activity of a user against its own rhythm: binned counts, the strong frequencies kept, and what they don't explain.

The line of bins is cut into blocks; a block is judged in a window that reaches ``half`` bins into its neighbours on either side, so
a group holds a bounded number of bins however long and busy a user's history is. Counting comes first: rows of a bin are one
row before any Python runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = "user string, bin long"


def unexplained(signals: np.ndarray, filter_percent: float, threshold: float) -> np.ndarray:
    """Of each row, a signal, the places whose distance from the signal of its strong frequencies is ``threshold`` deviations or more from the mean one.

    A frequency is strong if its share of the standardised signal's power is at least the given percentile of all shares.
    """
    n, spread = signals.shape[1], signals.std(axis=1, keepdims=True)
    flat = (signals - signals.mean(axis=1, keepdims=True)) / np.where(spread == 0, 1.0, spread)
    power = np.abs(np.fft.fft(flat)[:, : n // 2 + 1]) ** 2 / n
    waves = np.fft.rfft(signals)
    waves[power < np.percentile(power, filter_percent, axis=1)[:, None]] = 0
    residue = np.abs(np.fft.irfft(waves, n) - signals)
    spread = residue.std(axis=1, keepdims=True)
    return (spread != 0) & (np.abs(residue - residue.mean(axis=1, keepdims=True)) / np.where(spread == 0, 1.0, spread) >= threshold)


def _judged(batch: pa.RecordBatch, half: int, block_bins: int, hot_start: bool, cold_end: bool, filter_percent: float, threshold: float) -> pa.RecordBatch:
    """The bins of a batch of blocks that don't fit: user and bin."""
    block, least, most = (batch.column(c).to_numpy() for c in ("block", "least", "most"))
    lists = batch.column("held")
    bins, counts = (lists.flatten().field(c).to_numpy() for c in ("bin", "count"))
    of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    inside = (bins >= block[of] * block_bins) & (bins < (block[of] + 1) * block_bins)
    start, end = np.full(batch.num_rows, np.iinfo(np.int64).max), np.full(batch.num_rows, np.iinfo(np.int64).min)
    np.minimum.at(start, of[inside], bins[inside])
    np.maximum.at(end, of[inside], bins[inside])
    ready = start <= end
    start, end = np.where(ready, start - half, 0), np.where(ready, end + half, 0)
    ready &= (hot_start | (least <= start)) & ~(cold_end & (most < end))
    hit = np.zeros(len(bins), bool)
    for length in np.unique((end - start)[ready]):
        own = np.flatnonzero(ready & (end - start == length))
        row = np.full(batch.num_rows, -1)
        row[own] = np.arange(len(own))
        held = np.flatnonzero((row[of] >= 0) & (bins >= start[of]) & (bins <= end[of]))
        # a free bin before the first one; the last two share one, as the window's end is closed
        place = np.minimum(bins[held] - start[of[held]] + 1, length)
        signals = np.zeros((len(own), length + 1))
        np.add.at(signals, (row[of[held]], place), counts[held])
        # the window's end is a bin that the last place holds but doesn't name
        named = held[inside[held] & (bins[held] < end[of[held]])]
        hit[named] = unexplained(signals, filter_percent, threshold)[row[of[named]], bins[named] - start[of[named]] + 1]
    return pa.RecordBatch.from_arrays([batch.column("user").take(pa.array(of[hit])).cast(pa.string()), pa.array(bins[hit], pa.int64())], ["user", "bin"])


def time_series_anomalies(df: DataFrame, user: str, time: str, resolution_s: int = 3600, min_window_s: int = 12 * 3600, hot_start: bool = False, cold_end: bool = False, filter_percent: float = 90.0, threshold: float = 8.0, block_bins: int = 24) -> DataFrame:
    """df with ts_anomaly: the row's bin doesn't fit the user's rhythm around its block.

    Bins start with the user's first day, and seconds are rounded. A block whose window begins before the user's first row is warming up
    and flags nothing, unless hot_start; one whose window ends after the user's last row flags nothing if cold_end. Rows without a user or a time are never flagged.
    """
    half = math.ceil(min_window_s / resolution_s)
    second = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000 + 0.5)
    own = df.withColumns({"_user": F.col(user).cast("string"), "_second": second})
    first = own.where("_user IS NOT NULL AND _second IS NOT NULL").groupBy("_user").agg((F.floor(F.min("_second") / 86400) * 86400).alias("_t0"))
    own = own.join(first, "_user", "left").withColumn("_bin", F.floor((F.col("_second") - F.col("_t0")) / resolution_s).cast("long"))
    counts = own.where("_bin IS NOT NULL").groupBy(F.col("_user").alias("user"), F.col("_bin").alias("bin")).count()
    span = counts.groupBy("user").agg(F.min("bin").alias("least"), F.max("bin").alias("most"))
    blocks = counts.join(span, "user").withColumn("block", F.explode(F.sequence(F.floor((F.col("bin") - half) / block_bins).cast("long"), F.floor((F.col("bin") + half) / block_bins).cast("long"))))

    # one row a block, with its few bins: a batch holds thousands of blocks, and those of one length are transformed at once
    held = blocks.groupBy("user", "block").agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("held"), F.first("least").alias("least"), F.first("most").alias("most"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _judged(batch, half, block_bins, hot_start, cold_end, filter_percent, threshold)

    flagged = held.mapInArrow(judge, BINS).select(F.col("user").alias("_user"), F.col("bin").alias("_bin"), F.lit(True).alias("_hit"))
    return own.join(flagged, ["_user", "_bin"], "left").withColumn("ts_anomaly", F.coalesce("_hit", F.lit(False))).select(*df.columns, "ts_anomaly")
