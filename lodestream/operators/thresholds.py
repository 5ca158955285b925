"""Thresholds that a baseline period proposes: exact by nearest rank, or from quantile sketches that are kept and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 1024  # size of a sketch: ranks are within about 0.3 % with a confidence of 99 %


def rank_of(fires: str, quantile: float) -> float:
    """The rank to take: from the other end for a rule that fires below its threshold."""
    if fires not in ("above", "below"):
        raise ValueError(f"{fires!r}: a rule fires above or below")
    if not 0 < quantile < 1:
        raise ValueError(f"a quantile lies between 0 and 1, not at {quantile}")
    return quantile if fires == "above" else round(1 - quantile, 12)


def derive_thresholds(df: DataFrame, keys: list[str], value: Column, fires: str, quantile: float) -> DataFrame:
    """keys, samples and threshold: the value at the quantile by nearest rank. Nulls, NaN and what is no number are no samples.

    Values are counted by (key, value) first, so a key's ties are one row, and the running count finds the rank.
    """
    rank = rank_of(fires, quantile)
    if not keys:
        return derive_thresholds(df.withColumn("_all", F.lit(0)), ["_all"], value, fires, quantile).drop("_all")
    rows = df.select(*keys, value.try_cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)").groupBy(*keys, "_x").count()
    totals = rows.groupBy(*keys).agg(F.sum("count").alias("samples"))
    upto = rows.withColumn("_n", F.sum("count").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    both = upto.join(totals, keys)
    at = F.greatest(F.ceil(F.lit(rank) * F.col("samples")), F.lit(1))
    return both.where(F.col("_n") >= at).groupBy(*keys, "samples").agg(F.min("_x").alias("threshold"))


def sketches(df: DataFrame, keys: list[str], value: Column, k: int = K) -> DataFrame:
    """keys and sketch of the period's values, a few KB a key, whatever their number; made by partial aggregation."""
    rows = df.select(*keys, value.try_cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)")
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_x", F.lit(k)).alias("sketch"))


def merge_sketches(kept: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of two periods as those of both: a kept table is merged with a new period's, no value is read again."""
    return kept.select(*keys, "sketch").unionByName(more.select(*keys, "sketch")).groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def propose(kept: DataFrame, keys: list[str], fires: str, quantile: float) -> DataFrame:
    """keys, samples and threshold from sketches."""
    rank = rank_of(fires, quantile)
    return kept.select(*keys, F.kll_sketch_get_n_double("sketch").alias("samples"), F.kll_sketch_get_quantile_double("sketch", F.lit(rank)).alias("threshold"))
