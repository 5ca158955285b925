"""Scheduled searches: detections over scored frames, keyed tables, sequences of layers and chains.

Search terms in Spark: stats is groupBy with null keys dropped, values() a sorted set, streamstats a lag, join a many-to-
many equi-join, lookup a left join on the first match, collect an append and outputlookup a keyed merge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.sources.sinks import upsert  # noqa: F401  a search's outputlookup


@dataclass(frozen=True)
class Rule:
    """A detection: its id, layer, score and the condition that raises it."""

    rule_id: str
    layer: int
    score: float
    condition: str


#: Detections over the event frame's own features, from single signals to forecasts.
RULES = (
    Rule("R-D-L7-001", 7, 40.0, "event_type = 'error' AND value > 30"),
    Rule("R-D-L5-001", 5, 25.0, "failure_then_success AND consecutive_failures >= 2"),
    Rule("R-B-L3-001", 3, 30.0, "distinct_n >= 4"),
    Rule("R-B-L7-002", 7, 20.0, "ratio >= 0.5"),
    Rule("R-P-L5-001", 5, 35.0, "surprise_bits >= 5.5 AND cycle_mature"),
)


def stats(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """Aggregate; rows with a null key are left out."""
    return df.na.drop(subset=by).groupBy(*by).agg(*(c.alias(n) for n, c in aggregates.items()))


def values(c: str) -> Column:
    """Sorted different values as text."""
    return F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";")


def streamstats_last(df: DataFrame, by: list[str], order: list[str], **columns: str) -> DataFrame:
    """Each column's value on the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({name: F.lag(c).over(w) for name, c in columns.items()})


def dedup(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def lookup(df: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on the first match by key: the table has one row a key by its own order of columns."""
    first = table.groupBy(key).agg(F.min(F.struct(*columns)).alias("_m"))
    return df.join(first, key, "left").withColumns({c: F.col(f"_m.{c}") for c in columns}).drop("_m")


def expire(table: DataFrame, column: str, least: int) -> DataFrame:
    return table.where(F.col(column) >= least)


def raise_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a (event, rule that it raises): the frame with rule_id, layer and risk_score. One pass for all rules."""
    hits = F.array_compact(F.array(*(F.when(F.expr(r.condition), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.layer).alias("layer"), F.lit(r.score).alias("risk_score"))) for r in rules)))
    return df.withColumn("_h", F.explode(hits)).select(*df.columns, "_h.*")


def assemble_chains(risks: DataFrame, group: str, period_ns: int) -> DataFrame:
    """One row a (group, window): layers and rules met, risk as the sum of each rule's greatest score, span of time;
    cross_layer if two or more layers met."""
    keyed = risks.withColumn("window_id", F.floor(F.col("t") / period_ns).cast("long"))
    by_rule = keyed.groupBy(group, "window_id", "rule_id", "layer").agg(F.max("risk_score").alias("s"), F.min("t").alias("a"), F.max("t").alias("b"))
    out = by_rule.groupBy(group, "window_id").agg(
        F.sum("s").alias("risk"), F.countDistinct("layer").alias("layers"), values("rule_id").alias("rules"), F.min("a").alias("first_t"), F.max("b").alias("last_t"),
    )
    return out.withColumn("cross_layer", F.col("layers") >= 2)


def sequence_join(first: DataFrame, second: DataFrame, key: str, within_ns: int, bucket_ns: int | None = None) -> DataFrame:
    """Pairs where second follows first of the same key within a time: key, first_t, second_t, first_seq, second_seq.

    Joined by (key, time bucket) and its neighbour, so that a busy key's history is never paired with itself as a whole.
    """
    size = bucket_ns or within_ns
    a = first.select(key, F.col("t").alias("first_t"), F.col("seq").alias("first_seq"), F.explode(F.array(*(F.floor(F.col("t") / size).cast("long") + k for k in range(within_ns // size + 2)))).alias("_b"))
    b = second.select(key, F.col("t").alias("second_t"), F.col("seq").alias("second_seq"), F.floor(F.col("t") / size).cast("long").alias("_b"))
    return a.join(b, [key, "_b"]).where(f"second_t > first_t AND second_t - first_t <= {within_ns}").drop("_b")


def suppress(risks: DataFrame, allowlist: DataFrame, key: str) -> DataFrame:
    """Risks whose key isn't allowed."""
    return risks.join(allowlist.select(key).distinct(), key, "left_anti")


def watched(df: DataFrame, watchlist: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on the watchlist."""
    return df.join(watchlist.select(key).distinct(), key, "left_semi")
