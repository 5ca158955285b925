"""Envelopes, lineage ids, sealed windows, edges and health records over frames with t (ns) and seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.identity import lineage_id, link_uid, window_id


def total_order_ties(df: DataFrame, *order: str) -> DataFrame:
    """Keys of the total order that more than one row has, with their counts."""
    return df.groupBy(*order).agg(F.count("*").alias("rows")).where("rows > 1")


def validate_envelope(df: DataFrame, required: list[str], offset_ms: str | None = None, max_offset_ms: int = 1000) -> DataFrame:
    """quarantine_reasons (sorted, empty if the row is fine): missing:<column>, clock_offset."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in sorted(required)]
    if offset_ms:
        checks.insert(0, F.when(F.abs(F.col(offset_ms)) > max_offset_ms, F.lit("clock_offset")))
    return df.withColumn("quarantine_reasons", F.array_compact(F.array(*checks)))


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are fine, rows in quarantine) of a validated frame."""
    return df.where(F.size("quarantine_reasons") == 0).drop("quarantine_reasons"), df.where(F.size("quarantine_reasons") > 0)


def seal_windows(df: DataFrame, period_ns: int, lateness_ns: int, epoch_ns: int = 0) -> DataFrame:
    """window_id, and late: the row's window had been sealed by the watermark (the greatest t that arrived before it, in
    order of seq) when it came. The running maximum is made in two steps, within hours of arrival and across them, so
    that no task sees the whole stream."""
    out = df.withColumn("window_id", window_id(F.col("t"), period_ns, epoch_ns))
    out = out.withColumn("_block", F.floor(F.col("seq") / 65536).cast("long"))
    blocks = out.groupBy("_block").agg(F.max("t").alias("_max"))
    # few rows: one a block of arrivals
    earlier = blocks.withColumn("_before", F.max("_max").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_max")
    inside = Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_own", F.max("t").over(inside)).join(earlier, "_block")
    watermark = F.greatest("_own", "_before")
    end = (F.col("window_id") + 1) * period_ns + epoch_ns
    return out.withColumn("late", F.coalesce(end + lateness_ns <= watermark, F.lit(False))).drop("_block", "_own", "_before")


def entity_frame(df: DataFrame, entity: str, features: dict[str, tuple[str, str]], carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a (entity, window_id): features by name as (column, max/min/mean/sum/last/count_true); carry columns take
    their first non-null value. Late rows are left out."""
    rows = df.where(~F.col("late")) if "late" in df.columns else df
    how = {
        "max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum,
        "last": lambda c: F.max_by(c, F.struct("t", "seq")), "count_true": lambda c: F.sum(F.col(c).cast("long")),
    }
    aggs = [how[kind](c).alias(name) for name, (c, kind) in features.items()]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("t", "seq"))).alias(c) for c in carry]
    return rows.groupBy(F.col(entity).alias("entity"), "window_id").agg(F.count("*").alias("rows"), *aggs, *firsts)


def chain_anchor(df: DataFrame, candidates: list[str]) -> DataFrame:
    """chain_anchor: the first candidate that isn't null; chain_anchor_source: its name."""
    source = F.lit(None).cast("string")
    for c in reversed(candidates):
        source = F.when(F.col(c).isNotNull(), F.lit(c)).otherwise(source)
    return df.withColumns({"chain_anchor": F.coalesce(*(F.col(c).cast("string") for c in candidates)), "chain_anchor_source": source})


def emit_edges(df: DataFrame, join_key: str, layer: str, uid: str) -> DataFrame:
    """Edges carried_by: the parent of a row is the first uid of the nearest lower layer that its join key has shown up
    to then. Columns: parent, child, relation, join_method, link_uid, t."""
    w = Window.partitionBy(join_key).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(join_key, layer).orderBy("t", "seq")
    own = df.where(F.col(join_key).isNotNull() & F.col(layer).isNotNull()).withColumn("_n", F.row_number().over(first))
    # the first of each layer is all that later rows can look at: few entries a key
    own = own.withColumn("_s", F.collect_list(F.when(F.col("_n") == 1, F.struct(F.col(layer).alias("layer"), F.col(uid).alias("uid")))).over(w))
    below = F.filter("_s", lambda x: x["layer"] < F.col(layer))
    own = own.withColumn("parent", F.array_max(below)["uid"]).where("parent IS NOT NULL")
    out = own.select("parent", F.col(uid).alias("child"), F.lit("carried_by").alias("relation"), F.lit("hard").alias("join_method"), "t")
    return out.withColumn("link_uid", link_uid(F.col("parent"), F.col("child"), F.col("relation"), F.col("join_method")))


def stamp_lineage(df: DataFrame, entity: str, uid: str) -> DataFrame:
    """lineage_id of the row's (entity, window_id), rooted in the window's first event."""
    w = Window.partitionBy(entity, "window_id").orderBy("t", "seq")
    return df.withColumn("lineage_id", lineage_id(F.col(entity).cast("string"), F.col("window_id"), F.first(uid).over(w)))


def pipeline_health(df: DataFrame, collector: str, lag_ns: Column) -> DataFrame:
    """One row a (window_id, collector): rows, late rows, first and last t, and the greatest and median lag."""
    return df.groupBy("window_id", F.col(collector).alias("collector")).agg(
        F.count("*").alias("rows"), F.sum(F.col("late").cast("long")).alias("late_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.max(lag_ns).alias("max_lag_ns"), F.percentile(lag_ns, F.lit(0.5)).alias("median_lag_ns"),
    )


def route(df: DataFrame, key: Column, keys: list[str]) -> dict[str, DataFrame]:
    """One frame a key."""
    return {k: df.where(key == k) for k in keys}


def minimise(df: DataFrame, drop: list[str], pseudonyms: list[str], key: bytes) -> DataFrame:
    """Privacy: drop columns, replace others by keyed hashes."""
    from lodestream.functions.identity import pseudonymize

    return df.drop(*drop).withColumns({c: pseudonymize(F.col(c), key) for c in pseudonyms})
