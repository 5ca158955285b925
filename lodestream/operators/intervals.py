"""Interval facts: closing them from observations, point lookup, time buckets, bitemporal versions.

Half-open intervals [start, end) in nanoseconds. A lookup is an equi-join: both sides are cut into time buckets, so no
key's whole history meets in one comparison, then the greatest (start, end) that covers the instant wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.lineage import chain_anchor
from lodestream.operators.stabbing import covering

FOREVER = (1 << 63) - 1


def close_bindings(df: DataFrame, attributes: list[str], idle_ns: int, grant: str | None = None) -> DataFrame:
    """Observations (entity, t, seq, attributes) to intervals: entity, attributes, start_ns, end_ns, observations, reason.

    A change of an attribute starts a new interval at that instant (displaced, or conflict if at the same instant), as
    does a silence of more than idle_ns (idle_timeout). An interval ends one tick after its last sighting, or at the
    grant's end if there is one, but no later than the next one's start; the last one is open.
    """
    w = Window.partitionBy("entity").orderBy("t", "seq")
    changed = F.lit(False)
    for a in attributes:
        changed = changed | ~F.col(a).eqNullSafe(F.lag(a).over(w))
    out = df.withColumns({"_first": F.lag("t").over(w).isNull(), "_idle": F.coalesce(F.col("t") - F.lag("t").over(w) > idle_ns, F.lit(False)), "_moved": changed})
    out = out.withColumn("_new", (F.col("_first") | F.col("_idle") | F.col("_moved")).cast("long"))
    out = out.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.max(grant).alias("_grant")] if grant else []
    runs = out.groupBy("entity", "_run").agg(*(F.first(a).alias(a) for a in attributes), F.min("t").alias("start_ns"), F.max("t").alias("_seen"), F.count("*").alias("observations"), F.max(F.col("_idle") & (F.col("_new") == 1)).alias("_by_idle"), *ends)
    nxt = Window.partitionBy("entity").orderBy("_run")
    follows, by_idle = F.lead("start_ns").over(nxt), F.lead("_by_idle").over(nxt)
    end = F.col("_seen") + 1
    if grant:
        end = F.greatest(end, F.coalesce("_grant", end))
    reason = F.when(follows.isNull(), "open").when(by_idle, "idle_timeout").when(follows == F.col("_seen"), "conflict").otherwise("displaced")
    out = runs.withColumns({"reason": reason, "_next": follows})
    end = F.when(F.col("_next").isNull() | (F.col("_next") == F.col("_seen")), end).otherwise(F.least(end, F.col("_next")))
    return out.withColumn("end_ns", F.greatest(end, F.col("start_ns") + 1)).select("entity", *attributes, "start_ns", "end_ns", "observations", "reason")


def bucketed(bindings: DataFrame, bucket_ns: int, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """One row a (binding, time bucket) that it touches."""
    first, last = F.floor(F.col(start) / bucket_ns).cast("long"), F.floor((F.col(end) - 1) / bucket_ns).cast("long")
    return bindings.withColumn("bucket", F.explode(F.sequence(first, last)))


def bucket_winners(bindings: DataFrame, key: str, bucket_ns: int) -> DataFrame:
    """One row a (key, bucket): the binding that starts last in it, then ends last."""
    order = Window.partitionBy(key, "bucket").orderBy(F.desc("start_ns"), F.desc("end_ns"))
    return bucketed(bindings, bucket_ns).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def resolve(df: DataFrame, bindings: DataFrame, key: str, values: list[str], bucket_ns: int, method: str) -> DataFrame:
    """df with the values of the binding that covers (key, t), null if none does, and resolution_method: soft:<method>
    or unresolved. Rows are kept once each; of covering bindings the greatest (start, end) wins. Needs a unique seq."""
    cut = bucketed(bindings, bucket_ns).select(F.col(key).alias("_k"), "bucket", "start_ns", "end_ns", *(F.col(v).alias(f"_v_{v}") for v in values))
    own = df.withColumn("bucket", F.floor(F.col("t") / bucket_ns).cast("long"))
    hit = own.select(F.col(key).alias("_k"), "bucket", "t", "seq").join(cut, ["_k", "bucket"]).where("start_ns <= t AND t < end_ns")
    # one aggregation in place of a sort a row: the winner by (start, end)
    best = hit.groupBy("seq").agg(F.max_by(F.struct(*(F.col(f"_v_{v}").alias(v) for v in values)), F.struct("start_ns", "end_ns")).alias("_b"))
    out = own.drop("bucket").join(best, "seq", "left")
    return out.withColumns({v: F.col(f"_b.{v}") for v in values} | {"resolution_method": F.when(F.col("_b").isNotNull(), f"soft:{method}").otherwise("unresolved")}).drop("_b")


def as_of(df: DataFrame, versions: DataFrame, entity: str, values: list[str], known: Column | None = None) -> DataFrame:
    """Bitemporal point-in-time lookup.

    versions: entity, valid_from, valid_to (null: open), recorded_at, change (assert or retract), values. Of the versions
    recorded by ``known`` (the row's t unless given) that cover t, the one of highest (recorded_at, valid_from) decides; a
    retraction gives nulls. Adds the values, ctx_found and ctx_recorded_at. Needs a unique seq.

    Where rows are judged by what was recorded by their own t, a version holds from when it is both valid and recorded, and the best of
    the versions that hold is found without meeting them all. With another ``known`` versions meet the entity's rows.
    """
    if known is None:
        v = versions.select(entity, F.greatest("valid_from", "recorded_at").alias("_from"), F.coalesce("valid_to", F.lit(FOREVER)).alias("_to"), "recorded_at", "valid_from", "change", *values)
        out = covering(df, v, entity, "_from", "_to", ["recorded_at", "valid_from", "_to", "change"], ["change", "recorded_at", *values], "_b")
        told = F.coalesce(F.col("_b.change") == "assert", F.lit(False))
        return out.withColumns({x: F.when(told, F.col(f"_b.{x}")) for x in values} | {"ctx_found": told, "ctx_recorded_at": F.when(told, F.col("_b.recorded_at"))}).drop("_b")
    v = versions.select(F.col(entity).alias("_e"), "valid_from", F.coalesce("valid_to", F.lit(FOREVER)).alias("_to"), "recorded_at", "change", *(F.col(x).alias(f"_v_{x}") for x in values))
    own = df.withColumn("_known", F.col("t") if known is None else known)
    hit = own.select(F.col(entity).alias("_e"), "t", "seq", "_known").join(v, "_e").where("recorded_at <= _known AND valid_from <= t AND t < _to")
    best = hit.groupBy("seq").agg(F.max_by(F.struct("change", "recorded_at", *(F.col(f"_v_{x}").alias(x) for x in values)), F.struct("recorded_at", "valid_from", "_to", "change")).alias("_b"))
    out = own.drop("_known").join(best, "seq", "left")
    told = F.coalesce(F.col("_b.change") == "assert", F.lit(False))
    return out.withColumns({x: F.when(told, F.col(f"_b.{x}")) for x in values} | {"ctx_found": told, "ctx_recorded_at": F.when(told, F.col("_b.recorded_at"))}).drop("_b")


def host_identity(df: DataFrame, leases: DataFrame, inventory: DataFrame, address: str = "src_ip", fallback: str = "src_ip") -> DataFrame:
    """The machine behind an address at t, by two lookups in time: who leased the address, and which machine had that interface.

    leases: ip, start_ns, end_ns, mac; inventory: mac, start_ns, end_ns, hostname; null ends are open. Adds host_mac, lease_method,
    host_key, inventory_method, chain_anchor and chain_anchor_source (the machine, else the fallback). Of facts that cover an
    instant the greatest (start, end, value) wins. Needs a unique seq.
    """
    out = df
    hops = ((leases, "ip", address, "mac", "host_mac", "lease"), (inventory, "mac", "host_mac", "hostname", "host_key", "inventory"))
    for facts, key, by, value, name, method in hops:
        own = facts.select(F.col(key).alias(by), "start_ns", F.coalesce("end_ns", F.lit(FOREVER)).alias("end_ns"), value)
        out = covering(out, own, by, "start_ns", "end_ns", ["start_ns", "end_ns", value], [value], "_b")
        out = out.withColumns({name: F.col(f"_b.{value}"), f"{method}_method": F.when(F.col("_b").isNotNull(), f"soft:{method}").otherwise("unresolved")}).drop("_b")
    return chain_anchor(out, ["host_key", fallback])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Versions that turn one snapshot into the next: assert what is new or changed, retract what is gone."""
    b = before.select(key, F.struct(*values).alias("_b"))
    a = after.select(key, F.struct(*values).alias("_a"))
    both = a.join(b, key, "full")
    change = F.when(F.col("_a").isNull(), "retract").when(F.col("_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")), "assert")
    out = both.withColumn("change", change).where("change IS NOT NULL")
    return out.select(key, "change", *(F.coalesce(F.col(f"_a.{v}"), F.col(f"_b.{v}")).alias(v) for v in values))


def contradictions(versions: DataFrame, entity: str, values: list[str]) -> DataFrame:
    """Pairs of asserted versions of an entity, recorded at one time and overlapping, that say different things."""
    own = versions.where("change = 'assert'").withColumn("_to", F.coalesce("valid_to", F.lit(FOREVER))).withColumn("_v", F.struct(*values))
    l, r = own.alias("l"), own.alias("r")
    both = l.join(r, [F.col(f"l.{entity}") == F.col(f"r.{entity}"), F.col("l.recorded_at") == F.col("r.recorded_at")])
    both = both.where("l.valid_from < r._to AND r.valid_from < l._to AND (l.valid_from, l._to, to_json(l._v)) < (r.valid_from, r._to, to_json(r._v)) AND NOT l._v <=> r._v")
    return both.select(F.col(f"l.{entity}").alias(entity), F.col("l.recorded_at").alias("recorded_at"), F.col("l.valid_from").alias("left_from"), F.col("r.valid_from").alias("right_from"))


def pair_sessions(df: DataFrame, begin: Column, finish: Column, timeout_ns: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a finish: attempts (starts since the last finish, while none timed out), start_t (the latest start),
    elapsed_ns and unpaired; and one row a start that nothing followed within timeout_ns: abandoned. Columns to carry are those of the row."""
    w = Window.partitionBy("entity").orderBy("t", "seq")
    out = df.withColumns({"_b": begin, "_f": finish})
    out = out.withColumn("_run", F.coalesce(F.sum(F.col("_f").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy("entity", "_run").orderBy("t", "seq")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"start_t": F.last(F.when(F.col("_b"), F.col("t")), ignorenulls=True).over(before), "attempts": F.coalesce(F.sum(F.col("_b").cast("long")).over(before), F.lit(0)), "_next": F.lead("t").over(Window.partitionBy("entity").orderBy("t", "seq"))})
    fresh = F.col("t") - F.col("start_t") <= timeout_ns
    ended = out.where("_f").select("entity", *carry, "t", "seq", F.when(fresh, F.col("start_t")).alias("start_t"), F.when(fresh, F.col("attempts")).otherwise(0).alias("attempts"), F.when(fresh, F.col("t") - F.col("start_t")).alias("elapsed_ns"), F.when(fresh, "paired").otherwise("unpaired").alias("outcome"))
    # the next marked row, in one pass: a frame that ends with the partition would be gone through for each row
    later = F.expr("lead(CASE WHEN _f OR _b THEN t END, 1) IGNORE NULLS OVER (PARTITION BY entity ORDER BY t, seq)")
    left = out.withColumn("_later", later).where(F.col("_b") & (F.col("_later").isNull() | (F.col("_later") - F.col("t") > timeout_ns)))
    return ended.unionByName(left.select("entity", *carry, "t", "seq", F.col("t").alias("start_t"), F.lit(1).cast("long").alias("attempts"), F.lit(None).cast("long").alias("elapsed_ns"), F.lit("abandoned").alias("outcome")))
