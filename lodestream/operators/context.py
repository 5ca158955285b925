"""Context: source records as versions of facts, and the set of memberships that hold at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.identity import SEPARATOR, compose_key, event_uid, normalize_text
from lodestream.operators.stabbing import covering, covering_all
from lodestream.session import written

FOREVER = (1 << 63) - 1
#: What a source may say of a fact: fixed values.
CHANGES = ("assert", "retract")


def context_columns(df: DataFrame, kind: Column, entity: Column, key_parts: list[Column], values: dict[str, Column], valid_from: Column, valid_to: Column, recorded_at: Column, change: Column | None = None) -> DataFrame:
    """Every row as a version, or with the reason why it is none: context_kind, context_entity, context_key, context_attributes, context_uid,
    context_refused, valid_from, valid_to, recorded_at, change, and the values as text.

    Times are nanoseconds. Reasons, the first that holds: no_entity, no_valid_from, no_recorded_at, inverted_interval, unknown_change. A refused row has
    its entity but neither key nor uid. Without a change a row asserts.
    """
    who, said = normalize_text(entity), F.coalesce(F.lower(normalize_text(change)) if change is not None else F.lit(None), F.lit("assert"))
    start, end, at = valid_from.cast("long"), valid_to.cast("long"), recorded_at.cast("long")
    own = df.select(kind.alias("context_kind"), who.alias("context_entity"), compose_key(who, *(p.cast("string") for p in key_parts), sep=SEPARATOR).alias("_key"), start.alias("valid_from"), end.alias("valid_to"), at.alias("recorded_at"), said.alias("change"), *(normalize_text(v.cast("string")).alias(n) for n, v in values.items()))
    reason = (
        F.when(F.col("context_entity").isNull() | F.col("_key").isNull(), "no_entity").when(F.col("valid_from").isNull(), "no_valid_from").when(F.col("recorded_at").isNull(), "no_recorded_at")
        .when(F.col("valid_to") <= F.col("valid_from"), "inverted_interval").when(~F.col("change").isin(*CHANGES), "unknown_change")
    )
    told = ["context_kind", "_key", "valid_from", "valid_to", "recorded_at", "change", *values]
    out = own.withColumns({"context_refused": reason, "context_attributes": F.lit(",".join(sorted(values)) or None).cast("string")})
    fine = F.col("context_refused").isNull()
    out = out.withColumns({"context_key": F.when(fine, F.col("_key")), "context_uid": F.when(fine, event_uid(*(F.col(c).cast("string") for c in told)))})
    return out.select("context_kind", "context_entity", "context_key", "context_attributes", "context_uid", "context_refused", "valid_from", "valid_to", "recorded_at", "change", *values)


def memberships(df: DataFrame, versions: DataFrame, entity: str, member: str, name: str) -> DataFrame:
    """df with ``name``: the members that the row's entity holds at t, by what had been recorded by then, sorted and joined by ``;``; empty without one.

    versions: entity, member, valid_from, valid_to, recorded_at, change. A member's state changes only where one of its versions begins or
    ends to hold; there the version recorded last decides. Between changes it is a run, and a row gathers the runs that are open at its t. A
    membership that is retracted later is still held by rows before the retraction was recorded. Needs a unique seq.
    """
    v = versions.where(F.col(entity).isNotNull() & F.col(member).isNotNull()).select(F.struct(F.col(entity).alias("e"), F.col(member).cast("string").alias("m")).alias("_k"), F.greatest("valid_from", "recorded_at").alias("_from"), F.coalesce("valid_to", F.lit(FOREVER)).alias("_to"), "recorded_at", "valid_from", "change")
    # written once: what follows reads versions several times, and what makes records into versions is dear
    v = written(v.withColumn("_k", F.to_json("_k")), "versions")
    points = v.where("_from < _to").select("_k", F.explode(F.array("_from", "_to")).alias("t")).distinct().withColumn("seq", F.struct("_k", "t"))
    states = covering(points, v, "_k", "_from", "_to", ["recorded_at", "valid_from", "_to", "change"], ["change"], "_s")
    runs = states.withColumn("_until", F.coalesce(F.lead("t").over(Window.partitionBy("_k").orderBy("t")), F.lit(FOREVER))).where("_s.change = 'assert'")
    runs = written(runs.select(F.get_json_object("_k", "$.e").alias("_e"), F.get_json_object("_k", "$.m").alias("_m"), F.col("t").alias("_from"), "_until"), "memberships")
    own = df.withColumn("_e", F.col(entity).cast("string"))
    out = covering_all(own, runs, "_e", "_from", "_until", "_m", "_held")
    return out.withColumn(name, F.coalesce(F.array_join("_held", ";"), F.lit(""))).drop("_held", "_e")
