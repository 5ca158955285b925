"""The scheduled searches over scored events: single-signal detections, evidence, health, keyed tables and chains.

A ``Search`` is data: which rows, an optional first-match lookup, an optional aggregation by key (rows with a null key
are left out), a condition on its result and the risk it raises. ``detect`` states it with the DataFrame API; one filter
reaches the scan and one shuffle on the search's own key follows, with partial aggregation before it. Its terms are SQL
that both engines read, with ``values(x)`` for the sorted different values of x and ``latest(x)`` for the last one.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.plans import searches
from lodestream.sources.sinks import KeyedTable

FIVE_MINUTES, DAY = 300_000_000_000, 86_400_000_000_000
SLACK = 120_000_000_000  # what a step may come too early, as clocks differ


@dataclass(frozen=True)
class Search:
    """where, then lookup, by, out, having; rule, score and entity are null for searches that raise no risk."""

    name: str
    where: str
    out: dict[str, str]
    by: tuple[str, ...] = ()
    having: str = "true"
    rule: str | None = None
    score: str = "0"
    entity: str = "NULL"
    lookup: tuple[str, str] | None = None  # (table, key)
    evals: dict[str, str] = field(default_factory=dict)  # columns of the result, from those before

    @property
    def layer(self) -> int:
        return int(found[1]) if self.rule and (found := re.search(r"-L(\d)-", self.rule)) else 0

    @property
    def thresholds_hash(self) -> str:
        """Names the conditions that raised a risk."""
        return hashlib.sha256(f"{self.where}|{self.having}".encode()).hexdigest()[:16]


def spark_terms(sql: str) -> str:
    sql = re.sub(r"values\((.*?)\)", r"array_join(array_sort(collect_set(cast(\1 as string))), ';')", sql)
    return re.sub(r"latest\((.*?)\)", r"max_by(\1, seq)", sql)


def detect(df: DataFrame, search: Search, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows that the search finds."""
    out = df.where(search.where)
    if search.lookup:
        table, key = search.lookup
        names = [c for c in tables[table].columns if c != key]
        out = searches.lookup(out, tables[table], key, names)
    shown = [F.expr(spark_terms(e)).alias(n) for n, e in search.out.items()]
    if search.by:
        out = searches.stats(out, list(search.by), **dict(zip(search.out, shown, strict=True)))
    else:
        out = out.where(search.having).select(*shown, F.expr(search.entity).alias("_entity"))
    for name, e in search.evals.items():
        out = out.withColumn(name, F.expr(e))
    if search.by:
        out = out.where(search.having)
    if search.rule:
        entity = F.expr(search.entity if search.by else "_entity").cast("string").alias("entity_key")
        out = out.select("*", F.lit(search.rule).alias("rule_id"), F.expr(search.score).cast("double").alias("risk_score"), F.lit(search.layer).alias("osi_layer"), entity, F.lit(search.thresholds_hash).alias("thresholds_hash"))
    return out.drop("_entity")


def _rule(rule: str, score: str, where: str, entity: str, **more) -> Search:  # noqa: ANN003
    out = more.pop("out", {"seq": "seq", "t": "t"})
    by = more.pop("by", ())
    if by and "t" not in out:
        out = {"t": "min(t)"} | out
    return Search(rule.lower().replace("-", "_"), where, out, by, rule=rule, score=score, entity=entity, **more)


#: Which signals raise which rule, with its thresholds and scores. Rules of other shapes stand in rule_searches.
RULES = (
    _rule("R-D-L1-001", "65", "osi_layer = 1 AND transceiver_serial_changed AND link_flaps = 0 AND oper_status <> 'down'", "entity"),
    _rule("R-D-L1-003", "30", "osi_layer = 1 AND flaps_in_window >= 10 AND NOT device_reset", "port_key", by=("port_key",), out={"transitions_in_hour": "max(flaps_in_window)", "transitions": "sum(link_flaps)"}),
    _rule("R-B-L1-005", "25", "osi_layer = 1 AND baseline_mature AND step > 0.1", "port_key", by=("port_key",), out={"errors_per_second": "max(rate)", "baseline": "max(baseline_max)", "peak_step": "max(step)"}),
    _rule("R-D-L1-006", "40", "osi_layer = 1 AND neighbor_changed AND first_seen AND neighbor IS NOT NULL", "port_key", out={"seq": "seq", "t": "t", "neighbor": "neighbor"}),
    _rule("R-B-L1-007", "30", "osi_layer = 1 AND baseline_mature AND (rate > 2 * baseline_max OR (baseline_min > 0 AND rate < 0.1 * baseline_min))", "port_key", by=("port_key",), out={"directions": "values(CASE WHEN rate > baseline_max THEN 'surge' ELSE 'silence' END)", "bits": "max(rate)"}),
    _rule("R-D-L1-008", "50", "osi_layer = 1 AND config_changed AND NOT change_in_window", "device_key"),
    _rule("R-P-L1-009", "60", "osi_layer = 1 AND baseline_mature AND rising >= 3", "device_key"),
    _rule("R-D-L2-004", "60", "osi_layer = 2 AND bind_end_reason IN ('conflict', 'displaced') AND bind_gap_ns <= 60000000000", "mac", out={"seq": "seq", "t": "t", "gap_seconds": "bind_gap_ns / 1000000000"}),
    _rule("R-D-L2-005", "50", "osi_layer = 2 AND auth_unpaired", "port_key"),
    _rule("R-D-L2-001", "40", "osi_layer = 2 AND first_in_window", "port_key", out={"seq": "seq", "t": "t", "port_key": "port_key", "macs": "distinct_n"}, lookup=("port_designations", "port_key"), having="designation = 'single-host' AND distinct_n > coalesce(max_macs, 1)"),
    _rule("R-B-L2-002", "35", "osi_layer = 2 AND first_in_window AND step > 0", "port_key", by=("port_key", "designation"), out={"macs_in_window": "max(distinct_n)", "baseline": "max(baseline_max)"}, lookup=("port_designations", "port_key"), having="NOT (designation = 'trunk' OR designation = 'lag-member')"),
    _rule("R-D-L2-003", "55", "osi_layer = 2 AND claimants > 1 AND NOT excluded", "src_ip", by=("src_ip",), out={"most_claimants": "max(claimants)", "claimant_macs": "values(mac)"}),
    _rule("R-B-L2-007", "20", "osi_layer = 2 AND ratio >= 2 AND attempts >= 3", "port_key"),
    _rule("R-B-L2-008", "30", "osi_layer = 2 AND ratio <= 0.1", "port_key"),
    _rule("R-B-L3-002", "60", "osi_layer = 3 AND baseline_mature AND interval_cv < 0.15 AND size_cv < 0.15", "sources", by=("pair_key",), out={"least_interval_cv": "min(interval_cv)", "least_size_cv": "min(size_cv)", "sources": "values(src_ip)"}),
    _rule("R-D-L3-003", "30", "osi_layer = 3 AND (dst_reserved OR dst_multicast)", "src_ip", out={"seq": "seq", "t": "t", "src_ip": "src_ip", "destination_class": "CASE WHEN dst_reserved THEN 'reserved' ELSE 'multicast' END"}),
    _rule("R-B-L3-004", "45", "osi_layer = 3 AND ttl_shifted AND baseline_mature", "src_ip", by=("src_ip",), out={"shifted_flows": "count(*)", "shifts": "values(ttl_shift)"}, having="shifted_flows >= 3"),
    _rule("R-B-L3-006", "50", "osi_layer = 3 AND role = 'workstation' AND baseline_mature AND step > 0 AND distinct_n >= 10", "dst_ip", by=("dst_ip",), out={"distinct_sources": "max(distinct_n)", "sources": "values(src_ip)"}),
    _rule("R-B-L3-007", "55", "osi_layer = 3 AND first_seen AND baseline_mature AND step > 0 AND rate >= 10", "src_ip", by=("src_ip", "asn"), out={"asymmetry": "max(rate)", "destinations": "values(dst_ip)"}),
    _rule("R-D-L3-008", "40", "osi_layer = 3 AND distinct_n >= 25 AND dst_private", "src_ip", by=("src_ip",), out={"distinct_ports": "max(distinct_n)", "hosts": "count(DISTINCT dst_ip)"}),
    _rule("R-D-L6-002", "60", "osi_layer = 6 AND issuer_differs AND baseline_mature AND issuer_distinct = 1", "pair_key", by=("pair_key",), out={"presented": "values(issuer)", "sources": "values(src_ip)"}),
    _rule("R-D-L6-003", "50", "osi_layer = 6 AND self_signed_external", "dst_ip", by=("dst_ip",), out={"connections": "count(*)", "shortest_validity_days": "min(validity_days)", "issuers": "values(issuer)"}),
    _rule("R-B-L6-004", "65", "osi_layer = 6 AND cipher_downgraded AND baseline_mature", "src_ip", by=("pair_key", "src_ip", "dst_ip"), out={"handshakes": "count(*)", "tiers": "values(cipher_tier)"}),
    _rule("R-B-L7-001", "60", "osi_layer = 7 AND label_entropy > 4.0 AND label_length > 30 AND (NOT baseline_mature OR ratio >= 2)", "src_ip", by=("src_ip", "domain"), out={"subdomains": "count(DISTINCT subdomain)", "times_busiest_day": "max(ratio)"}, having="subdomains >= 2"),
    _rule("R-B-L7-003", "50", "osi_layer = 7 AND length(labels) > 0", "src_ip", out={"seq": "seq", "t": "t", "src_ip": "src_ip", "labels": "labels"}),
    _rule("R-D-L7-005", "45", "osi_layer = 7 AND distinct_paths > 200 AND (NOT baseline_mature OR ratio >= 2) AND refused > 0.7 * served", "src_ip", by=("src_ip",), out={"paths": "max(distinct_paths)", "refusals": "max(refused)"}),
    _rule("R-B-L7-008", "55", "osi_layer = 7 AND distinct_n > 50 AND share > 0.5 AND (NOT baseline_mature OR ratio >= 2)", "src_ip", by=("src_ip",), out={"domains": "max(distinct_n)", "nxdomain_share": "max(share)"}),
    _rule("R-B-L7-002", "CASE classification WHEN 'restricted' THEN 75 WHEN 'confidential' THEN 60 WHEN 'internal' THEN 40 WHEN 'public' THEN 20 ELSE 50 END", "osi_layer = 7 AND baseline_mature AND ratio > 5", "principal", out={"seq": "seq", "t": "t", "principal": "principal", "classification": "coalesce(classification, 'unclassified')"}),
    _rule("R-D-L5-003", "70", "osi_layer = 5 AND travel_status = 'measured' AND kmh >= 900", "principal", out={"seq": "seq", "t": "t", "principal": "principal", "elapsed_seconds": "elapsed_ns / 1000000000"}),
    _rule("R-D-L5-004", "75", "osi_layer = 5 AND denied_then_approved AND attempts > 5 AND denials >= 4", "principal"),
    _rule("R-D-L5-007", "40", "osi_layer = 5 AND hour_unseen AND baseline_mature AND auth_result = 'success'", "principal"),
    _rule("R-D-L5-008", "45", "osi_layer = 5 AND auth_result = 'success' AND baseline_mature AND (first_seen OR device_first_seen)", "principal"),
    _rule("R-D-L5-009", "50", "osi_layer = 5 AND failed_then_succeeded AND failures >= 3", "principal"),
    _rule("R-B-L5-001", "80", "osi_layer = 5 AND NOT fallback AND max_abs_z >= 6.0 AND mean_abs_z >= 2.0", "principal"),
    _rule("R-B-L5-002", "55", "osi_layer = 5 AND NOT fallback AND z_loss >= 4.0", "principal"),
    _rule("R-B-L5-005", "CASE privilege WHEN 'admin' THEN 70 WHEN 'elevated' THEN 55 ELSE 40 END", "osi_layer = 5 AND baseline_mature AND coalesce(account_type, 'unknown') <> 'service' AND ratio > 1.0", "principal", out={"seq": "seq", "t": "t", "principal": "principal", "privilege": "privilege"}),
)
_DRIFT = "baseline_mature AND rising >= 4 AND rise_sigmas > 1.5"
#: Rules over drift put their entity on a watchlist, once a window.
DRIFT_RULES = tuple(
    _rule(rule, "20", f"{where} AND {_DRIFT}", entity, by=(entity, "day_id"), out={"rising_windows": "max(rising)", "rise": "max(rise_sigmas)"}, evals={"reason": f"'{reason}'", "expires": "t + 2592000000000000", "list_key": f"concat(cast({entity} as string), '|{rule}')"})
    for rule, where, entity, reason in (
        ("R-P-L3-009", "osi_layer = 3", "host_key", "host-drift-trajectory"), ("R-P-L6-006", "osi_layer = 6", "src_ip", "client-stack-trajectory"),
        ("R-P-L7-009", "osi_layer = 7 AND domain IS NOT NULL", "src_ip", "subdomain-count-trajectory"), ("R-P-L7-010", "osi_layer = 7 AND distinct_paths IS NOT NULL", "src_ip", "path-count-trajectory"),
        ("R-P-L7-011", "osi_layer = 7 AND pair_key IS NOT NULL", "host_key", "process-breadth-trajectory"), ("R-P-L5-006", "osi_layer = 5 AND mean_abs_z < 2.0 AND abs(acceleration) < 0.1", "principal", "drift-trajectory"),
    )
)
#: Evidence and health: searches that show and raise nothing.
REPORTS = (
    Search("device_restart", "osi_layer = 1 AND (rebooted OR counter_reset OR device_reset)", {"t": "min(t)", "device_restarts": "sum(CASE WHEN rebooted THEN 1 ELSE 0 END)", "ports": "count(DISTINCT port_key)"}, ("device_key",)),
    Search("connection_evidence", "osi_layer IN (3, 4, 6) AND community IS NOT NULL", {"layers": "count(DISTINCT osi_layer)", "sources": "values(src_ip)", "bytes_out": "max(rate)", "first_t": "min(t)"}, ("community",), "layers = 3"),
    Search("host_evidence", "osi_layer IN (3, 4, 6, 7)", {"layers": "count(DISTINCT osi_layer)", "layer_list": "values(osi_layer)", "macs": "values(mac)", "first_t": "min(t)", "last_t": "max(t)"}, ("host_key",), "layers >= 2"),
    Search("tls_table_coverage", "osi_layer = 6", {"handshakes": "count(*)", "unrecognized": "sum(CASE WHEN cipher_tier IS NULL THEN 1 ELSE 0 END)", "unclassified": "sum(CASE WHEN category IS NULL THEN 1 ELSE 0 END)"}, ("osi_layer",)),
    Search("binding_health", "resolution IS NOT NULL", {"total": "count(*)", "unresolved": "sum(CASE WHEN resolution = 'unresolved' THEN 1 ELSE 0 END)"}, ("osi_layer",), evals={"unresolved_rate": "round(unresolved / total, 3)", "degraded": "round(unresolved / total, 3) > 0.2"}),
    Search("refusal_rate", "true", {"delivered": "sum(CASE WHEN quarantined THEN 0 ELSE 1 END)", "held": "sum(CASE WHEN quarantined THEN 1 ELSE 0 END)", "clock_refused": "sum(refused_clock)", "invalid": "sum(envelope_invalid)"}, ("collector",), "refusal_rate > 0 OR invalid > 0", evals={"refusal_rate": "round((held + clock_refused) / (delivered + held), 3)"}),
    Search("collector_health", "true", {"rows_seen": "count(*)", "gaps": "sum(seq_gap)", "regressed": "sum(seq_regressed)", "least_offset": "min(offset_ms)", "most_offset": "max(offset_ms)", "most_lag": "max(lag_seconds)"}, ("collector",), "gaps > 0 OR regressed > 0 OR worst_offset_ms > 1000 OR most_lag > 300", evals={"worst_offset_ms": "greatest(abs(least_offset), abs(most_offset))"}),
    Search("stage_counts", "true", {"rows_seen": "count(*)", "keyless": "sum(CASE WHEN community IS NULL THEN 1 ELSE 0 END)", "unpaired": "sum(CASE WHEN auth_unpaired THEN 1 ELSE 0 END)", "offset_median": "median(offset_ms)"}, ("collector", "osi_layer"), "keyless > 0 OR unpaired > 0"),
    Search("late_arrivals", "late", {"late_rows": "count(*)", "windows": "count(DISTINCT window_id)"}, ("osi_layer", "collector")),
    Search("behavior_summary", "true", {"peak_z": "max(max_abs_z)", "peak_destinations": "max(distinct_n)", "event_count": "count(DISTINCT seq)"}, ("window_id", "osi_layer", "entity", "lineage")),
)
SEARCHES = (*RULES, *DRIFT_RULES, *REPORTS)


@dataclass(frozen=True)
class Table:
    """A keyed lookup table kept by a refresh and an expiry: the last row of a key stays; a key's bucket dates it."""

    name: str
    where: str
    key: tuple[str, ...]
    bucket_ns: int | None
    columns: tuple[str, ...]


#: The lookup tables, what they are keyed by and how finely.
TABLES = (
    Table("binding_l2_l3", "osi_layer = 3", ("src_ip",), FIVE_MINUTES, ("mac",)),
    Table("binding_l2", "osi_layer = 2", ("mac",), FIVE_MINUTES, ("port_key",)),
    Table("binding_l5_l2", "osi_layer = 5", ("principal",), FIVE_MINUTES, ("port_key",)),
    Table("binding_l1", "osi_layer = 1", ("port_key", "device_key"), None, ("neighbor",)),
    Table("binding_l1_history", "osi_layer = 1", ("port_key", "device_key"), DAY, ("neighbor",)),
    Table("principal_watchlist", "osi_layer = 5 AND rising >= 4", ("principal",), None, ("rising",)),
    Table("host_watchlist", "osi_layer = 3 AND rising >= 4", ("host_key",), None, ("rising",)),
)
KEPT_NS = 400 * DAY  # bindings are kept so long
LISTED_NS = 30 * DAY  # watchlist entries


def refresh(df: DataFrame, table: Table) -> DataFrame:
    """_key, bucket, t, seq and the table's columns: rows to merge, the last one of each key."""
    bucket = F.floor(F.col("t") / F.lit(table.bucket_ns)).cast("long") if table.bucket_ns else F.lit(0).cast("long")
    rows = df.where(table.where).na.drop(subset=list(table.key)).withColumn("bucket", bucket)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in table.key], *([F.col("bucket").cast("string")] if table.bucket_ns else []))
    names = [*table.key, "bucket", "t", "seq", *table.columns]
    return rows.withColumn("_key", key).groupBy("_key").agg(F.max_by(F.struct(*names), "seq").alias("m")).select("_key", "m.*")


def maintain(kept: KeyedTable, rows: DataFrame, table: Table) -> DataFrame:
    """A scheduled refresh: the rows since the last one go into the keyed table, the newest of each key stays."""
    return kept.merge(refresh(rows, table))


def expire(kept: KeyedTable, now_ns: int, listed: bool) -> DataFrame:
    """A scheduled expiry: what is older than the table keeps is deleted from it."""
    return kept.delete(F.col("t") + (LISTED_NS if listed else KEPT_NS) < now_ns)


def adjacency(df: DataFrame, known: DataFrame) -> DataFrame:
    """Links seen between neighbours, merged with those known: first and last time, and where the link was last."""
    seen = searches.stats(df.where("osi_layer = 1"), ["neighbor", "port_key"], first_seen=F.min("t"), last_seen=F.max("t"), device_key=F.max_by("device_key", "seq"))
    both = seen.unionByName(known)
    return both.groupBy("neighbor", "port_key").agg(F.min("first_seen").alias("first_seen"), F.max_by("device_key", "last_seen").alias("device_key"), F.max("last_seen").alias("last_seen"))


def chain_of_layers(df: DataFrame, risks: DataFrame) -> DataFrame:
    """Lineages that reach three layers or more with risk enough, or four with a high score."""
    layers = df.groupBy("lineage").agg(F.countDistinct("osi_layer").alias("layer_span"), F.min("t").alias("chain_start"), F.max("t").alias("chain_end"), F.max("max_abs_z").alias("peak_z"), searches.values("resolution").alias("methods"))
    risk = risks.groupBy("lineage").agg(F.sum("risk_score").alias("total_risk"), searches.values("rule_id").alias("rules"))
    both = layers.where("layer_span >= 3").join(risk, "lineage", "left")
    return both.where("total_risk >= 60 OR (layer_span >= 4 AND peak_z >= 4.0)").withColumn("chain_duration", F.col("chain_end") - F.col("chain_start"))


def steps(first: DataFrame, then: list[tuple[DataFrame, str, int]], keep: list[str]) -> DataFrame:
    """Chains: each next step shares a key with the row so far, comes SLACK before the step before at the earliest, and
    within its time of the first. Rows so far are one a (kept columns) with the least times. A row meets the kept columns that a step brings
    in its (key, time bucket) once each, and of each its earliest time from the least one allowed on, which is read from the running last
    one backwards in time: a busy key's rows are sorted, and never paired.

    first has t0 and the columns kept; each step's frame has the key, t and may add columns of ``keep``.
    """
    out = first.withColumn("t_last", F.col("t0"))
    for k, (frame, key, within) in enumerate(then, 1):
        own = out.withColumn("_b", F.explode(F.expr(f"sequence(cast(floor((t_last - {SLACK}) / {within}) as bigint), cast(floor((t0 + {within}) / {within}) as bigint))")))
        new = frame.withColumnRenamed("t", f"t{k}").withColumn("_b", F.floor(F.col(f"t{k}") / F.lit(within)).cast("long"))
        brought = [c for c in frame.columns if c in keep and c != key]
        own = own.join(new.select(key, "_b", *brought).distinct(), [key, "_b"]).withColumns({"_at": F.col("t_last") - SLACK, "_asked": F.lit(True)})
        own = own.unionByName(new.where(F.col(key).isNotNull()).select(key, "_b", *brought, f"t{k}", F.col(f"t{k}").alias("_at"), F.lit(False).alias("_asked")), allowMissingColumns=True)
        back = Window.partitionBy(key, "_b", *brought).orderBy(F.desc("_at"), "_asked").rowsBetween(Window.unboundedPreceding, 0)
        own = own.withColumn(f"t{k}", F.last(f"t{k}", ignorenulls=True).over(back)).where(F.expr(f"_asked AND t{k} - t0 <= {within}"))
        names = [c for c in keep if c in own.columns]
        times = [F.min(f"t{i}").alias(f"t{i}") for i in range(1, k + 1)]
        out = own.groupBy(*names, "t0").agg(*times).withColumn("t_last", F.col(f"t{k}"))
    return out.drop("t_last")
