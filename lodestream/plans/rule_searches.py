"""Searches whose shape is their own: two aggregations, directions, weights and lookups, over the columns that the stages emit.

Each is a function over a scored frame and the lookup tables it names; its SQL beside it is written by hand. Rows of windows that
are still open raise nothing. A risk carries its events, its lineages and the thresholds in force, which are looked up by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.plans.catalog import QUERIES, SQL, E, Query
from lodestream.plans.scored_feed import SCORED_ALL, scored
from lodestream.plans.searches import lookup, stats, values

#: Watchlist entries of a rule that lists its entity end after so many ns.
LISTED_NS = 30 * 86_400_000_000_000

#: SQL for both engines: the stages' columns that these searches look at, after the scored feed's.
SIGNALS = {
    "window_complete": "seq % 11 > 0", "event_uid": "'e' || cast(seq AS string)", "lineage_id": "'l' || cast(lineage AS string)", "rollup_time_ns": "day_id",
    "entity_key": "port_key", "optical_rx_dbm_forecast_status": "forecast_status", "optical_rx_dbm_days_to_floor": "days_to_floor", "optical_rx_dbm": "rx_dbm", "optical_rx_dbm_deviation": "rx_deviation", "optical_tx_dbm_deviation": "tx_deviation",
    "optical_rx_dbm_baseline_samples": "baseline_samples", "ctx_port_found": "ctx_found", "ctx_port_commissioning_rx_dbm": "cast(commissioning_rx AS string)", "vlan_key": "vlan", "mac_address": "'AA:bb:0' || oui || ':' || mac",
    "ouis_per_vlan": "distinct_n", "ouis_per_vlan_first_in_window": "first_in_window", "ouis_per_vlan_baseline_mature": "baseline_mature", "ouis_per_vlan_step": "step", "ouis_per_vlan_baseline_max": "baseline_max",
    "dsts_per_src": "distinct_n", "dsts_per_src_baseline_mature": "baseline_mature", "dsts_per_src_step": "step", "dsts_per_src_baseline_max": "baseline_max", "internal_dst_ratio": "share",
    "flow_data_len": "rate", "flow_data_len_envelope": "baseline_max", "flow_data_len_envelope_breached": "volume_breached", "flow_bpp_envelope_breached": "shape_breached", "transfer_triple": "src_ip || '|' || dst_ip || '|' || cast(dst_port % 3 AS string)",
    "ja4_client": "ja4", "ja4_client_first_seen": "first_seen", "ja4_client_observations": "observations", "ctx_criticality": "criticality", "content_category_crossed": "category_crossed", "content_category_declared": "category",
    "service_clients_baseline_mature": "baseline_mature", "service_clients_in_window": "distinct_n", "service_clients_ratio": "ratio", "service_clients_baseline": "baseline_max", "service_client_fingerprint_first_seen": "first_seen",
    "user_principal": "principal", "saas_object_types_in_week": "object_types", "drift_rising_windows": "rising", "ctx_groups": "CASE WHEN entity % 3 = 0 THEN role END", "week_window_id": "day_id", "endpoint_pair_novel": "pair_novel", "endpoint_integrity": "integrity", "endpoint_host": "host_key",
}
OWN = ("seq", "t", "osi_layer", "src_ip", "dst_ip", "dst_port", "port_key", "transceiver_serial_changed", "flow_id", "flow_syn", "flow_ack", "flow_rst", "flow_all", "service_key")
W = f"WITH {E}, {SCORED_ALL}, s AS (SELECT {', '.join(OWN)}, {', '.join(f'{e} AS {n}' for n, e in SIGNALS.items())} FROM scored WHERE seq % 11 > 0), m AS (SELECT rule_id, substr(sha256(rule_id), 1, 16) AS thresholds_hash FROM (SELECT unnest(RULES) AS rule_id))"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).selectExpr(*OWN, *(f"{e} AS {n}" for n, e in SIGNALS.items()))


def latest(c: str) -> Column:
    return F.max_by(c, F.struct("t", "seq"))


def _told() -> dict[str, Column]:
    """What every risk carries of the events behind it."""
    return {"t": F.min("t"), "event_uids": values("event_uid"), "lineage_ids": values("lineage_id")}


def risk(df: DataFrame, rule: str, layer: int, score: Column | float, entity: str, metadata: DataFrame) -> DataFrame:
    """df with rule_id, osi_layer, risk_score, entity_key and the rule's thresholds_hash (null if the table lacks it)."""
    out = df.withColumns({"rule_id": F.lit(rule), "osi_layer": F.lit(layer), "risk_score": (F.lit(score) if isinstance(score, int | float) else score).cast("double"), "entity_key": F.col(entity).cast("string")})
    return lookup(out, metadata.where(F.col("rule_id") == rule), "rule_id", ["thresholds_hash"])


# layer 1


def optical_forecast(df: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = df.where("window_complete AND osi_layer = 1 AND optical_rx_dbm_forecast_status = 'projected' AND optical_rx_dbm_days_to_floor <= 14")
    out = stats(rows, ["entity_key"], **_told(), days_to_floor=F.min("optical_rx_dbm_days_to_floor"), optical_rx_dbm=latest("optical_rx_dbm"))
    return risk(out, "R-P-L1-004", 1, 15, "entity_key", metadata)


def optical_tap(df: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = df.where("window_complete AND osi_layer = 1 AND optical_rx_dbm_deviation <= -1.0 AND optical_rx_dbm_baseline_samples >= 10 AND NOT coalesce(transceiver_serial_changed, false) AND abs(optical_tx_dbm_deviation) < 0.5")
    out = stats(rows, ["entity_key"], **_told(), rx_deviation_db=F.min("optical_rx_dbm_deviation"), rx_dbm=latest("optical_rx_dbm"), tx_deviation_db=latest("optical_tx_dbm_deviation"))
    return risk(out, "R-D-L1-002", 1, 50, "entity_key", metadata)


def below_commissioning(df: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = df.where("window_complete AND osi_layer = 1 AND ctx_port_found AND ctx_port_commissioning_rx_dbm IS NOT NULL AND NOT coalesce(transceiver_serial_changed, false)")
    rows = rows.withColumn("below", F.round(F.expr("try_cast(ctx_port_commissioning_rx_dbm AS double)") - F.col("optical_rx_dbm"), 3)).where("below >= 1.5")
    out = stats(rows, ["entity_key"], **_told(), rx_below_commissioning_db=F.max("below"), commissioning_rx_dbm=latest("ctx_port_commissioning_rx_dbm"), rx_dbm=F.min("optical_rx_dbm"))
    return risk(out, "R-D-L1-010", 1, 30, "entity_key", metadata)


# layers 2 and 3


def new_vendor(df: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = df.where("window_complete AND osi_layer = 2 AND ouis_per_vlan_first_in_window AND ouis_per_vlan_baseline_mature AND ouis_per_vlan_step > 0").withColumn("oui", F.lower(F.substring("mac_address", 1, 8)))
    out = stats(rows, ["vlan_key"], **_told(), vendors_in_window=F.max("ouis_per_vlan"), baseline_vendors=F.max("ouis_per_vlan_baseline_max"), new_ouis=values("oui"), new_macs=values("mac_address"), port_keys=values("port_key"))
    return risk(out, "R-B-L2-006", 2, 30, "vlan_key", metadata)


def fan_out(df: DataFrame, metadata: DataFrame, allowlist: DataFrame) -> DataFrame:
    rows = df.where("window_complete AND osi_layer = 3 AND dsts_per_src_baseline_mature AND dsts_per_src_step > 0 AND dsts_per_src > 50 AND internal_dst_ratio > 0.5")
    rows = lookup(rows, allowlist, "src_ip", ["allowed"]).where("allowed IS NULL OR allowed <> 'true'")
    out = stats(rows, ["src_ip"], **_told(), distinct_destinations=F.max("dsts_per_src"), baseline_destinations=F.max("dsts_per_src_baseline_max"), step=F.max("dsts_per_src_step"), internal_ratio=F.max("internal_dst_ratio"))
    return risk(out, "R-B-L3-001", 3, 50, "src_ip", metadata)


# layer 4: by flow and rollup first, then by who did it


def half_open(df: DataFrame, metadata: DataFrame, ports: int = 50) -> DataFrame:
    """Sources whose flows of a rollup ask ``ports`` ports and more without an answer."""
    own = df.where("window_complete AND osi_layer = 4")
    flows = stats(own, ["flow_id", "rollup_time_ns", "src_ip", "dst_ip", "dst_port"], syn=F.max("flow_syn"), ack=F.max("flow_ack"), flags=F.max("flow_all"), uids=F.collect_set("event_uid"), lineages=F.collect_set("lineage_id"), t=F.min("t"))
    flows = flows.where("flags > 0 AND ack = 0 AND syn / flags >= 0.9")
    merged = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ";")
    out = stats(flows, ["src_ip", "rollup_time_ns"], destination_ports=F.countDistinct("dst_port"), destination_hosts=F.countDistinct("dst_ip"), unanswered_syns=F.sum("syn"), event_uids=merged("uids"), lineage_ids=merged("lineages"), t=F.min("t"))
    return risk(out.where(F.col("destination_ports") > ports), "R-D-L4-002", 4, 55, "src_ip", metadata)


def refused_flows(df: DataFrame, metadata: DataFrame, least: int = 10) -> DataFrame:
    """A server that refuses many clients is an outage; a client that many servers refuse, and nobody else, tries closed ports."""
    own = df.where("window_complete AND osi_layer = 4")
    flows = stats(own, ["flow_id", "rollup_time_ns", "src_ip", "dst_ip"], rst=F.max("flow_rst"), flags=F.max("flow_all"), t=F.min("t")).where("flags > 0 AND rst / flags >= 0.5")
    # counts by either side are aggregated and looked up: no window holds a busy address's flows
    refused = flows.groupBy("src_ip", "rollup_time_ns").agg(F.countDistinct("dst_ip").alias("clients_refused"))
    refusing = flows.groupBy("dst_ip", "rollup_time_ns").agg(F.countDistinct("src_ip").alias("servers_refusing"))
    flows = flows.join(refused, ["src_ip", "rollup_time_ns"]).join(refusing, ["dst_ip", "rollup_time_ns"])
    outage = (F.col("clients_refused") >= least) & (F.col("servers_refusing") == 1)
    closed = (F.col("servers_refusing") >= least) & (F.col("clients_refused") == 1)
    flows = flows.withColumn("refusal_direction", F.when(outage, "service_outage").when(closed, "closed_port_enumeration")).where("refusal_direction IS NOT NULL")
    is_outage = F.col("refusal_direction") == "service_outage"
    flows = flows.withColumns({"entity": F.when(is_outage, F.col("src_ip")).otherwise(F.col("dst_ip")), "fan": F.when(is_outage, F.col("clients_refused")).otherwise(F.col("servers_refusing"))})
    out = stats(flows, ["entity", "refusal_direction", "rollup_time_ns"], refused_flows=F.count("*"), counterparties=F.max("fan"), t=F.min("t"))
    return risk(out, "R-D-L4-003", 4, F.when(F.col("refusal_direction") == "closed_port_enumeration", 40).otherwise(10), "entity", metadata)


def transfer_breach(df: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = df.where("window_complete AND osi_layer = 4 AND (flow_data_len_envelope_breached OR flow_bpp_envelope_breached)")
    volume, shape = F.coalesce("flow_data_len_envelope_breached", F.lit(False)), F.coalesce("flow_bpp_envelope_breached", F.lit(False))
    rows = rows.withColumn("envelope", F.when(volume & shape, "volume and shape").when(volume, "volume").otherwise("shape"))
    out = stats(rows, ["transfer_triple"], **_told(), transferred=F.max("flow_data_len"), volume_envelope=F.max("flow_data_len_envelope"), breached_envelope=values("envelope"), src_ips=values("src_ip"), dst_ips=values("dst_ip"))
    return risk(out, "R-B-L4-005", 4, 65, "transfer_triple", metadata)


# layers 6 and 7


def new_client(df: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = df.where("window_complete AND osi_layer = 6 AND ja4_client_first_seen AND ja4_client_observations >= 20 AND ctx_port_found")
    out = stats(rows, ["src_ip"], **_told(), new_fingerprints=values("ja4_client"), prior_handshakes=F.max("ja4_client_observations"), criticality=values("ctx_criticality"), dst_ips=values("dst_ip"))
    return risk(out, "R-B-L6-001", 6, 55, "src_ip", metadata)


def content_mismatch(df: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = df.where("window_complete AND osi_layer = 6 AND content_category_crossed")
    out = stats(rows, ["src_ip", "dst_ip"], **_told(), transfers=F.count("*"), declared_category=values("content_category_declared"))
    return risk(out, "R-D-L6-005", 6, 55, "src_ip", metadata)


def service_clients(df: DataFrame, metadata: DataFrame) -> DataFrame:
    rows = df.where("window_complete AND osi_layer = 7 AND service_key IS NOT NULL AND service_clients_baseline_mature")
    rows = rows.withColumn("new_software", F.when(F.col("service_client_fingerprint_first_seen"), F.col("ja4_client")))
    out = stats(rows, ["service_key", "week_window_id"], **_told(), clients=F.max("service_clients_in_window"), times_busiest_day=F.max("service_clients_ratio"), busiest_day=F.max("service_clients_baseline"), new_fingerprints=F.count("new_software"), new_client_software=values("new_software"))
    return risk(out.where("clients >= 10 AND times_busiest_day >= 2 AND new_fingerprints > 0"), "R-B-L7-007", 7, 50, "service_key", metadata)


def access_breadth(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Principals of one role whose breadth rises for weeks; they go on the watchlist."""
    rows = df.where("window_complete AND osi_layer = 7 AND saas_object_types_in_week IS NOT NULL").withColumn("role", F.coalesce("ctx_groups", F.lit("none")))
    out = stats(rows, ["user_principal"], rising_weeks=F.max("drift_rising_windows"), role_versions=F.countDistinct("role"), role=values("role"), peak_object_types=F.max("saas_object_types_in_week"), weeks=values("week_window_id"), lineage_ids=values("lineage_id"), t=F.max("t"))
    out = out.where("rising_weeks >= 4 AND role_versions = 1")
    out = out.withColumns({"action": F.lit("watchlist"), "reason": F.lit("access-breadth"), "expires": F.col("t") + LISTED_NS, "list_key": F.concat("user_principal", F.lit(":R-P-L7-006"))})
    return risk(out, "R-P-L7-006", 7, 20, "user_principal", metadata)


def process_ancestry(df: DataFrame, metadata: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Integrity times criticality, and more for a host on the watchlist."""
    rows = df.where("window_complete AND osi_layer = 7 AND endpoint_pair_novel").withColumns({"integrity": F.coalesce("endpoint_integrity", F.lit("unknown")), "criticality": F.coalesce("ctx_criticality", F.lit("unknown"))})
    weight = F.expr("CASE integrity WHEN 'system' THEN 70 WHEN 'high' THEN 55 WHEN 'medium' THEN 40 WHEN 'low' THEN 25 ELSE 40 END")
    factor = F.expr("CASE criticality WHEN 'high' THEN 1.5D WHEN 'low' THEN 0.5D ELSE 1.0D END")
    rows = lookup(rows, watchlist, "endpoint_host", ["watchlist_reason"]).withColumn("on_watchlist", F.col("watchlist_reason").isNotNull().cast("int"))
    out = rows.select("seq", "t", "endpoint_host", "integrity", "criticality", "on_watchlist", "watchlist_reason", "event_uid", "lineage_id", (F.round(weight * factor) + F.col("on_watchlist") * 15).alias("weighed"))
    return risk(out, "R-B-L7-004", 7, F.col("weighed"), "endpoint_host", metadata).drop("weighed")


ALLOWLIST = "SELECT DISTINCT src_ip, 'true' AS allowed FROM s WHERE src_ip LIKE '%1'"
WATCHLIST = "SELECT DISTINCT endpoint_host, 'host-drift-trajectory' AS watchlist_reason FROM s WHERE drift_rising_windows >= 7 AND osi_layer = 3"
_v = lambda c: f"coalesce(string_agg(DISTINCT CAST({c} AS VARCHAR), ';' ORDER BY CAST({c} AS VARCHAR)), '')"
TOLD = f"min(t) AS t, {_v('event_uid')} AS event_uids, {_v('lineage_id')} AS lineage_ids"
#: For each rule: its search, the lookup table it takes, and the SQL of its result before the rule's own columns, with layer, score and entity.
RULED = {
    "R-P-L1-004": (optical_forecast, None, f"SELECT entity_key, {TOLD}, min(optical_rx_dbm_days_to_floor) AS days_to_floor, arg_max(optical_rx_dbm, (t, seq)) AS optical_rx_dbm FROM s WHERE osi_layer = 1 AND optical_rx_dbm_forecast_status = 'projected' AND optical_rx_dbm_days_to_floor <= 14 GROUP BY entity_key", 1, "15", "entity_key"),
    "R-D-L1-002": (optical_tap, None, f"SELECT entity_key, {TOLD}, min(optical_rx_dbm_deviation) AS rx_deviation_db, arg_max(optical_rx_dbm, (t, seq)) AS rx_dbm, arg_max(optical_tx_dbm_deviation, (t, seq)) AS tx_deviation_db FROM s WHERE osi_layer = 1 AND optical_rx_dbm_deviation <= -1.0 AND optical_rx_dbm_baseline_samples >= 10 AND NOT transceiver_serial_changed AND optical_tx_dbm_deviation BETWEEN -0.4999999 AND 0.4999999 GROUP BY entity_key", 1, "50", "entity_key"),
    "R-D-L1-010": (below_commissioning, None, f"SELECT entity_key, {TOLD}, max(b) AS rx_below_commissioning_db, arg_max(ctx_port_commissioning_rx_dbm, (t, seq)) AS commissioning_rx_dbm, min(optical_rx_dbm) AS rx_dbm FROM (SELECT *, round(CAST(ctx_port_commissioning_rx_dbm AS DOUBLE) - optical_rx_dbm, 3) AS b FROM s WHERE osi_layer = 1 AND ctx_port_found AND NOT transceiver_serial_changed) WHERE b >= 1.5 GROUP BY entity_key", 1, "30", "entity_key"),
    "R-B-L2-006": (new_vendor, None, f"SELECT vlan_key, {TOLD}, max(ouis_per_vlan) AS vendors_in_window, max(ouis_per_vlan_baseline_max) AS baseline_vendors, {_v('lower(substr(mac_address, 1, 8))')} AS new_ouis, {_v('mac_address')} AS new_macs, {_v('port_key')} AS port_keys FROM s WHERE osi_layer = 2 AND ouis_per_vlan_first_in_window AND ouis_per_vlan_baseline_mature AND ouis_per_vlan_step > 0 GROUP BY vlan_key", 2, "30", "vlan_key"),
    "R-B-L3-001": (fan_out, "allowlist", f"SELECT src_ip, {TOLD}, max(dsts_per_src) AS distinct_destinations, max(dsts_per_src_baseline_max) AS baseline_destinations, max(dsts_per_src_step) AS step, max(internal_dst_ratio) AS internal_ratio FROM s WHERE osi_layer = 3 AND dsts_per_src_baseline_mature AND dsts_per_src_step > 0 AND dsts_per_src > 50 AND internal_dst_ratio > 0.5 AND src_ip NOT LIKE '%1' GROUP BY src_ip", 3, "50", "src_ip"),
    "R-D-L4-002": (half_open, None, f"""SELECT src_ip, rollup_time_ns, count(DISTINCT dst_port) AS destination_ports, count(DISTINCT dst_ip) AS destination_hosts, CAST(sum(syn) AS BIGINT) AS unanswered_syns, array_to_string(list_sort(list_distinct(flatten(list(uids)))), ';') AS event_uids, array_to_string(list_sort(list_distinct(flatten(list(lins)))), ';') AS lineage_ids, min(t) AS t
        FROM (SELECT flow_id, rollup_time_ns, src_ip, dst_ip, dst_port, max(flow_syn) AS syn, list(event_uid) AS uids, list(lineage_id) AS lins, min(t) AS t FROM s WHERE osi_layer = 4 GROUP BY ALL HAVING max(flow_all) > 0 AND max(flow_ack) = 0 AND 10 * max(flow_syn) >= 9 * max(flow_all)) GROUP BY src_ip, rollup_time_ns HAVING count(DISTINCT dst_port) > PORTS""", 4, "55", "src_ip"),
    "R-D-L4-003": (refused_flows, None, """WITH f AS (SELECT flow_id, rollup_time_ns, src_ip, dst_ip, min(t) AS t FROM s WHERE osi_layer = 4 GROUP BY ALL HAVING max(flow_all) > 0 AND 2 * max(flow_rst) >= max(flow_all)),
        g AS (SELECT *, (SELECT count(DISTINCT dst_ip) FROM f b WHERE b.src_ip = f.src_ip AND b.rollup_time_ns = f.rollup_time_ns) AS c, (SELECT count(DISTINCT src_ip) FROM f b WHERE b.dst_ip = f.dst_ip AND b.rollup_time_ns = f.rollup_time_ns) AS v FROM f)
        SELECT entity, refusal_direction, rollup_time_ns, count(*) AS refused_flows, max(fan) AS counterparties, min(t) AS t FROM (SELECT src_ip AS entity, 'service_outage' AS refusal_direction, rollup_time_ns, c AS fan, t FROM g WHERE c >= LEAST AND v = 1
        UNION ALL SELECT dst_ip, 'closed_port_enumeration', rollup_time_ns, v, t FROM g WHERE v >= LEAST AND c = 1) GROUP BY ALL""", 4, "CASE refusal_direction WHEN 'closed_port_enumeration' THEN 40 ELSE 10 END", "entity"),
    "R-B-L4-005": (transfer_breach, None, f"SELECT transfer_triple, {TOLD}, max(flow_data_len) AS transferred, max(flow_data_len_envelope) AS volume_envelope, {_v('CASE WHEN NOT flow_bpp_envelope_breached THEN $$volume$$ WHEN flow_data_len_envelope_breached THEN $$volume and shape$$ ELSE $$shape$$ END')} AS breached_envelope, {_v('src_ip')} AS src_ips, {_v('dst_ip')} AS dst_ips FROM s WHERE osi_layer = 4 AND (flow_data_len_envelope_breached OR flow_bpp_envelope_breached) GROUP BY transfer_triple", 4, "65", "transfer_triple"),
    "R-B-L6-001": (new_client, None, f"SELECT src_ip, {TOLD}, {_v('ja4_client')} AS new_fingerprints, max(ja4_client_observations) AS prior_handshakes, {_v('ctx_criticality')} AS criticality, {_v('dst_ip')} AS dst_ips FROM s WHERE osi_layer = 6 AND ja4_client_first_seen AND ja4_client_observations >= 20 AND ctx_port_found GROUP BY src_ip", 6, "55", "src_ip"),
    "R-D-L6-005": (content_mismatch, None, f"SELECT src_ip, dst_ip, {TOLD}, count(*) AS transfers, {_v('content_category_declared')} AS declared_category FROM s WHERE osi_layer = 6 AND content_category_crossed GROUP BY src_ip, dst_ip", 6, "55", "src_ip"),
    "R-B-L7-007": (service_clients, None, f"SELECT service_key, week_window_id, {TOLD}, max(service_clients_in_window) AS clients, max(service_clients_ratio) AS times_busiest_day, max(service_clients_baseline) AS busiest_day, count(*) FILTER (service_client_fingerprint_first_seen) AS new_fingerprints, coalesce(string_agg(DISTINCT ja4_client, ';' ORDER BY ja4_client) FILTER (service_client_fingerprint_first_seen), '') AS new_client_software FROM s WHERE osi_layer = 7 AND service_clients_baseline_mature GROUP BY service_key, week_window_id HAVING max(service_clients_in_window) >= 10 AND max(service_clients_ratio) >= 2 AND count(*) FILTER (service_client_fingerprint_first_seen) > 0", 7, "50", "service_key"),
    "R-P-L7-006": (access_breadth, None, f"SELECT user_principal, max(drift_rising_windows) AS rising_weeks, count(DISTINCT coalesce(ctx_groups, 'none')) AS role_versions, {_v('coalesce(ctx_groups, $$none$$)')} AS role, max(saas_object_types_in_week) AS peak_object_types, {_v('week_window_id')} AS weeks, {_v('lineage_id')} AS lineage_ids, max(t) AS t, 'watchlist' AS action, 'access-breadth' AS reason, max(t) + {LISTED_NS} AS expires, user_principal || ':R-P-L7-006' AS list_key FROM s WHERE osi_layer = 7 AND saas_object_types_in_week IS NOT NULL GROUP BY user_principal HAVING max(drift_rising_windows) >= 4 AND count(DISTINCT coalesce(ctx_groups, 'none')) = 1", 7, "20", "user_principal"),
    "R-B-L7-004": (process_ancestry, "watchlist", f"""SELECT seq, t, s.endpoint_host, coalesce(endpoint_integrity, 'unknown') AS integrity, coalesce(ctx_criticality, 'unknown') AS criticality, CAST(watchlist_reason IS NOT NULL AS INTEGER) AS on_watchlist, watchlist_reason, event_uid, lineage_id FROM s LEFT JOIN ({WATCHLIST}) w ON w.endpoint_host = s.endpoint_host WHERE osi_layer = 7 AND endpoint_pair_novel""",
        7, "round(CASE integrity WHEN 'system' THEN 70 WHEN 'high' THEN 55 WHEN 'low' THEN 25 ELSE 40 END * CASE criticality WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.5 ELSE 1 END) + CASE WHEN watchlist_reason IS NULL THEN 0 ELSE 15 END", "endpoint_host"),
}
#: The test feed is thin: a rollup of a source there has few ports and few counterparties.
FEED = {"R-D-L4-002": ("ports", 2, "PORTS"), "R-D-L4-003": ("least", 2, "LEAST")}


def _register(rule: str) -> None:
    search, table, sql, layer, score, entity = RULED[rule]
    option, value, mark = FEED.get(rule, ("", 0, ""))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = signals(spark, sf_dir)
        metadata = spark.createDataFrame([(r,) for r in RULED], "rule_id string").withColumn("thresholds_hash", F.substring(F.sha2("rule_id", 256), 1, 16))
        own = df.where("window_complete")
        tables = {
            "allowlist": own.where("src_ip LIKE '%1'").select("src_ip").distinct().withColumn("allowed", F.lit("true")),
            "watchlist": own.where("drift_rising_windows >= 7 AND osi_layer = 3").select("endpoint_host").distinct().withColumn("watchlist_reason", F.lit("host-drift-trajectory")),
        }
        return search(df, metadata, *([tables[table]] if table else []), **({option: value} if option else {}))

    name = f"search_{rule.lower().replace('-', '_')}"
    run.__name__ = name
    if mark:
        sql = sql.replace(mark, str(value))
    query: Query = run
    QUERIES[name] = query
    SQL[name] = f"{W.replace('RULES', str(list(RULED)))} SELECT r.*{'' if entity == 'entity_key' else f', CAST({entity} AS VARCHAR) AS entity_key'}, '{rule}' AS rule_id, CAST({layer} AS INTEGER) AS osi_layer, CAST({score} AS DOUBLE) AS risk_score, (SELECT thresholds_hash FROM m WHERE rule_id = '{rule}') AS thresholds_hash FROM ({sql}) r"


for _rule in RULED:
    _register(_rule)
