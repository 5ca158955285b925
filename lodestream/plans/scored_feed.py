"""Scored events of all layers, derived from the event stream by arithmetic that Spark and DuckDB read alike.

The test tables hold no security telemetry; this view gives the searches every column they look at, over whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.plans.catalog import events

DAY = 86_400_000_000_000


def _k(a: int, b: int, m: int) -> str:
    return f"((seq * {a} + entity * {b}) % {m})"


def _flag(a: int, b: int, m: int) -> str:
    return f"({_k(a, b, m)} = 0)"


def _text(prefix: str, a: int, b: int, m: int) -> str:
    return f"('{prefix}' || cast({_k(a, b, m)} AS string))"


def _one_of(a: int, b: int, *values: str | None) -> str:
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"(CASE {_k(a, b, len(values))} {whens} END)"


_BUCKET = "cast(floor(cast(t AS double) / {}) AS bigint)"
COLUMNS = {
    "osi_layer": "cast(1 + seq % 7 AS int)", "window_id": _BUCKET.format(300_000_000_000), "day_id": _BUCKET.format(DAY), "lineage": "entity * 100000 + " + _BUCKET.format(DAY),
    "port_key": _text("p", 0, 7, 23), "device_key": _text("d", 0, 3, 7), "src_ip": _text("10.0.0.", 0, 11, 40), "dst_ip": _text("10.1.0.", 5, 13, 29), "dst_port": _k(17, 1, 60), "host_key": _text("h", 0, 5, 31), "principal": _text("u", 0, 1, 97),
    "mac": _text("m", 1, 19, 37), "oui": _text("o", 1, 2, 9), "vlan": _text("v", 0, 1, 5), "asn": _k(3, 1, 12), "community": f"(CASE WHEN {_k(1, 3, 4)} > 0 THEN {_text('c', 1, 0, 50)} END)", "flow_id": _text("f", 1, 7, 211), "pair_key": _text("pk", 0, 29, 53), "service_key": _text("s", 2, 1, 17), "collector": _text("col", 0, 1, 6),
    "transceiver_serial_changed": _flag(3, 1, 9), "link_flaps": _k(5, 1, 3), "oper_status": _one_of(2, 1, "up", "up", "down", "up"), "forecast_status": _one_of(3, 2, "projected", "immature", "nonlinear"), "days_to_floor": _k(7, 3, 40), "rx_dbm": f"(-3.0 - {_k(11, 1, 60)} / 10.0)", "rx_deviation": f"(0.5 - {_k(13, 5, 40)} / 10.0)", "tx_deviation": f"({_k(17, 3, 20)} / 10.0 - 1.0)", "baseline_samples": _k(19, 1, 25),
    "flaps_in_window": _k(23, 1, 15), "device_reset": _flag(1, 1, 5), "rebooted": _flag(1, 2, 6), "counter_reset": _flag(2, 3, 8), "baseline_mature": f"({_k(29, 3, 4)} > 0)", "step": f"({_k(31, 7, 30)} / 10.0 - 1.0)", "rate": f"({_k(37, 11, 200)} / 5.0)", "baseline_max": f"({_k(41, 3, 50)} / 2.0)", "baseline_min": f"({_k(43, 5, 20)} / 2.0)",
    "neighbor": f"(CASE WHEN {_k(1, 5, 7)} > 0 THEN {_text('n', 1, 1, 13)} END)", "neighbor_changed": _flag(47, 1, 4), "first_seen": _flag(53, 2, 3), "config_changed": _flag(59, 3, 6), "change_in_window": _flag(61, 1, 5), "rising": _k(67, 1, 8), "rise_sigmas": f"({_k(71, 3, 40)} / 10.0)", "acceleration": f"({_k(73, 1, 30)} / 100.0 - 0.15)", "ctx_found": f"({_k(79, 1, 5)} > 0)", "commissioning_rx": f"(CASE WHEN {_k(83, 1, 4)} > 0 THEN -2.0 - {_k(89, 1, 10)} / 10.0 END)",
    "bind_end_reason": _one_of(97, 1, "conflict", "displaced", "idle", "released"), "bind_gap_ns": f"({_k(101, 3, 120)} * 1000000000)", "auth_unpaired": _flag(103, 1, 6), "first_in_window": _flag(107, 1, 2), "distinct_n": _k(109, 3, 80), "claimants": _k(113, 1, 4), "excluded": _flag(127, 1, 3), "ratio": f"(CASE WHEN {_k(131, 1, 5)} > 0 THEN {_k(137, 1, 70)} / 10.0 END)", "attempts": _k(139, 1, 9), "denials": _k(149, 1, 7), "share": f"({_k(151, 1, 100)} / 100.0)",
    "interval_cv": f"({_k(157, 1, 50)} / 100.0)", "size_cv": f"({_k(163, 1, 50)} / 100.0)", "dst_reserved": _flag(167, 1, 11), "dst_multicast": _flag(173, 1, 13), "dst_private": f"({_k(179, 1, 3)} > 0)", "dst_management": _flag(181, 1, 3), "ttl_shifted": _flag(191, 1, 3), "ttl_shift": f"({_k(193, 1, 5)} * 64)", "role": _one_of(197, 1, "workstation", "server", None),
    "flow_syn": _k(199, 1, 6), "flow_ack": f"({_k(211, 1, 3)} - {_k(211, 1, 3)} % 2)", "flow_rst": _k(223, 1, 4), "flow_all": _k(227, 1, 9), "volume_breached": _flag(229, 1, 5), "shape_breached": _flag(233, 1, 4), "ja4": _text("ja", 239, 1, 19), "observations": _k(241, 1, 40), "issuer": _text("ca", 251, 1, 6), "issuer_differs": _flag(257, 1, 3), "issuer_distinct": f"(1 + {_k(263, 1, 3)})", "issuer_new": _flag(269, 1, 4),
    "self_signed_external": _flag(271, 1, 5), "validity_days": _k(277, 1, 400), "cipher_tier": _one_of(281, 1, "modern", "weak", "broken", None), "cipher_downgraded": _flag(283, 1, 3), "category": _one_of(293, 1, "image", "archive", "executable", None), "category_crossed": _flag(307, 1, 4), "label_entropy": f"(2.5 + {_k(311, 1, 30)} / 10.0)", "label_length": _k(313, 1, 60), "domain": f"(CASE WHEN {_k(317, 1, 5)} > 0 THEN {_text('dom', 1, 3, 8)} END)", "subdomain": _text("sub", 331, 1, 90),
    "labels": f"(CASE {_k(337, 1, 4)} WHEN 0 THEN 'iban' WHEN 1 THEN 'phone' ELSE '' END)", "distinct_paths": f"(CASE WHEN {_k(347, 1, 4)} > 0 THEN {_k(349, 1, 300)} END)", "refused": _k(353, 1, 50), "served": _k(359, 1, 50), "classification": _one_of(367, 1, "restricted", "confidential", "internal", "public", None), "object_types": f"(CASE WHEN {_k(373, 1, 3)} > 0 THEN {_k(379, 1, 12)} END)", "pair_novel": _flag(383, 1, 4), "criticality": _one_of(389, 1, "high", "low", None), "integrity": _one_of(397, 1, "system", "high", "medium", "low", None),
    "travel_status": _one_of(401, 1, "measured", "first_for_principal", "unlocated"), "kmh": f"({_k(409, 1, 200)} * 10.0)", "elapsed_ns": f"({_k(419, 1, 90)} * 1000000000)", "denied_then_approved": _flag(421, 1, 2), "hour_unseen": _flag(431, 1, 5), "auth_result": _one_of(433, 1, "success", "failure"), "device_first_seen": _flag(439, 1, 4), "failed_then_succeeded": _flag(443, 1, 3), "failures": _k(449, 1, 6), "fallback": _flag(457, 1, 3), "max_abs_z": f"({_k(461, 1, 90)} / 10.0)", "mean_abs_z": f"({_k(463, 1, 40)} / 10.0)", "z_loss": f"({_k(467, 1, 60)} / 10.0)",
    "privilege": _one_of(479, 1, "admin", "elevated", "user"), "account_type": _one_of(487, 1, "service", "person", None), "session_key": f"(CASE WHEN {_k(491, 1, 3)} > 0 THEN {_text('ses', 0, 1, 61)} END)", "lifecycle": _one_of(499, 1, "start", "end", "running"), "resolution": _one_of(503, 1, "lease", "dot1x", "unresolved", None), "quarantined": _flag(509, 1, 12), "refused_clock": f"(CASE WHEN {_flag(521, 1, 15)} THEN 1 ELSE 0 END)", "envelope_invalid": f"(CASE WHEN {_flag(523, 1, 17)} THEN 1 ELSE 0 END)", "seq_gap": f"(CASE WHEN {_flag(541, 1, 30)} THEN 2 ELSE 0 END)", "seq_regressed": f"(CASE WHEN {_flag(547, 1, 40)} THEN 1 ELSE 0 END)", "offset_ms": f"({_k(557, 1, 2400)} - 1200)", "lag_seconds": _k(563, 1, 500), "late": _flag(569, 1, 9),
}
# doubles, not decimals, in both engines
COLUMNS = {n: re.sub(r"(\(\(seq \* \d+ \+ entity \* \d+\) % \d+\)) / (\d+)\.0", r"cast(\1 AS double) / \2", e) for n, e in COLUMNS.items()}
#: SQL: the view, after catalog.E.
SCORED_ALL = "scored AS (SELECT seq, entity, t, " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM e)"
#: SQL: lookup tables by name.
LOOKUPS = {
    "port_designations": "SELECT DISTINCT port_key, CASE substr(port_key, length(port_key), 1) WHEN '1' THEN 'trunk' WHEN '2' THEN 'lag-member' WHEN '3' THEN 'desk' ELSE 'single-host' END AS designation, cast(length(port_key) AS bigint) AS max_macs FROM scored WHERE port_key <> 'p9'",
    "scanner_allowlist": "SELECT DISTINCT src_ip, 'true' AS allowed FROM scored WHERE src_ip LIKE '%1'",
}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("seq", "entity", "t", *[f"{e} AS {n}" for n, e in COLUMNS.items()])


def lookups(df: DataFrame) -> dict[str, DataFrame]:
    ports = df.where("port_key <> 'p9'").select("port_key").distinct()
    last = F.substring("port_key", -1, 1)
    kind = F.when(last == "1", "trunk").when(last == "2", "lag-member").when(last == "3", "desk").otherwise("single-host")
    return {
        "port_designations": ports.select("port_key", kind.alias("designation"), F.length("port_key").cast("long").alias("max_macs")),
        "scanner_allowlist": df.where("src_ip LIKE '%1'").select("src_ip").distinct().withColumn("allowed", F.lit("true")),
    }
