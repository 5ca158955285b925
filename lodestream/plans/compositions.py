"""Composed runs: a class of records from its feed to sealed, stamped and scored rows, each run one lazy plan.

Every class passes the same gates around its own stages: envelopes are checked and what they refuse is held apart, collectors' numbers are followed, the
subject and what decided the numbers are stamped, and windows are sealed with late rows marked. Runs over days or weeks put a second seal and a trajectory
behind that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.identity import event_uid
from lodestream.operators import intervals, lineage, stamps, trackers
from lodestream.operators import telemetry as tc
from lodestream.operators.trackers import DAY, HOUR
from lodestream.plans.catalog import E, query
from lodestream.plans.scored_feed import SCORED_ALL, scored
from lodestream.plans.telemetry_queries import _novel, _sub

LATENESS = 900 * 10**9
Stages = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Composition:
    """A class: its layer, what its rows are about, its stages, and the period it is sealed by."""

    layer: int
    entity: tuple[str, ...]
    stages: Stages
    period_ns: int = HOUR

    @property
    def stamps(self) -> dict[str, str | int]:
        """The settings and everything else that decides the run's numbers, as digests."""
        settings = {"layer": self.layer, "entity": list(self.entity), "period_ns": self.period_ns, "lateness_ns": LATENESS}
        config = stamps.settings_hash(settings)
        parts = dict.fromkeys(("schema_versions", "thresholds", "code_commit", "image_digest", "reference_data"), stamps.UNKNOWN)
        return {"config_hash": config, "pipeline_fingerprint": stamps.pipeline_fingerprint(configuration=config, **parts)}


def run(df: DataFrame, c: Composition, collector: str = "collector", offset_ms: str = "offset_ms") -> tuple[DataFrame, DataFrame]:
    """(the class's rows, sealed; rows that its envelopes refuse)."""
    fine, held = lineage.split_quarantine(lineage.validate_envelope(df, [collector], offset_ms))
    out = fine.withColumn("event_uid", event_uid(F.col(collector), F.col("seq").cast("string"), F.col("t").cast("string")))
    out = c.stages(trackers.collector_sequence(out, collector, "seq"))
    out = stamps.stamp_envelope(out, c.layer, list(c.entity))
    out = stamps.stamp_determinism(out, "numeric", c.stamps)
    out = lineage.seal_windows(out, c.period_ns, LATENESS)
    return lineage.stamp_lineage(out, "entity_key", "event_uid"), held


def trajectory(sealed: DataFrame, entity: str, score: str, period_ns: int, aggregate: str, epoch_ns: int = 0) -> DataFrame:
    """A second seal by a longer period, and the drift of the entity's score over it. Rows that came late for the first seal are left out."""
    out = lineage.seal_windows(sealed.where(~F.col("late")).drop("window_id", "late"), period_ns, LATENESS, epoch_ns)
    return tc.tc5_drift(out.where(~F.col("late")), entity, score, "window_id", aggregate)


def host_stages(classes: dict[str, tuple[DataFrame, str]], host: str = "host_key", period_ns: int = HOUR) -> DataFrame:
    """One machine over several classes: their rows as one stream, a frame by the hour of each class's feature (name to sealed rows and column; the greatest of
    the hour, 0 without rows), its mean distance from the host's own hours in deviations, and the trajectory of that by the day."""
    names = list(classes)
    parts = [rows.where(~F.col("late") & F.col(host).isNotNull()).select(host, "t", "seq", *(F.col(column).cast("double").alias(n) if n == name else F.lit(None).cast("double").alias(n) for n in names)) for name, (rows, column) in classes.items()]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    frame = merged.withColumn("window_id", F.floor(F.col("t") / period_ns).cast("long")).groupBy(host, "window_id").agg(F.min("t").alias("t"), F.count("*").alias("rows"), *(F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names))
    for n in names:
        frame = trackers.zscore(frame, n, [host]).withColumnRenamed("z", f"{n}_z")
    frame = frame.withColumns({"mean_abs_z": sum((F.col(f"{n}_z") for n in names), F.lit(0.0)) / len(names), "day": F.floor(F.col("t") / DAY).cast("long")})
    return tc.tc5_drift(frame, host, "mean_abs_z", "day")


def health(sealed: DataFrame, collector: str = "collector") -> DataFrame:
    """One row a window and collector: rows, late rows, the greatest gap of numbers and whether one went back, and rows against the collector's busiest window before."""
    out = sealed.groupBy(collector, "window_id").agg(F.count("*").alias("rows"), F.count_if("late").alias("late_rows"), F.max("sequence_gap").alias("most_gap"), F.max("sequence_regressed").alias("regressed"))
    from pyspark.sql import Window

    before = Window.partitionBy(collector).orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("busiest_before", F.max("rows").over(before))


# the classes over the feed


def _network(df: DataFrame) -> DataFrame:
    return tc.tc3_reach(tc.tc3_cardinality(df, window_ns=DAY), bytes_out="rate", bytes_in="kmh", window_ns=DAY)


def _transport(df: DataFrame) -> DataFrame:
    out = tc.tc4_flow(df.withColumn("tcp_flags", (F.col("seq") % 64).cast("int")), ("src_ip", "dst_ip"), "tcp_flags", "dst_port", DAY)
    return tc.tc4_envelope(out, ("src_ip",), ("rate",), 5 * DAY, 20, 1.0)


def _endpoint(df: DataFrame) -> DataFrame:
    return tc.tc7_endpoint(df.withColumns({"parent_image": F.concat(F.lit("C:\\Windows\\"), "subdomain"), "image": F.concat(F.lit("/bin/"), "oui")}))


def _saas(df: DataFrame) -> DataFrame:
    return tc.tc7_saas(df, operation="ja4", object_type="category", records="served", ok=F.col("auth_result") == "success")


NETWORK = Composition(3, ("src_ip",), _network)
TRANSPORT = Composition(4, ("src_ip", "dst_ip"), _transport)
PRESENTATION = Composition(6, ("src_ip",), lambda df: tc.tc6_fingerprint(df))
SESSION = Composition(5, ("principal",), lambda df: tc.tc5_risk(tc.tc5_novelty(df, columns={"location": "dst_ip"}), mfa=F.col("device_first_seen"), run_ns=5 * DAY, min_denominator=3))
ACCESS = Composition(2, ("port_key",), lambda df: tc.tc2_cardinality(df, window_ns=DAY))
ENDPOINT = Composition(7, ("host_key",), _endpoint)
SAAS = Composition(7, ("principal",), _saas)


def feed(spark: SparkSession, sf_dir: str, layer: int) -> DataFrame:
    df = scored(spark, sf_dir).where(F.col("osi_layer") == layer)
    return df.drop("osi_layer", "window_id", "lineage", "late", "first_in_window", "attempts", "failures", "hour_unseen")


def _sealed(layer: int, name: str = "k", period: int = HOUR) -> str:
    """SQL: the layer's rows that are fine, with the window and whether they came late."""
    return f"""{name} AS MATERIALIZED (SELECT *, t // {period} AS win, coalesce((t // {period} + 1) * {period} + {LATENESS} <= max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was_late,
        max(seq) OVER (PARTITION BY collector ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS number FROM scored WHERE osi_layer = {layer} AND abs(offset_ms) <= 1000)"""


def _common(layer: int, entity: str) -> str:
    return f"seq, {layer} AS osi_layer, {entity} AS entity_key, win AS window_id, was_late AS late, CASE WHEN number IS NOT NULL THEN greatest(seq - number - 1, 0) END AS sequence_gap"


COMMON = ("seq", "osi_layer", "entity_key", "window_id", "late", "sequence_gap")
W = f"WITH {E}, {SCORED_ALL}"


@query(f"""{W}, {_sealed(3)}, l AS (SELECT src_ip, t AS start_ns, t + {2 * DAY} AS end_ns, mac FROM scored WHERE osi_layer = 2), a AS (SELECT k.seq, arg_max(l.mac, (l.start_ns, l.end_ns, l.mac)) AS host_mac FROM k JOIN l ON l.src_ip = k.src_ip AND l.start_ns <= k.t AND k.t < l.end_ns GROUP BY k.seq),
 h AS (SELECT DISTINCT mac, 'host-' || mac AS hostname FROM scored WHERE osi_layer = 1), c AS (SELECT a.seq, host_mac, hostname FROM a LEFT JOIN h ON h.mac = host_mac)
 SELECT {_common(3, 'src_ip')}, {_sub('count(DISTINCT b.dst_ip)', 'src_ip', DAY, source='k')} AS dsts_per_src, {_sub('count(DISTINCT b.src_ip)', 'dst_ip', DAY, source='k')} AS srcs_per_dst, {_sub('count(DISTINCT b.dst_port)', 'src_ip', DAY, source='k')} AS dst_ports_per_src,
 round(rate / (kmh + 1), 6) AS byte_asymmetry, {_novel('src_ip', 'asn', 'dst_asn', 'k')}, host_mac, hostname AS host_key, coalesce(hostname, src_ip) AS chain_anchor FROM k a LEFT JOIN c USING (seq)""")
def composed_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows: counts, reach, the machine behind the source, sealed by the hour."""
    other = scored(spark, sf_dir)
    leases = other.where("osi_layer = 2").select(F.col("src_ip").alias("ip"), F.col("t").alias("start_ns"), (F.col("t") + 2 * DAY).alias("end_ns"), "mac")
    machines = other.where("osi_layer = 1").select("mac", F.lit(0).cast("long").alias("start_ns"), F.lit(None).cast("long").alias("end_ns"), F.concat(F.lit("host-"), "mac").alias("hostname")).distinct()
    named = Composition(3, ("src_ip",), lambda df: intervals.host_identity(_network(df).drop("host_key"), leases, machines))
    out, _ = run(feed(spark, sf_dir, 3), named)
    return out.select(*COMMON, "dsts_per_src", "srcs_per_dst", "dst_ports_per_src", F.round("byte_asymmetry", 6).alias("byte_asymmetry"), "dst_asn_changed", "dst_asn_first_seen", "dst_asn_distinct", "host_mac", "host_key", "chain_anchor")


@query(f"""{W}, {_sealed(4)}, f AS (SELECT *, seq % 64 AS flags FROM k), s AS (SELECT *, sum(flags >> 1 & 1) OVER w AS syn, sum(dst_port) OVER w AS len, count(*) OVER w AS packets FROM f WINDOW w AS (PARTITION BY src_ip, dst_ip, t // {DAY} ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
 h AS (SELECT a.seq, count(b.rate) AS n, list_sort(list(b.rate)) AS l FROM k a JOIN k b ON b.src_ip = a.src_ip AND b.t < a.t AND b.t >= a.t - {5 * DAY} GROUP BY a.seq)
 SELECT {_common(4, "src_ip || ':' || dst_ip")}, packets AS flow_packets, CAST(syn AS BIGINT) AS flow_syn, CAST(len AS BIGINT) AS flow_data_len, CASE WHEN n >= 20 THEN l[CAST(greatest(ceil(0.99 * n), 1) AS INT)] END AS rate_envelope FROM s LEFT JOIN h USING (seq)""")
def composed_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = run(feed(spark, sf_dir, 4), TRANSPORT)
    return out.select(*COMMON, "flow_packets", "flow_syn", "flow_data_len", "rate_envelope")


@query(f"""{W}, {_sealed(6)} SELECT {_common(6, 'src_ip')}, {_novel('src_ip', 'ja4', 'ja4', 'k')}, {_sub('count(b.ja4)', 'src_ip', where='b.seq <> a.seq', source='k')} AS ja4_observations FROM k a""")
def composed_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = run(feed(spark, sf_dir, 6), PRESENTATION)
    return out.select(*COMMON, "ja4_changed", "ja4_first_seen", "ja4_distinct", "ja4_observations")


@query(f"""{W}, {_sealed(2)} SELECT {_common(2, 'port_key')}, {_sub('count(DISTINCT b.mac)', 'port_key', DAY, source='k')} AS macs_per_port, {_sub('count(DISTINCT b.port_key)', 'mac', DAY, source='k')} AS ports_per_mac FROM k a""")
def composed_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = run(feed(spark, sf_dir, 2), ACCESS)
    return out.select(*COMMON, "macs_per_port", "ports_per_mac")


@query(f"""{W}, {_sealed(5)}, f AS (SELECT *, {_sub('count(*)', 'principal', 5 * DAY, source='k')} AS tries FROM k a WHERE NOT was_late),
 d AS (SELECT principal, t // {DAY} AS day, avg(tries) AS s FROM (SELECT * FROM f) GROUP BY ALL)
 SELECT principal AS entity, day AS window_id, round(s, 6) AS score, round(CASE WHEN lag(day) OVER w = day - 1 THEN s - lag(s) OVER w END, 6) AS velocity, count(s) OVER (w ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS history_windows FROM d WINDOW w AS (PARTITION BY principal ORDER BY day)""")
def composed_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ins by the hour, and the trajectory of a principal's attempts by the day."""
    out, _ = run(feed(spark, sf_dir, 5), SESSION)
    return trajectory(out, "principal", "auth_attempts_in_window", DAY, "mean").select("entity", "window_id", F.round("score", 6).alias("score"), F.round("velocity", 6).alias("velocity"), "history_windows")


@query(f"""{W}, {_sealed(7)}, d AS (SELECT host_key, t // {DAY} AS day, count(DISTINCT subdomain || '>' || oui) AS n FROM k WHERE NOT was_late GROUP BY ALL)
 SELECT host_key AS entity, day AS window_id, n AS score, CASE WHEN lag(day) OVER w = day - 1 THEN n - lag(n) OVER w END AS velocity FROM d WINDOW w AS (PARTITION BY host_key ORDER BY day)""")
def composed_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes by the hour, and the trajectory of a host's different pairs by the day."""
    out, _ = run(feed(spark, sf_dir, 7), ENDPOINT)
    return trajectory(out, "host_key", "endpoint_pair", DAY, "distinct").select("entity", "window_id", F.col("score").cast("long").alias("score"), F.col("velocity").cast("long").alias("velocity"))


@query(f"""{W}, {_sealed(7)}, o AS (SELECT *, (t - {tc.WEEK_EPOCH}) // {7 * DAY} AS week, CASE WHEN auth_result = 'success' THEN category END AS o FROM k),
 c AS (SELECT principal, week, was_late, (SELECT count(DISTINCT b.o) FROM o b WHERE b.principal = a.principal AND b.week = a.week AND (b.t < a.t OR (b.t = a.t AND b.seq <= a.seq))) AS n FROM o a),
 d AS (SELECT principal, week, max(n) AS n FROM c WHERE NOT was_late GROUP BY ALL)
 SELECT principal AS entity, week AS window_id, n AS score, CASE WHEN lag(week) OVER w = week - 1 THEN n - lag(n) OVER w END AS velocity FROM d WINDOW w AS (PARTITION BY principal ORDER BY week)""")
def composed_saas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of software as a service by the hour, and the trajectory of a principal's breadth by the week."""
    out, _ = run(feed(spark, sf_dir, 7), SAAS)
    return trajectory(out, "principal", "saas_object_types_in_week", 7 * DAY, "max", tc.WEEK_EPOCH).select("entity", "window_id", F.col("score").cast("long").alias("score"), F.col("velocity").cast("long").alias("velocity"))


@query(f"""{W}, {_sealed(3, 'k3')}, {_sealed(6, 'k6')}, {_sealed(7, 'k7')},
 x AS (SELECT host_key, t // {HOUR} AS win, t, {_sub('count(DISTINCT b.dst_ip)', 'src_ip', DAY, source='k3')} AS a, NULL AS b, NULL AS c FROM k3 a WHERE NOT was_late
   UNION ALL SELECT host_key, t // {HOUR}, t, NULL, {_sub('count(DISTINCT b.ja4)', 'src_ip', source='k6')}, NULL FROM k6 a WHERE NOT was_late UNION ALL SELECT host_key, t // {HOUR}, t, NULL, NULL, seq % 5 FROM k7 a WHERE NOT was_late),
 f AS (SELECT host_key, win, min(t) AS t, CAST(coalesce(max(a), 0) AS DOUBLE) AS a, CAST(coalesce(max(b), 0) AS DOUBLE) AS b, CAST(coalesce(max(c), 0) AS DOUBLE) AS c FROM x GROUP BY host_key, win),
 z AS (SELECT host_key, t // {DAY} AS day, (CASE WHEN stddev_pop(a) OVER w > 0 THEN abs(a - avg(a) OVER w) / stddev_pop(a) OVER w ELSE 0 END + CASE WHEN stddev_pop(b) OVER w > 0 THEN abs(b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE 0 END + CASE WHEN stddev_pop(c) OVER w > 0 THEN abs(c - avg(c) OVER w) / stddev_pop(c) OVER w ELSE 0 END) / 3 AS z FROM f WINDOW w AS (PARTITION BY host_key)),
 d AS (SELECT host_key, day, avg(z) AS s FROM z GROUP BY ALL)
 SELECT host_key AS entity, day AS window_id, round(s, 5) AS score, round(CASE WHEN lag(day) OVER w = day - 1 THEN s - lag(s) OVER w END, 5) AS velocity FROM d WINDOW w AS (PARTITION BY host_key ORDER BY day)""")
def composed_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines over three classes: by the hour, then by the day."""
    flows, _ = run(feed(spark, sf_dir, 3), NETWORK)
    shaken, _ = run(feed(spark, sf_dir, 6), PRESENTATION)
    started, _ = run(feed(spark, sf_dir, 7), Composition(7, ("host_key",), lambda df: df.withColumn("pairs", F.col("seq") % 5)))
    out = host_stages({"fan_out": (flows, "dsts_per_src"), "stacks": (shaken, "ja4_distinct"), "pairs": (started, "pairs")})
    return out.select("entity", "window_id", F.round("score", 5).alias("score"), F.round("velocity", 5).alias("velocity"))


@query(f"""{W}, {_sealed(2)}, g AS (SELECT collector, win, count(*) AS n, count(*) FILTER (was_late) AS late_rows, max(CASE WHEN number IS NOT NULL THEN greatest(seq - number - 1, 0) END) AS most_gap, bool_or(coalesce(seq <= number, false)) AS regressed FROM k GROUP BY ALL)
 SELECT collector, win AS window_id, n AS rows, late_rows, most_gap, regressed, max(n) OVER (PARTITION BY collector ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busiest_before FROM g""")
def composed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(run(feed(spark, sf_dir, 2), ACCESS)[0])


@query(f"""{W} SELECT seq, CASE WHEN offset_ms > 1000 OR offset_ms < -1000 THEN 'clock_offset' END AS reasons FROM scored WHERE osi_layer = 2 AND abs(offset_ms) > 1000""")
def composed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held = run(feed(spark, sf_dir, 2), ACCESS)
    return held.select("seq", F.array_join("quarantine_reasons", ",").alias("reasons"))
