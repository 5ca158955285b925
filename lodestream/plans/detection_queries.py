"""Every scheduled search as a query, with DuckDB SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.plans import detections, searches
from lodestream.plans.catalog import QUERIES, SQL, E, query
from lodestream.plans.detections import DAY, SLACK, Search, Table
from lodestream.plans.scored_feed import LOOKUPS, SCORED_ALL, lookups, scored
from lodestream.session import shared_root
from lodestream.sources.sinks import KeyedTable

W = f"WITH {E}, {SCORED_ALL}"
MIDDLE = 1_705_400_000_000_000_000  # what is older expires: amid the events


def _duck(sql: str) -> str:
    sql = re.sub(r"values\((.*?)\)(?=$|,)", r"coalesce(string_agg(DISTINCT cast(\1 AS varchar), ';' ORDER BY cast(\1 AS varchar)), '')", sql)
    sql = re.sub(r"latest\((.*?)\)", r"max_by(\1, seq)", sql)
    return sql


def search_sql(s: Search) -> str:
    """The search in DuckDB's words: nested selects, from the rows outwards."""
    source = f"SELECT * FROM scored{f' LEFT JOIN ({LOOKUPS[s.lookup[0]]}) USING ({s.lookup[1]})' if s.lookup else ''} WHERE {s.where}"
    shown = ", ".join(f"{_duck(e)} AS {n}" for n, e in s.out.items())
    if s.by:
        known = " AND ".join(f"{b} IS NOT NULL" for b in s.by)
        out = f"SELECT {', '.join(s.by)}, {shown} FROM ({source}) WHERE {known} GROUP BY {', '.join(s.by)}"
    else:
        out = f"SELECT {shown}, {s.entity if s.rule else 'NULL'} AS _entity FROM ({source}) WHERE {s.having}"
    for n, e in s.evals.items():
        out = f"SELECT *, {e} AS {n} FROM ({out})"
    if s.by:
        out = f"SELECT * FROM ({out}) WHERE {s.having}"
    if s.rule:
        entity = s.entity if s.by else "_entity"
        out = f"SELECT *, '{s.rule}' AS rule_id, cast({s.score} AS double) AS risk_score, cast({s.layer} AS int) AS osi_layer, cast({entity} AS varchar) AS entity_key, '{s.thresholds_hash}' AS thresholds_hash FROM ({out})"
    return f"SELECT * {'' if s.by else 'EXCLUDE (_entity) '}FROM ({out})"


def _register(s: Search) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = scored(spark, sf_dir)
        return detections.detect(df, s, lookups(df))

    run.__name__ = f"search_{s.name}"
    QUERIES[run.__name__], SQL[run.__name__] = run, f"{W} {search_sql(s)}"


for _s in detections.SEARCHES:
    _register(_s)


def _register_table(t: Table) -> None:
    listed = "watchlist" in t.name
    bucket = f"cast(floor(t / {t.bucket_ns}.0) AS bigint)" if t.bucket_ns else "cast(0 AS bigint)"
    key = " || '|' || ".join([f"cast({k} AS varchar)" for k in t.key] + (["cast(bucket AS varchar)"] if t.bucket_ns else []))
    known = " AND ".join(f"{k} IS NOT NULL" for k in t.key)
    names = ", ".join([*t.key, "bucket", "t", "seq", *t.columns])
    merged = f"SELECT {key} AS _key, {names} FROM (SELECT *, {bucket} AS bucket FROM scored WHERE {t.where} AND {known}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) = 1"

    def kept(spark: SparkSession) -> KeyedTable:
        return KeyedTable(spark, f"{shared_root(spark)}/{t.name}-{uuid.uuid4().hex}", "_key", "seq")

    def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Two runs of the refresh: the second one meets the first one's table."""
        df, table = scored(spark, sf_dir), kept(spark)
        detections.maintain(table, df.where("seq % 2 = 0"), t)
        return detections.maintain(table, df.where("seq % 2 = 1"), t)

    def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = kept(spark)
        detections.maintain(table, scored(spark, sf_dir), t)
        return detections.expire(table, MIDDLE + held, listed)

    QUERIES[f"search_{t.name}_refresh"], SQL[f"search_{t.name}_refresh"] = refreshed, f"{W} {merged}"
    held = detections.LISTED_NS if listed else detections.KEPT_NS
    QUERIES[f"search_{t.name}_expiry"], SQL[f"search_{t.name}_expiry"] = expired, f"{W} SELECT * FROM ({merged}) WHERE t >= {MIDDLE}"


for _t in detections.TABLES:
    _register_table(_t)


@query(f"""{W}, s AS (SELECT neighbor, port_key, min(t) AS first_seen, max(t) AS last_seen, max_by(device_key, seq) AS device_key FROM scored WHERE osi_layer = 1 AND neighbor IS NOT NULL AND seq % 2 = 1 GROUP BY ALL
  UNION ALL SELECT neighbor, port_key, min(t), max(t), max_by(device_key, seq) FROM scored WHERE osi_layer = 1 AND neighbor IS NOT NULL AND seq % 2 = 0 GROUP BY ALL)
 SELECT neighbor, port_key, min(first_seen) AS first_seen, max_by(device_key, last_seen) AS device_key, max(last_seen) AS last_seen FROM s GROUP BY ALL""")
def search_topology_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    known = searches.stats(df.where("osi_layer = 1 AND seq % 2 = 0"), ["neighbor", "port_key"], first_seen=F.min("t"), last_seen=F.max("t"), device_key=F.max_by("device_key", "seq"))
    return detections.adjacency(df.where("seq % 2 = 1"), known)


_Z = "max_abs_z >= 6.0"


@query(f"""{W}, l AS (SELECT lineage, count(DISTINCT osi_layer) AS layer_span, min(t) AS chain_start, max(t) AS chain_end, max(max_abs_z) AS peak_z, coalesce(string_agg(DISTINCT resolution, ';' ORDER BY resolution), '') AS methods FROM scored GROUP BY lineage),
 r AS (SELECT lineage, sum(CASE osi_layer WHEN 5 THEN 80.0 ELSE 30.0 END) AS total_risk, string_agg(DISTINCT 'Z' || osi_layer, ';' ORDER BY 'Z' || osi_layer) AS rules FROM scored WHERE {_Z} GROUP BY lineage)
 SELECT lineage, layer_span, chain_start, chain_end, peak_z, methods, total_risk, rules, chain_end - chain_start AS chain_duration FROM l LEFT JOIN r USING (lineage) WHERE layer_span >= 3 AND (total_risk >= 60 OR (layer_span >= 4 AND peak_z >= 4.0))""")
def search_chain_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    raised = df.where(_Z).select("lineage", F.when(F.col("osi_layer") == 5, 80.0).otherwise(30.0).alias("risk_score"), F.concat(F.lit("Z"), F.col("osi_layer").cast("string")).alias("rule_id"))
    return detections.chain_of_layers(df, raised)


@query(f"""{W}, b AS (SELECT src_ip, dst_ip, min(t) AS t_beacon FROM scored WHERE osi_layer = 3 AND baseline_mature AND interval_cv < 0.15 GROUP BY ALL),
 a AS (SELECT src_ip, dst_ip, t, ja4 FROM scored WHERE osi_layer = 6 AND first_seen AND observations >= 20)
 SELECT src_ip, dst_ip, min(t) AS t_tls, min(t_beacon) AS t_beacon, string_agg(DISTINCT ja4, ';' ORDER BY ja4) AS fingerprints, min(t_beacon) - min(t) AS gap, 70.0::DOUBLE AS risk_score FROM a JOIN b USING (src_ip, dst_ip) WHERE t_beacon >= t - {SLACK} AND t_beacon - t <= {10 * DAY} GROUP BY src_ip, dst_ip""")
def search_r_c_002(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    # one row a pair on the right, so a busy pair is joined with one row
    beacons = searches.stats(df.where("osi_layer = 3 AND baseline_mature AND interval_cv < 0.15"), ["src_ip", "dst_ip"], t_beacon=F.min("t"))
    both = df.where("osi_layer = 6 AND first_seen AND observations >= 20").join(beacons, ["src_ip", "dst_ip"]).where(f"t_beacon >= t - {SLACK} AND t_beacon - t <= {10 * DAY}")
    out = both.groupBy("src_ip", "dst_ip").agg(F.min("t").alias("t_tls"), F.min("t_beacon").alias("t_beacon"), searches.values("ja4").alias("fingerprints"))
    return out.withColumns({"gap": F.col("t_beacon") - F.col("t_tls"), "risk_score": F.lit(70.0)})


@query(f"""{W}, p AS (SELECT src_ip, day_id, max(distinct_n) AS peak FROM scored WHERE osi_layer = 3 GROUP BY ALL),
 f AS (SELECT s.src_ip, s.day_id, min(s.t) AS t0 FROM scored s JOIN p ON p.src_ip = s.src_ip AND p.day_id + 1 = s.day_id WHERE s.osi_layer = 3 AND s.distinct_n > p.peak GROUP BY ALL),
 g AS (SELECT src_ip, principal, host_key, t FROM scored WHERE osi_layer = 5 AND auth_result = 'success' AND first_seen),
 x AS (SELECT host_key, t, pair_key FROM scored WHERE osi_layer = 7 AND pair_novel),
 a AS (SELECT src_ip, day_id, principal, host_key, t0, min(g.t) AS t1 FROM f JOIN g USING (src_ip) WHERE g.t >= t0 - {SLACK} AND g.t - t0 <= {2 * DAY} GROUP BY ALL),
 b AS (SELECT src_ip, principal, host_key, t0, t1, x.t AS t2 FROM a JOIN x USING (host_key) WHERE x.t >= t1 - {SLACK} AND x.t - t0 <= {2 * DAY})
 SELECT src_ip, principal, host_key, min(t0) AS t_fanout, min(t1) AS t_login, min(t2) AS t_process, 80.0::DOUBLE AS risk_score FROM b GROUP BY ALL""")
def search_r_c_001(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    flows = df.where("osi_layer = 3")
    peaks = flows.groupBy("src_ip", F.expr("day_id + 1").alias("day_id")).agg(F.max("distinct_n").alias("peak"))
    fan = flows.join(peaks, ["src_ip", "day_id"]).where("distinct_n > peak").groupBy("src_ip", "day_id").agg(F.min("t").alias("t0"))
    logins = df.where("osi_layer = 5 AND auth_result = 'success' AND first_seen").select("src_ip", "principal", "host_key", "t")
    starts = df.where("osi_layer = 7 AND pair_novel").select("host_key", "t")
    out = detections.steps(fan, [(logins, "src_ip", 2 * DAY), (starts, "host_key", 2 * DAY)], ["src_ip", "day_id", "principal", "host_key"])
    return out.groupBy("src_ip", "principal", "host_key").agg(F.min("t0").alias("t_fanout"), F.min("t1").alias("t_login"), F.min("t2").alias("t_process")).withColumn("risk_score", F.lit(80.0))


@query(f"""{W}, x AS (SELECT principal, src_ip, t AS t0 FROM scored WHERE osi_layer = 7 AND baseline_mature AND ratio > 5),
 b AS (SELECT src_ip, t FROM scored WHERE osi_layer = 4 AND (volume_breached OR shape_breached)),
 h AS (SELECT src_ip, t, issuer FROM scored WHERE osi_layer = 6 AND issuer_new),
 a AS (SELECT principal, src_ip, t0, min(b.t) AS t1 FROM x JOIN b USING (src_ip) WHERE b.t >= t0 - {SLACK} AND b.t - t0 <= {DAY} GROUP BY ALL),
 c AS (SELECT principal, src_ip, issuer, t0, min(t1) AS t1, min(h.t) AS t2 FROM a JOIN h USING (src_ip) WHERE h.t >= t1 - {SLACK} AND h.t - t0 <= {DAY} GROUP BY principal, src_ip, issuer, t0)
 SELECT principal, src_ip, min(t0) AS t_export, min(t1) AS t_breach, min(t2) AS t_handshake, string_agg(DISTINCT issuer, ';' ORDER BY issuer) AS issuers, 85.0::DOUBLE AS risk_score FROM c GROUP BY principal, src_ip""")
def search_r_c_004(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    exports = df.where("osi_layer = 7 AND baseline_mature AND ratio > 5").select("principal", "src_ip", F.col("t").alias("t0")).distinct()
    breaches = df.where("osi_layer = 4 AND (volume_breached OR shape_breached)").select("src_ip", "t")
    shaken = df.where("osi_layer = 6 AND issuer_new").select("src_ip", "t", "issuer")
    out = detections.steps(exports, [(breaches, "src_ip", DAY), (shaken, "src_ip", DAY)], ["principal", "src_ip", "issuer"])
    return out.groupBy("principal", "src_ip").agg(F.min("t0").alias("t_export"), F.min("t1").alias("t_breach"), F.min("t2").alias("t_handshake"), searches.values("issuer").alias("issuers")).withColumn("risk_score", F.lit(85.0))


@query(f"""{W}, p AS (SELECT *, lag(port_key) OVER w AS previous_port, lag(src_ip) OVER w AS previous_ip, lag(lineage) OVER w AS previous_lineage FROM scored WHERE osi_layer = 5 AND travel_status IN ('measured', 'first_for_principal') WINDOW w AS (PARTITION BY principal ORDER BY t, seq))
 SELECT seq, principal, previous_port, previous_ip, previous_lineage, elapsed_ns / 1000000000 AS elapsed_seconds, 90.0::DOUBLE AS risk_score FROM p WHERE travel_status = 'measured' AND kmh >= 900""")
def search_r_c_005(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).where("osi_layer = 5 AND travel_status IN ('measured', 'first_for_principal')")
    df = searches.streamstats_last(df, ["principal"], ["t", "seq"], previous_port="port_key", previous_ip="src_ip", previous_lineage="lineage").where("travel_status = 'measured' AND kmh >= 900")
    return df.select("seq", "principal", "previous_port", "previous_ip", "previous_lineage", F.expr("elapsed_ns / 1000000000 AS elapsed_seconds"), F.lit(90.0).alias("risk_score"))


@query(f"""{W}, o AS (SELECT port_key, t AS t0, CASE WHEN transceiver_serial_changed THEN 'transceiver substitution' ELSE 'link event' END AS port_event FROM scored WHERE osi_layer = 1 AND (transceiver_serial_changed OR link_flaps > 0)),
 v AS (SELECT port_key, mac, t FROM scored WHERE osi_layer = 2 AND first_seen), m AS (SELECT mac, t FROM scored WHERE osi_layer = 3 AND dst_management),
 a AS (SELECT DISTINCT port_key, port_event, mac, t0, min(v.t) AS t1 FROM o JOIN v USING (port_key) WHERE v.t >= t0 - {SLACK} AND v.t - t0 <= {DAY} GROUP BY port_key, port_event, mac, t0),
 b AS (SELECT port_key, port_event, mac, t0, t1, m.t AS t2 FROM a JOIN m USING (mac) WHERE m.t >= t1 - {SLACK} AND m.t - t0 <= {DAY})
 SELECT port_key, mac, min(t0) AS t_port, min(t1) AS t_vendor, min(t2) AS t_management, string_agg(DISTINCT port_event, ';' ORDER BY port_event) AS port_events, 85.0::DOUBLE AS risk_score FROM b GROUP BY port_key, mac""")
def search_r_c_003(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    ports = df.where("osi_layer = 1 AND (transceiver_serial_changed OR link_flaps > 0)").select("port_key", F.col("t").alias("t0"), F.when(F.col("transceiver_serial_changed"), "transceiver substitution").otherwise("link event").alias("port_event"))
    vendors = df.where("osi_layer = 2 AND first_seen").select("port_key", "mac", "t")
    managed = df.where("osi_layer = 3 AND dst_management").select("mac", "t")
    out = detections.steps(ports, [(vendors, "port_key", DAY), (managed, "mac", DAY)], ["port_key", "port_event", "mac"])
    return out.groupBy("port_key", "mac").agg(F.min("t0").alias("t_port"), F.min("t1").alias("t_vendor"), F.min("t2").alias("t_management"), searches.values("port_event").alias("port_events")).withColumn("risk_score", F.lit(85.0))


@query(f"""{W}, b AS (SELECT *, cast(floor(t / {DAY}.0) AS bigint) AS bucket FROM scored),
 i AS (SELECT principal, bucket, max_by(port_key, seq) AS identity_port FROM b WHERE osi_layer = 2 GROUP BY ALL), l AS (SELECT src_ip, bucket, max_by(mac, seq) AS walked_mac FROM b WHERE osi_layer = 3 GROUP BY ALL), m AS (SELECT mac AS walked_mac, bucket, max_by(port_key, seq) AS address_port FROM b WHERE osi_layer = 2 GROUP BY ALL)
 SELECT seq, coalesce(identity_port, address_port) AS walked_port, CASE WHEN identity_port IS NOT NULL THEN 'dot1x_identity' ELSE 'address' END AS rung, coalesce(coalesce(identity_port, address_port) = b.port_key, false) AS agrees
 FROM b LEFT JOIN i USING (principal, bucket) LEFT JOIN l USING (src_ip, bucket) LEFT JOIN m USING (walked_mac, bucket) WHERE osi_layer = 5 AND coalesce(identity_port, address_port) IS NOT NULL""")
def search_identity_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).withColumn("bucket", F.floor(F.col("t") / F.lit(DAY)).cast("long"))
    last = lambda layer, key, value, name: df.where(f"osi_layer = {layer}").groupBy(F.col(key), "bucket").agg(F.max_by(value, "seq").alias(name))
    out = df.where("osi_layer = 5").join(last(2, "principal", "port_key", "identity_port"), ["principal", "bucket"], "left").join(last(3, "src_ip", "mac", "walked_mac"), ["src_ip", "bucket"], "left")
    out = out.join(last(2, "mac", "port_key", "address_port").withColumnRenamed("mac", "walked_mac"), ["walked_mac", "bucket"], "left")
    out = out.withColumn("walked_port", F.coalesce("identity_port", "address_port")).where("walked_port IS NOT NULL")
    return out.select("seq", "walked_port", F.when(F.col("identity_port").isNotNull(), "dot1x_identity").otherwise("address").alias("rung"), F.coalesce(F.col("walked_port") == F.col("port_key"), F.lit(False)).alias("agrees"))


@query(f"""{W}, p AS (SELECT entity, window_id, lineage, max(distinct_n) AS peak FROM scored WHERE osi_layer = 3 GROUP BY ALL),
 q AS (SELECT *, lag(peak) OVER w AS previous, lag(peak, 2) OVER w AS earlier FROM p WINDOW w AS (PARTITION BY entity ORDER BY window_id, lineage))
 SELECT entity, window_id, lineage, peak, previous, earlier, 20.0::DOUBLE AS risk_score FROM q WHERE earlier IS NOT NULL AND peak > previous AND previous > earlier""")
def search_r_p_l3_005(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = scored(spark, sf_dir).where("osi_layer = 3").groupBy("entity", "window_id", "lineage").agg(F.max("distinct_n").alias("peak"))
    out = searches.streamstats_last(summary, ["entity"], ["window_id", "lineage"], previous="peak")
    out = searches.streamstats_last(out, ["entity"], ["window_id", "lineage"], earlier="previous")
    return out.where("earlier IS NOT NULL AND peak > previous AND previous > earlier").withColumn("risk_score", F.lit(20.0))


@query(f"""{W}, s AS (SELECT host_key, role, string_agg(DISTINCT ja4, ';' ORDER BY ja4) AS stacks, max(CASE WHEN first_seen THEN 1 ELSE 0 END) AS new_to_host FROM scored WHERE osi_layer = 4 AND role IS NOT NULL GROUP BY ALL),
 k AS (SELECT DISTINCT host_key, role AS declared FROM scored WHERE osi_layer = 7 AND role IS NOT NULL)
 SELECT host_key, role, declared, stacks, 40.0::DOUBLE AS risk_score FROM s JOIN k USING (host_key) WHERE role <> declared AND new_to_host = 1""")
def search_r_b_l4_004(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    stacks = searches.stats(df.where("osi_layer = 4"), ["host_key", "role"], stacks=searches.values("ja4"), new_to_host=F.max(F.when(F.col("first_seen"), 1).otherwise(0)))
    told = df.where("osi_layer = 7 AND role IS NOT NULL").select("host_key", F.col("role").alias("declared")).distinct()
    return stacks.join(told, "host_key").where("role <> declared AND new_to_host = 1").select("host_key", "role", "declared", "stacks", F.lit(40.0).alias("risk_score"))


@query(f"""{W}, h AS (SELECT collector, osi_layer, day_id, count(*) AS rows_seen FROM scored GROUP BY ALL),
 m AS (SELECT *, max(rows_seen) OVER (PARTITION BY collector, osi_layer ORDER BY day_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline, count(*) OVER (PARTITION BY collector, osi_layer ORDER BY day_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM h),
 p AS (SELECT *, lag(rows_seen) OVER w AS previous_rows, lag(baseline) OVER w AS previous_baseline, lag(n) OVER w AS previous_n FROM m WINDOW w AS (PARTITION BY collector, osi_layer ORDER BY day_id))
 SELECT collector, osi_layer, day_id, rows_seen, previous_rows, previous_baseline FROM p WHERE previous_n >= 3 AND 2 * previous_rows >= 3 * previous_baseline AND 2 * rows_seen >= 3 * previous_baseline""")
def search_platform_baseline_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    health = scored(spark, sf_dir).groupBy("collector", "osi_layer", "day_id").agg(F.count("*").alias("rows_seen"))
    w = Window.partitionBy("collector", "osi_layer").orderBy("day_id").rowsBetween(Window.unboundedPreceding, -1)
    health = health.withColumns({"baseline": F.max("rows_seen").over(w), "n": F.count("*").over(w)})
    out = searches.streamstats_last(health, ["collector", "osi_layer"], ["day_id"], previous_rows="rows_seen", previous_baseline="baseline", previous_n="n")
    return out.where("previous_n >= 3 AND 2 * previous_rows >= 3 * previous_baseline AND 2 * rows_seen >= 3 * previous_baseline").select("collector", "osi_layer", "day_id", "rows_seen", "previous_rows", "previous_baseline")
