"""Merges, stamps, thresholds, rhythms and captured packets over the event stream, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import context, intervals, schema, stamps, thresholds, timeseries
from lodestream.plans.catalog import E, events, query
from lodestream.session import load
from lodestream.sources import captures, wire
from lodestream.streaming.merge import release_schedule

HOUR = 3_600_000_000_000

#: SQL for both engines: events as a topic of four partitions that come in batches; some offsets are delivered again, some rows come late, some have no time.
TOPIC = "seq, seq % 4 AS part, CASE WHEN seq % 97 = 0 THEN seq - 40 ELSE seq END AS off, cast(floor(seq / 500.0) AS bigint) + CASE WHEN seq % 4 = 3 THEN 2 ELSE 0 END AS batch, CASE WHEN seq % 211 > 0 THEN t END AS moment"


@query(f"""WITH {E}, k AS (SELECT {TOPIC} FROM e), a AS (SELECT *, batch * 1000000 + seq AS arrival FROM k),
 o AS MATERIALIZED (SELECT * FROM (SELECT *, max(off) OVER (PARTITION BY part ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed FROM a) WHERE passed IS NULL OR off > passed),
 b AS (SELECT DISTINCT batch FROM o), f AS (SELECT b.batch, part, max(moment) AS front FROM b JOIN o ON o.batch <= b.batch WHERE moment IS NOT NULL GROUP BY ALL),
 w AS (SELECT batch, CASE WHEN count(*) >= 4 THEN min(front) END AS w FROM f GROUP BY batch), r AS MATERIALIZED (SELECT batch, max(w) OVER (ORDER BY batch) AS through FROM w)
 SELECT seq, coalesce(moment < (SELECT through FROM r WHERE r.batch = o.batch - 1), false) AS late, CASE WHEN moment IS NULL THEN batch ELSE (SELECT min(r.batch) FROM r WHERE r.batch >= o.batch AND r.through > moment) END AS released_in FROM o""")
def partition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the least frontier lets each row go."""
    df = events(spark, sf_dir).selectExpr(*TOPIC.split(", ")).withColumn("arrival", F.col("batch") * 1_000_000 + F.col("seq"))
    out = release_schedule(df.withColumnRenamed("seq", "event"), "part", "off", "batch", "moment", "arrival", expected=4)
    return out.select(F.col("event").alias("seq"), "late", "released_in")


def _sum_of(at: int, prime: int) -> str:
    return f"CAST(sum(CAST('0x' || substr(d, {at}, 15) AS HUGEINT)) % {prime} AS VARCHAR)"


@query(f"""WITH {E}, h AS (SELECT entity % 10 AS shard, sha256(concat_ws(chr(31), '=' || seq, '=' || v, coalesce('=' || CASE WHEN seq % 7 > 0 THEN t END, '-'))) AS d FROM e)
 SELECT shard, count(*) AS rows, sha256(concat_ws(':', count(*), {_sum_of(1, stamps.MODULI[0])}, {_sum_of(16, stamps.MODULI[1])})) AS fingerprint FROM h GROUP BY shard""")
def window_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each shard's rows, whatever their order."""
    df = events(spark, sf_dir).withColumns({"shard": F.col("entity") % 10, "moment": F.when(F.col("seq") % 7 > 0, F.col("t"))})
    return stamps.window_fingerprint(df, ["shard"], ["seq", "v", "moment"])


@query(f"""WITH {E}, r AS (SELECT seq, entity, CASE seq % 3 WHEN 0 THEN 'Host-' || entity || '.Corp.Example' WHEN 1 THEN 'host-' || entity END AS hostname, CASE WHEN seq % 5 = 0 THEN ' held-' || v || ' ' WHEN seq % 5 = 1 THEN '' END AS held, entity % 4 AS window_id FROM e)
 SELECT seq, 7 AS osi_layer, CASE WHEN seq % 5 = 0 THEN trim(held) WHEN hostname IS NOT NULL THEN lower(hostname) || ':' || entity END AS entity_key, 'numeric' AS determinism_tier, 'abc' AS config_hash,
 CASE WHEN entity % 3 = 0 AND window_id < 3 THEN 'm' || entity WHEN window_id < 2 THEN 'fallback' || window_id END AS model_version, CASE WHEN window_id < 2 OR (entity % 3 = 0 AND window_id < 3) THEN NOT (entity % 3 = 0 AND window_id < 3) END AS model_fallback FROM r""")
def envelope_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer and subject of each row, and the model it is scored against."""
    host = F.expr("CASE seq % 3 WHEN 0 THEN concat('Host-', entity, '.Corp.Example') WHEN 1 THEN concat('host-', entity) END")
    df = events(spark, sf_dir).withColumns({"hostname": host, "entity_key": F.expr("CASE WHEN seq % 5 = 0 THEN concat(' held-', v, ' ') WHEN seq % 5 = 1 THEN '' END"), "window_id": F.col("entity") % 4})
    out = stamps.stamp_envelope(df, 7, ["hostname", "entity"])
    own = events(spark, sf_dir).where("entity % 3 = 0").select(F.col("entity").cast("string").alias("entity")).distinct()
    models = own.select("entity", (F.col("entity").cast("long") % 4).alias("window_id"), F.concat(F.lit("m"), "entity").alias("model_version")).where("window_id < 3")
    rest = spark.createDataFrame([(None, w, f"fallback{w}") for w in (0, 1)], "entity string, window_id long, model_version string")
    out = stamps.stamp_determinism(out, "numeric", {"config_hash": "abc"}, models.unionByName(rest), "entity")
    return out.select("seq", "osi_layer", "entity_key", "determinism_tier", "config_hash", "model_version", "model_fallback")


@query(f"""WITH {E}, n AS (SELECT v, x, row_number() OVER (PARTITION BY v ORDER BY x) AS k, count(*) OVER (PARTITION BY v) AS samples FROM e WHERE x IS NOT NULL)
 SELECT v, samples, min(x) FILTER (k >= ceil(0.99 * samples)) AS above, min(x) FILTER (k >= ceil(0.01 * samples)) AS below FROM n GROUP BY v, samples""")
def rule_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that the period proposes for rules that fire above and below them."""
    df = events(spark, sf_dir)
    one = lambda fires: thresholds.derive_thresholds(df, ["v"], F.col("x"), fires, 0.99).withColumnRenamed("threshold", fires)
    return one("above").join(one("below").drop("samples"), "v")


@query()
def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of bins that don't fit their user's rhythm; held against a transform written out in the tests."""
    raw = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return timeseries.time_series_anomalies(raw, "user_id", "ts", hot_start=True, threshold=4.0).select(F.col("event_id").alias("seq"), "ts_anomaly")


def _hex(value: Column | str | int, n: int) -> Column:
    return F.lpad(F.hex(value if isinstance(value, Column) else F.expr(str(value)).cast("long")), 2 * n, "0")


def _frame(protocol: int, src: Column, dst: Column, transport: Column, vlan: Column) -> Column:
    """A frame of Ethernet and IPv4 around a transport's bytes in hexadecimal."""
    total = F.length(transport) / 2 + 20
    tag = F.when(vlan, F.lit("81000007")).otherwise(F.lit(""))
    return F.unhex(F.concat(F.lit("00" * 12), tag, F.lit("08004500"), _hex(total.cast("long"), 2), F.lit("0000000040"), F.lit(f"{protocol:02x}"), F.lit("0000"), src, dst, transport))


@query(f"""WITH {E} SELECT seq, t AS received_ns, '10.0.' || (entity % 200) || '.' || (seq % 250) AS src, '192.0.2.' || (seq % 90) AS dst, 1024 + seq % 5000 AS sport, 443 AS dport, CAST(CASE WHEN seq % 3 = 0 THEN 17 ELSE 6 END AS INTEGER) AS protocol,
 CASE WHEN seq % 3 > 0 THEN 2 + 16 * (seq % 2) END AS flags, CASE WHEN seq % 3 > 0 THEN 8192 + seq % 100 END AS window, CASE WHEN seq % 3 = 1 THEN 'mss,nop,ws,sok,eol' END AS options, CASE WHEN seq % 3 = 1 THEN 1200 + seq % 200 END AS mss, seq % 9 AS data_len FROM e""")
def captured_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets with options, payloads and tags, and back."""
    ports, payload = F.concat(_hex("1024 + seq % 5000", 2), F.lit("01BB")), F.expr("repeat('AB', cast(seq % 9 AS int))")
    # options: segment size, padding, scale, selective acknowledgement, end
    options = F.when(F.col("seq") % 3 == 1, F.concat(F.lit("0204"), _hex("1200 + seq % 200", 2), F.lit("01" + "030307" + "0402" + "0000"))).otherwise("")
    words = F.when(F.col("seq") % 3 == 1, "80").otherwise("50")  # 32 or 20 bytes of header
    tcp = F.concat(ports, F.lit("00" * 8), words, _hex("2 + 16 * (seq % 2)", 1), _hex("8192 + seq % 100", 2), F.lit("00000000"), options)
    udp = F.concat(ports, F.lit("00000000"))
    transport = F.concat(F.when(F.col("seq") % 3 == 0, udp).otherwise(tcp), payload)
    src, dst = F.concat(F.lit("0A00"), _hex("entity % 200", 1), _hex("seq % 250", 1)), F.concat(F.lit("C00002"), _hex("seq % 90", 1))
    frame = F.when(F.col("seq") % 3 == 0, _frame(17, src, dst, transport, F.col("seq") % 4 == 0)).otherwise(_frame(6, src, dst, transport, F.col("seq") % 4 == 0))
    frames = events(spark, sf_dir).select(F.lit("events").alias("path"), F.col("seq").alias("offset"), F.col("t").alias("received_ns"), frame.alias("frame"))
    return captures.packets(frames).drop("path").withColumnRenamed("offset", "seq")


@query(f"""WITH {E} SELECT seq, t AS received_ns, 1 + seq % 2 AS operation, '02:00:00:00:' || lpad(printf('%x', entity % 250), 2, '0') || ':01' AS sha, '10.3.0.' || (entity % 250) AS spa, '02:00:00:00:ab:' || lpad(printf('%x', seq % 200), 2, '0') AS tha, '10.3.1.' || (seq % 200) AS tpa FROM e WHERE seq % 5 > 0""")
def captured_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as address-resolution packets, some tagged, some for other hardware."""
    kind = F.when(F.col("seq") % 5 > 0, "0001").otherwise("0006")
    sender, target = F.concat(F.lit("02000000"), _hex("entity % 250", 1), F.lit("01"), F.lit("0A0300"), _hex("entity % 250", 1)), F.concat(F.lit("02000000AB"), _hex("seq % 200", 1), F.lit("0A0301"), _hex("seq % 200", 1))
    tag = F.when(F.col("seq") % 3 == 0, "81000009").otherwise("")
    frame = F.unhex(F.concat(F.lit("FF" * 12), tag, F.lit("0806"), kind, F.lit("08000604"), _hex("1 + seq % 2", 2), sender, target))
    frames = events(spark, sf_dir).select(F.lit("events").alias("path"), F.col("seq").alias("offset"), F.col("t").alias("received_ns"), frame.alias("frame"))
    return captures.address_packets(frames).drop("path").withColumnRenamed("offset", "seq")


@query(f"""WITH {E}, m AS (SELECT seq, t, entity % 5 AS x, entity, seq % 40 = 0 AS announces FROM e)
 SELECT seq, t AS received_ns, '10.9.0.' || x AS exporter_address, 3 AS observation_domain_id, 1700000000 + seq AS export_time, '10.1.' || (entity % 250) || '.1' AS source, '10.2.0.' || (seq % 200) AS destination, 1000 * seq AS octets, 7 + seq AS packets, seq % 6 AS reverse_octets
 FROM m WHERE seq % 11 > 0 AND EXISTS (SELECT 1 FROM m b WHERE b.x = m.x AND b.announces AND b.seq % 11 > 0 AND b.seq <= m.seq)""")
def captured_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flow messages of five exporters; templates come now and then, data before the first one is skipped, and messages of another version are refused."""
    template = F.lit("0002" + f"{4 + 4 + 5 * 4 + 4:04x}" + "01000005" + "00080004" + "000C0004" + "00010004" + "00020008" + "80010002" + f"{captures.REVERSE:08x}")
    data = F.concat(F.lit("0100" + f"{4 + 22:04x}"), F.lit("0A01"), _hex("entity % 250", 1), F.lit("01"), F.lit("0A0200"), _hex("seq % 200", 1), _hex("1000 * seq", 4), _hex("7 + seq", 8), _hex("seq % 6", 2))
    sets = F.concat(F.when(F.col("seq") % 40 == 0, template).otherwise(""), data)
    version = F.when(F.col("seq") % 11 > 0, "000A").otherwise("0009")
    message = F.concat(version, _hex((F.length(sets) / 2 + 16).cast("long"), 2), _hex("1700000000 + seq", 4), F.lit("00000000" + "00000003"), sets)
    udp = F.concat(F.lit("1000" + f"{captures.FLOW_PORT:04x}"), _hex((F.length(message) / 2 + 8).cast("long"), 2), F.lit("0000"), message)
    frame = _frame(17, F.concat(F.lit("0A0900"), _hex("entity % 5", 1)), F.lit("0A090064"), udp, F.col("seq") % 2 == 0)
    frames = events(spark, sf_dir).select(F.lit("events").alias("path"), F.col("seq").alias("offset"), F.col("t").alias("received_ns"), frame.alias("frame"))
    records, _ = captures.flow_records(captures.flow_sets(captures.flow_messages(frames)))
    return records.select((F.floor(F.col("seq") / captures.SETS_A_MESSAGE)).alias("seq"), "received_ns", "exporter_address", "observation_domain_id", "export_time", F.col("sourceIPv4Address").alias("source"), F.col("destinationIPv4Address").alias("destination"), F.col("octetDeltaCount").alias("octets"), F.col("packetDeltaCount").alias("packets"), F.col("reverseOctetDeltaCount").alias("reverse_octets"))


#: SQL for both engines: leases that overlap, some open, and machines of the leased interfaces.
LEASES = {"ip": "concat('ip', cast(entity % 40 AS string))", "start_ns": "t", "end_ns": "CASE WHEN seq % 5 > 0 THEN t + (seq % 90) * 3600000000000 END", "mac": "CASE WHEN seq % 13 > 0 THEN concat('mac', cast(seq % 60 AS string)) END"}
MACHINES = {"mac": "concat('mac', cast(seq % 50 AS string))", "start_ns": "t", "end_ns": "CASE WHEN seq % 7 > 0 THEN t + (seq % 60) * 86400000000000 END", "hostname": "concat('host', cast(seq % 30 AS string))"}


def _shown(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


@query(f"""WITH {E}, l AS (SELECT {', '.join(_shown(LEASES))} FROM e WHERE seq % 4 = 1), n AS (SELECT {', '.join(_shown(MACHINES))} FROM e WHERE seq % 9 = 2), r AS (SELECT seq, t, 'ip' || (seq % 45) AS src_ip FROM e),
 a AS (SELECT r.seq, arg_max(struct_pack(m := mac), (start_ns, coalesce(end_ns, {(1 << 63) - 1}), mac)) AS b FROM r JOIN l ON ip = src_ip AND start_ns <= t AND (end_ns IS NULL OR t < end_ns) GROUP BY r.seq),
 k AS (SELECT r.*, b.m AS host_mac, b IS NOT NULL AS leased FROM r LEFT JOIN a USING (seq)),
 c AS (SELECT k.seq, arg_max(hostname, (start_ns, coalesce(end_ns, {(1 << 63) - 1}), hostname)) AS host_key FROM k JOIN n ON n.mac = k.host_mac AND start_ns <= t AND (end_ns IS NULL OR t < end_ns) GROUP BY k.seq)
 SELECT seq, host_mac, CASE WHEN leased THEN 'soft:lease' ELSE 'unresolved' END AS lease_method, host_key, CASE WHEN host_key IS NOT NULL THEN 'soft:inventory' ELSE 'unresolved' END AS inventory_method,
 coalesce(host_key, src_ip) AS chain_anchor, CASE WHEN host_key IS NULL THEN 'src_ip' ELSE 'host_key' END AS chain_anchor_source FROM k LEFT JOIN c USING (seq)""")
def host_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine behind each event's address when it happened."""
    df = events(spark, sf_dir)
    leases, machines = (df.where(w).selectExpr(*_shown(e)) for w, e in (("seq % 4 = 1", LEASES), ("seq % 9 = 2", MACHINES)))
    rows = df.select("seq", "t", F.concat(F.lit("ip"), (F.col("seq") % 45).cast("string")).alias("src_ip"))
    out = intervals.host_identity(rows, leases, machines)
    return out.select("seq", "host_mac", "lease_method", "host_key", "inventory_method", "chain_anchor", "chain_anchor_source")



#: SQL for both engines: memberships that begin, end and are retracted, some recorded late, some not to be used.
MEMBER = {
    "entity": "CASE WHEN seq % 31 > 0 THEN cast(entity AS string) END", "member": "concat('g', cast(seq % 4 AS string))", "valid_from": "CASE WHEN seq % 37 > 0 THEN t END", "valid_to": "CASE seq % 5 WHEN 0 THEN t + 432000000000000 WHEN 1 THEN t - 5 END",
    "recorded_at": "t + (seq % 3) * 3600000000000", "change": "CASE seq % 6 WHEN 0 THEN 'retract' WHEN 1 THEN 'maybe' WHEN 2 THEN 'Assert' END",
}


@query(f"""WITH {E}, r AS (SELECT seq, {', '.join(_shown(MEMBER))} FROM e WHERE seq % 2 = 0)
 SELECT seq, entity AS context_entity, CASE WHEN entity IS NULL THEN 'no_entity' WHEN valid_from IS NULL THEN 'no_valid_from' WHEN valid_to <= valid_from THEN 'inverted_interval' WHEN change = 'maybe' THEN 'unknown_change' END AS context_refused,
 CASE WHEN entity IS NULL OR valid_from IS NULL OR valid_to <= valid_from OR change = 'maybe' THEN NULL ELSE entity || chr(31) || member END AS context_key, coalesce(lower(change), 'assert') AS change, valid_from, valid_to FROM r""")
def context_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as versions, or why not."""
    return _versions(events(spark, sf_dir).where("seq % 2 = 0")).select(F.col("number").cast("long").alias("seq"), "context_entity", "context_refused", "context_key", "change", "valid_from", "valid_to")


def _versions(df: DataFrame) -> DataFrame:
    rows = df.selectExpr("seq", *_shown(MEMBER))
    return context.context_columns(rows, F.lit("group"), F.col("entity"), [F.col("member")], {"member": F.col("member"), "number": F.col("seq")}, F.col("valid_from"), F.col("valid_to"), F.col("recorded_at"), F.col("change"))


@query(f"""WITH {E}, r AS (SELECT seq, {', '.join(_shown(MEMBER))} FROM e WHERE seq % 2 = 0),
 v AS (SELECT entity, member, valid_from, coalesce(valid_to, {(1 << 63) - 1}) AS valid_to, recorded_at, coalesce(lower(change), 'assert') AS change FROM r WHERE entity IS NOT NULL AND valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from) AND change IS DISTINCT FROM 'maybe'),
 h AS (SELECT e.seq, member, arg_max(change, (recorded_at, valid_from, valid_to, change)) AS state FROM e JOIN v ON v.entity = CAST(e.entity AS VARCHAR) AND greatest(valid_from, recorded_at) <= t AND t < valid_to GROUP BY e.seq, member)
 SELECT e.seq, coalesce((SELECT string_agg(member, ';' ORDER BY member) FROM h WHERE h.seq = e.seq AND state = 'assert'), '') AS ctx_groups FROM e""")
def context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that each event's entity was in, as recorded by then."""
    df = events(spark, sf_dir)
    v = _versions(df.where("seq % 2 = 0")).where("context_refused IS NULL")
    return context.memberships(df.withColumn("context_entity", F.col("entity").cast("string")), v, "context_entity", "member", "ctx_groups").select("seq", "ctx_groups")


WIRE = wire.Contract("events:own", "event_time", ("event_time", "ingest_time"), ("seq", "entity"), (("v",), ("x", "y")))


@query(f"""WITH {E}, r AS (SELECT seq, entity, CASE WHEN seq % 3 > 0 THEN v END AS v, strftime(make_timestamp(t // 1000), '%Y-%m-%dT%H:%M:%S.%fUTC') AS a, strftime(make_timestamp((t + 1999) // 1000), '%Y-%m-%dT%H:%M:%S.%fUTC') AS b FROM e WHERE seq % 17 > 0)
 SELECT '<<"seq":' || seq || ',"entity":' || entity || coalesce(',"v":"' || v || '"', '') || ',"event_time":"' || a || '","ingest_time":"' || b || '">>' AS line FROM r""".replace("<<", "{").replace(">>", "}"))
def wire_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they are delivered: moments as text, no nulls, none without its time."""
    df = events(spark, sf_dir).select("seq", "entity", F.when(F.col("seq") % 3 > 0, F.col("v")).alias("v"), F.when(F.col("seq") % 17 > 0, F.col("t")).alias("event_time"), (F.col("t") + 1999).alias("ingest_time"))
    return wire.to_lines(wire.to_wire(df, WIRE))


@query(f"""WITH {E} SELECT 'seq;v;x' AS line UNION ALL SELECT seq || ';' || CASE WHEN seq % 5 = 0 THEN '"a;b"' ELSE v END || ';' || (seq % 9) FROM e""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("seq", F.when(F.col("seq") % 5 == 0, "a;b").otherwise(F.col("v")).alias("v"), (F.col("seq") % 9).alias("x"))
    return wire.to_csv_lines(df, sep=";")


@query(f"""WITH {E}, r AS (SELECT seq, x AS a, CASE seq % 4 WHEN 0 THEN x * 1.004 WHEN 1 THEN x + 0.0005 WHEN 2 THEN x * 1.02 + 0.1 ELSE x END AS b, seq % 6 > 0 AS there, seq % 7 = 0 AS other FROM e)
 SELECT count(*) AS total_rows, count(*) FILTER (there AND NOT other AND coalesce(abs(a - b) <= 0.001 + 0.005 * abs(b), a IS NULL AND b IS NULL)) AS matching_rows, count(*) - count(*) FILTER (there AND NOT other AND coalesce(abs(a - b) <= 0.001 + 0.005 * abs(b), a IS NULL AND b IS NULL)) AS diff_rows FROM r""")
def compare_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against a frame that lacks some, and differs a little or more."""
    df = events(spark, sf_dir).select("seq", "v", F.col("x").cast("double").alias("x"), F.lit(1).alias("only_left"))
    moved = F.expr("CASE seq % 4 WHEN 0 THEN x * 1.004D WHEN 1 THEN x + 0.0005D WHEN 2 THEN x * 1.02D + 0.1D ELSE x END")
    right = df.where("seq % 6 > 0").withColumns({"x": moved, "v": F.when(F.col("seq") % 7 == 0, "other").otherwise(F.col("v"))}).drop("only_left")
    return schema.compare_within(df, right, "seq")[1]
