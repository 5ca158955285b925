"""Scalar functions and the feature language over the tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lodestream.functions import identity, network, text
from lodestream.operators import schema
from lodestream.plans.catalog import E, events, query
from lodestream.session import load

#: SQL: an address made of an event's number, over many kinds of networks.
IPS = "i AS (SELECT seq, n, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS ip FROM (SELECT seq, (CASE seq % 8 WHEN 0 THEN 167772160 WHEN 1 THEN 2886729728 WHEN 2 THEN 3232235520 WHEN 3 THEN 2130706432 WHEN 4 THEN 2851995648 WHEN 5 THEN 3758096384 WHEN 6 THEN 1681915904 ELSE 134744072 END + seq * 7919 % 65000) AS n FROM e))"


def _ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = (167772160, 2886729728, 3232235520, 2130706432, 2851995648, 3758096384, 1681915904, 134744072)
    base = F.element_at(F.array(*(F.lit(b) for b in bases)).cast("array<long>"), (F.col("seq") % 8 + 1).cast("int"))
    df = events(spark, sf_dir).select("seq", (base + F.col("seq") * 7919 % 65000).alias("n"))
    return df.withColumn("ip", network.int_to_ip(F.col("n")))


@query(f"""WITH {E}, {IPS} SELECT seq, ip, n AS number, true AS valid,
 (n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183) AS private,
 NOT (n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183) AND NOT n BETWEEN 1681915904 AND 1686110207 AS global,
 n BETWEEN 2130706432 AND 2147483647 AS loopback, n BETWEEN 3758096384 AND 4026531839 AS multicast, n BETWEEN 2851995648 AND 2852061183 AS link_local,
 (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.0' AS network FROM i""")
def ip_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.col("ip")
    return _ips(spark, sf_dir).select("seq", "ip", network.ip_to_int(ip).alias("number"), network.is_ip(ip).alias("valid"), network.is_private(ip).alias("private"), network.is_global(ip).alias("global"), network.is_loopback(ip).alias("loopback"), network.is_multicast(ip).alias("multicast"), network.is_link_local(ip).alias("link_local"), network.network_of(ip, 24).alias("network"))


@query(f"""WITH {E} SELECT seq, (seq % 32 & 1) <> 0 AS fin, (seq % 32 & 2) <> 0 AS syn, (seq % 32 & 4) <> 0 AS rst, (seq % 32 & 8) <> 0 AS psh, (seq % 32 & 16) <> 0 AS ack FROM e""")
def tcp_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", *(c.alias(n) for n, c in network.tcp_flags(F.col("seq") % 32).items()))


@query(f"""WITH {E}, {IPS}, p AS (SELECT seq, n AS a, (n * 31 + 7) % 4294967296 AS b, 1024 + seq % 50000 AS sp, 80 + seq % 3 AS dp FROM i),
 o AS (SELECT seq, least(a, b) AS x, greatest(a, b) AS y, CASE WHEN a > b OR (a = b AND sp > dp) THEN dp ELSE sp END AS p, CASE WHEN a > b OR (a = b AND sp > dp) THEN sp ELSE dp END AS q FROM p)
 SELECT seq, '1:' || base64(unhex(sha1(unhex('0000' || printf('%08X', x) || printf('%08X', y) || '0600' || printf('%04X', p) || printf('%04X', q))))) AS community_id FROM o""")
def community_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _ips(spark, sf_dir).withColumns({"other": network.int_to_ip((F.col("n") * 31 + 7) % 4294967296), "sp": 1024 + F.col("seq") % 50000, "dp": 80 + F.col("seq") % 3})
    return df.select("seq", network.community_id(F.col("ip"), F.col("other"), F.lit(6), F.col("sp"), F.col("dp")).alias("community_id"))


@query(f"""WITH {E}, w AS (SELECT seq, v || '.' || entity || '.example.com' AS name FROM e),
 c AS (SELECT seq, name, unnest(string_split(name, '')) AS c FROM w), n AS (SELECT seq, any_value(name) AS name, c, count(*) AS k FROM c GROUP BY seq, c)
 SELECT seq, round(sum(k / length(name) * log2(length(name) / k)), 6) AS entropy, round(any_value(list_avg(list_transform(string_split(name, '.'), lambda p: length(p)))), 6) AS label_length FROM n GROUP BY seq""")
def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(".", "v", "entity", F.lit("example.com"))
    return events(spark, sf_dir).select("seq", F.round(text.shannon_entropy(name), 6).alias("entropy"), F.round(text.mean_label_length(name), 6).alias("label_length"))


SUFFIX_RULES = ("com", "uk", "co.uk", "*.ck", "!www.ck", "example.com")
NAMES = "['a.b.co.uk', 'www.ck', 'x.y.ck', 'shop.example.com', 'example.com', 'plain', 'Deep.Sub.Host.COM.']"


@query(f"""WITH {E}, n AS (SELECT seq, ({NAMES})[1 + seq % 7] AS name FROM e) SELECT seq, name,
 CASE name WHEN 'a.b.co.uk' THEN 'co.uk' WHEN 'www.ck' THEN 'ck' WHEN 'x.y.ck' THEN 'y.ck' WHEN 'shop.example.com' THEN 'example.com' WHEN 'example.com' THEN 'example.com' WHEN 'plain' THEN 'plain' ELSE 'com' END AS public_suffix,
 CASE name WHEN 'a.b.co.uk' THEN 'b.co.uk' WHEN 'www.ck' THEN 'www.ck' WHEN 'x.y.ck' THEN 'x.y.ck' WHEN 'shop.example.com' THEN 'shop.example.com' WHEN 'Deep.Sub.Host.COM.' THEN 'host.com' END AS registered_domain,
 CASE name WHEN 'a.b.co.uk' THEN 'a' WHEN 'Deep.Sub.Host.COM.' THEN 'deep.sub' END AS subdomain FROM n""")
def public_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("a.b.co.uk", "www.ck", "x.y.ck", "shop.example.com", "example.com", "plain", "Deep.Sub.Host.COM.")))
    df = events(spark, sf_dir).select("seq", F.element_at(names, (F.col("seq") % 7 + 1).cast("int")).alias("name"))
    return text.public_suffix(df, "name", spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string"))


AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0 Safari/537.36 Edg/120.0", "Mozilla/5.0 (Linux; Android 14) Chrome/119.0 Mobile Safari/537.36 EdgA/119.0", "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_1) Chrome/119.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) CriOS/119.0 Mobile Safari/604.1", "Mozilla/5.0 (iPad; CPU OS 17_1 like Mac OS X) FxiOS/120.0 Safari/605.1", "Mozilla/5.0 (X11; Ubuntu; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (X11; CrOS x86_64 14541) Chrome/119.0 Safari/537.36", "Mozilla/5.0 (compatible; Thing/2)", " curl/8.1", "python-requests/2.31", "(none)", "",
)
FAMILIES = ("edge", "edge", "chrome", "chrome", "firefox", "firefox", "chrome", "mozilla", "curl", "python-requests", None, None)
PLATFORMS = ("windows", "android", "macos", "ios", "ios", "linux", "chromeos", None, None, None, None, None)
PLATFORM_STACKS = ("windows", "linux", "darwin", "darwin", "darwin", "linux", "linux", None, None, None, None, None)


def _listed(names: tuple[str | None, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" if n is not None else "NULL" for n in names) + "]"


@query(f"""WITH {E} SELECT seq, ({_listed(FAMILIES)})[1 + seq % 12] AS family, ({_listed(PLATFORMS)})[1 + seq % 12] AS platform, ({_listed(PLATFORM_STACKS)})[1 + seq % 12] AS stack FROM e""")
def client_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of each browser and platform, and of tools."""
    agent = F.element_at(F.array(*(F.lit(n) for n in AGENTS)), (F.col("seq") % 12 + 1).cast("int"))
    platform = text.user_agent_os(agent)
    return events(spark, sf_dir).select("seq", text.user_agent_family(agent).alias("family"), platform.alias("platform"), text.stack_for(platform).alias("stack"))


@query(f"""WITH {E}, r AS (SELECT seq, (['  Host-A.Corp.Example. ', 'nan', '10.0.0.1', '', 'b', '7.0'])[1 + seq % 6] AS raw, entity, v FROM e)
 SELECT seq, (['Host-A.Corp.Example.', NULL, '10.0.0.1', NULL, 'b', '7'])[1 + seq % 6] AS plain, (['host-a', NULL, '10.0.0.1', NULL, 'b', '7'])[1 + seq % 6] AS host,
 CASE WHEN (seq % 6) IN (1, 3) THEN NULL ELSE entity || ':' || (['Host-A.Corp.Example.', NULL, '10.0.0.1', NULL, 'b', '7'])[1 + seq % 6] END AS entity_key,
 CAST(CAST(('0x' || substr(sha256(v || entity), 1, 16)) AS UBIGINT) % 16 AS INT) AS shard FROM r""")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*(F.lit(n) for n in ("  Host-A.Corp.Example. ", "nan", "10.0.0.1", "", "b", "7.0"))), (F.col("seq") % 6 + 1).cast("int"))
    df = events(spark, sf_dir).withColumn("raw", raw)
    plain = identity.normalize_text(F.col("raw"))
    return df.select("seq", plain.alias("plain"), identity.normalize_hostname(F.col("raw"), strip_domain=True).alias("host"), identity.compose_key(F.col("entity").cast("string"), plain).alias("entity_key"), identity.stable_shard(F.concat("v", "entity"), 16).alias("shard"))


@query(f"""WITH {E}, k AS (SELECT 'secret-key' AS k), p AS (SELECT seq, v, rpad('', 0, '') AS z FROM e)
 SELECT seq, substr(sha256(unhex('{"".join(f"{b ^ 0x5C:02x}" for b in b"secret-key".ljust(64, chr(0).encode()))}') || unhex(sha256(unhex('{"".join(f"{b ^ 0x36:02x}" for b in b"secret-key".ljust(64, chr(0).encode()))}') || encode(v)))), 1, 32) AS pseudonym FROM p""")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("seq", identity.pseudonymize(F.col("v"), b"secret-key").alias("pseudonym"))


@query(f"""WITH {E}, d AS (SELECT *, t // 86400000000000 AS day FROM e), z AS (
 SELECT seq, row_number() OVER (PARTITION BY entity, day ORDER BY t, seq) - 1 AS log_count,
 (SELECT count(DISTINCT b.v) FROM d b WHERE b.entity = a.entity AND b.day = a.day AND (b.t, b.seq) <= (a.t, a.seq)) AS kinds,
 entity AS user_id, v IN ('purchase') AS bought, v || '/' || entity AS label FROM d a)
 SELECT * FROM z WHERE NOT starts_with(label, 'error')""")
def feature_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("at", F.timestamp_micros((F.col("t") / 1000).cast("long")))
    df = df.withColumn("day", F.floor(F.col("t") / 86400000000000))
    wanted = schema.Schema(
        (
            schema.column("seq", "long"),
            schema.Feature("log_count", "long", lambda: F.row_number().over(_by_day()) - 1),
            schema.Feature("kinds", "long", lambda: F.size(F.collect_set("v").over(_by_day().rowsBetween(Window.unboundedPreceding, 0)))),
            schema.column("user_id", "long", "entity"),
            schema.boolean("bought", "v", ("purchase",), ("click", "view", "signup", "error")),
            schema.concatenated("label", ("v", "entity"), "/"),
        ),
        row_filter=lambda: ~F.col("label").startswith("error"),
    )
    return schema.apply_schema(df, wanted)


def _by_day() -> WindowSpec:
    return Window.partitionBy("entity", "day").orderBy("t", "seq")


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'left' WHEN a.o_orderkey IS NULL THEN 'right' ELSE 'both' END AS side
 FROM (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 <> 0) b ON a.o_orderkey = b.o_orderkey
 WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.s <> b.s""")
def compare_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    left = orders.where("o_orderkey % 3 <> 0")
    right = orders.where("o_orderkey % 4 <> 0").withColumn("s", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("s")))
    return schema.compare(left, right, "o_orderkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def projection_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.select_by_pattern(schema.drop_null(load(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment"), "^c_(custkey|name)$")


@query(f"""WITH {E} SELECT seq, x > 20 AS is_high, x % 10 > 5 AS is_odd, round(x / 100, 6) AS s_high, round((x % 10) / 10, 6) AS s_odd FROM e""")
def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("seq", F.array(F.col("x") / 100, (F.col("x") % 10) / 10).alias("p"), F.array(F.when(F.col("x") > 20, 1.0).otherwise(0.0), F.when(F.col("x") % 10 > 5, 1.0).otherwise(0.0)).alias("q"))
    out = schema.add_scores(schema.add_classes(df, "q", ["high", "odd"], 0.5, "is_"), "p", ["high", "odd"], "s_")
    return out.select("seq", "is_high", "is_odd", F.round("s_high", 6).alias("s_high"), F.round("s_odd", 6).alias("s_odd"))


@query("""SELECT event_id AS seq, CAST(ts AS DATE) AS day, row_number() OVER w - 1 AS logcount, count(DISTINCT event_type) OVER w AS appincrement,
    count(DISTINCT CAST(floor(value / 10) AS BIGINT)) OVER w AS locincrement
    FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sources: rows, applications and places of a user's day so far."""
    raw = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = schema.daily_counters(raw, "user_id", "ts", "event_id", {"appincrement": F.col("event_type"), "locincrement": F.floor(F.col("value") / 10)})
    return out.select(F.col("event_id").alias("seq"), "day", "logcount", "appincrement", "locincrement")


@query(f"""WITH {E}, a AS (SELECT seq, 'FE80' || repeat('0', 20) || printf('%04X', 1 + seq % 9) || printf('%04X', entity % 300) AS x, 'FE80' || repeat('0', 20) || printf('%04X', 5) || printf('%04X', seq % 300) AS y, 'fe80::' || printf('%x', 1 + seq % 9) || ':' || printf('%x', entity % 300) AS xt,
 CASE seq % 4 WHEN 0 THEN 6 WHEN 1 THEN 58 WHEN 2 THEN 58 ELSE 50 END AS proto, CASE seq % 4 WHEN 0 THEN 1024 + seq % 77 WHEN 1 THEN 128 + seq % 2 WHEN 2 THEN 3 END AS p, CASE seq % 4 WHEN 0 THEN 1060 WHEN 1 THEN 0 WHEN 2 THEN seq % 5 END AS q FROM e),
 b AS (SELECT *, CASE WHEN proto = 58 AND p >= 128 THEN 257 - p ELSE q END AS r, proto = 58 AND p < 128 AS one_way FROM a), c AS (SELECT *, NOT one_way AND (x > y OR (x = y AND coalesce(p > r, false))) AS swap FROM b)
 SELECT seq, xt AS source, '1:' || base64(unhex(sha1(unhex('0001' || CASE WHEN swap THEN y || x ELSE x || y END || printf('%02X', proto) || '00' || coalesce(CASE WHEN swap THEN printf('%04X', r) || printf('%04X', p) ELSE printf('%04X', p) || printf('%04X', r) END, ''))))) AS community_id FROM c""")
def community_id_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of IPv6 with ports, messages that answer each other, messages that don't, and a protocol without ports."""
    low = lambda e: F.lower(F.hex(F.expr(e).cast("long")))
    df = events(spark, sf_dir).withColumns({"source": F.concat(F.lit("fe80::"), low("1 + seq % 9"), F.lit(":"), low("entity % 300")), "target": F.concat(F.lit("FE80:0:0:0:0:0:5:"), low("seq % 300"))})
    proto = F.expr("CASE seq % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'icmp6' WHEN 2 THEN '58' ELSE '50' END")
    sport, dport = F.expr("CASE seq % 4 WHEN 0 THEN 1024 + seq % 77 WHEN 1 THEN 128 + seq % 2 WHEN 2 THEN 3 END"), F.expr("CASE seq % 4 WHEN 0 THEN 1060 WHEN 1 THEN 0 WHEN 2 THEN seq % 5 END")
    return df.select("seq", "source", network.community_id(F.col("source"), F.col("target"), proto, sport, dport, seed=1).alias("community_id"))
