"""Detections, chains, keyed tables and sequences over the event stream and the star schema, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import trackers
from lodestream.operators.trackers import DAY, HOUR
from lodestream.plans import searches
from lodestream.plans.catalog import E, events, query
from lodestream.session import load

W12 = 12 * HOUR
ROWS = "b.entity = a.entity AND (b.t < a.t OR (b.t = a.t AND b.seq <= a.seq))"
#: SQL of the scored stream that rules look at.
SCORED = f"""p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS k, (t // {HOUR}) % 24 AS hour FROM e),
 d AS (SELECT a.seq, count(DISTINCT b.v) AS distinct_n FROM p a JOIN p b ON {ROWS} AND b.t > a.t - {W12} GROUP BY a.seq),
 r AS (SELECT a.seq, count(*) FILTER (WHERE b.v = 'error') AS num, count(*) AS den FROM p a JOIN p b ON {ROWS} AND b.t > a.t - {DAY} GROUP BY a.seq),
 l AS (SELECT a.seq, max(b.k) AS last_ok FROM p a JOIN p b ON a.entity = b.entity AND b.k < a.k AND b.v <> 'error' GROUP BY a.seq),
 n AS (SELECT a.seq, count(*) AS att FROM p a JOIN p b ON {ROWS} AND b.t > a.t - {5 * DAY} GROUP BY a.seq),
 h AS (SELECT a.seq, (SELECT count(*) FROM p b WHERE b.entity = a.entity AND b.t < a.t) AS hn, (SELECT count(*) FROM p b WHERE b.entity = a.entity AND b.t < a.t AND b.hour = a.hour) AS hc FROM p a),
 scored AS (SELECT p.*, distinct_n, CASE WHEN den >= 3 THEN num / den END AS ratio, least(k - 1 - coalesce(last_ok, 0), att - 1) AS run, -log2((hc + 1) / (hn + 24)) AS bits, hn >= 32 AS mature
  FROM p JOIN d USING (seq) JOIN r USING (seq) LEFT JOIN l USING (seq) JOIN n USING (seq) JOIN h USING (seq)),
 risk AS (SELECT seq, entity, t, 'R-D-L7-001' AS rule_id, 7 AS layer, 40.0::DOUBLE AS risk_score FROM scored WHERE v = 'error' AND x > 30
  UNION ALL SELECT seq, entity, t, 'R-D-L5-001', 5, 25.0 FROM scored WHERE v <> 'error' AND run > 0 AND run >= 2
  UNION ALL SELECT seq, entity, t, 'R-B-L3-001', 3, 30.0 FROM scored WHERE distinct_n >= 4
  UNION ALL SELECT seq, entity, t, 'R-B-L7-002', 7, 20.0 FROM scored WHERE ratio >= 0.5
  UNION ALL SELECT seq, entity, t, 'R-P-L5-001', 5, 35.0 FROM scored WHERE bits >= 5.5 AND mature)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the features of the trackers; all of them partition by entity."""
    df = trackers.distinct_window(events(spark, sf_dir), "v", W12)
    df = trackers.ratio_window(df, F.col("v") == "error", DAY, 3)
    df = trackers.outcome_run(df, F.col("v") != "error", 5 * DAY)
    df = trackers.cyclic_histogram(df, F.pmod(F.floor(F.col("t") / HOUR), F.lit(24)), 24)
    return df.withColumnRenamed("v", "event_type").withColumnRenamed("x", "value")


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.raise_rules(scored(spark, sf_dir)).select("seq", "entity", "t", "rule_id", "layer", "risk_score")


@query(f"WITH {E}, {SCORED} SELECT seq, entity, rule_id, CAST(layer AS INT) AS layer, risk_score FROM risk")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir).select("seq", "entity", "rule_id", "layer", "risk_score")


@query(f"""WITH {E}, {SCORED}, m AS (SELECT entity, t // {DAY} AS window_id, rule_id, layer, max(risk_score) AS s, min(t) AS a, max(t) AS b FROM risk GROUP BY ALL)
 SELECT entity, window_id, sum(s) AS risk, count(DISTINCT layer) AS layers, string_agg(DISTINCT rule_id, ';' ORDER BY rule_id) AS rules, min(a) AS first_t, max(b) AS last_t, count(DISTINCT layer) >= 2 AS cross_layer FROM m GROUP BY entity, window_id""")
def chain_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.assemble_chains(risks(spark, sf_dir), "entity", DAY)


@query(f"""WITH {E}, {SCORED} SELECT entity, sum(risk_score) AS total, count(DISTINCT rule_id) AS rules, max(t) AS latest FROM risk WHERE entity % 10 <> 3 GROUP BY entity""")
def risk_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = events(spark, sf_dir).where("entity % 10 = 3").select("entity").distinct()
    own = searches.suppress(risks(spark, sf_dir), allowed, "entity")
    return searches.stats(own, ["entity"], total=F.sum("risk_score"), rules=F.countDistinct("rule_id"), latest=F.max("t"))


@query(f"""WITH {E} SELECT a.entity, a.t AS first_t, b.t AS second_t, a.seq AS first_seq, b.seq AS second_seq FROM e a JOIN e b ON a.entity = b.entity AND a.v = 'signup' AND b.v = 'purchase' AND b.t > a.t AND b.t - a.t <= {DAY}""")
def lateral_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return searches.sequence_join(df.where("v = 'signup'"), df.where("v = 'purchase'"), "entity", DAY)


@query(f"""WITH {E}, s AS (SELECT a.entity, a.seq AS s1, b.seq AS s2, c.seq AS s3 FROM e a JOIN e b ON a.entity = b.entity AND a.v = 'error' AND b.v = 'click' AND b.t > a.t AND b.t - a.t <= {DAY}
  JOIN e c ON c.entity = b.entity AND c.v = 'purchase' AND c.t > b.t AND c.t - b.t <= {DAY})
 SELECT entity, count(*) AS chains, min(s1) AS first_seq, max(s3) AS last_seq FROM s GROUP BY entity""")
def three_step_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    one = searches.sequence_join(df.where("v = 'error'"), df.where("v = 'click'"), "entity", DAY)
    two = one.select("entity", F.col("second_t").alias("t"), F.col("second_seq").alias("seq"), F.col("first_seq").alias("s1"))
    # the middle step joins back by its own number
    last = searches.sequence_join(two.select("entity", "t", "seq").distinct(), df.where("v = 'purchase'"), "entity", DAY)
    both = last.join(two.select(F.col("seq").alias("first_seq"), "s1"), "first_seq")
    return both.groupBy("entity").agg(F.count("*").alias("chains"), F.min("s1").alias("first_seq"), F.max("second_seq").alias("last_seq"))


@query(f"""WITH {E} SELECT seq, lag(v) OVER w AS previous_v, lag(x) OVER w AS previous_x FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, seq)""")
def stream_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.streamstats_last(events(spark, sf_dir), ["entity"], ["t", "seq"], previous_v="v", previous_x="x").select("seq", "previous_v", "previous_x")


@query(f"""WITH {E}, b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY entity, v ORDER BY t DESC, seq DESC) = 1) SELECT entity, v, seq, x FROM b""")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.dedup(events(spark, sf_dir), ["entity", "v"], [F.desc("t"), F.desc("seq")]).select("entity", "v", "seq", "x")


@query(f"""WITH {E}, a AS (SELECT entity AS k, max(t) AS seen, arg_max(v, t) AS v FROM e WHERE seq % 2 = 0 GROUP BY entity), b AS (SELECT entity AS k, max(t) AS seen, arg_max(v, t) AS v FROM e WHERE seq % 2 = 1 GROUP BY entity),
 u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT k, max(seen) AS seen, arg_max(v, seen) AS v FROM u GROUP BY k HAVING max(seen) >= 1705900000000000000""")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda r: events(spark, sf_dir).where(f"seq % 2 = {r}").groupBy(F.col("entity").alias("k")).agg(F.max("t").alias("seen"), F.max_by("v", "t").alias("v"))
    return searches.expire(searches.upsert(half(0), half(1), "k", "seen"), "seen", 1705900000000000000)


@query(f"""WITH {E} SELECT e.seq, s.s_name AS owner FROM e LEFT JOIN (SELECT s_suppkey, min(s_name) AS s_name FROM supplier GROUP BY s_suppkey) s ON s.s_suppkey = e.entity""")
def lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("owner"))
    return searches.lookup(events(spark, sf_dir), owners, "entity", ["owner"]).select("seq", "owner")


@query(f"""WITH {E} SELECT seq FROM e WHERE entity IN (SELECT entity FROM e WHERE v = 'error' AND x > 60)""")
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return searches.watched(df, df.where("v = 'error' AND x > 60"), "entity").select("seq")


@query(f"""WITH {E} SELECT t // 300000000000 AS window_id, v, max(x) AS peak, count(DISTINCT entity) AS entities, string_agg(DISTINCT entity::VARCHAR, ';' ORDER BY entity::VARCHAR) AS who FROM e GROUP BY ALL""")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("window_id", F.floor(F.col("t") / 300000000000).cast("long"))
    return searches.stats(df, ["window_id", "v"], peak=F.max("x"), entities=F.countDistinct("entity"), who=searches.values("entity"))


@query("""WITH o AS (SELECT c.c_custkey, c.c_mktsegment, o.o_orderkey, o.o_orderdate FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey)
 SELECT c_mktsegment, count(*) AS shipped_soon, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate AND l.l_shipdate <= o.o_orderdate + INTERVAL 400 DAY GROUP BY c_mktsegment""")
def order_to_shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), F.col("c_custkey") == F.col("o_custkey"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_discount")
    soon = (F.col("l_shipdate") > F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 400 DAY"))
    joined = orders.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & soon)
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("shipped_soon"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS rows FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("rows"))
