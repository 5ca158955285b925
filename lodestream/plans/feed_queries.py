"""Feed lookups, folds and small text functions over the tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text
from lodestream.operators import feeds
from lodestream.plans.catalog import E, events, query

#: SQL: a changelog of the entities: every event sets one field of its entity, and five events in a row are one update.
AUDIT = "a AS (SELECT seq, 'd' || entity AS doc, 'c' || (seq // 5) AS cp, CASE v WHEN 'click' THEN 'install_status' WHEN 'view' THEN 'assigned_to' ELSE 'name' END AS f, CASE WHEN v = 'click' THEN (seq % 9)::VARCHAR WHEN v = 'view' THEN 'u' || (seq % 4) WHEN v <> 'error' THEN 'n' || seq END AS nv FROM e)"


@query(f"""WITH {E}, f AS (SELECT entity % 50 AS k, seq, x FROM e WHERE v = 'purchase')
 SELECT e.seq, f.x AS last_fact FROM e ASOF LEFT JOIN f ON e.entity % 50 = f.k AND e.seq >= f.seq""")
def feed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("k", (F.col("entity") % 50).cast("string"))
    return feeds.latest(df, F.col("k"), df.where("v = 'purchase'"), F.col("k"), F.col("x"), "last_fact").select("seq", "last_fact")


@query(f"""WITH {E}, {AUDIT}, r AS (SELECT *, CASE WHEN lag(cp) OVER w IS DISTINCT FROM cp THEN 1 ELSE 0 END AS fresh FROM a WINDOW w AS (PARTITION BY doc ORDER BY seq)),
 s AS (SELECT *, sum(fresh) OVER w AS run, last_value(CASE WHEN f = 'name' THEN [nv] END IGNORE NULLS) OVER w AS n, last_value(CASE WHEN f = 'assigned_to' THEN [nv] END IGNORE NULLS) OVER w AS u, last_value(CASE WHEN f = 'install_status' THEN [nv] END IGNORE NULLS) OVER w AS i
  FROM r WINDOW w AS (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 g AS (SELECT doc, min(seq) AS seq, arg_max({{'n': n[1], 'u': u[1], 'i': i[1]}}, seq) AS s, bool_or(f = 'install_status' AND nv IS NOT DISTINCT FROM '7') AS retracted FROM s GROUP BY doc, run)
 SELECT seq, doc AS documentkey, s.n AS name, CASE WHEN s.u <> 'u3' THEN s.u || '@example.com' END AS assigned_to, s.i AS install_status, retracted FROM g""")
def feed_item_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, seq = F.col("v"), F.col("seq")
    value = F.when(v == "click", (seq % 9).cast("string")).when(v == "view", F.concat(F.lit("u"), (seq % 4).cast("string"))).when(v != "error", F.concat(F.lit("n"), seq.cast("string")))
    field = F.when(v == "click", "install_status").when(v == "view", "assigned_to").otherwise("name")
    audit = events(spark, sf_dir).select("seq", F.lit("srv").alias("tablename"), F.concat(F.lit("d"), F.col("entity").cast("string")).alias("documentkey"), F.concat(F.lit("c"), F.floor(seq / 5).cast("string")).alias("record_checkpoint"), field.alias("fieldname"), value.alias("newvalue"), F.col("t").cast("string").alias("sys_created_on"))
    users = spark.range(3).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("sys_id"), F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@example.com")).alias("email"))
    groups = users.select("sys_id", F.lit(None).cast("string").alias("name"))
    out = feeds.item_versions(audit, users, groups, ["srv"], ["name", "assigned_to", "install_status"])
    return out.select("seq", "documentkey", "name", "assigned_to", "install_status", "retracted")


@query(f"""WITH {E}, p AS (SELECT seq, t, CASE seq % 4 WHEN 0 THEN 'mss,nop,ws,nop,nop,sok' WHEN 1 THEN 'mss,sok,ts,nop,ws' WHEN 2 THEN 'mss,odd' END AS o, seq % 1500 AS mss FROM e)
 SELECT seq, o || '|' || mss || '|' AS fingerprint, CASE seq % 4 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux' END AS family, 'c:\\users\\*\\app' || (seq % 7) || '.exe' AS image,
 (t // 1000000000 % 86400) >= 79200 OR (t // 1000000000 % 86400) < 18000 AS in_window FROM p""")
def feed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    options = F.when(seq % 4 == 0, "MSS;nop;wscale;nop;nop;sackOK").when(seq % 4 == 1, "maxseg sack_perm timestamps nop window_scale").when(seq % 4 == 2, "mss, odd")
    path = F.concat(F.lit('"C:\\Users\\U'), F.col("entity").cast("string"), F.lit("\\App"), (seq % 7).cast("string"), F.lit('.exe"'))
    return events(spark, sf_dir).select("seq", text.stack_fingerprint(options, seq % 1500, F.lit("n/a")).alias("fingerprint"), text.stack_family(options).alias("family"), text.image_path(path).alias("image"), text.in_daily_window(F.col("t"), ("22:00", "05:00")).alias("in_window"))
