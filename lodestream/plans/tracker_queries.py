"""Tracker and interval queries over the event stream, each with DuckDB SQL that says the same another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import intervals, lineage, trackers
from lodestream.operators.trackers import DAY, HOUR
from lodestream.plans.catalog import E, events, query


def _rows(own: str = "a") -> str:
    """SQL: rows of the same entity up to this one in the total order."""
    return f"b.entity = {own}.entity AND (b.t < {own}.t OR (b.t = {own}.t AND b.seq <= {own}.seq))"


W12, W1D, W30 = 12 * HOUR, DAY, 30 * DAY


@query(f"""WITH {E} SELECT a.seq, a.entity,
 (SELECT count(DISTINCT b.v) FROM e b WHERE {_rows()} AND b.t > a.t - {W12}) AS distinct_n,
 (SELECT count(b.v) FROM e b WHERE {_rows()} AND b.t > a.t - {W12}) AS total_n,
 NOT EXISTS (SELECT 1 FROM e b WHERE {_rows()} AND b.seq <> a.seq AND b.v = a.v AND b.t > a.t - {W12}) AS first_in_window
 FROM e a""")
def distinct_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.distinct_window(events(spark, sf_dir), "v", W12).select("seq", "entity", "distinct_n", "total_n", "first_in_window")


@query(f"""WITH {E}, w AS (SELECT a.seq, count(*) FILTER (WHERE b.v = 'error') AS numerator, count(*) AS denominator
 FROM e a JOIN e b ON {_rows()} AND b.t > a.t - {3 * DAY} GROUP BY a.seq)
 SELECT seq, numerator, denominator, round(CASE WHEN denominator >= 5 THEN numerator / denominator END, 6) AS ratio FROM w""")
def ratio_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trackers.ratio_window(events(spark, sf_dir), F.col("v") == "error", 3 * DAY, 5)
    return out.select("seq", "numerator", "denominator", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {E} SELECT a.seq, count(*) AS window_n, round(sum(coalesce(b.x, 0)), 4) AS window_sum
 FROM e a JOIN e b ON {_rows()} AND b.t > a.t - {W1D} GROUP BY a.seq""")
def sum_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.sum_window(events(spark, sf_dir), "x", W1D).select("seq", "window_n", F.round("window_sum", 4).alias("window_sum"))


@query(f"""WITH {E}, p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS k FROM e),
 w AS (SELECT a.seq, any_value(a.v) AS v, any_value(a.k) AS k, count(*) AS attempts, count(*) FILTER (WHERE b.v = 'error') AS failures FROM p a JOIN p b ON {_rows()} AND b.t > a.t - {5 * DAY} GROUP BY a.seq),
 l AS (SELECT a.seq, max(b.k) AS last_ok FROM p a JOIN p b ON a.entity = b.entity AND b.k < a.k AND b.v <> 'error' GROUP BY a.seq)
 SELECT w.seq, attempts, failures, least(k - 1 - coalesce(last_ok, 0), attempts - 1) AS consecutive_failures,
 (v <> 'error' AND least(k - 1 - coalesce(last_ok, 0), attempts - 1) > 0) AS failure_then_success FROM w LEFT JOIN l USING (seq)""")
def outcome_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trackers.outcome_run(events(spark, sf_dir), F.col("v") != "error", 5 * DAY)
    return out.select("seq", "attempts", "failures", "consecutive_failures", "failure_then_success")


@query(f"""WITH {E}, p AS (SELECT *, lag(v) OVER (PARTITION BY entity ORDER BY t, seq) AS last_v FROM e)
 SELECT seq, CASE WHEN last_v IS NOT NULL THEN v <> last_v END AS changed,
 CASE WHEN last_v IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM e b WHERE {_rows()} AND b.seq <> a.seq AND b.v = a.v) END AS first_seen,
 (SELECT count(DISTINCT b.v) FROM e b WHERE {_rows()}) AS distinct_so_far FROM p a""")
def value_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.value_novelty(events(spark, sf_dir), "v").select("seq", "changed", "first_seen", "distinct_so_far")


@query(f"""WITH {E} SELECT seq, EXISTS (SELECT 1 FROM e b WHERE b.entity = a.entity AND b.v = a.v AND b.t >= a.t - {3 * DAY} AND b.t < a.t) AS pair_seen,
 a.t - min(a.t) OVER (PARTITION BY entity) >= {7 * DAY} AS pair_mature FROM e a""")
def pair_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.pair_history(events(spark, sf_dir), "v", 3 * DAY).select("seq", "pair_seen", "pair_mature")


@query(f"""WITH {E}, c AS (SELECT a.seq, b.v, count(*) AS n FROM e a JOIN e b ON b.entity = a.entity AND b.t >= a.t - {7 * DAY} AND b.t < a.t GROUP BY a.seq, b.v),
 m AS (SELECT seq, arg_max(v, (n, v)) AS mode, sum(n) AS n FROM c GROUP BY seq)
 SELECT a.seq, CAST(coalesce(m.n, 0) AS BIGINT) AS history_n, CASE WHEN m.n >= 5 THEN mode END AS established, a.v <> CASE WHEN m.n >= 5 THEN mode END AS deviates FROM e a LEFT JOIN m USING (seq)""")
def value_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.value_history(events(spark, sf_dir), "v", 7 * DAY).select("seq", "history_n", "established", "deviates")


@query(f"""WITH {E}, m AS (SELECT a.seq, min(b.x) AS f, count(*) AS n FROM e a JOIN e b ON b.entity = a.entity AND b.t >= a.t - {W30} AND b.t < a.t GROUP BY a.seq)
 SELECT a.seq, CASE WHEN n >= 5 THEN f END AS floor_value, a.x < CASE WHEN n >= 5 THEN f END AS below_floor FROM e a LEFT JOIN m USING (seq)""")
def value_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.value_floor(events(spark, sf_dir), "x").select("seq", "floor_value", "below_floor")


@query(f"""WITH {E}, m AS (SELECT a.seq, count(*) AS n, list_sort(list(b.x))[CAST(ceil(0.9 * count(*)) AS INT)] AS q FROM e a JOIN e b ON b.entity = a.entity AND b.t >= a.t - {W30} AND b.t < a.t GROUP BY a.seq),
 c AS (SELECT a.seq, count(*) AS samples FROM e a JOIN e b ON b.entity = a.entity AND b.t >= a.t - {W30} AND (b.t, b.seq) <= (a.t, a.seq) AND b.x IS NOT NULL GROUP BY a.seq),
 r AS (SELECT a.seq, samples, CASE WHEN n >= 10 THEN q END AS envelope, a.x FROM e a LEFT JOIN m USING (seq) LEFT JOIN c USING (seq))
 SELECT seq, samples, envelope, round(CASE WHEN envelope <> 0 THEN x / envelope END, 6) AS envelope_ratio, CASE WHEN envelope <> 0 THEN x / envelope END >= 1.5 AS breached FROM r""")
def transfer_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trackers.transfer_envelope(events(spark, sf_dir), "x", quantile=0.9, multiplier=1.5, min_samples=10)
    return out.select("seq", "samples", "envelope", F.round("envelope_ratio", 6).alias("envelope_ratio"), "breached")


@query(f"""WITH {E}, k AS (SELECT *, t // {W1D} AS bucket FROM e), p AS (SELECT entity, bucket, max(x) AS peak, min(t) AS opened FROM k GROUP BY ALL),
 r AS (SELECT a.entity, a.bucket, max(b.peak) AS ref, count(b.peak) AS n FROM p a LEFT JOIN p b ON a.entity = b.entity AND b.bucket < a.bucket AND (b.bucket + 1) * {W1D} > a.opened - {14 * DAY + 7 * HOUR} GROUP BY ALL)
 SELECT seq, k.bucket, ref AS peak_reference, n AS peak_buckets, round(x - ref, 6) AS peak_step, n >= 5 AND ref IS NOT NULL AS peak_mature FROM k JOIN r USING (entity, bucket)""")
def bucket_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trackers.bucket_peak(events(spark, sf_dir), "x", W1D, 14 * DAY + 7 * HOUR, 5)
    return out.select("seq", "bucket", "peak_reference", "peak_buckets", F.round("peak_step", 6).alias("peak_step"), "peak_mature")


#: Length of the slots that make rows tie: no divisor of the day, so that slopes a day don't end on a rounding's half.
SLOT = 21_607 * 1_000_000_000
#: SQL: readings in slots, so that many rows of an entity tie; ``fresh`` is the first row of its instant.
TIED = f"r AS (SELECT seq, entity, x, v, t // {SLOT} * {SLOT} AS t FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY entity, t ORDER BY seq) = 1 AS fresh FROM r)"


def _tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("t", F.floor(F.col("t") / SLOT) * SLOT)


@query(f"""WITH {E}, {TIED}, m AS (SELECT a.seq, count(*) AS n, median(b.x) AS m FROM f a JOIN f b ON b.entity = a.entity AND b.fresh AND b.t > a.t - {3 * DAY} AND b.t < a.t GROUP BY a.seq)
 SELECT a.seq, CASE WHEN fresh THEN coalesce(n, 0) END AS baseline_n, round(CASE WHEN fresh AND n >= 5 THEN m END, 6) AS baseline, round(x - CASE WHEN fresh AND n >= 5 THEN m END, 6) AS deviation FROM f a LEFT JOIN m USING (seq)""")
def optical_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trackers.rolling_median(_tied(spark, sf_dir), "x", 3 * DAY)
    return out.select("seq", "baseline_n", F.round("baseline", 6).alias("baseline"), F.round("deviation", 6).alias("deviation"))


@query(f"""WITH {E}, {TIED}, o AS (SELECT *, CASE WHEN fresh AND lag(t) OVER w IS NOT NULL AND (v = 'error') <> lag(v = 'error') OVER w THEN 1 ELSE 0 END AS moved FROM f WINDOW w AS (PARTITION BY entity, fresh ORDER BY t, seq)),
 p AS (SELECT *, sum(moved) OVER (PARTITION BY entity ORDER BY t, seq) AS epoch FROM o),
 m AS (SELECT a.seq, count(*) AS n, regr_slope(b.x, (b.t - a.t) / {float(DAY)}) AS s, regr_intercept(b.x, (b.t - a.t) / {float(DAY)}) AS now, regr_sxx(b.x, (b.t - a.t) / {float(DAY)}) AS sxx, regr_sxy(b.x, (b.t - a.t) / {float(DAY)}) AS sxy, regr_syy(b.x, (b.t - a.t) / {float(DAY)}) AS syy
  FROM p a JOIN p b ON b.entity = a.entity AND b.epoch = a.epoch AND b.fresh AND b.t > a.t - {14 * DAY} AND b.t <= a.t GROUP BY a.seq),
 g AS (SELECT p.seq, x, n, CASE WHEN fresh AND n >= 5 THEN s END AS s, now, sqrt(greatest(syy - s * sxy, 0) / n) AS rms, sqrt(greatest(syy - s * sxy, 0) / (n - 2) / sxx) AS se FROM p JOIN m USING (seq)),
 k AS (SELECT *, CASE WHEN s IS NULL THEN 'immature' WHEN x <= 20 THEN 'below_floor' WHEN rms > 120 THEN 'nonlinear' WHEN s >= 0 OR abs(s) / se < 1.5 THEN 'not_degrading' ELSE 'projected' END AS status FROM g)
 SELECT seq, n AS fit_n, round(s, 5) AS slope_per_day, round(CASE WHEN s IS NOT NULL THEN rms END, 5) AS residual_rms, round(CASE WHEN s IS NOT NULL AND se > 0 THEN s / se END, 5) AS t_stat, status AS forecast_status,
 round(CASE status WHEN 'below_floor' THEN 0 WHEN 'projected' THEN greatest((20 - now) / s, 0) END, 3) AS days_to_floor FROM k""")
def optical_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _tied(spark, sf_dir).withColumn("o", F.col("v") == "error")
    out = trackers.level_forecast(df, "x", 20.0, 14 * DAY, 5, 120.0, 1.5, "o")
    return out.select("seq", "fit_n", F.round("slope_per_day", 5).alias("slope_per_day"), F.round("residual_rms", 5).alias("residual_rms"), F.round("t_stat", 5).alias("t_stat"), "forecast_status", F.round("days_to_floor", 3).alias("days_to_floor"))


@query(f"""WITH {E}, h AS (SELECT *, (t // {HOUR}) % 24 AS hour FROM e),
 c AS (SELECT a.seq, (SELECT count(*) FROM h b WHERE b.entity = a.entity AND b.t < a.t) AS n, (SELECT count(*) FROM h b WHERE b.entity = a.entity AND b.t < a.t AND b.hour = a.hour) AS c FROM h a)
 SELECT seq, n AS cycle_n, c AS cycle_count, round((c + 1) / (n + 24), 6) AS cycle_share, round(-log2((c + 1) / (n + 24)), 6) AS surprise_bits, c = 0 AS cycle_unseen, n >= 32 AS cycle_mature FROM c""")
def cyclic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trackers.cyclic_histogram(events(spark, sf_dir), F.pmod(F.floor(F.col("t") / HOUR), F.lit(24)), 24)
    return out.select("seq", "cycle_n", "cycle_count", F.round("cycle_share", 6).alias("cycle_share"), F.round("surprise_bits", 6).alias("surprise_bits"), "cycle_unseen", "cycle_mature")


@query(f"""WITH {E}, d AS (SELECT entity, t // {W1D} AS window_id, round(avg(x), 4) AS score FROM e GROUP BY ALL),
 p AS (SELECT *, lag(score) OVER w AS p, lag(window_id) OVER w AS pw FROM d WINDOW w AS (PARTITION BY entity ORDER BY window_id)),
 v AS (SELECT *, CASE WHEN pw = window_id - 1 THEN score - p END AS velocity, CASE WHEN pw = window_id - 1 AND score > p THEN 0 ELSE 1 END AS fresh FROM p),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY window_id) AS run, lag(velocity) OVER (PARTITION BY entity ORDER BY window_id) AS pv FROM v),
 s AS (SELECT *, count(*) OVER q AS rising_run, score - first_value(score) OVER q AS rise, count(score) OVER h AS history_windows, stddev_samp(score) OVER h AS sigma
  FROM r WINDOW q AS (PARTITION BY entity, run ORDER BY window_id), h AS (PARTITION BY entity ORDER BY window_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING))
 SELECT entity, window_id, round(velocity, 4) AS velocity, round(CASE WHEN pw = window_id - 1 THEN velocity - pv END, 4) AS acceleration, rising_run, round(rise, 4) AS rise, history_windows,
 round(CASE WHEN history_windows >= 4 THEN sigma END, 4) AS sigma FROM s""")
def drift_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = events(spark, sf_dir).groupBy("entity", F.floor(F.col("t") / W1D).cast("long").alias("window_id")).agg(F.round(F.avg("x"), 4).alias("score"))
    out = trackers.drift_trajectory(daily, "score", "window_id")
    return out.select("entity", "window_id", *(F.round(c, 4).alias(c) for c in ("velocity", "acceleration")), "rising_run", F.round("rise", 4).alias("rise"), "history_windows", F.round("sigma", 4).alias("sigma"))


@query(f"""WITH {E}, c AS (SELECT *, CAST(round(x * 100) AS BIGINT) % 4096 AS n FROM e), p AS (SELECT *, lag(n) OVER (PARTITION BY entity ORDER BY t, seq) AS p FROM c)
 SELECT seq, CASE WHEN n < p THEN n - p + 4096 ELSE n - p END AS delta, coalesce(n < p, false) AS counter_wrapped FROM p""")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("n", F.round(F.col("x") * 100).cast("long") % 4096)
    return trackers.counter_delta(df, "n", 12).select("seq", "delta", "counter_wrapped")


@query(f"""WITH {E}, c AS (SELECT *, v IN ('view', 'click') AS up, CAST(floor(x) AS BIGINT) AS ch FROM e),
 p AS (SELECT *, lag(up) OVER w AS s, lag(ch) OVER w AS c FROM c WINDOW w AS (PARTITION BY entity ORDER BY t, seq)),
 f AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN ch < c THEN 2 WHEN up <> s THEN 1 WHEN ch > c THEN 2 ELSE 0 END AS flaps FROM p)
 SELECT a.seq, CAST(any_value(a.flaps) AS BIGINT) AS flaps, CAST(sum(coalesce(b.flaps, 0)) AS BIGINT) AS flaps_in_window FROM f a JOIN f b ON {_rows()} AND b.t > a.t - {W1D} GROUP BY a.seq""")
def link_flap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumns({"up": F.col("v").isin("view", "click"), "ch": F.floor("x").cast("long")})
    return trackers.link_flap(df, "up", "ch", W1D).select("seq", "flaps", "flaps_in_window")


@query(f"""WITH {E}, {TIED}, g AS (SELECT *, lag(t) OVER (PARTITION BY entity, fresh ORDER BY t, seq) AS pt FROM f),
 m AS (SELECT a.seq, count(b.pt) AS n, avg((b.t - b.pt) / 1e9) AS m, stddev_pop((b.t - b.pt) / 1e9) AS s FROM g a LEFT JOIN g b ON b.entity = a.entity AND b.fresh AND b.t <= a.t AND b.pt >= a.t - {5 * DAY} GROUP BY a.seq),
 z AS (SELECT a.seq, avg(b.x) AS zm, stddev_pop(b.x) AS zs FROM g a JOIN g b ON b.entity = a.entity AND b.fresh AND b.t <= a.t AND b.t >= a.t - {5 * DAY} GROUP BY a.seq)
 SELECT seq, n AS intervals_n, round(m, 3) AS mean_interval, round(CASE WHEN n >= 4 AND m > 0 THEN s / m END, 4) AS interval_cv, round(CASE WHEN n >= 4 AND zm <> 0 THEN zs / zm END, 4) AS size_cv FROM m JOIN z USING (seq)""")
def arrival_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trackers.arrival_regularity(_tied(spark, sf_dir), 5 * DAY, 4, "x")
    return out.select("seq", "intervals_n", F.round("mean_interval", 3).alias("mean_interval"), F.round("interval_cv", 4).alias("interval_cv"), F.round("size_cv", 4).alias("size_cv"))


@query(f"""WITH {E}, l AS (SELECT *, CASE WHEN v <> 'error' THEN x % 90 END AS la, CASE WHEN v <> 'error' THEN (x * 7) % 180 END AS lo FROM e),
 h AS (SELECT *, last_value(CASE WHEN la IS NOT NULL THEN {{'a': la, 'o': lo, 't': t}} END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l),
 d AS (SELECT seq, CASE WHEN la IS NOT NULL AND p IS NOT NULL THEN 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(la - p.a) / 2), 2) + cos(radians(p.a)) * cos(radians(la)) * pow(sin(radians(lo - p.o) / 2), 2)))) END AS km,
 greatest(t - p.t, 1000000000) / 3.6e12 AS h FROM h)
 SELECT seq, round(km, 3) AS distance_km, round(km / h, 2) AS speed_kmh FROM d""")
def geo_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumns({"la": F.when(F.col("v") != "error", F.col("x") % 90), "lo": F.when(F.col("v") != "error", (F.col("x") * 7) % 180)})
    return trackers.geo_velocity(df, "la", "lo").select("seq", F.round("distance_km", 3).alias("distance_km"), F.round("speed_kmh", 2).alias("speed_kmh"))


@query(f"""WITH {E} SELECT seq, first_value(v) OVER (PARTITION BY entity % 7, entity ORDER BY t, seq) AS stable_name FROM e""")
def anchored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.anchored_names(events(spark, sf_dir).withColumn("site", F.col("entity") % 7), "site", "entity", "v").select("seq", "stable_name")


@query(f"""WITH {E}, c AS (SELECT entity, t // {W1D} AS bucket, count(*) FILTER (WHERE v = 'error') AS restarts FROM e GROUP BY ALL),
 u AS (SELECT *, coalesce(lag(bucket) OVER w = bucket - 1 AND restarts > lag(restarts) OVER w, false) AS up FROM c WINDOW w AS (PARTITION BY entity ORDER BY bucket)),
 r AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY bucket) AS run FROM u)
 SELECT entity, bucket, restarts, row_number() OVER (PARTITION BY entity, run ORDER BY bucket) - 1 AS rising_buckets FROM r""")
def reboot_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.reboot_counter(events(spark, sf_dir), F.col("v") == "error").select("entity", "bucket", "restarts", "rising_buckets")


@query(f"""WITH {E}, m AS (SELECT *, max(seq) OVER (PARTITION BY v ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e)
 SELECT seq, CASE WHEN m IS NOT NULL THEN greatest(seq - m - 1, 0) END AS sequence_gap, coalesce(seq <= m, false) AS sequence_regressed FROM m""")
def collector_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.collector_sequence(events(spark, sf_dir), "v", "seq").select("seq", "sequence_gap", "sequence_regressed")


@query(f"""WITH {E} SELECT seq, round(CASE WHEN stddev_pop(x) OVER w > 0 THEN abs(x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END, 6) AS z FROM e WINDOW w AS (PARTITION BY entity)""")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.zscore(events(spark, sf_dir), "x", ["entity"]).select("seq", F.round("z", 6).alias("z"))


#: SQL of the closed bindings of (entity, v) with an idle time of two days.
BINDINGS = f"""b0 AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM e WINDOW w AS (PARTITION BY entity ORDER BY t, seq)),
 b1 AS (SELECT *, CASE WHEN pt IS NULL OR v <> pv OR t - pt > {2 * DAY} THEN 1 ELSE 0 END AS fresh, coalesce(t - pt > {2 * DAY}, false) AS idle FROM b0),
 b2 AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY t, seq) AS run FROM b1),
 b3 AS (SELECT entity, run, any_value(v) AS v, min(t) AS start_ns, max(t) AS seen, count(*) AS observations, bool_or(idle AND fresh = 1) AS by_idle FROM b2 GROUP BY entity, run),
 b4 AS (SELECT *, lead(start_ns) OVER w AS nxt, lead(by_idle) OVER w AS nidle FROM b3 WINDOW w AS (PARTITION BY entity ORDER BY run)),
 bind AS (SELECT entity, v, start_ns, greatest(CASE WHEN nxt IS NULL OR nxt = seen THEN seen + 1 ELSE least(seen + 1, nxt) END, start_ns + 1) AS end_ns, observations,
  CASE WHEN nxt IS NULL THEN 'open' WHEN nidle THEN 'idle_timeout' WHEN nxt = seen THEN 'conflict' ELSE 'displaced' END AS reason FROM b4)"""


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.close_bindings(events(spark, sf_dir), ["v"], 2 * DAY)


@query(f"WITH {E}, {BINDINGS} SELECT entity, v, start_ns, end_ns, observations, reason FROM bind")
def binding_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bindings(spark, sf_dir)


@query(f"""WITH {E}, {BINDINGS}, k AS (SELECT seq, t, (entity + 1) % 150 AS other FROM e),
 m AS (SELECT k.seq, arg_max(b.v, (b.start_ns, b.end_ns)) AS v FROM k JOIN bind b ON b.entity = k.other AND b.start_ns <= k.t AND k.t < b.end_ns GROUP BY k.seq)
 SELECT k.seq, m.v AS held, CASE WHEN m.v IS NULL THEN 'unresolved' ELSE 'soft:holder' END AS resolution_method FROM k LEFT JOIN m USING (seq)""")
def binding_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("seq", "t", ((F.col("entity") + 1) % 150).alias("entity"))
    held = _bindings(spark, sf_dir).withColumnRenamed("v", "held")
    return intervals.resolve(rows, held, "entity", ["held"], DAY, "holder").select("seq", "held", "resolution_method")


@query(f"""WITH {E}, {BINDINGS}, x AS (SELECT *, unnest(range(start_ns // {6 * HOUR}, (end_ns - 1) // {6 * HOUR} + 1)) AS bucket FROM bind)
 SELECT entity, bucket, v, start_ns FROM x QUALIFY row_number() OVER (PARTITION BY entity, bucket ORDER BY start_ns DESC, end_ns DESC) = 1""")
def binding_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.bucket_winners(_bindings(spark, sf_dir), "entity", 6 * HOUR).select("entity", "bucket", "v", "start_ns")


#: Versions made from events: recorded an hour after they take effect, errors retract.
VERSIONS = f"vs AS (SELECT entity, t AS valid_from, CASE WHEN v = 'click' THEN t + {5 * DAY} END AS valid_to, t + {HOUR} AS recorded_at, CASE WHEN v = 'error' THEN 'retract' ELSE 'assert' END AS change, v AS owner FROM e WHERE seq % 3 = 0)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("seq % 3 = 0").select("entity", F.col("t").alias("valid_from"), F.when(F.col("v") == "click", F.col("t") + 5 * DAY).alias("valid_to"), (F.col("t") + HOUR).alias("recorded_at"), F.when(F.col("v") == "error", "retract").otherwise("assert").alias("change"), F.col("v").alias("owner"))


@query(f"""WITH {E}, {VERSIONS}, m AS (SELECT a.seq, arg_max({{'c': change, 'o': owner, 'r': recorded_at}}, (recorded_at, valid_from)) AS b FROM e a JOIN vs ON vs.entity = a.entity AND recorded_at <= a.t AND valid_from <= a.t AND (valid_to IS NULL OR a.t < valid_to) GROUP BY a.seq)
 SELECT a.seq, CASE WHEN b.c = 'assert' THEN b.o END AS owner, coalesce(b.c = 'assert', false) AS ctx_found, CASE WHEN b.c = 'assert' THEN b.r END AS ctx_recorded_at FROM e a LEFT JOIN m USING (seq)""")
def bitemporal_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.as_of(events(spark, sf_dir), _versions(spark, sf_dir), "entity", ["owner"]).select("seq", "owner", "ctx_found", "ctx_recorded_at")


@query(f"""WITH {E}, a AS (SELECT entity, count(*) AS n, max(v) AS top FROM e WHERE t < 1705000000000000000 GROUP BY entity), b AS (SELECT entity, count(*) AS n, max(v) AS top FROM e WHERE t >= 1705000000000000000 AND entity % 5 <> 0 GROUP BY entity)
 SELECT coalesce(a.entity, b.entity) AS entity, CASE WHEN b.entity IS NULL THEN 'retract' ELSE 'assert' END AS change, CASE WHEN b.entity IS NULL THEN a.n ELSE b.n END AS n, CASE WHEN b.entity IS NULL THEN a.top ELSE b.top END AS top
 FROM a FULL JOIN b ON a.entity = b.entity WHERE b.entity IS NULL OR a.entity IS NULL OR a.n <> b.n OR a.top <> b.top""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, cut = events(spark, sf_dir), 1705000000000000000
    before, after = (d.groupBy("entity").agg(F.count("*").alias("n"), F.max("v").alias("top")) for d in (df.where(F.col("t") < cut), df.where((F.col("t") >= cut) & (F.col("entity") % 5 != 0))))
    return intervals.snapshot_diff(before, after, "entity", ["n", "top"])


@query(f"""WITH {E}, r AS (SELECT *, coalesce(sum(CASE WHEN v = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
 f AS (SELECT a.entity, a.t, a.seq, max(b.t) AS s, count(b.t) AS n FROM r a LEFT JOIN r b ON b.entity = a.entity AND b.run = a.run AND b.v = 'signup' AND (b.t, b.seq) < (a.t, a.seq) WHERE a.v = 'purchase' GROUP BY ALL),
 l AS (SELECT a.entity, a.t, a.seq, min(b.t) AS nxt FROM e a LEFT JOIN e b ON b.entity = a.entity AND b.v IN ('signup', 'purchase') AND (b.t, b.seq) > (a.t, a.seq) WHERE a.v = 'signup' GROUP BY ALL)
 SELECT entity, t, seq, CASE WHEN t - s <= {2 * DAY} THEN s END AS start_t, CASE WHEN t - s <= {2 * DAY} THEN n ELSE 0 END AS attempts, CASE WHEN t - s <= {2 * DAY} THEN t - s END AS elapsed_ns, CASE WHEN t - s <= {2 * DAY} THEN 'paired' ELSE 'unpaired' END AS outcome FROM f
 UNION ALL SELECT entity, t, seq, t, 1, NULL, 'abandoned' FROM l WHERE nxt IS NULL OR nxt - t > {2 * DAY}""")
def session_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.pair_sessions(events(spark, sf_dir), F.col("v") == "signup", F.col("v") == "purchase", 2 * DAY)


#: The stream as it arrives: every 50th event comes 40 minutes late.
SHIFTED = f"s AS (SELECT seq, entity, v, x, CASE WHEN seq % 50 = 0 THEN t - {40 * 60 * 10**9} ELSE t END AS t FROM e)"
LATE = f"""q AS (SELECT *, (t - (t % {300 * 10**9} + {300 * 10**9}) % {300 * 10**9}) // {300 * 10**9} AS window_id, max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM s),
 z AS (SELECT *, coalesce((window_id + 1) * {300 * 10**9} + {900 * 10**9} <= wm, false) AS late FROM q)"""


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("t", F.when(F.col("seq") % 50 == 0, F.col("t") - 40 * 60 * 10**9).otherwise(F.col("t")))
    return lineage.seal_windows(df, 300 * 10**9, 900 * 10**9)


@query(f"WITH {E}, {SHIFTED}, {LATE} SELECT seq, window_id, late FROM z")
def window_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(spark, sf_dir).select("seq", "window_id", "late")


@query(f"""WITH {E}, {SHIFTED}, {LATE} SELECT entity, window_id, count(*) AS rows, max(x) AS peak, round(avg(x), 6) AS level, arg_max(v, (t, seq)) AS last_v, sum(CASE WHEN v = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, arg_min(v, (t, seq)) AS v FROM z WHERE NOT late GROUP BY entity, window_id""")
def entity_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _sealed(spark, sf_dir).withColumns({"failed": F.col("v") == "error", "user": F.col("entity")}).drop("entity")
    out = lineage.entity_frame(df, "user", {"peak": ("x", "max"), "level": ("x", "mean"), "last_v": ("v", "last"), "errors": ("failed", "count_true")}, ("v",))
    return out.withColumn("level", F.round("level", 6))


@query(f"""WITH {E}, {SHIFTED}, {LATE} SELECT window_id, v AS collector, count(*) AS rows, count(*) FILTER (WHERE late) AS late_rows, min(t) AS first_t, max(t) AS last_t, max(seq % 97) AS max_lag_ns, median(seq % 97) AS median_lag_ns FROM z GROUP BY window_id, v""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.pipeline_health(_sealed(spark, sf_dir), "v", F.col("seq") % 97)


@query(f"""WITH {E}, n AS (SELECT seq, t, entity * 100 + (t // {W1D}) % 100 AS k, CAST(ascii(v) % 7 AS INT) AS layer, 'u' || seq AS uid FROM e),
 f AS (SELECT k, layer, min((t, seq)) AS at, arg_min(uid, (t, seq)) AS uid FROM n GROUP BY k, layer),
 j AS (SELECT n.uid AS child, n.t, arg_max(f.uid, f.layer) AS parent FROM n JOIN f ON f.k = n.k AND f.layer < n.layer AND f.at < (n.t, n.seq) GROUP BY n.uid, n.t)
 SELECT parent, child, 'carried_by' AS relation, t, substr(sha256(parent || chr(31) || child || chr(31) || 'carried_by' || chr(31) || 'hard'), 1, 32) AS link_uid FROM j""")
def edge_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("seq", "t", (F.col("entity") * 100 + F.floor(F.col("t") / W1D) % 100).alias("k"), (F.ascii("v") % 7).alias("layer"), F.concat(F.lit("u"), F.col("seq")).alias("uid"))
    return lineage.emit_edges(df, "k", "layer", "uid").select("parent", "child", "relation", "t", "link_uid")


@query(f"""WITH {E}, n AS (SELECT seq, t, v, entity, t // {W1D} AS window_id, substr(sha256(seq::VARCHAR || chr(31) || v), 1, 32) AS uid FROM e)
 SELECT seq, uid, substr(sha256(entity::VARCHAR || chr(31) || window_id::VARCHAR || chr(31) || first_value(uid) OVER (PARTITION BY entity, window_id ORDER BY t, seq)), 1, 32) AS lineage_id FROM n""")
def lineage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.functions.identity import event_uid, render, window_id

    df = events(spark, sf_dir).withColumns({"uid": event_uid(render(F.col("seq")), render(F.col("v"))), "window_id": window_id(F.col("t"), W1D)})
    return lineage.stamp_lineage(df, "entity", "uid").select("seq", "uid", "lineage_id")


@query(f"""WITH {E}, c AS (SELECT seq, CASE WHEN v = 'click' THEN v END AS a, CASE WHEN seq % 2 = 0 THEN entity::VARCHAR END AS b, 'none' AS c FROM e)
 SELECT seq, coalesce(a, b, c) AS chain_anchor, CASE WHEN a IS NOT NULL THEN 'a' WHEN b IS NOT NULL THEN 'b' ELSE 'c' END AS chain_anchor_source FROM c""")
def chain_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("seq", F.when(F.col("v") == "click", F.col("v")).alias("a"), F.when(F.col("seq") % 2 == 0, F.col("entity").cast("string")).alias("b"), F.lit("none").alias("c"))
    return lineage.chain_anchor(df, ["a", "b", "c"]).select("seq", "chain_anchor", "chain_anchor_source")


@query("SELECT l_shipdate, l_suppkey, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def total_order_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.session import load

    return lineage.total_order_ties(load(spark, sf_dir, "lineitem"), "l_shipdate", "l_suppkey")


@query(f"""WITH {E}, c AS (SELECT seq, CASE WHEN v = 'error' THEN NULL ELSE v END AS name, CAST(x * 30 AS DOUBLE) AS off FROM e)
 SELECT seq, array_to_string(list_filter([CASE WHEN abs(off) > 1000 THEN 'clock_offset' END, CASE WHEN name IS NULL THEN 'missing:name' END], lambda r: r IS NOT NULL), ';') AS reasons FROM c""")
def envelope_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("seq", F.when(F.col("v") != "error", F.col("v")).alias("name"), (F.col("x") * 30).alias("off"))
    return lineage.validate_envelope(df, ["name"], "off").select("seq", F.array_join("quarantine_reasons", ";").alias("reasons"))
