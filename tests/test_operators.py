"""Ties, nulls and edges that the event stream doesn't have."""

import datetime
import hashlib
import hmac

from pyspark.sql import functions as F

from lodestream.functions import identity, network, text
from lodestream.operators import intervals, lineage, schema, trackers
from lodestream.plans import searches
from lodestream.plans.components import connected_components


def frame(spark, rows, ddl="entity string, t long, seq long, v string, x double"):
    return spark.createDataFrame(rows, ddl)


def by_seq(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


def test_distinct_window_counts_ties_in_order_and_leaves_out_the_far_edge(spark):
    df = frame(spark, [("a", 0, 1, "p", 0.0), ("a", 0, 2, "q", 0.0), ("a", 5, 3, "p", 0.0), ("a", 10, 4, "r", 0.0), ("a", 10, 5, None, 0.0), ("b", 3, 6, "p", 0.0)])
    got = by_seq(trackers.distinct_window(df, "v", 10), "distinct_n", "total_n", "first_in_window")
    assert got == [(1, 1, True), (2, 2, True), (2, 3, False), (2, 2, True), (2, 2, None), (1, 1, True)]


def test_trackers_on_no_rows(spark):
    empty = frame(spark, [])
    for out in (
        trackers.distinct_window(empty, "v"), trackers.ratio_window(empty, F.lit(True)), trackers.value_novelty(empty, "v"), trackers.bucket_peak(empty, "x"),
        trackers.arrival_regularity(empty), trackers.level_forecast(empty, "x", 0.0), intervals.close_bindings(empty, ["v"], 10),
    ):
        assert out.count() == 0


def test_tied_row_is_out_of_order_for_novelty(spark):
    df = frame(spark, [("a", 1, 1, "p", 0.0), ("a", 1, 2, "q", 0.0), ("a", 2, 3, "q", 0.0), ("a", 3, 4, None, 0.0), ("a", 4, 5, "q", 0.0)])
    got = by_seq(trackers.value_novelty(df, "v"), "changed", "first_seen", "distinct_so_far")
    assert got == [(None, None, 1), (None, None, 0), (True, True, 2), (None, None, 2), (False, False, 2)]


def test_counter_wrap_reset_and_tie(spark):
    df = spark.createDataFrame([("a", 10, 1, 250, 5), ("a", 20, 2, 4, 15), ("a", 20, 3, 9, 15), ("a", 30, 4, 3, 2)], "entity string, t long, seq long, c long, up long")
    assert by_seq(trackers.counter_delta(df, "c", 8, "up"), "delta", "counter_wrapped", "counter_reset") == [(None, False, False), (10, True, False), (None, False, False), (3, False, True)]


def test_forecast_projects_a_falling_level(spark):
    rows = [("a", k * trackers.HOUR * 6, k, None, -3.0 - 0.1 * k + (0.001 if k % 2 else 0)) for k in range(20)]
    last = trackers.level_forecast(frame(spark, rows), "x", -7.0).orderBy(F.desc("seq")).first()
    assert last["forecast_status"] == "projected" and abs(last["slope_per_day"] + 0.4) < 0.01 and abs(last["days_to_floor"] - (7.0 - 4.9) / 0.4) < 0.1
    first = trackers.level_forecast(frame(spark, rows), "x", -7.0).orderBy("seq").first()
    assert first["forecast_status"] == "immature"


def test_forecast_of_ties_gaps_and_new_optics(spark):
    rows = [("a", k * trackers.HOUR, 2 * k, "m", -3.0 - 0.1 * k) for k in range(8)]
    rows += [("a", 7 * trackers.HOUR, 15, "n", 50.0), ("a", 8 * trackers.HOUR, 16, "m", None), ("a", 9 * trackers.HOUR, 18, "m", -9.0), ("a", 10 * trackers.HOUR, 20, "n", -3.0)]
    got = by_seq(trackers.level_forecast(frame(spark, rows), "x", -8.0, min_samples=4, max_residual=5.0, optic="v"), "forecast_status", "fit_n", "days_to_floor")
    assert [g[0] for g in got] == ["immature"] * 3 + ["projected"] * 5 + ["immature", "no_reading", "below_floor", "immature"]
    assert [g[1] for g in got] == [1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 9, 1] and got[10][2] == 0.0
    none = trackers.level_forecast(frame(spark, rows), "x", None, min_samples=4).where("seq = 6").first()
    assert none["forecast_status"] == "no_floor" and none["slope_per_day"] is not None


def test_tied_polls_are_not_learned(spark):
    rows = [("a", k, 2 * k, None, float(k)) for k in range(6)] + [("a", 5, 11, None, 99.0), ("a", 6, 12, None, None), ("a", 7, 14, None, 7.0)]
    df = frame(spark, rows)
    assert by_seq(trackers.rolling_median(df, "x", 100), "baseline", "deviation", "baseline_n")[5:] == [(2.0, 3.0, 5), (None, None, None), (2.5, None, 6), (2.5, 4.5, 6)]
    assert by_seq(trackers.arrival_regularity(df, 100, 2, "x"), "intervals_n", "interval_cv", "size_cv")[5:7] == [(5, 0.0, 0.6831300510639732)] * 2
    assert [r[2] for r in by_seq(trackers.arrival_regularity(df, 100, 2, "x"), "intervals_n", "interval_cv", "size_cv")[7:]] == [None, None]
    assert by_seq(trackers.transfer_envelope(df, "x", 100, 0.5, 2.0, 5), "samples", "envelope", "breached")[5:] == [(6, 2.0, True), (7, 2.0, True), (None, None, None), (8, 3.0, True)]


def test_buckets_expire_by_the_row_that_closes_them(spark):
    late = frame(spark, [("a", 0, 1, None, 9.0), ("a", 10, 2, None, 1.0), ("a", 24, 3, None, 2.0)])
    early = frame(spark, [("a", 0, 1, None, 9.0), ("a", 10, 2, None, 1.0), ("a", 29, 3, None, 2.0)])
    assert by_seq(trackers.bucket_peak(late, "x", 10, 15, 1), "peak_reference")[2] == (9.0,)
    assert by_seq(trackers.bucket_peak(early, "x", 10, 15, 1), "peak_reference")[2] == (1.0,)


def test_pseudonyms_are_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = spark.range(1).select(identity.pseudonymize(F.lit("wert-ü"), key)).first()[0]
        assert got == hmac.new(key, "wert-ü".encode(), hashlib.sha256).hexdigest()[:32]


def test_merkle_root(spark):
    def plain(ids):
        level = [hashlib.sha256(b"\0" + u.encode()).digest() for u in sorted(set(ids))]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0].hex()

    for ids in (["a"], ["b", "a", "b"], list("qwertyuiopas")):
        assert spark.createDataFrame([(ids,)], "u array<string>").select(identity.merkle_root(F.col("u"))).first()[0] == plain(ids)


def test_windows_before_the_epoch_floor(spark):
    got = spark.createDataFrame([(-1,), (0,), (299,), (-300,), (-301,)], "t long").select(identity.window_id(F.col("t"), 300)).collect()
    assert [r[0] for r in got] == [-1, 0, 0, -1, -2]


def test_community_id_of_a_known_flow(spark):
    row = lambda a, b, p, q: spark.range(1).select(network.community_id(F.lit(a), F.lit(b), F.lit(6), F.lit(p), F.lit(q))).first()[0]
    assert row("128.232.110.120", "66.35.250.204", 34855, 80) == "1:LQU9qZlK+B5F3KDmev6m5PMibrg="
    assert row("66.35.250.204", "128.232.110.120", 80, 34855) == "1:LQU9qZlK+B5F3KDmev6m5PMibrg="


def test_entropy_of_nothing(spark):
    df = spark.createDataFrame([("",), (None,), ("aaaa",), ("ab",)], "s string")
    assert [r[0] for r in df.select(text.shannon_entropy(F.col("s"))).collect()] == [None, None, 0.0, 1.0]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("2024-03-06 10:20:30", "logs/app-2024-02-29T01_02_03.json", 2.00005, "")], "at string, path string, x double, none string")
    at = F.to_timestamp("at")
    got = df.select(*(text.period_start(at, p) for p in ("min", "H", "D", "W", "M", "Y")), text.date_of_path(F.col("path")), text.date_of_path(F.col("none"), modified=at), text.date_of_path(F.col("none"))).first()
    d = datetime.datetime
    assert tuple(got) == (d(2024, 3, 6, 10, 20), d(2024, 3, 6, 10), d(2024, 3, 6), d(2024, 3, 3), d(2024, 3, 1), d(2024, 1, 1), d(2024, 2, 29, 1, 2, 3), d(2024, 3, 6, 10, 20, 30), None)
    assert tuple(df.select(text.quantize(F.lit(0.5), 0), text.quantize(F.lit(2.5), 0), text.quantize(F.col("x")), text.image_path(F.lit("/home/Bob/Bin/Tool")), text.image_path(F.col("none")), text.subdomain_entropy(F.lit("A.b"))).first()) == (0.0, 2.0, 2.0, "/home/*/bin/tool", None, 1.0)


def test_truncate_bytes_keeps_whole_characters(spark):
    df = spark.createDataFrame([("aé€𝄞x",), ("abc",), (None,)], "s string")
    for n in range(1, 12):
        got = [r[0] for r in schema.truncate_bytes(df, {"s": n}).collect()]
        assert got == ["aé€𝄞x".encode()[:n].decode(errors="ignore"), "abc"[:n], None]


def test_binding_conflict_idle_and_grant(spark):
    df = frame(spark, [("a", 1, 1, "p", 0.0), ("a", 1, 2, "q", 0.0), ("a", 50, 3, "q", 0.0), ("a", 500, 4, "q", 0.0)])
    got = [tuple(r) for r in intervals.close_bindings(df, ["v"], 100).orderBy("start_ns", "end_ns").select("v", "start_ns", "end_ns", "reason").collect()]
    assert got == [("p", 1, 2, "conflict"), ("q", 1, 51, "idle_timeout"), ("q", 500, 501, "open")]


def test_retraction_hides_a_fact_once_it_is_known(spark):
    versions = spark.createDataFrame([("e", 0, None, 0, "assert", "x"), ("e", 0, None, 10, "retract", "x")], "entity string, valid_from long, valid_to long, recorded_at long, change string, owner string")
    rows = frame(spark, [("e", 5, 1, None, 0.0), ("e", 15, 2, None, 0.0), ("f", 15, 3, None, 0.0), (None, 1, 4, None, 0.0)])
    assert by_seq(intervals.as_of(rows, versions, "entity", ["owner"]), "owner", "ctx_found") == [("x", True), (None, False), (None, False), (None, False)]


def test_contradictions(spark):
    versions = spark.createDataFrame([("e", 0, 10, 1, "assert", "x"), ("e", 5, None, 1, "assert", "y"), ("e", 20, None, 1, "assert", "x")], "entity string, valid_from long, valid_to long, recorded_at long, change string, owner string")
    assert [(r.left_from, r.right_from) for r in intervals.contradictions(versions, "entity", ["owner"]).orderBy("left_from", "right_from").collect()] == [(0, 5), (5, 20)]


def test_late_rows_across_arrival_blocks(spark):
    rows = [("a", 1000, 1, None, 0.0), ("a", 100_000, 65_537, None, 0.0), ("a", 1000, 65_538, None, 0.0), ("a", 1000, 200_000, None, 0.0)]
    assert by_seq(lineage.seal_windows(frame(spark, rows), 100, 50), "late") == [(False,), (False,), (True,), (True,)]


def test_minimise_and_quarantine(spark):
    df = spark.createDataFrame([("u", "secret", None)], "a string, b string, c string")
    assert lineage.minimise(df, ["b"], ["a"], b"k").columns == ["a", "c"]
    fine, bad = lineage.split_quarantine(lineage.validate_envelope(df, ["a", "c"]))
    assert fine.count() == 0 and bad.first()["quarantine_reasons"] == ["missing:c"]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 150)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in range(100, 130)} == {100} and got[200] == got[150] == 150
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_upsert_prefers_the_newest_then_the_incoming(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, at long, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 4, "w"), ("c", 1, "n")], "k string, at long, v string")
    assert sorted(tuple(r) for r in searches.upsert(old, new, "k", "at").select("k", "v").collect()) == [("a", "z"), ("b", "y"), ("c", "n")]


def test_schema_booleans_and_moments(spark):
    df = spark.createDataFrame([("yes", "2024-01-01T10:00:00+02:00", ["a", "b"]), ("huh", "2024-01-01 10:00:00", None)], "f string, at string, l array<string>")
    wanted = schema.Schema((schema.boolean("ok", "f", ("yes",), ("no",), False), schema.moment("when", "at"), schema.joined("list", "l", "+")), preserve="f")
    got = [tuple(r) for r in schema.apply_schema(df, wanted).collect()]
    assert got == [(True, datetime.datetime(2024, 1, 1, 8), "a+b", "yes"), (False, datetime.datetime(2024, 1, 1, 10), None, "huh")]
