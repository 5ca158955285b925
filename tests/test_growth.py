"""Work that grows no faster than its input: what a plan holds, and that the results are those of the plain way."""

import random
import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.operators import telemetry, timeseries, trackers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_rows(spark, n=400):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(-60, 300), k, r.choice([None, 1.5, 2.25, -7.0, 40.0])) for k in range(n)] + [("a", None, n, 1.0), (None, 5, n + 1, 2.0), ("c", 4_000_000_000_000_000_019, n + 2, 9.0)]
    return spark.createDataFrame(rows, "entity string, t long, seq long, x double")


def test_a_stage_carries_only_what_is_read(spark):
    df = some_rows(spark).withColumns({"unread_text": F.concat("entity", F.lit("_")), "label": F.lit("l")})
    out = telemetry.novelty(df, ["entity"], "x")
    assert out.columns == [*df.columns, "x_changed", "x_first_seen", "x_distinct"]
    assert "unread_text" not in plan(out.select("seq", "x_distinct", "label"))


def test_moving_frames_only_grow(spark):
    df = some_rows(spark)
    for out in (trackers.value_floor(df, "x", 50), trackers.level_forecast(df, "x", 0.0, 50), trackers.arrival_regularity(df, 50, 2, "x"), trackers.sum_window(df, "x", 50)):
        frames = re.findall(r"specifiedwindowframe\(\w+, (\w+)", plan(out))
        assert frames and set(frames) == {"unboundedpreceding"}


def test_two_blocks_against_plain_frames(spark):
    df = some_rows(spark)
    by = Window.partitionBy("entity").orderBy("t")
    whole = df.where("t IS NOT NULL")
    for w in (1, 7, 50, 1000):
        for inclusive, frame in ((True, by.rangeBetween(-w + 1, 0)), (False, by.rangeBetween(-w, -1))):
            got = trackers.two_blocks(df, ["entity"], w, ["x"], lambda v, _: {"n": F.count(v("x")), "s": F.sum(v("x")), "m": F.min(v("x"))}, inclusive)
            got = got.selectExpr("seq", "n_0 + n_1", "coalesce(s_0, 0) + coalesce(s_1, 0)", "least(m_0, m_1)")
            assert got.count() == df.count()
            want = whole.select("seq", F.count("x").over(frame), F.coalesce(F.sum("x").over(frame), F.lit(0.0)), F.min("x").over(frame))
            assert sorted(map(tuple, got.where(f"seq <> {400}").collect())) == sorted(map(tuple, want.collect()))


def test_fits_over_two_blocks_against_numpy(spark):
    r = random.Random(4)
    rows = [("a", t * 10, t, r.gauss(-5, 1)) for t in range(80)]
    df = spark.createDataFrame(rows, "entity string, t long, seq long, x double")
    fits = {x.seq: x for x in trackers.level_forecast(df, "x", -100.0, 150, 4).collect()}
    beats = {x.seq: x for x in trackers.arrival_regularity(df, 150, 2, "x").collect()}
    for _, t, seq, _ in rows:
        held = [(b / trackers.DAY, x) for _, b, _, x in rows if t - 150 < b <= t]
        if len(held) >= 4:
            xs, ys = map(np.array, zip(*held, strict=True))
            slope = ((xs - xs.mean()) * (ys - ys.mean())).sum() / ((xs - xs.mean()) ** 2).sum()
            rms = np.sqrt((((ys - ys.mean()) - slope * (xs - xs.mean())) ** 2).mean())
            assert fits[seq].fit_n == len(held) and np.isclose(fits[seq].slope_per_day, slope, rtol=1e-9) and np.isclose(fits[seq].residual_rms, rms, rtol=1e-9)
        sizes = np.array([x for _, b, _, x in rows if t - 150 <= b <= t])
        assert beats[seq].intervals_n == len(sizes) - 1
        if len(sizes) > 2:
            assert np.isclose(beats[seq].size_cv, sizes.std() / sizes.mean(), rtol=1e-9) and abs(beats[seq].interval_cv) < 1e-6


def test_rhythms_of_many_blocks_are_judged_at_once(spark):
    df = spark.createDataFrame([("u", 5, 1), ("v", 9, 2)], "user string, s long, k long").select("user", F.timestamp_seconds("s").alias("at"), "k")
    assert "FlatMapGroupsInPandas" not in plan(timeseries.time_series_anomalies(df, "user", "at", hot_start=True))
    r = np.random.default_rng(2)
    signals = r.poisson(0.1, (300, 31)).astype(float)
    together = timeseries.unexplained(signals, 90.0, 4.0)
    assert (together == np.vstack([timeseries.unexplained(s[None], 90.0, 4.0) for s in signals])).all() and together.any()


def test_polls_of_one_instant_and_large_rates_as_in_sql(spark, tmp_path):
    import duckdb
    from oracle import connect

    from lodestream.plans import registry

    # a port's polls tie: users a whole number of ports apart have the same port
    duckdb.connect().execute(f"COPY (SELECT event_id + k * 1000 AS event_id, ts, user_id + k * 23 AS user_id, event_type, value, props FROM range(3) r(k), '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    for name in ("tc1_rate", "tc1_flap"):
        want = connect(tmp_path).sql(registry.oracle_sql()[name]).to_arrow_table().to_pylist()
        got = registry.queries()[name](spark, str(tmp_path)).toArrow().to_pylist()
        assert len(got) > 2900
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_polls_that_seq_does_not_tell_apart_are_in_one_order(spark, tmp_path):
    """An order that is open may differ between two sorts (where they spill), so a port's polls are sorted once."""
    import duckdb
    from oracle import connect

    from lodestream.plans import registry

    duckdb.connect().execute(f"COPY (SELECT event_id, ts, user_id + k * 23 AS user_id, event_type, value, props FROM range(3) r(k), '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    df = registry.queries()["tc1_rate"](spark, str(tmp_path))
    assert df._jdf.queryExecution().sparkPlan().toString().count("lag(") >= 3
    assert df._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    want = connect(tmp_path).sql(registry.oracle_sql()["tc1_rate"]).to_arrow_table().to_pylist()
    got = df.toArrow().to_pylist()
    assert len(got) > 2900
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_chained_steps_pair_no_rows(spark):
    from lodestream.plans import detections

    r = random.Random(9)
    w, slack = 500_000_000_000, detections.SLACK
    ports = [(r.choice("pq"), r.randrange(4 * w), r.choice("xy")) for _ in range(120)]
    seen = [(r.choice(["p", "q", None]), r.choice(["m", "n", None]), r.randrange(4 * w)) for _ in range(40)]
    first = spark.createDataFrame(ports, "port string, t0 long, event string")
    out = detections.steps(first, [(spark.createDataFrame(seen, "port string, mac string, t long"), "port", w)], ["port", "event", "mac"])
    # a join whose condition compares times meets a busy key's rows pair by pair
    assert not [line for line in plan(out).splitlines() if "Join" in line and ">=" in line]
    want = {}
    for port, t0, event in ports:
        for key, mac, t in seen:
            if key == port and t0 - slack <= t <= t0 + w:
                k = (port, event, mac, t0)
                want[k] = min(t, want.get(k, t))
    got = {(x.port, x.event, x.mac, x.t0): x.t1 for x in out.collect()}
    assert got == want and want


def test_a_lookup_in_time_costs_a_row_no_more_than_one(spark):
    from lodestream.operators.stabbing import covering, covering_all

    r = random.Random(11)
    held = [(r.choice("ab"), s, s + r.choice([0, 1, 3, 40, 900]), r.randrange(6)) for s in (r.randrange(1000) for _ in range(700))] + [("c", 5, 9, 1), (None, 1, 2, 3), ("a", None, 7, 4), ("a", 40, 1 << 62, 0)]
    rows = [(r.choice(["a", "b", "c", None]), r.choice([None, r.randrange(1100)]), k) for k in range(500)]
    df, own = spark.createDataFrame(rows, "k string, t long, seq long"), spark.createDataFrame(held, "k string, s long, e long, v int")
    best = covering(df, own, "k", "s", "e", ["v", "s", "e"], ["v", "s"], "best", slice_ns=300)
    every = {few: covering_all(df, own, "k", "s", "e", "v", "held", slice_ns=300, few=few) for few in (64, 10_000)}
    # rows are not multiplied: what holds from each end on is told before
    assert "Generate" not in plan(best)
    over = lambda k, t: [(v, s, e) for a, s, e, v in held if a == k and None not in (k, t, s) and s <= t < e]
    assert {x.seq: x.best and tuple(x.best) for x in best.collect()} == {q: max(over(k, t))[:2] if over(k, t) else None for k, t, q in rows}
    for out in every.values():
        assert {x.seq: x.held for x in out.collect()} == {q: sorted({v for v, _, _ in over(k, t)}) or None for k, t, q in rows}


def test_records_become_versions_once(spark):
    from lodestream.operators import context

    r = random.Random(12)
    said = [(r.choice("ab"), f" g{r.randrange(3)} ", t, t + r.choice([5, 90]), t + r.randrange(4), r.choice(["assert", "retract"])) for t in (r.randrange(300) for _ in range(60))]
    raw = spark.createDataFrame(said, "who string, grp string, f long, u long, at long, change string")
    v = context.context_columns(raw, F.lit("group"), F.col("who"), [F.col("grp")], {"member": F.col("grp")}, F.col("f"), F.col("u"), F.col("at"), F.col("change")).where("context_refused IS NULL")
    rows = [(r.choice("abc"), r.randrange(350), k) for k in range(200)]
    out = context.memberships(spark.createDataFrame(rows, "context_entity string, t long, seq long"), v, "context_entity", "member", "held")
    # reading records, in whatever way, is behind a written table
    assert "regexp_replace" not in plan(out)

    def held(who, t):
        state = {}
        for e, g, f, u, at, change in said:
            if e == who and max(f, at) <= t < u:
                state[g.strip()] = max(state.get(g.strip(), ((-1,), "")), ((at, f, u, change), change))
        return ";".join(sorted(g for g, (_, change) in state.items() if change == "assert"))

    assert {x.seq: x.held for x in out.collect()} == {k: held(who, t) for who, t, k in rows}


def test_the_mode_of_a_window_costs_a_row_no_more_than_one(spark):
    df = some_rows(spark).where("t IS NOT NULL")
    out = trackers.value_history(df, "x", 50, 3)
    assert "Generate" not in plan(out)
    rows = df.collect()
    want = {}
    for a in rows:
        held = [b.x for b in rows if b.entity == a.entity and a.t - 50 <= b.t < a.t and b.x is not None]
        want[a.seq] = (len(held), max(held, key=lambda v: (held.count(v), v)) if len(held) >= 3 else None)
    assert {x.seq: (x.history_n, x.established) for x in out.collect()} == want


def test_the_mode_of_a_window_keeps_running_counts_by_slice(spark):
    r = random.Random(13)
    # over 16 and over 256 values, ties in time and in count, times below 0, rows without time, value or entity
    rows = [(r.choice("ab"), r.randrange(-500, 900), k, f"v{r.choice([r.randrange(4), r.randrange(300)])}") for k in range(700)]
    rows += [("a", None, 700, "v1"), ("b", 7, 701, None), (None, 7, 702, "v1"), ("c", 10, 703, "v1"), ("c", 10, 704, "v2"), ("c", 61, 705, "v2"), ("c", 60, 706, "v1"), (None, 8, 707, "v2")]
    df = spark.createDataFrame(rows, "entity string, t long, seq long, x string")
    for data, w in ((df, 50), (df, 3), (df, 1), (df, 411), (df.where("x < 'v2' OR seq >= 700"), 300), (df.where("x IS NULL"), 50)):
        out = trackers.value_history(data, "x", w, 2)
        held_by = plan(out)
        assert "Join" not in held_by and all("_slice" in p for p in re.findall(r"windowspecdefinition\(entity#\d+,([^)]*)", held_by)) and "windowspecdefinition" in held_by
        mine, want = data.collect(), {}
        for a in mine:
            held = [b.x for b in mine if a.entity and b.entity == a.entity and None not in (a.t, b.t, b.x) and a.t - w <= b.t < a.t]
            mode = max(held, key=lambda v: (held.count(v), v)) if len(held) >= 2 else None
            want[a.seq] = (len(held) if a.entity else None, mode, None if None in (mode, a.x) else a.x != mode)
        assert {x.seq: (x.history_n if x.entity else None, x.established, x.deviates) for x in out.collect()} == want


def test_messages_are_cut_into_sets_once(spark):
    from lodestream.plans import registry

    # what remains in the plan is the reading of records, for which sets are a written table
    out = registry.queries()["captured_flows"](spark, "/root/testdata/sf0.001")
    assert plan(out).count("MapInArrow") == 1 and out.count() > 0
