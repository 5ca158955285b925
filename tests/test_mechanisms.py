"""Partition merge, captures, stamps, sketches and rhythms."""

import cmath
import itertools
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import stamps, thresholds, timeseries
from lodestream.sources import captures
from lodestream.streaming import merge

TOPIC = "shard int, part string, off long, t long, v string"


def drained(spark, stream, tmp_path, name):
    batches = []
    q = stream.writeStream.foreachBatch(lambda df, _: batches.append(df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return batches


def topic(spark, tmp_path, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, TOPIC).coalesce(1).write.json(str(tmp_path / "in" / f"{k:02d}"))
    return spark.readStream.schema(TOPIC).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_merge_equals_a_sort_for_any_interleaving(spark, tmp_path):
    r = random.Random(3)
    rows = {p: [(0, p, k, t, f"{p}{k}") for k, t in enumerate(sorted(r.randrange(100) for _ in range(12)))] for p in "abc"}
    rows["a"].append((0, "a", 12, 1000, "end"))
    rows["b"].append((0, "b", 12, 1000, "end"))
    rows["c"].append((0, "c", 12, 1000, "end"))
    turns = [p for p in "abc" for _ in range(13)]
    r.shuffle(turns)
    left = {p: iter(x) for p, x in rows.items()}
    arrived = [next(left[p]) for p in turns]
    parts = [arrived[k : k + 13] for k in range(0, 39, 13)]
    parts[2] = parts[0][:3] + parts[2]  # offsets that come again
    batches = drained(spark, merge.merged(topic(spark, tmp_path, parts), "shard", "part", "off", "t", expected=3), tmp_path, "m")
    got = [(x.t, x.part, x.off) for b in batches for x in sorted(b, key=lambda x: x.place)]
    want = sorted((t, p, k) for p, x in rows.items() for _, _, k, t, _ in x if t < 1000)
    assert got == want and not any(x.late for b in batches for x in b)


def test_merge_with_an_idle_partition(spark, tmp_path):
    parts = [[(0, "a", 0, 10, "x"), (0, "b", 0, 10, "y"), (0, "a", 1, None, "z")], [(0, "a", 2, 500, "x"), (0, "a", 3, 600, "x")], [(0, "b", 1, 20, "late")], [(0, "b", 2, 700, "x")]]
    batches = drained(spark, merge.merged(topic(spark, tmp_path, parts), "shard", "part", "off", "t", expected=2, max_lag_ns=100), tmp_path, "i")
    got = [[(x.t, x.late) for x in sorted(b, key=lambda x: x.place)] for b in batches if b]
    assert got == [[(None, False)], [(10, False), (10, False), (500, False)], [(20, True)]]


# captures


def capture(frames, endian="<", nano=False):
    out = struct.pack(endian + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for at, frame in frames:
        out += struct.pack(endian + "IIII", at // 10**9, at % 10**9 // (1 if nano else 1000), len(frame), len(frame)) + frame
    return out


def udp(payload, port, source="10.0.0.1"):
    head = bytes(12) + b"\x08\x00" + b"\x45\x00" + struct.pack("!H", 28 + len(payload)) + bytes(4) + b"\x40\x11\x00\x00" + bytes(map(int, source.split("."))) + bytes([10, 0, 0, 9])
    return head + struct.pack("!HHHH", 9999, port, 8 + len(payload), 0) + payload


def flow(sets):
    body = b"".join(struct.pack("!HH", kind, 4 + len(x)) + x for kind, x in sets)
    return struct.pack("!HHIII", 10, 16 + len(body), 5, 0, 1) + body


@pytest.mark.parametrize(("endian", "nano"), list(itertools.product("<>", (False, True))))
def test_capture_is_split_between_tasks(spark, tmp_path, endian, nano):
    r = random.Random(1)
    frames = [(1_700_000_000 * 10**9 + k * 1000, r.randbytes(r.randrange(1, 300))) for k in range(2000)]
    (tmp_path / "a.pcap").write_bytes(capture(frames, endian, nano) + b"\x01\x02")  # a record that broke off
    spark.dataSource.register(captures.PcapSource)
    df = spark.read.format("pcap").option("splitBytes", "20000").load(str(tmp_path / "*.pcap"))
    assert df.rdd.getNumPartitions() > 8
    assert [(x.received_ns, bytes(x.frame)) for x in df.orderBy("offset").collect()] == frames


def test_captures_that_are_none(spark, tmp_path):
    spark.dataSource.register(captures.PcapSource)
    for name, data in (("short", b"123"), ("other", b"x" * 40), ("link", struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101) + bytes(20))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="capture|link type"):
            spark.read.format("pcap").load(str(tmp_path / name)).count()
    (tmp_path / "empty").write_bytes(capture([]))
    assert spark.read.format("pcap").load(str(tmp_path / "empty")).count() == 0


def test_templates_serve_later_splits_of_their_exporter(spark, tmp_path):
    template = struct.pack("!HH", 256, 3) + struct.pack("!HHHHHH", 8, 4, 82, 65535, 1, 2) + bytes(3)
    row = lambda n: bytes([10, 1, 1, n]) + bytes([3]) + b"eth" + struct.pack("!H", n)
    frames = [udp(flow([(256, row(1))]), 4739), udp(flow([(2, template), (256, row(2) + row(3))]), 4739), udp(flow([(256, row(4))]), 4739, "10.0.0.2"), udp(b"nonsense", 4739), udp(b"x", 53)]
    frames += [udp(bytes(90), 53)] * 500 + [udp(flow([(3, b"opts"), (256, row(5) + b"\0")]), 4739)]
    (tmp_path / "f.pcap").write_bytes(capture([(10**18 + k * 1000, f) for k, f in enumerate(frames)]))
    spark.dataSource.register(captures.PcapSource)
    df = spark.read.format("pcap").option("splitBytes", "8000").load(str(tmp_path / "f.pcap"))
    assert df.rdd.getNumPartitions() > 4
    sets = captures.flow_sets(captures.flow_messages(df))
    records, skipped = captures.flow_records(sets)
    got = [(x.sourceIPv4Address, x.octetDeltaCount, x.exporter_address) for x in records.orderBy("seq").collect()]
    assert [x for x in got if x[0]] == [(f"10.1.1.{n}", n, "10.0.0.1") for n in (2, 3, 5)]
    assert sorted(x.exporter_address for x in skipped.collect()) == ["10.0.0.1", "10.0.0.2"]
    assert [x.refused for x in sets.where("refused IS NOT NULL").collect()] != []


# stamps, thresholds, rhythms


def test_fingerprint_is_of_the_multiset(spark):
    rows = [(k % 3, f"v{k}", None if k % 5 == 0 else k) for k in range(60)]
    one = lambda r, n: {x.w: (x.rows, x.fingerprint) for x in stamps.window_fingerprint(spark.createDataFrame(r, "w int, v string, x long").repartition(n), ["w"], ["v", "x"]).collect()}
    first = one(rows, 1)
    assert one(rows[::-1], 7) == first
    doubled = one([*rows, rows[0]], 3)
    assert doubled[0][1] != first[0][1] and doubled[1] == first[1]
    assert one([*rows[1:], (0, "v0", 0)], 2)[0] != first[0]
    swapped = [(0, "v0", 3), (0, "v3", None), *[x for x in rows if x[1] not in ("v0", "v3")]]
    assert one(swapped, 2)[0] != first[0]


def test_settings_and_stamps(spark):
    assert stamps.settings_hash({"a": 1.0, "b": [True]}) == stamps.settings_hash({"b": [True], "a": 1}) != stamps.settings_hash({"a": 1, "b": [1]})
    parts = dict.fromkeys(("configuration", "schema_versions", "thresholds", "code_commit", "image_digest", "reference_data"), stamps.UNKNOWN)
    assert stamps.pipeline_fingerprint(**parts) != stamps.pipeline_fingerprint(**parts | {"code_commit": "c"})
    for bad in (parts | {"thresholds": {}}, {k: v for k, v in parts.items() if k != "thresholds"}):
        with pytest.raises(ValueError):
            stamps.pipeline_fingerprint(**bad)
    df = spark.createDataFrame([("a", None, "x"), (None, "b", "y")], "site string, port string, entity_key string")
    assert [x.entity_key for x in stamps.stamp_envelope(df, 1, ["site", "port"], overwrite=True).collect()] == [None, None]
    for call in (lambda: stamps.stamp_envelope(df, 8, ["site"]), lambda: stamps.stamp_envelope(df, 1, []), lambda: stamps.stamp_determinism(df, "perhaps", {})):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(KeyError):
        stamps.stamp_envelope(df, 1, ["nothing"])


def test_sketches_merge_and_keep_their_error(spark):
    r = np.random.default_rng(2)
    values = r.lognormal(0, 2, 40_000)
    df = spark.createDataFrame([(int(k % 2), int(k % 3), float(v)) for k, v in enumerate(values)], "k int, period int, v double")
    whole = thresholds.sketches(df, ["k"], F.col("v"))
    parts = [thresholds.sketches(df.where(f"period = {p}"), ["k"], F.col("v")) for p in range(3)]
    kept = thresholds.merge_sketches(thresholds.merge_sketches(parts[0], parts[1], ["k"]), parts[2], ["k"])
    for fires, q in (("above", 0.99), ("below", 0.9), ("above", 0.5)):
        for table in (whole, kept):
            for x in thresholds.propose(table, ["k"], fires, q).collect():
                own = np.sort(values[x.k :: 2])
                assert x.samples == 20_000
                assert abs(np.searchsorted(own, x.threshold) / 20_000 - thresholds.rank_of(fires, q)) < 0.01
    exact = thresholds.derive_thresholds(df, [], F.col("v"), "above", 0.99).first()
    assert (exact.samples, exact.threshold) == (40_000, np.sort(values)[39_599])
    odd = spark.createDataFrame([("1",), ("x",), (None,), ("NaN",), ("3",)], "v string")
    assert thresholds.derive_thresholds(odd, [], F.col("v"), "below", 0.99).first() == (2, 1.0)
    for bad in (("sideways", 0.5), ("above", 1.0)):
        with pytest.raises(ValueError):
            thresholds.rank_of(*bad)


def written_out(signal, percent, z):
    """The same judgement by sums of sines and cosines, term by term."""
    n = len(signal)
    mean, sd = np.mean(signal), np.std(signal)
    flat = [(x - mean) / (sd or 1) for x in signal]
    wave = lambda xs, k: sum(x * cmath.exp(-2j * cmath.pi * k * j / n) for j, x in enumerate(xs))
    power = [abs(wave(flat, k)) ** 2 / n for k in range(n // 2 + 1)]
    bar = np.percentile(power, percent)
    kept = [0 if p < bar else wave(signal, k) for k, p in enumerate(power)]
    full = [kept[k] if k <= n // 2 else complex(kept[n - k]).conjugate() for k in range(n)]
    back = [(sum(c * cmath.exp(2j * cmath.pi * k * j / n) for k, c in enumerate(full)) / n).real for j in range(n)]
    residue = [abs(b - x) for b, x in zip(back, signal, strict=True)]
    return [j for j, e in enumerate(residue) if np.std(residue) and abs(e - np.mean(residue)) / np.std(residue) >= z]


def test_rhythms_against_a_transform_written_out(spark):
    r = random.Random(5)
    hours = [h for h in range(240) for _ in range(3 + 2 * (h % 24 in (9, 10, 11)) + (60 if h == 130 else 0))]
    rows = [("u", h * 3600 + r.randrange(1, 3500), k) for k, h in enumerate(hours)] + [("v", 7, -1), (None, 7, -2), ("u", None, -3)]
    df = spark.createDataFrame(rows, "user string, s long, k long").select("user", F.timestamp_seconds("s").alias("at"), "k")
    for hot, cold in ((False, False), (True, False), (False, True)):
        got = timeseries.time_series_anomalies(df, "user", "at", hot_start=hot, cold_end=cold, threshold=4.0)
        flagged = {x.k for x in got.where("ts_anomaly AND user = 'u'").collect()}
        counts = np.bincount(hours)
        want = set()
        for block in range(10):
            start, end = block * 24 - 12, block * 24 + 23 + 12
            if (not hot and start < 0) or (cold and end > 239):
                continue
            edges = range(start - 1, end)
            signal = [float(counts[b]) if 0 <= b < 240 and b >= start else 0.0 for b in edges]
            signal[-1] += counts[end] if end < 240 else 0
            want |= {edges[j] for j in written_out(signal, 90.0, 4.0) if block * 24 <= edges[j] < block * 24 + 24}
        assert flagged == {k for k, h in enumerate(hours) if h in want} and 130 in want
        assert got.count() == len(rows)


# lookups in time and windows of a busy entity


def test_lookup_in_time_against_brute_force(spark):
    from lodestream.operators import intervals
    from lodestream.operators.stabbing import covering

    r = random.Random(8)
    held = [(r.choice("abc"), r.randrange(60), r.randrange(70), r.randrange(9)) for _ in range(200)] + [(None, 1, 9, 1), ("a", None, 9, 1), ("d", 5, 5, 1), ("b", 3, (1 << 63) - 1, 0)]
    rows = [(r.choice("abcd"), r.randrange(-5, 90), k) for k in range(300)] + [(None, 5, 300), ("a", None, 301)]
    for few in (0, 1000):  # over nodes, and over a key's own intervals
        got = covering(spark.createDataFrame(rows, "k string, t long, seq long"), spark.createDataFrame(held, "k string, s long, e long, v int"), "k", "s", "e", ["v", "s"], ["v", "s"], "best", slice_ns=7, few=few)
        for x in got.collect():
            fit = [(v, s) for k, s, e, v in held if x.k is not None and x.t is not None and k == x.k and s is not None and s < e and s <= x.t < e]
            assert (tuple(x.best) if x.best else None) == max(fit, default=None), x
        assert got.count() == len(rows)
    leases = spark.createDataFrame([("1.1.1.1", 0, 10, "m1"), ("1.1.1.1", 5, None, "m2")], "ip string, start_ns long, end_ns long, mac string")
    machines = spark.createDataFrame([("m1", 0, None, "old"), ("m2", 8, None, "new")], "mac string, start_ns long, end_ns long, hostname string")
    out = intervals.host_identity(spark.createDataFrame([(1, 3, "1.1.1.1"), (2, 6, "1.1.1.1"), (3, 9, "1.1.1.1"), (4, 9, "2.2.2.2")], "seq long, t long, src_ip string"), leases, machines)
    assert [tuple(x) for x in out.orderBy("seq").select("host_mac", "host_key", "chain_anchor").collect()] == [("m1", "old", "old"), ("m2", None, "1.1.1.1"), ("m2", "new", "new"), (None, None, "2.2.2.2")]


def test_order_statistics_against_sorting(spark):
    from lodestream.operators.order_statistics import window_order_statistics

    r = random.Random(9)
    rows = [(r.choice(["a", None]), r.randrange(400), k, r.choice([None, *range(40)])) for k in range(500)]
    df = spark.createDataFrame(rows, "entity string, t long, seq long, x int")
    for small in (0, 1000):  # digit by digit, and as arrays
        got = window_order_statistics(df, "x", 50, 1, {"third": lambda n: F.lit(3), "last": lambda n: F.when(n > 4, n), "none": lambda n: F.lit(0)}, small)
        for x in got.collect():
            own = sorted(v for e, t, _, v in rows if e == x.entity and v is not None and x.t - 50 <= t <= x.t - 1)
            assert (x.third, x.last, x.none) == (own[2] if len(own) > 2 else None, own[-1] if len(own) > 4 else None, None)
        assert got.count() == 500


def test_a_busy_entity_is_no_square(spark):
    """One entity's rows, four times as many, must not take ten times as long."""
    import time

    from lodestream.operators import intervals, trackers

    def took(n, run):
        df = spark.range(n).select(F.lit("a").alias("entity"), (F.col("id") * 10**9).alias("t"), F.col("id").alias("seq"), (F.col("id") * 7919 % 1009).cast("double").alias("x"))
        at = time.time()
        run(df).write.format("noop").mode("overwrite").save()
        return time.time() - at

    for run in (lambda d: intervals.pair_sessions(d, F.col("seq") % 3 == 0, F.col("seq") % 5 == 0, 10**12), lambda d: trackers.ratio_window(d.withColumn("t", F.lit(1).cast("long")), F.col("x") > 5)):
        took(1000, run)
        assert took(80_000, run) < 10 * max(took(20_000, run), 0.5)
