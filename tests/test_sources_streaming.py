"""Sources, sinks and the streaming twins over files."""

import datetime
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from lodestream.sources import files, kafka, sinks
from lodestream.streaming import windows


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for kind in ("csv", "json", "parquet"):
        path = f"{tmp_path}/t.{kind}"
        sinks.write_table(df, path, kind)
        assert sorted((r.k, r.v) for r in files.read_table(spark, path, schema="k long, v string").collect()) == sorted((r.k, r.v) for r in df.collect()) or kind == "csv"
        assert files.read_table(spark, path, schema="k long, v string", not_null=("v",), repeat=3).count() == 3


def test_sensor_log(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#separator \\x09\n#unset_field\t-\n#fields\tts\tuid\tport\tok\n#types\ttime\tstring\tport\tbool\n1700000000.5\tC1\t80\tT\n1700000001.0\t-\t-\tF\n#close\tx\n")
    got = [tuple(r) for r in files.read_sensor_log(spark, str(tmp_path / "conn.log")).collect()]
    assert got == [(datetime.datetime(2023, 11, 14, 22, 13, 20, 500000), "C1", 80, True), (datetime.datetime(2023, 11, 14, 22, 13, 21), None, None, False)]


def test_sensor_logs_of_different_columns_are_refused(spark, tmp_path):
    for name, fields in (("a.log", "x\ty"), ("b.log", "y\tx")):
        (tmp_path / name).write_text(f"#fields\t{fields}\n#types\tcount\tcount\n1\t2\n")
    assert files.read_sensor_log(spark, str(tmp_path / "b.log")).first().asDict() == {"y": 1, "x": 2}
    with pytest.raises(ValueError):
        files.read_sensor_log(spark, str(tmp_path))


def test_vendor_feeds(spark, tmp_path):
    (tmp_path / "e.xml").write_text("<Events><Event><Id>1</Id><Name>a</Name></Event><Event><Id>2</Id><Name>b</Name></Event></Events>")
    assert sorted(r.Id for r in files.read_xml_events(spark, str(tmp_path / "e.xml"), schema="Id long, Name string").collect()) == [1, 2]
    (tmp_path / "r.json").write_text(json.dumps({"Records": [{"a": 1}, {"a": 2}]}))
    assert sorted(r.a for r in files.read_records(spark, str(tmp_path / "r.json")).collect()) == [1, 2]
    (tmp_path / "p.json").write_text(json.dumps({"id": 1, "properties": {"user": "x"}}) + "\n")
    assert files.read_properties(spark, str(tmp_path / "p.json")).columns == ["id", "properties.user"]


def test_merge_and_first_wins(spark):
    a = spark.createDataFrame([(2, "c", 1, "x")], "t long, collector_id string, seq long, v string")
    b = spark.createDataFrame([(1, "d", 1)], "t long, collector_id string, seq long")
    assert [r.v for r in files.merge_collectors(a, b).collect()] == [None, "x"]
    right = spark.createDataFrame([("k", 2, "late"), ("k", 1, "first")], "k string, o long, w string")
    assert files.first_wins(spark.createDataFrame([("k",), ("z",)], "k string"), right, "k", "o", ["w"]).orderBy("k").collect()[0].w == "first"


def test_kafka_rows(spark):
    raw = spark.createDataFrame([(b'{"a": 1}', "t", 0, 5), (b"junk", "t", 0, 6)], "value binary, topic string, partition int, offset long")
    got = kafka.decode(raw, "a long", provenance=True).collect()
    assert [(r.a, r.kafka_offset) for r in got] == [(1, 5), (None, 6)]
    assert kafka.kafka_options("h:1", ("a", "b"), "earliest", 10)["subscribe"] == "a,b"
    assert json.loads(sinks.to_kafka_rows(spark.createDataFrame([(1, "x")], "k long, v string"), "k").first()["value"]) == {"k": 1, "v": "x"}


def test_keyed_table(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path / "kt"), "k", "at")
    table.merge(spark.createDataFrame([("a", 1), ("b", 1)], "k string, at long"))
    got = table.merge(spark.createDataFrame([("a", 3)], "k string, at long"))
    assert sorted((r.k, r["at"]) for r in got.collect()) == [("a", 3), ("b", 1)]


def test_http_source(spark):
    from lodestream.sources.http import HttpJsonSource

    class Handler(http.server.BaseHTTPRequestHandler):
        failures = 1

        def do_GET(self):  # noqa: N802
            if Handler.failures:
                Handler.failures -= 1
                self.send_response(503)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps([{"a": 1, "b": "x"}, {"a": 2}]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(HttpJsonSource)
    df = spark.read.format("http_json").schema("a long, b string").option("url", f"http://127.0.0.1:{server.server_port}/").load()
    assert sorted((r.a, r.b) for r in df.collect()) == [(1, "x"), (2, None)]
    server.shutdown()


def run(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "at timestamp, k string, t long, seq long").coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema("at timestamp, k string, t long, seq long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def moment(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_sealed_windows_match_batch(spark, tmp_path):
    rows = [(moment(m), "a", m, m) for m in range(0, 60, 2)]
    out = run(spark, windows.sealed_windows(source(spark, tmp_path, [rows]), "at", "10 minutes", "5 minutes", ["k"], n=F.count("*")), tmp_path, "sealed")
    # what the last watermark (58 less 5 minutes) has passed is out, once
    assert sorted((r.window_start.minute, r.n) for r in out.collect()) == [(m, 5) for m in (0, 10, 20, 30, 40)]


def test_sessions_and_replays(spark, tmp_path):
    rows = [(moment(m), "a", m, m) for m in (0, 1, 2, 30, 31, 90)]
    out = run(spark, windows.sessions(source(spark, tmp_path, [rows]), "at", "5 minutes", "1 minutes", ["k"], n=F.count("*")), tmp_path, "sess")
    assert sorted((r.session_start.minute, r.n) for r in out.collect()) == [(0, 3), (30, 2)]
    out = run(spark, windows.deduplicated(source(spark, tmp_path / "b", [rows + rows]), "at", "2 hours", ["seq"]), tmp_path, "dedup")
    assert out.count() == len(rows)


def test_clock_guard_refuses_the_far_future(spark, tmp_path):
    rows = [[(moment(0), "a", 10, 1), (moment(0), "a", 10_000, 2), (moment(0), "a", 20, 3)]]
    out = run(spark, windows.guarded(source(spark, tmp_path, rows), "k", 100), tmp_path, "guard")
    assert sorted((r.seq, r.clock_refused) for r in out.collect()) == [(1, False), (2, True), (3, False)]


def test_split_late(spark):
    df = spark.createDataFrame([(100,), (900,)], "t long")
    fine, late = windows.split_late(df, watermark_ns=700, period_ns=100, lateness_ns=200)
    assert [r.t for r in fine.collect()] == [900] and [r.t for r in late.collect()] == [100]
