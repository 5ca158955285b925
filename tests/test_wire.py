"""The wire contract, comparison within tolerances, keyed tables and the HTTP sink."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from lodestream.operators import schema
from lodestream.sources import sinks, wire
from lodestream.sources.http import HttpJsonSource


def test_moments(spark):
    df = spark.createDataFrame([(1_700_000_000_123_456_789,), (-1,), (None,), (0,)], "t long")
    got = [r.x for r in df.select(wire.event_time(F.col("t")).alias("x")).collect()]
    assert got == ["2023-11-14T22:13:20.123456UTC", "1969-12-31T23:59:59.999999UTC", None, "1970-01-01T00:00:00.000000UTC"]
    own = spark.sql("SELECT 1 AS seq, 2 AS entity, 'a' AS v, timestamp'2024-01-02 03:04:05.000006Z' AS event_time, timestamp_ntz'2024-01-02 03:04:05' AS ingest_time, cast(null AS string) AS gone, 5 AS window_end_ns, struct(null AS inner) AS s")
    contract = wire.Contract("own:events", "event_time", ("event_time", "ingest_time"), ("seq",))
    line = json.loads(wire.to_lines(wire.to_wire(own, contract)).first().line)
    assert line["event_time"] == "2024-01-02T03:04:05.000006UTC" and line["ingest_time"] == "2024-01-02T03:04:05.000000UTC" and line["window_end_ns"] == 5 and "gone" not in line
    assert contract.topic == "own.events" and contract.filename == "own_events.jsonlines"


def test_contracts_refuse(spark, tmp_path):
    made = wire.contracts("own", {1: (("port_id",), ("device_key", "uptime"))})
    assert len(made) == 20 and made["own:score:l1"].variants
    df = spark.createDataFrame([(1, "a")], "seq long, v string")
    with pytest.raises(KeyError, match="event_time"):
        wire.to_wire(df, made["own:late"])
    whole = df.withColumns({c: F.lit("x") for c in (*wire.SCORED, *wire.MOMENTS)})
    with pytest.raises(KeyError, match="variants"):
        wire.to_wire(whole, made["own:score:l1"])
    wire.write_wire(whole.withColumn("port_id", F.lit("p")), made["own:score:l1"], str(tmp_path))
    assert json.loads(spark.read.text(str(tmp_path / "own_score_l1.jsonlines")).first().value)["port_id"] == "p"


def test_comparison(spark):
    left = spark.createDataFrame([(1, 1.0, "a", 1), (2, None, None, 2), (3, float("nan"), "c", 3), (4, 100.0, "d", 4)], "k long, x double, s string, only_left int")
    right = spark.createDataFrame([(1, 1.0005, "a", "z"), (2, None, None, "z"), (3, float("nan"), "C", "z"), (5, 1.0, "e", "z")], "k long, x double, s string, only_right string")
    names, out = schema.compare_within(left, right, "k")
    assert names == {"matching": ["x", "s"], "missing": ["only_left"], "extra": ["only_right"]}
    assert tuple(out.first()) == (4, 2, 2)
    assert schema.compare_within(left, right, "k", exclude="^(s|only.*)$")[1].first().matching_rows == 3
    assert tuple(schema.compare_within(left.limit(0), right, "k")[1].first()) == (0, 0, 0)


def test_keyed_table_deletes_and_keeps_two_versions(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path / "kt"), "k", "at")
    with pytest.raises(ValueError):
        table.delete("at < 1")
    for n in (1, 2, 3):
        table.merge(spark.createDataFrame([("a", n), (f"b{n}", n)], "k string, at long"))
    assert sorted((r.k, r["at"]) for r in table.delete("at < 2").collect()) == [("a", 3), ("b2", 2), ("b3", 3)]
    assert sorted(p.name for p in (tmp_path / "kt").iterdir()) == ["v3", "v4"]


def test_http_sink(spark):
    got, fails = [], [1]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            if fails and fails.pop():
                self.send_response(503)
                self.end_headers()
                return
            got.append((self.headers["Content-Type"], body))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"errors": true}' if self.path == "/bad" else b"{}")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(HttpJsonSource)
    df = spark.createDataFrame([(k, None if k == 3 else f"v{k}") for k in range(7)], "k long, v string").coalesce(1)
    send = lambda path="", **o: df.write.format("http_json").mode("append").options(url=f"http://127.0.0.1:{server.server_port}{path}", batch="3", **o).save()
    send()
    rows = [r for _, body in got for r in json.loads(body)]
    assert sorted(r["k"] for r in rows) == list(range(7)) and {"k": 3} in rows and len(got) == 3
    got.clear()
    send(index="events", id="k")
    assert got[0][0] == "application/x-ndjson"
    lines = [json.loads(x) for _, body in got for x in body.splitlines()]
    assert lines[0] == {"index": {"_index": "events", "_id": "0"}} and lines[1] == {"k": 0, "v": "v0"} and len(lines) == 14
    with pytest.raises(Exception, match="refused"):
        send("/bad", index="events")
    server.shutdown()
