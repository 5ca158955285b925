"""Watched folders, daily sources and their counters."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lodestream.operators.schema import daily_counters
from lodestream.sources import watched

SIGN_IN = "properties struct<createdDateTime string, userPrincipalName string, appDisplayName string, location struct<city string, state string, countryOrRegion string>>"


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(x) + "\n" for x in lines))


def drain(spark, stream, tmp_path, name):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}_out")).option("checkpointLocation", str(tmp_path / f"{name}_at")).trigger(**watched.trigger(False)).start()
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / f"{name}_out"))


def test_each_file_is_read_once_over_restarts(spark, tmp_path):
    stream = lambda: watched.watch_table(spark, str(tmp_path / "in"), "k long, v string", glob="*.json", max_files=1, not_null=("v",))
    put(tmp_path / "in", "a.json", [{"k": 1, "v": "x"}, {"k": 2}])
    put(tmp_path / "in", "skip.txt", [{"k": 9, "v": "z"}])
    assert sorted(r.k for r in drain(spark, stream(), tmp_path, "w").collect()) == [1]
    put(tmp_path / "in", "b.json", [{"k": 3, "v": "y"}])
    (tmp_path / "in" / "deep").mkdir()
    put(tmp_path / "in" / "deep", "c.json", [{"k": 4, "v": "y"}])
    got = drain(spark, stream(), tmp_path, "w")  # the same query again, from its checkpoint
    assert sorted(r.k for r in got.collect()) == [1, 3, 4] and got.where("source_file LIKE '%deep/c.json'").count() == 1
    assert sorted(r.k for r in drain(spark, stream(), tmp_path, "w").collect()) == [1, 3, 4]


def test_read_files_are_moved(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"k": 1}])
    (tmp_path / "done").mkdir()
    stream = lambda: watched.watch_table(spark, str(tmp_path / "in"), "k long", clean="archive", archive=str(tmp_path / "done"))
    drain(spark, stream(), tmp_path, "m")
    put(tmp_path / "in", "b.json", [{"k": 2}])
    assert sorted(r.k for r in drain(spark, stream(), tmp_path, "m").collect()) == [1, 2]
    put(tmp_path / "in", "c.json", [{"k": 3}])
    assert sorted(r.k for r in drain(spark, stream(), tmp_path, "m").collect()) == [1, 2, 3]
    assert list((tmp_path / "done").rglob("a.json"))
    with pytest.raises(ValueError):
        watched.watch_table(spark, "x", "k long", clean="archive")


def test_triggers():
    assert watched.trigger(False) == {"availableNow": True} and watched.trigger(True, "1 second") == {"processingTime": "1 second"}


def sign_in(user, minute, city, app, day=1):
    at = datetime.datetime(2024, 5, day) + datetime.timedelta(minutes=minute)
    return {"properties": {"createdDateTime": at.isoformat() + "Z", "userPrincipalName": user, "appDisplayName": app, "location": {"city": city, "state": None, "countryOrRegion": "X"}}}


def test_sign_in_counters_by_batch_and_stream(spark, tmp_path):
    first = [sign_in("u", 1, "A", "mail"), sign_in("u", 2, "A", "chat"), sign_in("v", 3, None, None)]
    later = [sign_in("u", 4, "B", "mail"), sign_in("u", 5, None, "mail"), sign_in("u", 6, "A", "chat", day=2), sign_in("u", 7, "C", "chat", day=20), sign_in("u", 8, "C", "mail", day=20)]
    put(tmp_path / "in", "a.json", first)

    def stream():
        return watched.sign_ins(watched.watch_table(spark, str(tmp_path / "in"), SIGN_IN))

    names = ["userPrincipalName", "time", "locincrement", "appincrement", "logcount"]
    counts = lambda: watched.counted_stream(stream(), "userPrincipalName", watched.SIGN_IN_COUNTERS, "createdDateTime").select(names)
    drain(spark, counts(), tmp_path, "s")
    put(tmp_path / "in", "b.json", later)
    got = sorted(map(tuple, drain(spark, counts(), tmp_path, "s").collect()))
    batch = watched.counted(watched.sign_ins(spark.read.schema(SIGN_IN).json(str(tmp_path / "in"))), "userPrincipalName", watched.SIGN_IN_COUNTERS, "createdDateTime")
    assert got == sorted(map(tuple, batch.select(names).collect()))
    assert [(x[0], *x[2:]) for x in got] == [("u", 1, 1, 0), ("u", 1, 2, 1), ("u", 2, 2, 2), ("u", 3, 2, 3), ("u", 1, 1, 0), ("u", 1, 1, 0), ("u", 1, 2, 1), ("v", 1, 0, 0)]


def test_audit_trail_and_second_factor(spark, tmp_path):
    record = {"eventTime": "2024-01-01T00:00:00Z", "userIdentity": {"accountId": 12, "type": "Root"}, "requestParameters": {"ownersSet": {"items": [{"owner": "self"}]}}}
    put(tmp_path / "in", "t.json", [{"Records": [record, record | {"requestParameters": None}]}])
    schema = "Records array<struct<eventTime string, userIdentity struct<accountId long, type string>, requestParameters struct<ownersSet struct<items array<struct<owner string>>>>>>"
    got = watched.audit_trail(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()
    assert [(r.userIdentityaccountId, r.userIdentitytype, r.requestParametersownersSetitems) for r in got] == [("Account-12", "Root", "self"), ("Account-12", "Root", None)]
    logs = spark.createDataFrame([("2024-01-01T00:00:00Z", ("a", ("C", None, "X")))], "isotimestamp string, access_device struct<name string, location struct<city string, state string, country string>>")
    out = watched.counted(watched.second_factor_logs(logs), "isotimestamp", watched.SECOND_FACTOR_COUNTERS, "isotimestamp")
    assert out.first().locincrement == 1 and "accessdevicelocationcity" in out.columns
    with pytest.raises(ValueError):
        watched.clean_names(spark.createDataFrame([(1, 2)], "a_b int, ab int"))


def test_daily_counters_of_a_busy_user(spark):
    df = spark.range(100_000).select(F.lit("u").alias("u"), F.timestamp_seconds(F.lit(0)).alias("at"), "id", (F.col("id") % 7).alias("v"))
    got = daily_counters(df, "u", "at", "id", {"n": F.col("v")})
    assert got.agg(F.max("n"), F.max("logcount"), F.sum("n")).first() == (7, 99_999, 7 * 100_000 - 21)
