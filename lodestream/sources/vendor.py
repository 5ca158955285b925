"""Readers of vendor logs and exports: polled metrics, lease logs, host inventories, access records and paged exports.

Line formats are read with a schema, so nothing is inferred; ``seq`` grows with the place in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.sources.files import read_records

METRIC = "name string, tags map<string,string>, fields map<string,string>, timestamp long"
INTERFACE = "struct<interface:string,mac:string>"
#: A lease line in its server's default layout: time, code, hardware address, then what was leased or let go; fixed values of the format.
LEASE_HEAD = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}) +\w+ +\[[^\]]*\] (DHCP4_LEASE_ALLOC|DHCP4_RELEASE|DHCP4_DECLINE) "
HARDWARE = r"hwtype=\d+ ([0-9a-f:]{17})"
LEASED = r"lease ([0-9.]+) has been allocated"
LET_GO = r"address ([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)"
SECONDS = r"for (\d+) seconds"


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.monotonically_increasing_id())


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics, a JSON object a line: name, tags, fields, timestamp (seconds) and seq; values are text."""
    return _numbered(spark.read.schema(METRIC).json(path))


def read_leases(spark: SparkSession, path: str) -> DataFrame:
    """A row a lease that was given, released or declined: seq, time (ns, UTC), code, mac, ip and lease_seconds (null but
    for one given). Other lines are skipped."""
    line = F.col("value")
    found = lambda pattern, k=1: F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))
    rows = _numbered(spark.read.text(path)).where(line.rlike(LEASE_HEAD))
    clock = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(_at AS TIMESTAMP_NTZ)) * 1000000")
    rows = rows.select("seq", found(LEASE_HEAD).alias("_at"), found(LEASE_HEAD, 2).alias("code"), found(HARDWARE).alias("mac"), F.coalesce(found(LEASED), found(LET_GO)).alias("ip"), found(SECONDS).cast("int").alias("lease_seconds"))
    given = F.col("code") == "DHCP4_LEASE_ALLOC"
    return rows.select("seq", clock.alias("time"), "code", "mac", "ip", F.when(given, F.col("lease_seconds")).alias("lease_seconds"))


def read_host_interfaces(spark: SparkSession, path: str) -> DataFrame:
    """A row an interface that a host's results log reports: the rows of a snapshot, or the columns of an added row."""
    raw = _numbered(spark.read.schema(f"action string, unixTime long, hostIdentifier string, snapshot array<{INTERFACE}>, columns {INTERFACE}").json(path))
    reported = F.when(F.col("action") == "snapshot", F.col("snapshot")).when(F.col("action") == "added", F.array("columns"))
    return raw.select("seq", "unixTime", "hostIdentifier", F.explode(reported).alias("_i")).select("seq", "unixTime", "hostIdentifier", "_i.interface", "_i.mac")


def read_access_records(spark: SparkSession, path: str, attributes: list[str]) -> DataFrame:
    """Records of an access server's detail file: a line of time, then indented ``name = value`` lines, then a blank line.
    A row a record: seq and the attributes asked for; quotes and their escapes are taken off, the last of equal names holds.

    Spark splits the file at blank lines, so a record is never cut between tasks.
    """
    raw = _numbered(spark.read.option("lineSep", "\n\n").text(path))
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^[ \t].*="))

    def value(name: str) -> Column:
        own = F.filter(lines, lambda x: F.trim(F.substring_index(x, "=", 1), F.lit(" \t")) == name)
        text = F.trim(F.regexp_replace(F.element_at(own, -1), r"^[^=]*=", ""), F.lit(" \t\r"))
        bare = F.regexp_replace(F.regexp_extract(text, r'^"(.*)"$', 1), r'\\(["\\])', "$1")
        return F.when(F.size(own) > 0, F.when(text.rlike(r'^".*"$'), bare).otherwise(text)).alias(name)

    return raw.where(F.size(lines) > 0).select("seq", *map(value, attributes))


def read_export(spark: SparkSession, path: str, array: str, schema: str | None = None) -> DataFrame:
    """Rows of exports that hold them in one array (``result``, ``results``, ``Report_Entry``), numbered by seq.

    Each file is one JSON document and is read by one task: export by pages.
    """
    return _numbered(read_records(spark, path, array, schema))


def read_objects(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """Records of an audit log, values as written, numbered by seq: a JSON object a line, or with array one JSON array a file (which one task reads)."""
    return _numbered(spark.read.schema(schema).option("multiLine", str(array).lower()).json(path))


def read_audit_properties(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Audit records, a JSON object a line, by their ``properties`` object or, without one, by their own fields."""
    raw = _numbered(spark.read.text(path)).where(F.trim("value") != "")
    whole = F.coalesce(F.get_json_object("value", "$.properties"), F.col("value"))
    return raw.select("seq", F.from_json(whole, properties).alias("_p")).select("seq", "_p.*")
