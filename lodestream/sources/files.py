"""File sources: tables in CSV, JSON lines or Parquet, tab-separated sensor logs, XML event logs, vendor JSON feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of tab-separated sensor logs: fixed values of the format.
LOG_TYPES = {"bool": "boolean", "count": "long", "int": "long", "double": "double", "interval": "double", "time": "double", "port": "int", "string": "string", "addr": "string", "subnet": "string", "enum": "string"}


def read_table(spark: SparkSession, path: str, kind: str = "auto", schema: str | T.StructType | None = None, repeat: int = 1, not_null: tuple[str, ...] = (), **options: str) -> DataFrame:
    """CSV (with a header), JSON lines or Parquet by extension or by name; rows null in not_null are dropped.

    With a schema nothing is inferred and only the columns asked for are read. repeat unions the rows so many times.
    """
    if kind == "auto":
        stem = path.removesuffix(".gz").removesuffix("/")
        kind = next((k for k, ends in (("csv", (".csv",)), ("json", (".json", ".jsonl", ".jsonlines")), ("parquet", (".parquet", ".pq"))) if stem.endswith(ends)), "")
        if not kind:
            raise ValueError(f"unknown file type: {path}")
    reader = spark.read.options(**options)
    if kind == "csv":
        reader = reader.option("header", "true")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", "true")
    df = reader.format(kind).load(path)
    if not_null:
        df = df.na.drop(subset=list(not_null))
    if repeat > 1:
        df = df.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).drop("_n")
    return df


def read_sensor_log(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated log whose ``#fields`` and ``#types`` lines name and type the columns; ``time`` becomes a timestamp.

    Only the different header lines reach the driver; files of one call that differ in them are an error, as their rows
    would be read by another file's columns.
    """
    lines = spark.read.text(path)
    headers = lines.where(F.col("value").rlike("^#(fields|types|unset_field|empty_field)\t")).distinct().limit(5).collect()
    head = {r.value.split("\t", 1)[0]: r.value.split("\t")[1:] for r in headers}
    if len(head) < len(headers):
        raise ValueError(f"files of different columns, to be read one by one: {path}")
    names, kinds = head["#fields"], head["#types"]
    unset = head.get("#unset_field", ["-"])[0]
    parts = F.split("value", "\t")
    columns = []
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        raw = F.get(parts, F.lit(i))
        value = F.when(raw != unset, raw)
        if kind == "bool":
            value = F.when(value == "T", True).when(value == "F", False)
        elif kind == "time":
            value = F.timestamp_micros(F.round(F.try_to_number(value, F.lit("9999999999.999999")) * 1000000).cast("long"))
        elif kind.startswith(("vector", "set")):
            value = F.split(value, ",")
        else:
            value = value.try_cast(LOG_TYPES.get(kind, "string"))
        columns.append(value.alias(name))
    return lines.where(~F.col("value").startswith("#")).select(*columns)


def read_xml_events(spark: SparkSession, path: str, row_tag: str = "Event", schema: str | None = None) -> DataFrame:
    """XML event fragments, one row a row_tag."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_records(spark: SparkSession, path: str, array: str = "Records", schema: str | None = None) -> DataFrame:
    """JSON documents that hold their rows in an array; each element is flattened one level."""
    raw = (spark.read.schema(schema) if schema else spark.read).option("multiLine", "true").json(path)
    return raw.select(F.explode(array).alias("r")).select("r.*")


def read_properties(spark: SparkSession, path: str, nested: str = "properties", schema: str | None = None) -> DataFrame:
    """JSON lines with a nested object whose fields come up beside the others, as nested.field."""
    raw = (spark.read.schema(schema) if schema else spark.read).json(path)
    inner = raw.schema[nested].dataType.names
    return raw.select(*(c for c in raw.columns if c != nested), *(F.col(f"{nested}.{n}").alias(f"{nested}.{n}") for n in inner))


def merge_collectors(*frames: DataFrame, order: tuple[str, ...] = ("t", "collector_id", "seq")) -> DataFrame:
    """All collectors' rows in the total order; a column that one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(*order)


def first_wins(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Left join on the first right row of each key, by order."""
    best = right.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_r"))
    return left.join(best, key, "left").select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in columns))
