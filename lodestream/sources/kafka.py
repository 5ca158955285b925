"""Kafka source options and row decoding; the connector itself comes with Spark's Kafka package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kafka_options(servers: str, topics: tuple[str, ...], offsets: str = "latest", max_per_trigger: int | None = None) -> dict[str, str]:
    """offsets: earliest, latest, or a JSON of offsets by topic and partition."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": offsets, "failOnDataLoss": "true"}
    return out | ({"maxOffsetsPerTrigger": str(max_per_trigger)} if max_per_trigger else {})


def decode(raw: DataFrame, schema: str | T.StructType, provenance: bool = False) -> DataFrame:
    """JSON values to columns; with provenance the topic, partition and offset of each row. Undecodable values are null rows."""
    row = F.from_json(F.col("value").cast("string"), schema).alias("r")
    more = [F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset")] if provenance else []
    return raw.select(row, *more).select("r.*", *(c.alias(n) for c, n in zip([F.col("kafka_topic"), F.col("kafka_partition"), F.col("kafka_offset")], ["kafka_topic", "kafka_partition", "kafka_offset"], strict=True) if more))


def read_stream(spark: SparkSession, schema: str | T.StructType, options: dict[str, str], provenance: bool = False) -> DataFrame:
    return decode(spark.readStream.format("kafka").options(**options).load(), schema, provenance)


def read_batch(spark: SparkSession, schema: str | T.StructType, options: dict[str, str], provenance: bool = False) -> DataFrame:
    return decode(spark.read.format("kafka").options(**options | {"endingOffsets": "latest"}).load(), schema, provenance)
