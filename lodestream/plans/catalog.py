"""The query catalog: callables by name, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: SQL: the event stream in the trackers' terms.
E = "e AS (SELECT event_id AS seq, user_id AS entity, event_type AS v, value AS x, epoch_us(ts) * 1000 AS t FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream in the trackers' terms: seq, entity, v (a category), x (a number) and t in nanoseconds."""
    raw = load(spark, sf_dir, "events")
    # wall-clock time taken as UTC, whatever the session's time zone
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return raw.select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity"), F.col("event_type").alias("v"), F.col("value").alias("x"), (t * 1000).alias("t"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
