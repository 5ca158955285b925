"""Sinks: files by type, Kafka, and keyed tables that take micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """Write CSV (with a header), JSON lines or Parquet."""
    writer = df.write.mode(mode).options(**options)
    if kind == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)


def to_kafka_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as the key and value that the Kafka writer takes; value is the row as JSON."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_kafka(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    """Needs Spark's Kafka connector on the class path."""
    to_kafka_rows(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def upsert(table: DataFrame, rows: DataFrame, key: str, newest: str) -> DataFrame:
    """A keyed table after a merge: of rows with one key the newest stays, and ties go to the rows that come in."""
    both = table.withColumn("_in", F.lit(0)).unionByName(rows.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in (key, "_in")]
    best = both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(newest, "_in")).alias("_m"))
    return best.select(key, "_m.*")


class KeyedTable:
    """A keyed table in versions: each merge writes the next version beside the last, so a lost writer leaves the last
    one whole. The version is read from the storage each time: the last one that was written to its end."""

    def __init__(self, spark: SparkSession, path: str, key: str, newest: str) -> None:
        self.spark, self.path, self.key, self.newest = spark, path.rstrip("/"), key, newest

    @property
    def version(self) -> int:
        sc = self.spark.sparkContext
        pattern = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")
        found = pattern.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return max((int(f.getPath().getParent().getName()[1:]) for f in found), default=0)

    def read(self) -> DataFrame | None:
        last = self.version
        return self.spark.read.parquet(f"{self.path}/v{last}") if last else None

    def merge(self, rows: DataFrame) -> DataFrame:
        """Upsert rows; the newest of each key stays."""
        old = self.read()
        return self._next(upsert(old if old is not None else rows.limit(0), rows, self.key, self.newest))

    def delete(self, where: Column | str) -> DataFrame:
        """Remove the rows for which the condition is true; those for which it is null stay."""
        old = self.read()
        if old is None:
            raise ValueError(f"{self.path} holds no table")
        gone = F.expr(where) if isinstance(where, str) else where
        return self._next(old.where(~F.coalesce(gone, F.lit(False))))

    def _next(self, table: DataFrame) -> DataFrame:
        """Write the next version; of those before only the last one stays, for readers that have begun."""
        now = self.version + 1
        table.write.mode("overwrite").parquet(f"{self.path}/v{now}")
        sc = self.spark.sparkContext
        old = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{now - 2}")
        old.getFileSystem(sc._jsc.hadoopConfiguration()).delete(old, True)
        return self.read()
