"""Session helpers: table loading and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: a query's shuffle files go as soon as it has ended.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder with Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local master gets a folder here; a cluster is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestream-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def written(df: DataFrame, tag: str, group_rows: int | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again. Its shuffles aren't needed any more and end with the write.

    group_rows bounds a row group where rows are MB large: Spark reads up to 4,096 rows of a row group at once, whatever their bytes.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.option("parquet.block.row.count.limit", group_rows) if group_rows else out).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for df in tables:
        if path := _paths.pop(df, None):
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
