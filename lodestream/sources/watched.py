"""Watched folders: files that arrive are read once each, by Structured Streaming's file source.

What has been read stands in the query's checkpoint, so a restart goes on with the files that came since. A folder is
read once to its end (``trigger(False)``) or watched (``trigger(True)``); the batch of files, their order, their age and
what becomes of read ones are options of the source.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestream.operators.schema import daily_counters, day_of

#: Characters that names of flattened columns lose: fixed values of the format.
NOT_IN_NAMES = "_,.{}:"
#: Where a row comes from: added by watch_table, kept by name.
SOURCE = ("source_file", "source_modified")
#: Stands for a missing part of a place: a fixed value.
NO_PLACE = "nan"


def watch_table(
    spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "json", glob: str | None = None, max_files: int | None = None, newest_first: bool = False,
    max_age: str | None = None, recursive: bool = True, clean: str = "off", archive: str | None = None, not_null: tuple[str, ...] = (), **options: str,
) -> DataFrame:
    """A stream of the files under path, with source_file and source_modified.

    glob chooses by name; max_files bounds a micro-batch and newest_first orders it; files older than max_age against the newest one are
    left out; clean removes read files (``delete``) or moves them to archive (``archive``) after their batch; rows null in not_null are dropped.
    """
    if clean == "archive" and not archive:
        raise ValueError("clean='archive' needs a folder for read files")
    chosen = {
        "pathGlobFilter": glob, "maxFilesPerTrigger": max_files, "latestFirst": "true" if newest_first else None, "maxFileAge": max_age, "recursiveFileLookup": "true" if recursive else None,
        "cleanSource": clean, "sourceArchiveDir": archive, "header": "true" if kind == "csv" else None,
    }
    reader = spark.readStream.format(kind).schema(schema).options(**{k: str(v) for k, v in chosen.items() if v is not None} | options)
    rows = reader.load(path).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("source_modified"))
    return rows.na.drop(subset=list(not_null)) if not_null else rows


def trigger(watch: bool, batch_timeout: str = "5 seconds") -> dict[str, Any]:
    """For ``writeStream.trigger(**...)``: look again and again, or read what is there and end."""
    return {"processingTime": batch_timeout} if watch else {"availableNow": True}


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Every field of nested structs as a column of its own, names joined by the separator; arrays and maps stay."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    quoted = lambda path: ".".join(f"`{p}`" for p in path)
    return df.select(*(F.col(quoted(p)).alias(separator.join(p)) for p in leaves(df.schema, ())))


def clean_names(df: DataFrame, remove: str = NOT_IN_NAMES) -> DataFrame:
    """Columns under their names without the characters to remove and without blanks at the ends; two that become one are an error."""
    names = [c if c in SOURCE else c.translate(str.maketrans("", "", remove)).strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names that become one: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def place(*parts: str) -> Column:
    """The parts of a place in one text; a missing part is ``nan``."""
    return F.concat_ws(", ", *(F.coalesce(F.col(p), F.lit(NO_PLACE)) for p in parts))


def sign_ins(raw: DataFrame) -> DataFrame:
    """Cloud directory sign-ins: the fields of ``properties``, flattened, with time."""
    out = clean_names(flattened(raw.select("properties.*", *_source(raw))))
    return out.withColumn("time", F.try_to_timestamp("createdDateTime"))


def second_factor_logs(raw: DataFrame) -> DataFrame:
    """Second-factor logs, flattened, with time."""
    return clean_names(flattened(raw)).withColumn("time", F.try_to_timestamp("isotimestamp"))


def audit_trail(raw: DataFrame) -> DataFrame:
    """Cloud audit records: the elements of ``Records``, flattened without dots; event_dt; number-like account ids as Account-<id>."""
    rows = raw.select(F.explode("Records").alias("r"), *_source(raw)).select("r.*", *_source(raw))
    out = clean_names(flattened(rows), ".").withColumn("event_dt", F.try_to_timestamp("eventTime"))
    account = "userIdentityaccountId"
    if account in out.columns and isinstance(out.schema[account].dataType, T.NumericType):
        out = out.withColumn(account, F.concat(F.lit("Account-"), F.col(account).cast("string")))
    owners = "requestParametersownersSetitems"
    kind = out.schema[owners].dataType if owners in out.columns else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):  # the first field of the first element
        out = out.withColumn(owners, F.get(owners, F.lit(0))[kind.elementType.fields[0].name])
    return out


def _source(raw: DataFrame) -> list[str]:
    return [c for c in SOURCE if c in raw.columns]


SIGN_IN_COUNTERS = {"locincrement": ("locationcity", "locationstate", "locationcountryOrRegion"), "appincrement": ("appDisplayName",)}
SECOND_FACTOR_COUNTERS = {"locincrement": ("accessdevicelocationcity", "accessdevicelocationstate", "accessdevicelocationcountry")}


def counted(df: DataFrame, user: str, counters: dict[str, tuple[str, ...]], order: str) -> DataFrame:
    """Daily counters of a read table: distinct values so far of each counter and logcount, by user and day."""
    values = {name: place(*parts) if len(parts) > 1 else F.col(parts[0]) for name, parts in counters.items()}
    return daily_counters(df, user, "time", order, values)


class DailyCounters(StatefulProcessor):
    """daily_counters over a stream. A user's days are keyed state: their counts, and the values seen in them. Days more than
    ``keep_days`` before the user's newest one go; a row that comes for such a day starts it anew. Rows of a micro-batch are taken in
    order of (time, order)."""

    def __init__(self, order: str, values: list[str], keep_days: int) -> None:
        self.order, self.values, self.keep_days = order, values, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "day long, name string, value string", "n long")
        self.counts = handle.getMapState("counts", "day long", ", ".join(f"n{k} long" for k in range(1 + len(self.values))))

    def _one(self, day: int, frame: pd.DataFrame) -> pd.DataFrame:
        before, *sizes = self.counts.getValue((day,)) if self.counts.containsKey((day,)) else [0] * (1 + len(self.values))
        frame["logcount"] = range(before, before + len(frame))
        for k, name in enumerate(self.values):
            found: set[str] = set()  # of this batch: one look at the state a value
            out = []
            for v in frame[f"value_of_{name}"]:
                if v is not None and not pd.isna(v) and v not in found:
                    found.add(v)
                    if not self.seen.containsKey((day, name, v)):
                        sizes[k] += 1
                        self.seen.updateValue((day, name, v), (sizes[k],))
                out.append(sizes[k])
            frame[name] = out
        self.counts.updateValue((day,), (before + len(frame), *sizes))
        return frame

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["time", self.order], kind="stable", na_position="first")
        for day, own in frame.groupby("day_number", sort=True):
            yield self._one(int(day), own.copy())
        days = [k[0] for k in self.counts.keys()]
        gone = {d for d in days if d < max(days) - self.keep_days}
        if gone:
            for k in [k for k in self.seen.keys() if k[0] in gone]:
                self.seen.removeKey(tuple(k))
            for d in gone:
                self.counts.removeKey((d,))

    def close(self) -> None:
        pass


def counted_stream(stream: DataFrame, user: str, counters: dict[str, tuple[str, ...]], order: str, keep_days: int = 3) -> DataFrame:
    """counted() over a stream, in append mode; needs the RocksDB state store."""
    values = {name: place(*parts) if len(parts) > 1 else F.col(parts[0]) for name, parts in counters.items()}
    rows = stream.withColumns({"day": day_of("time"), "day_number": F.unix_date(day_of("time")).cast("long")} | {f"value_of_{name}": v.cast("string") for name, v in values.items()})
    schema = rows.select("*", F.lit(0).cast("long").alias("logcount"), *(F.lit(0).cast("long").alias(n) for n in values)).schema
    out = rows.groupBy(user).transformWithStateInPandas(statefulProcessor=DailyCounters(order, list(values), keep_days), outputStructType=schema, outputMode="Append", timeMode="None")
    return out.drop("day_number", *(f"value_of_{name}" for name in values))
