"""The feature language: a declarative list of output columns, applied as one projection."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Feature:
    """An output column: its name, Spark type and expression."""

    name: str
    kind: str
    expression: Callable[[], Column]

    def column(self) -> Column:
        return self.expression().cast(self.kind).alias(self.name)


def column(name: str, kind: str, source: str | None = None) -> Feature:
    """A column of the input, renamed and cast."""
    return Feature(name, kind, lambda: F.col(source or name))


def boolean(name: str, source: str, true: tuple[str, ...], false: tuple[str, ...], default: bool | None = None) -> Feature:
    """Listed values to booleans, others to the default."""
    c = F.col
    return Feature(name, "boolean", lambda: F.when(c(source).isin(*true), True).when(c(source).isin(*false), False).otherwise(F.lit(default)))


def moment(name: str, source: str) -> Feature:
    """A timestamp; texts with an offset become UTC, texts without one are UTC."""
    return Feature(name, "timestamp", lambda: F.try_to_timestamp(F.col(source).cast("string")))


def joined(name: str, source: str, sep: str = ",") -> Feature:
    """A list as text."""
    return Feature(name, "string", lambda: F.array_join(source, sep))


def concatenated(name: str, sources: tuple[str, ...], sep: str = ", ") -> Feature:
    """Columns as one text; null if any is."""
    def whole() -> Column:
        known = F.lit(True)
        for s in sources:
            known = known & F.col(s).isNotNull()
        return F.when(known, F.concat_ws(sep, *sources))

    return Feature(name, "string", whole)


def increment(name: str, group: str, time: str, order: str, period: str = "day") -> Feature:
    """How many rows of the group came before in the period."""
    def count() -> Column:
        w = Window.partitionBy(group, F.date_trunc(period, F.coalesce(F.col(time), F.lit("1970-01-01").cast("timestamp")))).orderBy(time, order)
        return F.row_number().over(w) - 1

    return Feature(name, "long", count)


def distinct_increment(name: str, value: str, group: str, time: str, order: str, period: str = "day") -> Feature:
    """Running number of different values of the group in the period; null counts as a value."""
    own = F.col

    def count() -> Column:
        day = F.date_trunc(period, own(time))
        filled = F.coalesce(own(value).cast("string"), F.lit("nan"))
        # a value is new where its least (time, order) in the period is the row's own
        seen = F.collect_set(filled).over(Window.partitionBy(group, day).orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0))
        return F.size(seen)

    return Feature(name, "long", count)


def day_of(time: str) -> Column:
    """The row's day; rows without a time are the first day of the epoch's."""
    return F.coalesce(F.to_date(time), F.lit("1970-01-01").cast("date"))


def daily_counters(df: DataFrame, user: str, time: str, order: str, values: dict[str, Column]) -> DataFrame:
    """day, logcount (rows of the user's day before this one) and for each name the different values of its column so far
    in the day, in order of (time, order). Null values count none; rows without a time come first.

    A value counts at its first row: one window by (user, day, value) marks those, a running sum counts the marks. No frame
    collects a set."""
    out = df.withColumns({"day": day_of(time)} | {f"_value_{n}": v for n, v in values.items()})
    by_day = Window.partitionBy(user, "day").orderBy(time, order)
    out = out.withColumns({"logcount": (F.row_number().over(by_day) - 1).cast("long")} | {f"_new_{n}": (F.col(f"_value_{n}").isNotNull() & (F.row_number().over(Window.partitionBy(user, "day", f"_value_{n}").orderBy(time, order)) == 1)).cast("long") for n in values})
    upto = by_day.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({n: F.sum(f"_new_{n}").over(upto) for n in values})
    return out.drop(*(f"_{k}_{n}" for n in values for k in ("value", "new")))


@dataclass(frozen=True)
class Schema:
    """Features, columns of the input to keep (a pattern), and a row filter over the result."""

    features: tuple[Feature, ...]
    preserve: str | None = None
    row_filter: Callable[[], Column] | None = None
    flatten: dict[str, str] = field(default_factory=dict)  # JSON column to its DDL type


def apply_schema(df: DataFrame, schema: Schema) -> DataFrame:
    """One projection, then the filter. Struct fields of flattened JSON columns are addressed as column.field."""
    for name, ddl in schema.flatten.items():
        df = df.withColumn(name, F.from_json(name, ddl))
    names = {f.name for f in schema.features}
    kept = [c for c in df.columns if schema.preserve and re.fullmatch(schema.preserve, c) and c not in names]
    out = df.select(*(f.column() for f in schema.features), *kept)
    return out.where(schema.row_filter()) if schema.row_filter else out


def select_by_pattern(df: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    return df.select(*(c for c in df.columns if (not include or re.search(include, c)) and not (exclude and re.search(exclude, c))))


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of one side only, or that differ: key and side (left, right, both)."""
    names = [c for c in left.columns if c != key]
    l, r = (d.select(key, F.struct(*names).alias(s)) for d, s in ((left, "_l"), (right, "_r")))
    both = l.join(r, key, "full").where(~F.col("_l").eqNullSafe(F.col("_r")))
    return both.select(key, F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both").alias("side"))


def compare_within(left: DataFrame, right: DataFrame, key: str, abs_tol: float = 0.001, rel_tol: float = 0.005, include: str | None = None, exclude: str | None = None) -> tuple[dict[str, list[str]], DataFrame]:
    """(matching, extra and missing columns; one row of total_rows, matching_rows, diff_rows) of right against left.

    Rows meet by key; a row of left matches if each column that both have is equal, or within abs_tol + rel_tol of right's value where both
    are numbers. Two nulls are equal, and so are two NaN. Only columns that the patterns choose count.
    """
    l, r = (select_by_pattern(d, include, exclude) for d in (left, right))
    shared = [c for c in l.columns if c in r.columns and c != key]
    names = {"matching": shared, "missing": [c for c in l.columns if c not in r.columns and c != key], "extra": [c for c in r.columns if c not in l.columns and c != key]}
    both = left.select(F.col(key).alias("_k"), F.struct(F.lit(1).alias("_here"), *shared).alias("_l")).join(right.select(F.col(key).alias("_k"), F.struct(F.lit(1).alias("_here"), *shared).alias("_r")), "_k", "left")
    fits = F.col("_r").isNotNull()
    for c in shared:
        a, b = F.col(f"_l.{c}"), F.col(f"_r.{c}")
        numbers = all(isinstance(d.schema[c].dataType, T.NumericType) for d in (left, right))
        same = a.eqNullSafe(b)
        if numbers:
            x, y = a.cast("double"), b.cast("double")
            same = same | F.coalesce((x == y) | (F.isnan(x) & F.isnan(y)) | (F.abs(x - y) <= abs_tol + rel_tol * F.abs(y)), F.lit(False))
        fits = fits & same
    out = both.agg(F.count("*").alias("total_rows"), F.count_if(fits).alias("matching_rows"))
    return names, out.withColumn("diff_rows", F.col("total_rows") - F.col("matching_rows"))


def drop_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def add_classes(df: DataFrame, probabilities: str, labels: list[str], threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """A boolean column a label: its probability is over the threshold."""
    return df.withColumns({f"{prefix}{name}": F.get(F.col(probabilities), F.lit(i)) > threshold for i, name in enumerate(labels)})


def add_scores(df: DataFrame, probabilities: str, labels: list[str], prefix: str = "") -> DataFrame:
    """A column a label with its probability."""
    return df.withColumns({f"{prefix}{name}": F.get(F.col(probabilities), F.lit(i)) for i, name in enumerate(labels)})


def truncate_bytes(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Texts cut to at most so many UTF-8 bytes, at a character's edge."""
    def cut(name: str, n: int) -> Column:
        raw = F.encode(F.col(name), "UTF-8")
        # the bytes of the character that the limit would split are continuation bytes 10xxxxxx
        back = F.lit(n)
        for k in range(3, 0, -1):
            lead = F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int")
            inner = lead.between(128, 191)
            own = F.conv(F.hex(F.substring(raw, n + 1 - k, 1)), 16, 10).cast("int")
            rest = inner
            for j in range(1, k):
                rest = rest & F.conv(F.hex(F.substring(raw, n + 1 - j, 1)), 16, 10).cast("int").between(128, 191)
            back = F.when(rest & ~own.between(128, 191), F.lit(n - k)).otherwise(back)
        return F.when(F.octet_length(name) <= n, F.col(name)).otherwise(F.decode(F.substring(raw, F.lit(1), back), "UTF-8"))

    return df.withColumns({c: cut(c, n) for c, n in limits.items()})
