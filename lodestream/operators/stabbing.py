"""Which interval holds at an instant: of those of a key that cover it, the one of highest priority, in n log n.

An interval's ends are numbered within its key, so it covers a run of places between them, and its priority is a rank. What holds at a place is
found once a place and not once a row: a run is a part of a block of places at either end, and whole blocks between, which are a union of few
dyadic nodes (two a level at most). Places keep the greatest rank of the parts over them, nodes that of their runs, both as plain numbers; a
block looks up the nodes above it, one a level. A row then takes what the last end before it began. Nothing meets pair by pair, and an interval
without an end is as cheap as any other. Where no key has more than ``FEW`` intervals, which is counted first, a row meets those of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.feeds import latest
from lodestream.session import written

#: Instants of a key between two of these marks are one group when places are looked up.
SLICE_NS = 86_400_000_000_000
FEW = 64
#: Places are 2 ** BLOCK_BITS a block.
BLOCK_BITS = 4


def _runs(intervals: DataFrame, key: str, start: str, end: str, priority: list[str], carry: Column) -> DataFrame:
    """Intervals as runs of places: _k, _r (rank of the priority within the key), _s and _e (instants), _a and _b (their places), _c. Written once."""
    own = intervals.where(F.col(key).isNotNull() & (F.col(start) < F.col(end))).select(F.col(key).alias("_k"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), F.struct(*(F.col(p) for p in priority)).alias("_p"), carry.alias("_c"))
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("_p")).cast("long"))
    ends = own.select("_k", "_r", "_c", F.explode(F.array("_s", "_e")).alias("_s"))
    ends = ends.withColumn("_a", (F.dense_rank().over(Window.partitionBy("_k").orderBy("_s")) - 1).cast("long"))
    two = Window.partitionBy("_k", "_r").orderBy("_s")
    return written(ends.withColumns({"_e": F.lead("_s").over(two), "_b": F.lead("_a").over(two)}).where("_b IS NOT NULL"), "runs")


def _ends(runs: DataFrame) -> DataFrame:
    """_k, _place, _at of every end; an instant stands there once a run."""
    return runs.select("_k", F.explode(F.array(*(F.struct(F.col(p).alias("p"), F.col(t).alias("t")) for p, t in (("_a", "_s"), ("_b", "_e"))))).alias("_end")).select("_k", F.col("_end.p").alias("_place"), F.col("_end.t").alias("_at"))


def _nodes(runs: DataFrame, first: str, last: str, *more: str) -> DataFrame:
    """A row a dyadic node of the places from first up to but not with last: _k, level, node and more columns."""
    levels = runs.where(f"{first} < {last}").select("_k", *more, F.expr(first).alias("_x"), F.expr(last).alias("_y"), F.explode(F.expr(f"sequence(0, cast(floor(log2({last} - {first})) as int) + 1)")).alias("level"))
    levels = levels.withColumns({"_x": F.expr("shiftright(_x + shiftleft(1L, level) - 1, level)"), "_y": F.expr("shiftright(_y, level)")}).where("_x < _y")
    both = F.array(F.when(F.col("_x") % 2 == 1, F.col("_x")), F.when((F.col("_y") % 2 == 1) & (F.col("_x") + F.col("_x") % 2 < F.col("_y")), F.col("_y") - 1))
    return levels.select("_k", *more, "level", F.explode(both).alias("node")).where("node IS NOT NULL")


def _above(places: DataFrame, place: str, most: int) -> DataFrame:
    """The nodes over each place, most being more than the greatest of them."""
    return places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(most.bit_length())))).withColumn("node", F.expr(f"shiftright({place}, level)"))


def _winners(runs: DataFrame, most: int) -> DataFrame:
    """_k, _at, _c: what holds from each end on, up to the next; null where nothing does."""
    size, bits = 1 << BLOCK_BITS, BLOCK_BITS
    whole = runs.withColumns({"_f": F.expr(f"shiftright(_a + {size - 1}, {bits})"), "_l": F.expr(f"shiftright(_b, {bits})")})
    few = lambda a, b: f"CASE WHEN {a} < {b} THEN sequence({a}, {b} - 1) ELSE cast(array() AS array<bigint>) END"
    parts = F.expr(f"CASE WHEN _f > _l THEN sequence(_a, _b - 1) ELSE concat({few('_a', f'_f * {size}')}, {few(f'_l * {size}', '_b')}) END")
    parts = whole.select("_k", F.explode(parts).alias("_place"), "_r").groupBy("_k", "_place").agg(F.max("_r").alias("_r"))
    ends = _ends(runs).groupBy("_k", "_place").agg(F.min("_at").alias("_at"))
    nodes = _nodes(whole, "_f", "_l", "_r").groupBy("_k", "level", "node").agg(F.max("_r").alias("_r"))
    blocks = _above(ends.where(f"_place % {size} = 0").select("_k", F.expr(f"shiftright(_place, {bits})").alias("_block")), "_block", most >> bits)
    blocks = blocks.join(nodes, ["_k", "level", "node"]).groupBy("_k", "_block").agg(F.max("_r").alias("_r"))
    blocks = blocks.select("_k", F.explode(F.expr(f"sequence(_block * {size}, _block * {size} + {size - 1})")).alias("_place"), "_r")
    best = ends.unionByName(parts, allowMissingColumns=True).unionByName(blocks, allowMissingColumns=True).groupBy("_k", "_place").agg(F.min("_at").alias("_at"), F.max("_r").alias("_r"))
    return best.where("_at IS NOT NULL").join(runs.select("_k", "_r", "_c"), ["_k", "_r"], "left").select("_k", "_at", "_c")


def _looked_up(df: DataFrame, key: str, facts: DataFrame, value: str, name: str, slice_ns: int) -> DataFrame:
    """df with ``name``: the value of the last fact of the row's key (_k, _at) up to t."""
    aside = {c: f"_d{i}" for i, c in enumerate(df.columns)}
    rows = df.select(F.col("t").alias("seq"), *(F.col(c).alias(a) for c, a in aside.items()))
    known = F.when(F.col("seq").isNotNull(), F.col(aside[key]))
    out = latest(rows, known, facts.withColumnRenamed("_at", "seq"), F.col("_k"), F.col(value), name, slice_ns)
    return out.select(*(F.col(a).alias(c) for c, a in aside.items()), F.when(known.isNotNull(), F.col(name)).alias(name))


def _most(intervals: DataFrame, key: str) -> int:
    return intervals.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.max("count")).first()[0] or 0


def covering(df: DataFrame, intervals: DataFrame, key: str, start: str, end: str, priority: list[str], carry: list[str], name: str, slice_ns: int = SLICE_NS, few: int = FEW) -> DataFrame:
    """df (with t and a unique seq) with ``name``: a struct of carry of the interval of the row's key that covers t and has the
    greatest priority; null without one. Intervals are [start, end); those that are empty, or null in the key or an end, hold nowhere."""
    most = _most(intervals, key)
    if most <= few:
        own = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*(F.col(p) for p in priority)).alias("_p"), F.struct(*(F.col(c) for c in carry)).alias("_c"))
        found = df.select(F.col(key).alias("_k"), "t", F.col("seq").alias("_q")).join(own, "_k").where("_s <= t AND t < _e").groupBy("_q").agg(F.max_by("_c", "_p").alias(name))
        return df.join(found.withColumnRenamed("_q", "seq"), "seq", "left").select(*df.columns, name)
    runs = _runs(intervals, key, start, end, priority, F.struct(*(F.col(c) for c in carry)))
    return _looked_up(df, key, written(_winners(runs, 2 * most), "winners"), "_c", name, slice_ns)


def covering_all(df: DataFrame, intervals: DataFrame, key: str, start: str, end: str, value: str, name: str, slice_ns: int = SLICE_NS, few: int = FEW) -> DataFrame:
    """df with ``name``: the different values of all intervals of the row's key that cover t, sorted; null without one."""
    most = _most(intervals, key)
    if most <= few:
        own = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_c"))
        found = df.select(F.col(key).alias("_k"), "t", F.col("seq").alias("_q")).join(own, "_k").where("_s <= t AND t < _e").groupBy("_q").agg(F.array_sort(F.collect_set("_c")).alias(name))
        return df.join(found.withColumnRenamed("_q", "seq"), "seq", "left").select(*df.columns, name)
    runs = _runs(intervals, key, start, end, [value], F.col(value))
    asked = df.select(F.col(key).alias("_k"), "t", F.col("seq").alias("_q")).where("_k IS NOT NULL AND t IS NOT NULL")
    asked = _looked_up(asked, "_k", _ends(runs).distinct(), "_place", "_place", slice_ns).where("_place IS NOT NULL").select("_k", "_q", "_place")
    asked = written(asked, "asked")
    held = _nodes(runs, "_a", "_b", "_c").distinct()
    # once a place that rows ask for, not once a row
    found = _above(asked.select("_k", "_place").distinct(), "_place", 2 * most).join(held, ["_k", "level", "node"]).groupBy("_k", "_place").agg(F.array_sort(F.collect_set("_c")).alias(name))
    found = asked.join(found, ["_k", "_place"]).select(F.col("_q").alias("seq"), name)
    return df.join(found, "seq", "left").select(*df.columns, name)
