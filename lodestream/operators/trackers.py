"""Per-entity trackers over time-ordered rows, as window expressions.

Every function takes a frame with an entity column ``entity``, an event time ``t`` (long, nanoseconds) and a tie
breaker ``seq``; (t, seq) is the total order. Rows are kept and columns are added. Windows named w look at the
half-open interval (t-w, t], or at the strictly earlier instants [t-w, t). Rows that tie in t are taken in order of
seq, or count as out of order where the function says so; an out-of-order row gets nulls and changes nothing.

All state is a Catalyst window partitioned by entity, so one shuffle on the entity serves a chain of trackers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.order_statistics import window_order_statistics
from lodestream.session import written

SECOND = 1_000_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86400 * SECOND

#: Slices of a moving window's length, and counts that run side by side (a power of 2), where a mode is kept up.
SLICES = 8
WIDE = 16


def _ordered(*keys: str) -> Window:
    return Window.partitionBy("entity", *keys).orderBy("t", "seq")


def _after_in_tie(value: Column) -> Column:
    """Sum of value over the rows of the same instant that come after this row."""
    # the instant's total less the running sum: a frame that ends with the partition would be summed anew for each row
    instant = Window.partitionBy("entity", "t")
    upto = instant.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.sum(value).over(instant), F.lit(0)) - F.coalesce(F.sum(value).over(upto), F.lit(0))


def _trailing_sum(value: Column, window_ns: int) -> Column:
    """Sum of whole numbers over (t-w, t] up to this row in the total order.

    It is the running sum less the running sum at t-w: both frames only grow, so Spark keeps them up in one pass, where a sliding frame is
    summed anew for each row.
    """
    w = Window.partitionBy("entity").orderBy("t")
    upto, gone = F.sum(value).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.sum(value).over(w.rangeBetween(Window.unboundedPreceding, -window_ns))
    return F.coalesce(upto, F.lit(0)) - F.coalesce(gone, F.lit(0)) - _after_in_tie(value)


def two_blocks(df: DataFrame, keys: list[str], window_ns: int, values: list[str], aggregates: Callable[[Callable[[str], Column], bool], dict[str, Column]], inclusive: bool = True) -> DataFrame:
    """df with aggregates over (t-w, t] of all rows of the keys, ties and all, or over [t-w, t), in two parts a name: ``name_0`` over the window's
    rows in the row's own block of time, ``name_1`` over those in the block before.

    Time is cut into blocks of w, so a window is the start of its block and the end of the block before. Both parts are frames that only
    grow, one forwards and one backwards, where a sliding frame is made anew for each row; nothing is subtracted, so fractions and extremes are as
    exact as in one frame. A row stands in its own block and, with its values alone, in the next. ``aggregates`` gives the columns of a part: its
    arguments are a value's column in the part, null outside, and whether the part runs backwards.
    """
    block = F.floor(F.col("t") / F.lit(window_ns)).cast("long")
    block = block - (block * window_ns > F.col("t")).cast("long") + ((block + 1) * window_ns <= F.col("t")).cast("long")  # the quotient of a long is rounded
    both = F.when(F.col("t").isNotNull(), F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("b"), F.lit(True).alias("own"))))
    out = df.withColumn("_block", F.explode(both))
    here = F.col("_block.own")
    told = {*keys, *values, "t"}
    out = out.select(*(F.col(c) if c in told else F.when(here, F.col(c)).alias(c) for c in df.columns), F.col("_block.b").alias("_b"), here.alias("_here"))
    out = out.withColumn("_phase", F.col("t") - (F.col("_b") - F.when(F.col("_here"), 0).otherwise(1)) * window_ns)
    out = out.withColumn("_back", -F.col("_phase"))
    part = Window.partitionBy(*keys, "_b")
    frames = (part.orderBy("_phase").rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1), part.orderBy("_back").rangeBetween(Window.unboundedPreceding, -1 if inclusive else 0))
    for k, frame in enumerate(frames):
        inside = F.col("_here") if k == 0 else ~F.col("_here")
        out = out.withColumns({f"{n}_{k}": a.over(frame) for n, a in aggregates(lambda c, inside=inside: F.when(inside, F.col(c)), k == 1).items()})
    return out.where("_here").drop("_b", "_here", "_phase", "_back")


def _added(name: str) -> Column:
    """The parts' sum, 0 without a row."""
    return F.coalesce(F.col(f"{name}_0"), F.lit(0)) + F.coalesce(F.col(f"{name}_1"), F.lit(0))


def _moment(name: str, n: str, a: str, b: str) -> Column:
    """A sum of products of deviations from the mean, of the parts' own and the distance of their means: a and b name the means, n the counts."""
    n0, n1 = (F.coalesce(F.col(f"{n}_{k}"), F.lit(0)) for k in (0, 1))
    apart = lambda c: F.coalesce(F.col(f"{c}_0") - F.col(f"{c}_1"), F.lit(0.0))
    return F.when(n0 + n1 > 0, _added(name) + apart(a) * apart(b) * (n0 * n1 / F.greatest(n0 + n1, F.lit(1))))


def _mean(name: str, n: str) -> Column:
    n0, n1 = (F.coalesce(F.col(f"{n}_{k}"), F.lit(0)) for k in (0, 1))
    # a part alone gives its mean as it is
    both = F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0")) * (n1 / F.greatest(n0 + n1, F.lit(1)))
    return F.coalesce(both, F.col(f"{name}_0"), F.col(f"{name}_1"))


def _parts(*names: str) -> list[str]:
    return [f"{n}_{k}" for n in names for k in (0, 1)]


def first_of_instant() -> Column:
    """False for a row that ties with an earlier one of its entity."""
    return F.row_number().over(Window.partitionBy("entity", "t").orderBy("seq")) == 1


def distinct_window(df: DataFrame, value: str, window_ns: int = HOUR) -> DataFrame:
    """distinct_n and total_n in (t-w, t], and first_in_window: no equal value in the window before.

    A value counts from its first row until w after its last one: rows of a value form runs without gaps of w, each
    run counts from its start until its end, and two running sums tell how many are open. That is n log n in one derivation,
    where collecting a set in each frame is quadratic in the frame.
    """
    by_value = _ordered(value)
    known = F.col(value).isNotNull()
    out = df.withColumns({
        "first_in_window": F.when(known, F.coalesce(F.col("t") - F.lag("t").over(by_value) >= window_ns, F.lit(True))),
        "_end": known & F.coalesce(F.lead("t").over(by_value) - F.col("t") >= window_ns, F.lit(True)),
        "total_n": _trailing_sum(known.cast("long"), window_ns),
    })
    # runs that began by this row, less those that were over by its instant: both frames only grow
    begun = F.sum(F.coalesce(F.col("first_in_window").cast("long"), F.lit(0))).over(_ordered().rowsBetween(Window.unboundedPreceding, 0))
    over = F.sum(F.col("_end").cast("long")).over(Window.partitionBy("entity").orderBy("t").rangeBetween(Window.unboundedPreceding, -window_ns))
    return out.withColumn("distinct_n", begun - F.coalesce(over, F.lit(0))).drop("_end")


def ratio_window(df: DataFrame, flag: Column, window_ns: int = 5 * MINUTE, min_denominator: int = 10) -> DataFrame:
    """numerator, denominator in (t-w, t], and their ratio, null below min_denominator."""
    out = df.withColumns({"numerator": _trailing_sum(F.coalesce(flag.cast("long"), F.lit(0)), window_ns), "denominator": _trailing_sum(F.lit(1), window_ns)})
    return out.withColumn("ratio", F.when(F.col("denominator") >= min_denominator, F.col("numerator") / F.col("denominator")))


def sum_window(df: DataFrame, amount: str, window_ns: int = DAY) -> DataFrame:
    """window_n and window_sum in (t-w, t]; a null amount counts as 0."""
    whole = df.schema[amount].dataType.typeName() in ("byte", "short", "integer", "long")
    out = df.withColumn("window_n", _trailing_sum(F.lit(1), window_ns))
    if whole:
        return out.withColumn("window_sum", _trailing_sum(F.coalesce(F.col(amount), F.lit(0)), window_ns))
    # differences of long sums of fractions lose digits
    out = two_blocks(out, ["entity"], window_ns, [amount], lambda v, _: {"_sum": F.sum(v(amount))})
    return out.withColumn("window_sum", _added("_sum") - _after_in_tie(F.coalesce(F.col(amount), F.lit(0)))).drop(*_parts("_sum"))


def outcome_run(df: DataFrame, success: Column, window_ns: int = 10 * MINUTE) -> DataFrame:
    """attempts and failures in (t-w, t]; the run of failures just before this row that is still in the window; and
    failure_then_success: a success that ends such a run."""
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_ok", success.cast("boolean"))
    out = out.withColumns({
        "attempts": _trailing_sum(F.lit(1), window_ns),
        "failures": _trailing_sum((~F.col("_ok")).cast("long"), window_ns),
        "_place": F.row_number().over(_ordered()),
    })
    out = out.withColumn("_last_ok", F.coalesce(F.max(F.when(F.col("_ok"), F.col("_place"))).over(before), F.lit(0)))
    run = F.least(F.col("_place") - 1 - F.col("_last_ok"), F.col("attempts") - 1)
    out = out.withColumn("consecutive_failures", run.cast("long"))
    return out.withColumn("failure_then_success", F.col("_ok") & (F.col("consecutive_failures") > 0)).drop("_ok", "_place", "_last_ok")


def value_novelty(df: DataFrame, value: str) -> DataFrame:
    """changed (against the last non-null value), first_seen (never seen for the entity; both null on its first
    sample) and distinct_so_far. A row that ties with an earlier one is out of order: nulls and 0."""
    out = df.withColumn("_in", first_of_instant())
    seen = F.when(F.col("_in"), F.col(value))
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    upto = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_v", seen)
    out = out.withColumns({
        "_last": F.last("_v", ignorenulls=True).over(before),
        "_new": F.col("_v").isNotNull() & (F.row_number().over(_ordered("_v")) == 1),
    })
    judged = F.col("_v").isNotNull() & F.col("_last").isNotNull()
    out = out.withColumns({
        "changed": F.when(judged, F.col("_v") != F.col("_last")),
        "first_seen": F.when(judged, F.col("_new")),
        "distinct_so_far": F.when(F.col("_in"), F.sum(F.col("_new").cast("long")).over(upto)).otherwise(0),
    })
    return out.drop("_in", "_v", "_last", "_new")


def pair_history(df: DataFrame, pair: str, window_ns: int = 30 * DAY, warmup_ns: int = 7 * DAY) -> DataFrame:
    """pair_seen: an equal pair of the entity at an earlier instant in [t-w, t); pair_mature: warm-up is over."""
    prior = Window.partitionBy("entity", pair).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumns({
        "pair_seen": F.coalesce(F.max("t").over(prior) >= F.col("t") - window_ns, F.lit(False)),
        "pair_mature": F.col("t") - F.min("t").over(Window.partitionBy("entity")) >= warmup_ns,
    })


def mode_of(values: Column) -> Column:
    """The commonest element; ties go to the largest."""
    distinct = F.array_distinct(values)
    counted = F.transform(distinct, lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    return F.array_max(counted)["v"]


def nearest_rank(values: Column, quantile: float) -> Column:
    """Element ceil(q*n) of the sorted values; null if there are none."""
    return F.when(F.size(values) > 0, F.get(F.array_sort(values), F.greatest(F.ceil(F.lit(quantile) * F.size(values)).cast("int") - 1, F.lit(0))))


def value_history(df: DataFrame, value: str, window_ns: int = 30 * DAY, min_samples: int = 5) -> DataFrame:
    """established: the mode of the prior instants in [t-w, t), null below min_samples; history_n; deviates. Ties go to the largest value. Rows
    without an entity have no mode.

    Time is cut into slices, each a fixed part of w, and an entity is dealt by slice. A slice starts with how often each value stands in the
    window then; from there a value's count is the running sum of rows that enter and leave. The counts of ``WIDE`` values run side by side; where an
    entity has more values, so do the tops of groups of them, a level each. A row meets no interval and no other row, and frames only grow.
    """
    width = -(-window_ns // SLICES)
    start = lambda at: at - F.pmod(at, F.lit(width))
    known = df.where(F.col(value).isNotNull() & F.col("t").isNotNull()).select("entity", F.col(value).alias("_value"), F.col("t").alias("_at"))
    # a row is in the window at the start of each slice after its own, up to the one that it leaves in
    held = known.groupBy("entity", "_value", start(F.col("_at")).alias("_from"), start(F.col("_at") + window_ns).alias("_to")).count()
    held = held.select("entity", "_value", "count", F.explode(F.expr(f"sequence(_from + {width}, _to, {width}L)")).alias("_slice"))
    held = written(held.groupBy("entity", "_slice", "_value").agg(F.sum("count").alias("_step")), "held")
    most = held.select("entity", "_value").distinct().groupBy("entity").count().agg(F.max("count")).first()[0] or 1

    own = df.withColumns({"_at": F.col("t"), "_value": F.when(F.col("t").isNotNull(), F.col(value)), "_own": F.lit(True)}).withColumns({"_step": F.when(F.col("_value").isNotNull(), F.lit(1).cast("long")), "_slice": start(F.col("_at"))})
    leaving = known.withColumn("_at", F.col("_at") + window_ns).withColumns({"_step": F.lit(-1).cast("long"), "_slice": start(F.col("_at"))})
    # what a slice starts with stands before its first instant
    out = own.unionByName(leaving, allowMissingColumns=True).unionByName(held.withColumn("_at", F.col("_slice") - 1), allowMissingColumns=True)
    out = out.withColumn("_rank", F.dense_rank().over(Window.partitionBy("entity", "_slice").orderBy(F.col("_value").asc_nulls_last())) - 1)

    def tops(frame: Window, groups: int, level: int) -> Column:
        """The greatest (count, value) of groups side by side."""
        mine = [F.col("_rank").bitwiseAND(WIDE - 1) == k for k in range(min(groups, WIDE))]
        if level:
            each = [F.last(F.when(m, F.col("_top")), ignorenulls=True).over(frame) for m in mine]
        else:
            each = [F.struct(F.sum(F.when(m, F.col("_step"))).over(frame).alias("n"), F.max(F.when(m, F.col("_value"))).over(frame).alias("v")) for m in mine]
        return F.greatest(*each) if len(each) > 1 else each[0]

    groups, level = most, 0
    while groups > WIDE:
        out = out.withColumn("_group", F.shiftright("_rank", WIDE.bit_length() - 1))
        # as of the end of an instant, so that rows of one instant tell the same of their group
        out = out.withColumn("_top", tops(Window.partitionBy("entity", "_slice", "_group").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0), groups, level))
        out = out.withColumn("_rank", F.col("_group")).drop("_group")
        groups, level = -(-groups // WIDE), level + 1
    before = Window.partitionBy("entity", "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"history_n": F.coalesce(F.sum("_step").over(before), F.lit(0).cast("long")), "_mode": tops(before, groups, level)}).where("_own")
    has = F.col("entity").isNotNull() & (F.col("_mode.n") > 0) & (F.col("history_n") >= min_samples)
    out = out.select(*df.columns, "history_n", F.when(has, F.col("_mode.v")).alias("established"))
    return out.withColumn("deviates", F.col(value) != F.col("established"))


def value_floor(df: DataFrame, value: str, window_ns: int = 30 * DAY, min_samples: int = 5) -> DataFrame:
    """floor_value: the least of the prior instants in [t-w, t), null below min_samples; below_floor."""
    out = two_blocks(df, ["entity"], window_ns, [value], lambda v, _: {"_n": F.count(v(value)), "_least": F.min(v(value))}, inclusive=False)
    out = out.withColumn("floor_value", F.when(_added("_n") >= min_samples, F.least("_least_0", "_least_1")))
    return out.withColumn("below_floor", F.col(value) < F.col("floor_value")).drop(*_parts("_n", "_least"))


def transfer_envelope(df: DataFrame, amount: str, window_ns: int = 30 * DAY, quantile: float = 0.99, multiplier: float = 3.0, min_samples: int = 100) -> DataFrame:
    """envelope: nearest-rank quantile of the prior instants in [t-w, t), null below min_samples; ratio, breached.

    samples counts the amounts in [t-w, t] up to this row and with it; rows that tie share one envelope. A row without
    an amount is not a transfer: nulls.
    """
    known = F.col(amount).isNotNull()
    rank = lambda n: F.when(n >= min_samples, F.greatest(F.ceil(F.lit(quantile) * n), F.lit(1)))
    out = window_order_statistics(df, amount, window_ns, 1, {"_ranked": rank})
    samples = _trailing_sum(known.cast("long"), window_ns + 1)
    out = out.withColumns({"samples": F.when(known, samples), "envelope": F.when(known, F.col("_ranked"))})
    out = out.withColumn("envelope_ratio", F.when(F.col("envelope") != 0, F.col(amount) / F.col("envelope")))
    return out.withColumn("breached", F.col("envelope_ratio") >= multiplier).drop("_ranked")


def bucket_peak(df: DataFrame, value: str, bucket_ns: int = HOUR, window_ns: int = 30 * DAY, min_buckets: int = 24) -> DataFrame:
    """bucket, peak_reference: the greatest peak of the entity's closed buckets in the window; peak_buckets; peak_step
    (value less reference); peak_mature. Peaks are made by one aggregation, then looked up by (entity, bucket)."""
    keyed = df.withColumn("bucket", F.floor(F.col("t") / F.lit(bucket_ns)).cast("long"))
    # a bucket is gone when its end is w or more before the row that closed the last one: its own bucket's first row
    span, rest = divmod(window_ns, bucket_ns)
    prior = lambda n: Window.partitionBy("entity").orderBy("bucket").rangeBetween(-n, -1)
    peaks = keyed.groupBy("entity", "bucket").agg(F.max(value).alias("_peak"), (F.min("t") - F.col("bucket") * bucket_ns < rest).alias("_early"))
    held = lambda f: F.when(F.col("_early"), f("_peak").over(prior(span + 1))).otherwise(f("_peak").over(prior(span)))
    peaks = peaks.select("entity", "bucket", held(F.max).alias("peak_reference"), held(F.count).alias("peak_buckets"))
    out = keyed.join(peaks, ["entity", "bucket"], "left")
    mature = (F.col("peak_buckets") >= min_buckets) & F.col("peak_reference").isNotNull()
    return out.withColumns({"peak_step": F.col(value) - F.col("peak_reference"), "peak_mature": mature})


def rolling_median(df: DataFrame, reading: str, window_ns: int = 6 * HOUR, min_samples: int = 5) -> DataFrame:
    """baseline: the median of earlier readings in (t-w, t), null below min_samples; deviation; baseline_n.
    Rows that tie with an earlier one are out of order: nulls, and not learned."""
    out = df.withColumn("_in", first_of_instant())
    out = out.withColumn("_v", F.when(F.col("_in"), F.col(reading)))
    # whole numbers, so that the count of the window is a difference of running counts
    upto = Window.partitionBy("entity").orderBy("t")
    n = F.count("_v").over(upto.rangeBetween(Window.unboundedPreceding, -1)) - F.count("_v").over(upto.rangeBetween(Window.unboundedPreceding, -window_ns))
    enough = lambda place: lambda n: F.when(n >= min_samples, place(n))
    out = out.withColumn("_n", n)
    out = window_order_statistics(out, "_v", window_ns - 1, 1, {"_lo": enough(lambda n: F.floor((n + 1) / 2)), "_hi": enough(lambda n: F.floor((n + 2) / 2))})
    out = out.withColumns({"baseline_n": F.when(F.col("_in"), F.col("_n")), "baseline": F.when(F.col("_in"), (F.col("_lo") + F.col("_hi")) / 2)})
    return out.withColumn("deviation", F.col(reading) - F.col("baseline")).drop("_in", "_v", "_n", "_lo", "_hi")


def level_forecast(df: DataFrame, reading: str, floor_level: float | Column | None, window_ns: int = 7 * DAY, min_samples: int = 12, max_residual: float = 0.5, min_significance: float = 4.0, optic: str | None = None) -> DataFrame:
    """Least squares over (t-w, t]: fit_n, slope_per_day, residual_rms, t_stat, days_to_floor and forecast_status.

    The status is the first that holds: no_reading, immature, no_floor, below_floor (0 days), nonlinear, not_degrading,
    projected. With an optic, a change of it (null is a value) starts the readings anew. Rows that tie with an earlier
    one are out of order: a status only, no_reading or immature, and not learned.
    """
    out = df.withColumn("_in", first_of_instant())
    keys = ["entity"]
    if optic:
        past = F.lag(F.struct(optic)).over(Window.partitionBy("entity", "_in").orderBy("t", "seq"))
        out = out.withColumn("_new", (F.col("_in") & past.isNotNull() & ~F.struct(optic).eqNullSafe(past)).cast("long"))
        out = out.withColumn("_epoch", F.sum("_new").over(_ordered().rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
        keys.append("_epoch")
    # places relative to the entity's first row keep the sums small, never the epoch
    day = (F.col("t") - F.min("t").over(Window.partitionBy("entity"))) / F.lit(float(DAY))
    out = out.withColumns({"_y": F.when(F.col("_in"), F.col(reading)), "_x": F.when(F.col("_in") & F.col(reading).isNotNull(), day)})
    fits = {"xx": F.regr_sxx, "xy": F.regr_sxy, "yy": F.regr_syy, "mx": F.regr_avgx, "my": F.regr_avgy}
    out = two_blocks(out, keys, window_ns, ["_y", "_x"], lambda v, _: {"_n": F.count(v("_y"))} | {f"_{n}": f(v("_y"), v("_x")) for n, f in fits.items()})
    out = out.withColumns({"fit_n": _added("_n"), "_sxx": _moment("_xx", "_n", "_mx", "_mx"), "_sxy": _moment("_xy", "_n", "_mx", "_my"), "_syy": _moment("_yy", "_n", "_my", "_my"), "_mx": _mean("_mx", "_n"), "_my": _mean("_my", "_n")})
    out = out.drop(*_parts("_n", *(f"_{n}" for n in fits)))
    ok = F.col("_y").isNotNull() & (F.col("fit_n") >= min_samples) & (F.col("_sxx") > 0)
    out = out.withColumn("slope_per_day", F.when(ok, F.col("_sxy") / F.col("_sxx")))
    sse = F.greatest(F.col("_syy") - F.col("slope_per_day") * F.col("_sxy"), F.lit(0.0))
    out = out.withColumns({"residual_rms": F.when(ok, F.sqrt(sse / F.col("fit_n"))), "_se": F.when((F.col("fit_n") > 2) & ok, F.sqrt(sse / (F.col("fit_n") - 2) / F.col("_sxx")))})
    out = out.withColumn("t_stat", F.when(F.col("_se") > 0, F.col("slope_per_day") / F.col("_se")))
    level = F.col("_my") + F.col("slope_per_day") * (F.col("_x") - F.col("_mx"))
    floor = floor_level if isinstance(floor_level, Column) else F.lit(floor_level).cast("double")
    status = (
        F.when(F.col(reading).isNull(), "no_reading")
        .when(F.col("slope_per_day").isNull(), "immature")
        .when(floor.isNull(), "no_floor")
        .when(F.col(reading) <= floor, "below_floor")
        .when(F.col("residual_rms") > max_residual, "nonlinear")
        .when((F.col("slope_per_day") >= 0) | (F.abs(F.coalesce("t_stat", F.lit(1e9))) < min_significance), "not_degrading")
        .otherwise("projected")
    )
    out = out.withColumn("forecast_status", status)
    days = F.when(F.col("forecast_status") == "projected", F.greatest((floor - level) / F.col("slope_per_day"), F.lit(0.0))).when(F.col("forecast_status") == "below_floor", 0.0)
    return out.withColumn("days_to_floor", days).drop("_in", "_epoch", "_x", "_y", "_sxx", "_sxy", "_syy", "_mx", "_my", "_se")


def cyclic_histogram(df: DataFrame, bucket: Column, buckets: int, min_samples: int = 32) -> DataFrame:
    """How usual the row's bucket (hour, weekday) was before: share (c+1)/(n+buckets), surprise in bits, unseen, mature.
    Rows that tie with an earlier one are scored against the same past and not learned."""
    out = df.withColumns({"_b": bucket, "_in": first_of_instant().cast("long")})
    prior = Window.partitionBy("entity").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("entity", "_b").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    n, c = F.coalesce(F.sum("_in").over(prior), F.lit(0)), F.coalesce(F.sum("_in").over(same), F.lit(0))
    out = out.withColumns({"cycle_n": n, "cycle_count": c})
    share = (F.col("cycle_count") + 1) / (F.col("cycle_n") + buckets)
    return out.withColumns({"cycle_share": share, "surprise_bits": -F.log2(share), "cycle_unseen": F.col("cycle_count") == 0, "cycle_mature": F.col("cycle_n") >= min_samples}).drop("_b", "_in")


def drift_trajectory(df: DataFrame, score: str, window_id: str, max_windows: int = 64, min_windows: int = 4) -> DataFrame:
    """One row a (entity, window): velocity, acceleration, the rising run's length and total rise, the deviation of up
    to max_windows prior values, the rise in deviations, and a straight-line forecast over runs of 3 or more.
    A gap in the window ids or a value that doesn't rise starts a run anew."""
    w = Window.partitionBy("entity").orderBy(window_id)
    out = df.withColumns({"_p": F.lag(score).over(w), "_pw": F.lag(window_id).over(w)})
    next_to = F.col("_pw") == F.col(window_id) - 1
    out = out.withColumn("velocity", F.when(next_to, F.col(score) - F.col("_p")))
    out = out.withColumn("acceleration", F.when(next_to, F.col("velocity") - F.lag("velocity").over(w)))
    out = out.withColumn("_new", (~F.coalesce(next_to & (F.col(score) > F.col("_p")), F.lit(False))).cast("long"))
    out = out.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("entity", "_run").orderBy(window_id).rowsBetween(Window.unboundedPreceding, 0)
    back = w.rowsBetween(-max_windows, -1)
    out = out.withColumns({"rising_run": F.count("*").over(run), "rise": F.col(score) - F.first(score).over(run), "history_windows": F.count(score).over(back), "sigma": F.stddev_samp(score).over(back)})
    mature = F.col("history_windows") >= min_windows
    fit = F.when(F.col("rising_run") >= 3, F.regr_slope(score, window_id).over(run) * (F.col(window_id) + 1) + F.regr_intercept(score, window_id).over(run))
    return out.withColumns({"sigma": F.when(mature, F.col("sigma")), "drift_forecast": fit}).withColumn("rise_sigmas", F.when(F.col("sigma") > 0, F.col("rise") / F.col("sigma"))).drop("_p", "_pw", "_new", "_run")


def counter_delta(df: DataFrame, counter: str, bits: int = 32, uptime_ns: str | None = None, tied: bool = False) -> DataFrame:
    """delta of a monotone counter against the previous sample: a fall is a wrap (2**bits is added), or a reset if the
    uptime shows a restart since then, where the count itself is the delta. Ties are out of order: null; where they may be tied, samples of
    an instant follow each other by seq."""
    out = counter_deltas(df.withColumn("_c", F.col(counter)), ["_c"], bits, uptime_ns, tied)
    return out.withColumns({"delta": F.col("_c_delta"), "counter_reset": F.col("_c_reset"), "counter_wrapped": F.col("_c_wrapped")}).drop("_c", "_c_delta", "_c_reset", "_c_wrapped")


def counter_deltas(df: DataFrame, counters: list[str], bits: int = 32, uptime_ns: str | None = None, tied: bool = False) -> DataFrame:
    """counter_delta of several counters of a sample: <counter>_delta, _reset and _wrapped. All are read in one order, so that samples
    which even seq doesn't tell apart have one sample before them."""
    out = df.withColumn("_in", F.lit(True) if tied else first_of_instant())
    order = Window.partitionBy("entity", *([] if tied else ["_in"])).orderBy("t", "seq")
    out = out.withColumns({"_pt": F.lag("t").over(order)} | {f"_p{k}": F.lag(c).over(order) for k, c in enumerate(counters)})
    reset = (F.col(uptime_ns) < F.col("t") - F.col("_pt")) if uptime_ns else F.lit(False)
    found = {}
    for k, c in enumerate(counters):
        value, before = F.col(c).cast("decimal(38,0)"), F.col(f"_p{k}")
        fell = F.col(c) < before
        raw = F.when(reset, value).when(fell, value - before + F.lit(2**bits).cast("decimal(38,0)")).otherwise(value - before)
        found[f"{c}_delta"] = F.when(F.col("_in") & before.isNotNull() & (raw <= F.lit(2**63 - 1).cast("decimal(38,0)")), raw.cast("long"))
        found |= {f"{c}_reset": F.col("_in") & F.coalesce(reset, F.lit(False)), f"{c}_wrapped": F.col("_in") & F.coalesce(fell & ~reset, F.lit(False))}
    return out.withColumns(found).drop("_in", "_pt", *[f"_p{k}" for k in range(len(counters))])


def link_flap(df: DataFrame, status: str, last_change: str, window_ns: int = HOUR, tied: bool = False) -> DataFrame:
    """flaps between polls (2 if last_change fell, or went on without a change of status; 1 if the status changed) and
    flaps_in_window over (t-w, t]. Ties are out of order: null; where they may be tied, polls of an instant follow each other by seq."""
    out = df.withColumn("_in", F.lit(True) if tied else first_of_instant())
    order = Window.partitionBy("entity", "_in").orderBy("t", "seq")
    out = out.withColumns({"_s": F.lag(status).over(order), "_c": F.lag(last_change).over(order)})
    moved = F.col(status) != F.col("_s")
    flaps = F.when(F.col(last_change) < F.col("_c"), 2).when(moved, 1).when(F.col(last_change) > F.col("_c"), 2).otherwise(0)
    out = out.withColumn("flaps", F.when(F.col("_in") & F.col("_s").isNotNull(), flaps.cast("long")))
    total = _trailing_sum(F.coalesce("flaps", F.lit(0)), window_ns)
    return out.withColumn("flaps_in_window", F.when(F.col("_in"), total)).drop("_in", "_s", "_c")


def arrival_regularity(df: DataFrame, window_ns: int = DAY, min_intervals: int = 12, size: str | None = None) -> DataFrame:
    """Of the arrivals in [t-w, t]: intervals_n, mean_interval (seconds) and interval_cv (deviation over mean), null below
    min_intervals; with a size also size_cv, null unless every arrival has one. An interval counts if both of its
    arrivals are inside. Rows that tie with an earlier one are no arrivals: they show the window as it stands."""
    # the intervals inside are all in the frame but the one that ends at the frame's first arrival
    out = df.withColumn("_in", first_of_instant())
    # before the first row of an instant comes a row of the last instant
    out = out.withColumn("_g", F.when(F.col("_in"), (F.col("t") - F.lag("t").over(_ordered())) / F.lit(float(SECOND))))
    out = out.withColumns({"_a": F.when(F.col("_in"), F.struct("_g")), "_z": F.when(F.col("_in"), F.col(size)) if size else F.lit(None).cast("double"), "_i": F.col("_in").cast("long"), "_gg": F.col("_g") * F.col("_g")})

    def sums(v: Callable[[str], Column], backwards: bool) -> dict[str, Column]:
        # the first arrival of a part is the last that it meets on its way backwards
        out = {"_n": F.sum(v("_i")), "_s": F.sum(v("_g")), "_q": F.sum(v("_gg")), "_f": (F.last if backwards else F.first)(v("_a"), ignorenulls=True)}
        return out | ({"_zn": F.count(v("_z")), "_zm": F.avg(v("_z")), "_zv": F.regr_syy(v("_z"), v("_z"))} if size else {})

    out = two_blocks(out, ["entity"], window_ns + 1, ["_a", "_z", "_i", "_g", "_gg"], sums).withColumns({"_z": F.lit(None)})
    out = out.withColumns({"_n": _added("_n"), "_s": _added("_s"), "_q": _added("_q"), "_f": F.coalesce(F.coalesce("_f_1", "_f_0")["_g"], F.lit(0.0))})
    if size:
        out = out.withColumns({"_z": _added("_zn"), "_zm": _mean("_zm", "_zn"), "_zs": F.sqrt(_moment("_zv", "_zn", "_zm", "_zm") / F.greatest(_added("_zn"), F.lit(1)))})
    out = out.drop(*_parts("_n", "_s", "_q", "_f", "_zn", "_zm", "_zv"))
    out = out.withColumns({"intervals_n": F.col("_n") - 1, "_s": F.coalesce("_s", F.lit(0.0)) - F.col("_f"), "_q": F.coalesce("_q", F.lit(0.0)) - F.col("_f") * F.col("_f")})
    out = out.withColumn("mean_interval", F.when(F.col("intervals_n") > 0, F.col("_s") / F.col("intervals_n")))
    variance = F.greatest(F.col("_q") / F.col("intervals_n") - F.col("mean_interval") * F.col("mean_interval"), F.lit(0.0))
    mature = F.col("intervals_n") >= min_intervals
    results = {"interval_cv": F.when(mature & (F.col("mean_interval") > 0), F.sqrt(variance) / F.col("mean_interval"))}
    if size:
        results["size_cv"] = F.when(mature & (F.col("_z") == F.col("_n")) & (F.col("_zm") != 0), F.col("_zs") / F.col("_zm"))
    return out.withColumns(results).drop("_in", "_g", "_gg", "_a", "_i", "_n", "_s", "_q", "_f", "_z", "_zm", "_zs")


def geo_velocity(df: DataFrame, latitude: str, longitude: str, min_elapsed_ns: int = SECOND) -> DataFrame:
    """distance_km, elapsed_hours (at least min_elapsed_ns) and speed_kmh from the entity's previous located row."""
    from lodestream.functions.network import great_circle_km

    has = F.col(latitude).isNotNull() & F.col(longitude).isNotNull()
    before = _ordered().rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_at", F.when(has, F.struct(F.col(latitude).alias("a"), F.col(longitude).alias("o"), "t")))
    out = out.withColumn("_p", F.last("_at", ignorenulls=True).over(before))
    both = has & F.col("_p").isNotNull()
    elapsed = F.greatest(F.col("t") - F.col("_p.t"), F.lit(min_elapsed_ns)) / F.lit(float(HOUR))
    out = out.withColumns({"distance_km": F.when(both, great_circle_km(F.col("_p.a"), F.col("_p.o"), F.col(latitude), F.col(longitude))), "elapsed_hours": F.when(both, elapsed)})
    return out.withColumn("speed_kmh", F.col("distance_km") / F.col("elapsed_hours")).drop("_at", "_p")


def anchored_names(df: DataFrame, scope: str, anchor: str, name: str) -> DataFrame:
    """stable_name: the first non-null name reported for (scope, anchor), up to this row."""
    w = Window.partitionBy(scope, anchor).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("stable_name", F.first(name, ignorenulls=True).over(w))


def reboot_counter(df: DataFrame, restarted: Column, bucket_ns: int = DAY) -> DataFrame:
    """One row a (entity, bucket): restarts, and rising_buckets, how many buckets in a row have gone up."""
    counts = df.groupBy("entity", F.floor(F.col("t") / F.lit(bucket_ns)).cast("long").alias("bucket")).agg(F.sum(restarted.cast("long")).alias("restarts"))
    w = Window.partitionBy("entity").orderBy("bucket")
    up = F.coalesce((F.lag("bucket").over(w) == F.col("bucket") - 1) & (F.col("restarts") > F.lag("restarts").over(w)), F.lit(False))
    out = counts.withColumn("_up", up).withColumn("_run", F.sum((~F.col("_up")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("entity", "_run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("rising_buckets", F.count("*").over(inside) - 1).drop("_up", "_run")


def collector_sequence(df: DataFrame, collector: str, number: str) -> DataFrame:
    """sequence_gap: numbers skipped since the greatest one before (null on a collector's first row, 0 if it
    regressed), and sequence_regressed."""
    before = Window.partitionBy(collector).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_m", F.max(number).over(before))
    return out.withColumns({"sequence_gap": F.when(F.col("_m").isNotNull(), F.greatest(F.col(number) - F.col("_m") - 1, F.lit(0))), "sequence_regressed": F.coalesce(F.col(number) <= F.col("_m"), F.lit(False))}).drop("_m")


def zscore(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """z: absolute distance from the keys' mean in population deviations, 0 where there is none."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn("z", F.when(sd > 0, F.abs(F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))
