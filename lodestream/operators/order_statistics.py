"""Order statistics of moving windows: the k-th smallest value of each row's window, for any k, in n log n.

Values become ranks within their entity, and a rank is read digit by digit, highest first. For each digit the values of an entity that share the digits
so far are one partition; running counts by the next digit, taken at a window's two ends, give the window's histogram of
that digit, which tells the digit of the k-th value and how many values stand before it. So each round is one running sum and
one aggregation, a busy entity is split further with each digit, and no window's values are ever gathered.

Where no entity has more than ``SMALL`` values, which is counted first, a window is at most that long and is sorted as an array: the
same results in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE = 16
SMALL = 1024


def window_order_statistics(df: DataFrame, value: str, lower: int, upper: int, ranks: dict[str, Callable[[Column], Column]], small: int = SMALL) -> DataFrame:
    """df with a column a name: of the entity's values at times in [t-lower, t-upper] the one whose place, counted from 1, is the
    name's function of how many there are; null where that is null or there is none. Null values are none.

    Needs entity, t and seq, which tells an entity's rows apart.
    """
    rows = df.select("entity", "t", "seq", F.col(value).alias("_x"))
    known = rows.where("_x IS NOT NULL")
    most = known.groupBy("entity").count().agg(F.max("count")).first()[0] or 1
    if most <= small:
        window = Window.partitionBy("entity").orderBy("t").rangeBetween(-lower, -upper)
        out = df.withColumn("_h", F.array_sort(F.collect_list(value).over(window)))
        n = F.size("_h").cast("long")
        picked = {name: F.when(f(n).between(1, n), F.get("_h", (f(n) - 1).cast("int"))) for name, f in ranks.items()}
        return out.withColumns(picked).drop("_h")
    ranked = known.select("entity", "t", "_x", (F.dense_rank().over(Window.partitionBy("entity").orderBy("_x")) - 1).cast("long").alias("_rank"))
    digits = 1
    while BASE**digits < most:
        digits += 1
    asked = rows.select("entity", "t", "seq", F.explode(F.array(*(F.lit(n) for n in ranks))).alias("_name"), F.lit(0).cast("long").alias("_prefix"), F.lit(None).cast("long").alias("_left"))
    for k in range(digits):
        unit = BASE ** (digits - 1 - k)
        own = ranked.select("entity", F.floor(F.col("_rank") / (unit * BASE)).cast("long").alias("_prefix"), F.col("t").alias("_at"), F.lit(1).alias("_own"), (F.floor(F.col("_rank") / unit) % BASE).cast("int").alias("_digit"))
        # what stands before an instant: a window's end less its start
        ends = F.array(F.struct((F.col("t") - upper + 1).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("t") - lower).alias("at"), F.lit(-1).alias("sign")))
        both = own.unionByName(asked.withColumn("_end", F.explode(ends)).select("*", F.col("_end.at").alias("_at"), F.col("_end.sign").alias("_sign"), F.lit(0).alias("_own")).drop("_end"), allowMissingColumns=True)
        upto = Window.partitionBy("entity", "_prefix").orderBy("_at", "_own").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumns({f"_c{d}": F.sum((F.col("_digit") == d).cast("long")).over(upto) for d in range(BASE)}).where("_own = 0")
        found = both.groupBy("entity", "seq", "t", "_name", "_prefix", "_left").agg(*(F.coalesce(F.sum(F.col("_sign") * F.col(f"_c{d}")), F.lit(0)).alias(f"_c{d}") for d in range(BASE)))
        upto_digit = [sum((F.col(f"_c{i}") for i in range(1, d + 1)), F.col("_c0")) for d in range(BASE)]
        if k == 0:
            place = F.lit(None).cast("long")
            for name, f in ranks.items():
                place = F.when(F.col("_name") == name, f(upto_digit[-1]).cast("long")).otherwise(place)
            found = found.withColumn("_left", place).where(F.col("_left").between(1, upto_digit[-1]))
        digit, before = F.lit(BASE - 1), upto_digit[BASE - 2]
        for d in range(BASE - 2, -1, -1):
            fits = F.col("_left") <= upto_digit[d]
            digit, before = F.when(fits, d).otherwise(digit), F.when(fits, upto_digit[d - 1] if d else F.lit(0)).otherwise(before)
        asked = found.select("entity", "seq", "t", "_name", (F.col("_prefix") * BASE + digit).cast("long").alias("_prefix"), (F.col("_left") - before).cast("long").alias("_left"))
    values = ranked.select(F.col("entity").alias("_e"), "_rank", "_x").distinct()
    told = asked.join(values, F.col("entity").eqNullSafe(F.col("_e")) & (F.col("_prefix") == F.col("_rank")))
    told = told.groupBy(F.col("entity").alias("_e"), F.col("seq").alias("_q")).agg(*(F.max(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in ranks))
    return df.join(told, df["entity"].eqNullSafe(told["_e"]) & (df["seq"] == told["_q"]), "left").drop("_e", "_q")
