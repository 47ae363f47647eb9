"""Versioned counters, unique visitors, decayed counters and saturating weight vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = math.log(2)
RUN = 4096


def counters(events: DataFrame, keys: list[str], uid: str = "uid", breakdown: dict[str, Column] | None = None, order: tuple[str, ...] = ("time", "id"), op: str | None = None) -> DataFrame:
    """keys, views, deletes, visitors and a map n_<name> of visitors by each breakdown value.

    A visitor's breakdown is that of their first event under the keys. With op (1: decrement) decrements count as deletes; they add
    unseen visitors all the same.
    """
    parts = breakdown or {}
    down = F.col(op) == 1 if op else F.lit(False)
    first = events.groupBy(*keys, uid).agg(F.count_if(~down).alias("views"), F.count_if(down).alias("deletes"), *(F.min_by(c, F.struct(*order)).alias(f"_{k}") for k, c in parts.items()))
    flat = first.groupBy(*keys).agg(F.sum("views").alias("views"), F.sum("deletes").alias("deletes"), F.count("*").alias("visitors"))
    for k in parts:
        n = first.where(F.col(f"_{k}").isNotNull()).groupBy(*keys, F.col(f"_{k}").alias("_v")).agg(F.count("*").alias("_n"))
        m = n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias(f"n_{k}"))
        flat = flat.join(m, keys, "left")
    return flat


def subcounters(events: DataFrame, keys: list[str], sub: str, delta: Column) -> DataFrame:
    """Sum of deltas for each key and sub-counter 0 to 63."""
    return events.where(F.col(sub).between(0, 63)).groupBy(*keys, sub).agg(F.sum(delta).alias("n"))


def first_keys(events: DataFrame, keys: list[str], value: str, order: tuple[str, ...], most: int = 63) -> DataFrame:
    """Exact counts of the first distinct values to arrive under the keys, at most so many."""
    n = events.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_first", value)
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r", "_first")


def unique_by(events: DataFrame, keys: list[str], uid: str = "uid") -> DataFrame:
    return events.groupBy(*keys).agg(F.countDistinct(uid).alias("visitors"))


def recent_uniques(events: DataFrame, keys: list[str], day: str, today: str, uid: str = "uid") -> DataFrame:
    """week, days30 and month: visitors whose last day under the keys is within 7 days, 30 days and the calendar month of today (a date)."""
    last = events.where(F.col(day) <= F.lit(today).cast("date")).groupBy(*keys, uid).agg(F.max(day).alias("_last"))
    age = F.datediff(F.lit(today).cast("date"), F.col("_last"))
    same = F.trunc("_last", "month") == F.trunc(F.lit(today).cast("date"), "month")
    return last.groupBy(*keys).agg(F.count_if(age <= 6).alias("week"), F.count_if(age <= 29).alias("days30"), F.count_if(same).alias("month"))


def decayed(value: Column, time: Column, now: int | Column, half_life: float | Column) -> Column:
    """Sum of increments halved every half_life seconds, as of now; order-free, so late increments need no care."""
    return F.sum(value * F.pow(F.lit(2.0), -((F.lit(now) if isinstance(now, int) else now) - time) / half_life))


def saturating(events: DataFrame, keys: list[str], value: str, time: str, half_life: float, order: tuple[str, ...]) -> DataFrame:
    """keys, weight: increments in time order under x # y = (x + y) / (1 + x y), the weight halving every half_life seconds between them.

    An increment after a pause takes x to (d x + y) / (1 + d x y), a fractional linear map; maps of neighbours multiply as
    2 x 2 matrices. So a key's increments are folded in runs of RUN, and the runs' matrices after that: no row holds more
    than RUN increments, or a matrix for every RUN of them.
    """
    by = [F.col(time).cast("double"), *(F.col(c) for c in order)]
    own = events.select(*keys, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_y"), F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).alias("_r"), F.lag(F.col(time).cast("double")).over(Window.partitionBy(*keys).orderBy(*by)).alias("_was"))
    d = F.pow(F.lit(2.0), -(F.col("_t") - F.coalesce("_was", F.col("_t"))) / half_life)
    own = own.select(*keys, "_r", F.floor((F.col("_r") - 1) / RUN).alias("_c"), F.struct(d.alias("a"), F.col("_y").alias("b"), (d * F.col("_y")).alias("c"), F.lit(1.0).alias("d")).alias("m"))

    def times(n: Column, m: Column) -> Column:
        """m after n, scaled to keep its size."""
        a, b, c, e = m.a * n.a + m.b * n.c, m.a * n.b + m.b * n.d, m.c * n.a + m.d * n.c, m.c * n.b + m.d * n.d
        size = F.greatest(F.abs(a), F.abs(b), F.abs(c), F.abs(e), F.lit(1e-300))
        return F.struct((a / size).alias("a"), (b / size).alias("b"), (c / size).alias("c"), (e / size).alias("d"))

    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"))
    fold = lambda place: F.aggregate(F.array_sort(F.collect_list(F.struct(F.col(place).alias("r"), F.col("m").alias("m")))), one, lambda n, x: times(n, x.m))
    runs = own.groupBy(*keys, "_c").agg(fold("_r").alias("m"))
    return runs.groupBy(*keys).agg(fold("_c").alias("m")).select(*keys, (F.col("m.b") / F.col("m.d")).alias("weight"))


def saturating_sum(value: Column) -> Column:
    """The same without decay, order-free; values in (-1, 1)."""
    return F.tanh(F.sum(F.atanh(value)))


def date_distribution(rows: DataFrame, time: str, low: int, high: int, step: int) -> DataFrame:
    """bucket, n: -1 below low, then steps of [low, high), then one above; steps without rows count 0."""
    if (high - low) % step:
        raise ValueError("the step must divide the range")
    k = (high - low) // step
    b = F.when(F.col(time) < low, -1).when(F.col(time) >= high, k).otherwise(F.floor((F.col(time) - low) / step)).cast("int")
    counts = rows.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(-1, k + 1).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
