"""Feeds, recommendations and item similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import written

BLOCK = 1000
SHARE, PAIRS = 500_000, 2_000_000


def recommended(actions: DataFrame, rates: DataFrame, raters: DataFrame, now: int, period: float, once_below: int = 32) -> DataFrame:
    """type, owner, place, users, weight: actions (user, type, owner, place, action, created) at rates (type, action, rate) times raters (user, rate), halved every period seconds.

    A user's repeated action under once_below counts once, at its latest time; items older than 30 periods are left out; later ones aren't decayed.
    """
    a = actions.where(F.col("created") > now - 30 * period)
    keys = ["user", "type", "owner", "place", "action"]
    once = a.where(F.col("action") < once_below).groupBy(*keys).agg(F.max("created").alias("created"))
    a = once.unionByName(a.where(F.col("action") >= once_below).select(*keys, "created"))
    a = a.join(rates.select("type", "action", F.col("rate").alias("_r")), ["type", "action"]).join(raters.select("user", F.col("rate").alias("_u")), "user", "left")
    w = F.col("_r") * F.coalesce("_u", F.lit(1.0)) * F.pow(F.lit(2.0), -F.greatest(F.lit(now) - F.col("created"), F.lit(0)) / period)
    return a.groupBy("type", "owner", "place").agg(F.countDistinct("user").alias("users"), F.sum(w).alias("weight"))


def top_recommended(scored: DataFrame, least_users: int, limit: int) -> DataFrame:
    return scored.where(F.col("users") >= least_users).orderBy(F.desc("weight"), "type", "owner", "place").limit(limit)


def grouped_feed(items: DataFrame, keys: list[str], time: str, member: str, most: int, day0: int = 0) -> DataFrame:
    """keys, day, newest, total, members: items of a day under the keys as one entry, its distinct members newest first and cut at most (the feature), with their number.

    Distinct members are counted before they are ranked, so a hot entry gathers most rows only.
    """
    day = F.floor((F.col(time) - day0) / 86400).alias("day")
    one = items.groupBy(*keys, day, member).agg(F.max(time).alias("_t"))
    whole = one.groupBy(*keys, "day").agg(F.max("_t").alias("newest"), F.count("*").alias("total"))
    w = Window.partitionBy(*keys, "day").orderBy(F.desc("_t"), member)
    top = one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    lists = top.groupBy(*keys, "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", member))), lambda x: x[member]).alias("members"))
    return whole.join(lists, [*keys, "day"])


def similarity(scores: DataFrame, least: float = 0.2, user: str = "user", item: str = "item", value: str = "value") -> DataFrame:
    """i, j, sim for pairs of items of common users: sum of products of scores, plus least.

    Every user counts: the items of one with up to BLOCK are paired in their own row. Those of one with more are spread over
    blocks of about BLOCK, and each pair of blocks is joined by itself. Pairs still grow with the square of a user's items.
    Rows go to tasks of about SHARE, as a task gives more pairs than it takes rows.
    """
    n = max(scores.sparkSession.sparkContext.defaultParallelism, -(-scores.count() // SHARE))
    dealt = scores.select(user, item, value).where(F.col(user).isNotNull()).repartition(n, user)
    s = dealt.groupBy(user, item).agg(F.sum(value).alias("v"))
    s = s.withColumn("_c", F.count("*").over(Window.partitionBy(user)))
    rows = s.where(F.col("_c").between(2, BLOCK)).groupBy(user).agg(F.collect_list(F.struct(F.col(item).alias("i"), "v")).alias("_l"))
    few = rows.select("_l", F.explode("_l").alias("_a")).select("_a", F.explode("_l").alias("_b")).where("_a.i < _b.i")
    few = few.select(F.col("_a.i").alias("i"), F.col("_b.i").alias("j"), (F.col("_a.v") * F.col("_b.v")).alias("p"))
    m = s.where(F.col("_c") > BLOCK).withColumn("_n", F.ceil(F.col("_c") / BLOCK)).withColumn("_b", F.pmod(F.xxhash64(item), F.col("_n")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    a = m.select(user, F.col(item).alias("i"), F.col("v").alias("a"), F.col("_b").alias("_x"), every.alias("_y"))
    b = m.select(user, F.col(item).alias("j"), F.col("v").alias("b"), every.alias("_x"), F.col("_b").alias("_y"))
    many = a.join(b, [user, "_x", "_y"]).where("i < j").select("i", "j", (F.col("a") * F.col("b")).alias("p"))
    return few.union(many).groupBy("i", "j").agg((F.sum("p") + least).alias("sim"))


def _scored(limit: int):
    """Rows (j, k, a, b, x) in that order to (user, item, score, r): k is 0 for similar items (a to b, x) of a block, 1 for the items (b, x) of a user (a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, items, near, user, mine, out = None, [], None, {}, None, [], []

        def best() -> None:
            total = np.zeros(len(items))
            seen = np.zeros(len(items), bool)
            for i, v in mine:
                if i in near:
                    places, sim = near[i]
                    total[places] += v * sim  # an item is in another's list once
                    seen[places] = True
            own = np.array([i for i, _ in mine])
            at_own = np.searchsorted(items, own)
            at_own = at_own[(at_own < len(items)) & (items[np.minimum(at_own, len(items) - 1)] == own)]
            seen[at_own] = False
            places = np.flatnonzero(seen)
            if len(places):
                score = total[places]
                r = np.round(score, 9)
                if len(places) > limit:  # those under the limit-th best score can't be among the best
                    some = np.flatnonzero(r >= np.partition(r, len(r) - limit)[len(r) - limit])
                    places, score, r = places[some], score[some], r[some]
                top = np.lexsort((items[places], -r))[:limit]
                out.append((np.full(len(top), user), items[places[top]], score[top], r[top]))

        def given() -> Iterator[pa.RecordBatch]:
            if out:
                cols = [np.concatenate([o[n] for o in out]) for n in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["user", "item", "score", "r"])
                out.clear()

        for batch in batches:
            j, k, a, b, x = (batch.column(n).to_numpy() for n in range(5))
            if not len(j):
                continue
            starts = np.flatnonzero(np.r_[True, (j[1:] != j[:-1]) | (k[1:] != k[:-1]) | ((k[1:] == 1) & (a[1:] != a[:-1]))])
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(j)], strict=True):
                if mine and ((j[lo], k[lo]) != (at, 1) or a[lo] != user):
                    best()
                    mine = []
                    if len(out) >= 10_000:
                        yield from given()
                if j[lo] != at:
                    at, parts, items, near = j[lo], [], None, {}
                if k[lo] == 0:
                    parts.append((a[lo:hi], b[lo:hi], x[lo:hi]))
                    continue
                if not parts and items is None:
                    continue
                if items is None:
                    i, other, sim = (np.concatenate([p[n] for p in parts]) for n in range(3))
                    order = np.argsort(i, kind="stable")
                    items, places = np.unique(other[order], return_inverse=True)
                    keys, first = np.unique(i[order], return_index=True)
                    near = dict(zip(keys.tolist(), zip(np.split(places, first[1:]), np.split(sim[order], first[1:]), strict=True), strict=True))
                    parts = []
                user = a[lo]
                mine += zip(b[lo:hi].tolist(), x[lo:hi].tolist(), strict=True)
        if mine:
            best()
        yield from given()

    return run


def suggest_items(scores: DataFrame, sim: DataFrame, users: DataFrame, limit: int, user: str = "user", item: str = "item", value: str = "value", factor: Column | None = None) -> DataFrame:
    """user, item, score, rank: for the given users, items they don't have by clamped own scores times similarity; ids are whole numbers, factor is over user, item and v.

    The similar items are dealt into blocks of about PAIRS rows by the suggested item, every block meets all items of the
    users, sums one user at a time and gives the user's best of the block, which decide the best of all: no row for a
    user and a candidate is shuffled. The similarity is written out once.
    """
    sim = written(sim.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("sim").cast("double").alias("sim")), "similarity")
    both = sim.union(sim.select("j", "i", "sim"))
    own = scores.join(users.select(user).distinct(), user, "left_semi").groupBy(user, item).agg(F.sum(value).alias("v"))
    f = F.greatest(factor, F.lit(0.02)) if factor is not None else F.lit(1.0)
    own = own.select(F.col(user).cast("bigint").alias("a"), F.col(item).cast("bigint").alias("b"), (F.least(F.greatest(F.col("v"), F.lit(1.0)), F.lit(100.0)) * f).alias("x")).dropna()
    n = max(sim.sparkSession.sparkContext.defaultParallelism, -(-2 * sim.count() // PAIRS))
    near = both.select(F.pmod(F.xxhash64("j"), F.lit(n)).cast("bigint").alias("j"), F.lit(0).alias("k"), F.col("i").alias("a"), F.col("j").alias("b"), F.col("sim").alias("x"))
    asked = own.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("j"), F.lit(1).alias("k"), "a", "b", "x")
    met = near.union(asked).repartition(min(n, 10_000), "j").sortWithinPartitions("j", "k", "a")
    best = met.mapInArrow(_scored(limit), "user bigint, item bigint, score double, r double")
    w = Window.partitionBy("user").orderBy(F.desc("r"), "item")
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return top.select(F.col("user").cast(scores.schema[user].dataType).alias(user), F.col("item").cast(scores.schema[item].dataType).alias(item), "score", "rank")
