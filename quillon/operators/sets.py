"""Set algebra over ids: postings, lists, ranges and friend graphs, all as equi-joins or aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.predicate import words_of

OWN, FAR = 200_000, 100_000
HELD = 500_000


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, key: each distinct word of each text."""
    return docs.select(F.explode(words_of(F.col(text))).alias("word"), key)


def all_words(post: DataFrame, words: list[str], key: str = "doc_id", missing: int = 0) -> DataFrame:
    """Keys whose postings hold all of the words, or all but missing of them."""
    wanted = list(dict.fromkeys(words))
    hits = post.where(F.col("word").isin(wanted)).select("word", key).distinct()
    return hits.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= len(wanted) - missing).select(key)


def any_words(post: DataFrame, words: list[str], key: str = "doc_id") -> DataFrame:
    return post.where(F.col("word").isin(words)).select(key).distinct()


def but_words(keys: DataFrame, post: DataFrame, words: list[str], key: str = "doc_id") -> DataFrame:
    return keys.join(any_words(post, words, key), key, "left_anti")


def range_join(points: DataFrame, ranges: DataFrame, point: str, bits: int = 16) -> DataFrame:
    """points with the code of the shortest range (start, end, code) around them, else null; equal points stay rows of their own.

    A range goes to the level of its width (a power of two, 2**bits at least), where it meets two buckets at most; a point
    looks into its bucket of each level that occurs. So the join is an equi-join, and no range is spread over many rows.
    Ties go to the later start, then to the code.
    """
    level = F.greatest(F.ceil(F.log2((F.col("end") - F.col("start") + 1).cast("double"))).cast("int"), F.lit(bits))
    wide = ranges.where("start <= end").select("start", "end", "code", level.alias("_l"))
    wide = wide.withColumn("_b", F.explode(F.array_distinct(F.array(F.expr("shiftright(start, _l)"), F.expr("shiftright(end, _l)")))))
    levels = wide.agg(F.sort_array(F.collect_set("_l")).alias("_levels"))  # 64 at most
    own = points.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(levels)).withColumn("_l", F.explode_outer("_levels")).withColumn("_b", F.expr(f"shiftright(cast({point} AS bigint), _l)"))
    hit = own.join(wide, ["_l", "_b"], "left")
    inside = F.col(point).between(F.col("start"), F.col("end"))
    best = F.min(F.when(inside, F.struct((F.col("end") - F.col("start")).alias("w"), (-F.col("start")).alias("s"), F.col("code").alias("code"))))
    return hit.groupBy("_id", *points.columns).agg(best.getField("code").alias("code")).drop("_id")


def common_neighbours(edges: DataFrame, user: int) -> DataFrame:
    """other, common for every other u with neighbours in common with one user; edges (u, v)."""
    own = edges.where(F.col("u") == user).select("v").distinct()
    return edges.where(F.col("u") != user).distinct().join(own, "v", "left_semi").groupBy(F.col("u").alias("other")).agg(F.count("*").alias("common"))


def _tops(u: np.ndarray, other: np.ndarray, n: np.ndarray, limit: int) -> np.ndarray:
    """Places of the limit best rows of each u: most n, then the least other."""
    order = np.lexsort((other, -n, u))
    s = u[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    rank = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    return order[rank < limit]


class _Block:
    """Counts of common neighbours between the users of a block and others, who come in ascending order."""

    def __init__(self, own: list[tuple], barred: list[tuple], least: int, limit: int | None, held: int):
        u, v = (np.concatenate([x[i] for x in own]) if own else np.zeros(0, np.int64) for i in (0, 1))
        self.users, at = np.unique(u, return_inverse=True)
        self.members = self._by(v, at)
        a, b = (np.concatenate([x[i] for x in barred]) if barred else np.zeros(0, np.int64) for i in (0, 1))
        known = np.isin(a, self.users)
        self.barred = self._by(b[known], np.searchsorted(self.users, a[known]))
        # A pair must have more than this; later others lose ties, so it rises to the least of a user's limit best.
        self.bound = np.full(len(self.users), least - 1, np.int64)
        self.limit, self.held, self.rows, self.size = limit, held, [], 0

    @staticmethod
    def _by(key: np.ndarray, value: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(key, kind="stable")
        keys, starts = np.unique(key[order], return_index=True)
        return dict(zip(keys.tolist(), np.split(value[order], starts[1:]), strict=True)) if len(keys) else {}

    def add(self, other: int, nodes: list[int]) -> None:
        parts = [m for m in map(self.members.get, nodes) if m is not None]
        if not parts:
            return
        hits = np.concatenate(parts)
        if len(hits) * 8 < len(self.users):
            who, n = np.unique(hits, return_counts=True)
        else:
            every = np.bincount(hits, minlength=len(self.users))
            who = np.flatnonzero(every > self.bound)
            n = every[who]
        keep = (n > self.bound[who]) & (self.users[who] != other)
        for gone in (self.members.get(other), self.barred.get(other)):
            if gone is not None:
                keep &= ~np.isin(who, gone)
        if keep.any():
            self.rows.append((who[keep], np.full(int(keep.sum()), other), n[keep].astype(np.int64)))
            self.size += len(self.rows[-1][0])

    def taken(self, last: bool) -> tuple | None:
        """Rows to give out, once there are held of them or it is the last time."""
        if not self.rows or self.size < self.held and not last:
            return None
        at, other, n = (np.concatenate([r[i] for r in self.rows]) for i in range(3))
        if self.limit is not None:
            top = _tops(at, other, n, self.limit)
            at, other, n = at[top], other[top], n[top]
            full = np.bincount(at, minlength=len(self.users)) >= self.limit
            low = np.full(len(self.users), np.iinfo(np.int64).max)
            np.minimum.at(low, at, n)
            self.bound = np.where(full, np.maximum(self.bound, low), self.bound)
            if not last and len(at) <= self.held // 2:
                self.rows, self.size = [(at, other, n)], len(at)
                return None
        self.rows, self.size = [], 0
        return self.users[at], other, n


def _common(least: int, limit: int | None, held: int):
    """Rows (i, j, k, a, b) in that order to (u, other, common): k is 0 for users' neighbours, 1 for pairs left out, 2 for the others'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, own, barred, other, nodes = None, None, [], [], None, []

        def given(last: bool) -> Iterator[pa.RecordBatch]:
            rows = block.taken(last) if block else None
            if rows is not None:
                for lo in range(0, len(rows[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000], pa.int64()) for c in rows], ["u", "other", "common"])

        for batch in batches:
            i, j, k, a, b = (batch.column(n).to_numpy() for n in range(5))
            if not len(k):
                continue
            change = lambda *c: np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in c])])
            starts = change(i, j, k, np.where(k == 2, a, 0))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(k)], strict=True):
                if (i[lo], j[lo]) != at:
                    if nodes:
                        block.add(other, nodes)
                    yield from given(True)
                    at, block, own, barred, other, nodes = (i[lo], j[lo]), None, [], [], None, []
                if k[lo] < 2:
                    (barred if k[lo] else own).append((a[lo:hi], b[lo:hi]))
                    continue
                if block is None:
                    block = _Block(own, barred, least, limit, held)
                if nodes and a[lo] != other:
                    block.add(other, nodes)
                    nodes = []
                    yield from given(False)
                other = int(a[lo])
                nodes += b[lo:hi].tolist()
        if nodes:
            block.add(other, nodes)
        yield from given(True)

    return run


def suggestions(edges: DataFrame, users: DataFrame, least: int = 1, limit: int | None = 10, except_pairs: DataFrame | None = None) -> DataFrame:
    """u, other, common, rank: for the given users (u) the others with most neighbours in common that aren't neighbours already; ids are whole numbers.

    Two hops from a stated set of users over every middle node, without writing out a pair for each path. Users are dealt
    into blocks of about OWN edges and all nodes into blocks of about FAR; each two blocks are counted where they meet, one
    other at a time, and give a pair with its count. With a limit a block keeps the best of each user only, which decide
    the best of all. limit None: every pair, without rank.
    """
    e = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).dropna().distinct()
    asked = users.select(F.col("u").cast("bigint").alias("u")).distinct()
    own = e.join(asked, "u", "left_semi")
    ni = max(1, -(-own.count() // OWN))
    nj = max(e.sparkSession.sparkContext.defaultParallelism, -(-e.count() // FAR))
    dealt = lambda n: F.pmod(F.xxhash64("u"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    rows = lambda df, k, other, i, j: df.select(i.alias("i"), j.alias("j"), F.lit(k).alias("k"), F.col("u").alias("a"), F.col(other).cast("bigint").alias("b"))
    parts = rows(own, 0, "v", dealt(ni), every(nj)).union(rows(e, 2, "v", every(ni), dealt(nj)))
    if except_pairs is not None:
        barred = except_pairs.select(F.col("u").cast("bigint").alias("u"), "other").dropna().join(asked, "u", "left_semi")
        parts = parts.union(rows(barred, 1, "other", dealt(ni), every(nj)))
    met = parts.repartition(min(ni * nj, 10_000), "i", "j").sortWithinPartitions("i", "j", "k", "a")
    pairs = met.mapInArrow(_common(least, limit, HELD), "u bigint, other bigint, common bigint")
    kind = edges.schema["u"].dataType
    pairs = pairs.select(F.col("u").cast(kind).alias("u"), F.col("other").cast(kind).alias("other"), "common")
    if limit is None:
        return pairs
    w = Window.partitionBy("u").orderBy(F.desc("common"), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
