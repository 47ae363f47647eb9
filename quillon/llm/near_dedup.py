"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

A text's set holds its distinct shingles of k words (A-Z lower-cased, words between ASCII white space). Its sketch has
REGISTERS registers; each keeps the leading-zero count and ten mantissa bits of the least hash of its bucket, and empty
registers borrow along a fixed random order (one order for all texts, so that registers still agree with probability J).
Texts with equal registers in any band become candidates. The estimate, corrected for chance collisions, drops
candidates far below the threshold; whatever is left is confirmed on full sets.

Scale: equal sets are one node with a number of its own. Work on pairs goes in steps, each in blocks of bounded size and
none emitting more than a spanning forest:
1. each member of a bucket is estimated against the bucket's least; where that fails in a bucket of three or more, it is
   estimated against all members of that bucket, registers only;
2. each candidate is confirmed on full sets against its likeliest neighbour;
3. only components that are still in several parts compare whole sets between their parts, the largest one not with itself.
So a group of copies costs a comparison for each copy. All state lies in tables in the shared folder; texts are moved
for candidates alone, but for one shuffle that finds them.

Edge cases: null or empty texts have empty sets, link with nothing and are their own component. Repeated rows (one
doc_id, one text) share a component; rows of one doc_id with different texts are judged apart. A row whose doc_id is null
links like any other; it takes the least doc_id of its component, or null, and is kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._graph import components
from ._store import stored

REGISTERS = 252
MANTISSA = 10
SLACK = 0.14  # five standard deviations of the estimate at a similarity of 0.8
BLOCK_DOCS, BLOCK_SHINGLES, BLOCK_CHILDREN = 256, 200_000, 128
BLOCK_SKETCHES = 192

_order = np.array([np.roll(np.random.default_rng(i).permutation(REGISTERS), 0) for i in range(REGISTERS)])
for _i in range(REGISTERS):
    _j = int(np.flatnonzero(_order[_i] == _i)[0])
    _order[_i, [0, _j]] = _order[_i, [_j, 0]]


def rows_per_band(threshold: float) -> int:
    """The longest band that misses a pair at the threshold with a probability under 1e-5."""
    return max(r for r in range(1, 13) if r == 1 or (1 - threshold**r) ** (REGISTERS // r) < 1e-5)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: 64 - bucket bits give the bucket, the next bits (zeros << MANTISSA) + mantissa."""
    wide = (hashes >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket = (wide >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (wide[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    bits = np.frexp(rest.astype(np.float64))[1]  # of rest: 32 - leading zeros
    mantissa = np.where(bits > MANTISSA, rest >> np.maximum(bits - 1 - MANTISSA, 0), rest << np.maximum(MANTISSA + 1 - bits, 0)) & ((1 << MANTISSA) - 1)
    value = ((32 - bits) << MANTISSA) + mantissa
    out = np.full(REGISTERS, -1, dtype=np.int64)
    out[bucket[first]] = value
    if len(first) < REGISTERS:
        full = out >= 0
        empty = np.flatnonzero(~full)
        order = _order[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out.astype(np.uint16)


def band_keys(registers: np.ndarray, r: int) -> np.ndarray:
    """A hash for each band of each row of registers, apart from those of other bands."""
    b = REGISTERS // r
    x = registers[:, : b * r].reshape(len(registers), b, r).astype(np.uint64)
    h = np.arange(1, b + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    h = np.repeat(h, len(x), axis=0)
    for j in range(r):
        h = _text.mix(h ^ (x[:, :, j] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))
    return h.view(np.int64)


def estimate(same: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, less those that agree by chance: zeros agree one time in three, mantissas one in 2**MANTISSA."""
    chance = 1 / 3 / 2**MANTISSA
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _sketches(k: int, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _text.slices(whole, "text"):
                sizes, digests, regs = [], [], []
                for s in _text.sets(batch.column("text"), k):
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    regs.append(sketch(s) if len(s) else np.zeros(REGISTERS, np.uint16))
                m = np.stack(regs)
                keys = band_keys(m, r)
                yield pa.record_batch(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in m], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "registers", "bands"],
                )
        _text.release()

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst, estimate of each pair of sketches."""
    for b in batches:
        if b.num_rows:
            e = estimate((_registers(b.column("registers")) == _registers(b.column("others"))).mean(axis=1))
            yield pa.record_batch([b.column("src"), b.column("dst"), b.column("crowded"), pa.array(e)], names=["src", "dst", "crowded", "estimate"])


class Forest:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)
        return a != b


def _grouped(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first width values; rows come sorted by these."""
    key, held = None, []
    for r in rows:
        if r[:width] != key:
            if held:
                yield key, held
            key, held = r[:width], []
        held.append(r[width:])
    if held:
        yield key, held


def _edges(found: list[tuple]) -> pa.RecordBatch:
    src, dst, e = zip(*found, strict=True) if found else ((), (), ())
    return pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(e, pa.float64())], names=["src", "dst", "estimate"])


def _crowd(least: float):
    """Rows (band, i, j, all, node, registers) sorted by block: the first of each block against all of it, by estimate; a spanning forest of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("band", "i", "j", "all", "node", "registers")), strict=True))
        for _, own in _grouped(rows, 3):
            few, every = ([r for r in own if r[0] is x] for x in (False, True))
            if not few or not every:
                continue
            at = {n: i for i, n in enumerate(sorted({r[1] for r in own}))}
            forest, found = Forest(len(at)), []
            y = np.stack([np.frombuffer(r[2], np.uint16) for r in every])
            for _, node, raw in few:
                e = estimate((y == np.frombuffer(raw, np.uint16)).mean(axis=1))
                for k in np.flatnonzero(e >= least).tolist():
                    other = every[k][1]
                    if other != node and forest.join(at[node], at[other]):
                        found.append((max(node, other), min(node, other), float(e[k])))
            if found:
                yield _edges(found)
        _text.release()

    return run


def linked(first: list[np.ndarray], second: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(i, j) of every pair of a first and a second set with 100 * intersection >= percent * union."""
    m, n = len(first), len(second)
    a, b = (np.array([len(x) for x in sets], dtype=np.int64) for sets in (first, second))
    common = np.zeros((m, n), dtype=np.float64)
    if min(m, n) == 1:
        one, rest, own = (first[0], second, common[0]) if m == 1 else (second[0], first, common[:, 0])
        for k, x in enumerate(rest):
            if len(one) and len(x):
                own[k] = (one[np.minimum(np.searchsorted(one, x), len(one) - 1)] == x).sum()
    elif m and n:
        values, column = np.unique(np.concatenate(first + second), return_inverse=True)
        row, cut = np.repeat(np.arange(m + n), np.concatenate([a, b])), int(a.sum())
        both = np.zeros(len(values), bool)
        both[column[:cut]] = True
        also = np.zeros(len(values), bool)
        also[column[cut:]] = True
        both &= also
        shared = both[column]
        row, column = row[shared], (np.cumsum(both) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(both.sum()), 2048):
            p, q = np.searchsorted(column, [at, at + 2048])
            x = np.zeros((m + n, 2048), dtype=np.float32)
            x[row[p:q], column[p:q] - at] = 1
            common += x[:m] @ x[m:].T
    union = a[:, None] + b[None, :] - common
    return list(zip(*(x.tolist() for x in np.nonzero((100 * common >= percent * union) & (union > 0))), strict=True))


def _confirm(k: int, percent: int):
    """Rows (comp, i, j, all, node, text) sorted by block: the first of each block against all of it on full sets; a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for whole in batches:
                for batch in _text.slices(whole, "text"):
                    yield from zip(*(batch.column(x).to_pylist() for x in ("comp", "i", "j", "all", "node")), _text.sets(batch.column("text"), k), strict=True)

        for _, own in _grouped(rows(), 3):
            few, every = ([r for r in own if r[0] is x] for x in (False, True))
            if not few or not every:
                continue
            at = {n: i for i, n in enumerate(sorted({r[1] for r in own}))}
            forest, found = Forest(len(at)), []
            for x, y in linked([r[2] for r in few], [r[2] for r in every], percent):
                one, other = few[x][1], every[y][1]
                if one != other and forest.join(at[one], at[other]):
                    found.append((max(one, other), min(one, other), 1.0))
            if found:
                yield _edges(found)
        _text.release()

    return run


_EDGE = "src long, dst long, estimate double"
_ROW = ("row_none", "row_id", "text_hash")


def row_keys(df: DataFrame) -> DataFrame:
    """df (doc_id, text) with keys that tell its rows apart, null-safe; equal keys: a repeated row."""
    return df.withColumns({"row_none": F.col("doc_id").isNull(), "row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "text_hash": F.xxhash64(F.col("text").cast("string"))})


def _blocks(few: DataFrame, every: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Rows of few and every (key, node) dealt to blocks (key, i, j, all), so that each of few meets each of every once; sizes has few_blocks and all_blocks of each key."""
    put = lambda df, own, other, mine, theirs, flag: (
        df.join(sizes, key).withColumn(mine, F.pmod(F.xxhash64("node"), own).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(key, "i", "j", F.lit(flag).alias("all"), "node")
    )
    return put(few, F.col("few_blocks"), "all_blocks", "i", "j", False).unionByName(put(every, F.col("all_blocks"), "few_blocks", "j", "i", True))


def _candidates(nodes: DataFrame, least: float) -> DataFrame:
    """src, dst, estimate (src > dst): a forest, over whose trees every pair estimated at least at ``least`` that shares a band is connected."""
    member = nodes.select("node", F.explode("bands").alias("band"))
    bucket = member.groupBy("band").agg(F.min("node").alias("dst"), F.max("node").alias("most"), F.count("*").alias("m")).where("dst < most")
    inside = stored(member.join(bucket, "band").where("node > dst").select("band", "node", "dst", "m"), "buckets")
    pairs = inside.groupBy(F.col("node").alias("src"), "dst").agg(F.max(F.col("m") > 2).alias("crowded"))
    regs = nodes.select("node", "registers")
    judged = stored(
        pairs.join(regs.withColumnRenamed("node", "src"), "src").join(regs.select(F.col("node").alias("dst"), F.col("registers").alias("others")), "dst").mapInArrow(_judge, "src long, dst long, crowded boolean, estimate double"),
        "judged",
    )
    near = judged.where(F.col("estimate") >= least).select("src", "dst", "estimate")
    failed = judged.where((F.col("estimate") < least) & F.col("crowded")).select(F.col("src").alias("node"), "dst")
    few = stored(inside.where("m > 2").join(failed, ["node", "dst"]).select("band", "node", "dst", "m"), "crowded")
    blocks = lambda n: F.ceil(n / BLOCK_SKETCHES).cast("int")
    sizes = stored(few.groupBy("band").agg(F.first("dst").alias("node"), blocks(F.first("m")).alias("all_blocks"), blocks(F.count("*")).alias("few_blocks")), "sizes")
    every = inside.select("band", "node").join(sizes.select("band"), "band").unionByName(sizes.select("band", "node"))
    dealt = _blocks(few.select("band", "node"), every, "band", sizes.drop("node")).join(regs, "node")
    crowd = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_crowd(least), _EDGE)
    return stored(near.unionByName(crowd), "near")


def _verified(nodes: DataFrame, texts: DataFrame, near: DataFrame, percent: int, k: int) -> DataFrame:
    """node, comp of every node that has a confirmed link."""
    cand = near.select(F.col("src").alias("node")).union(near.select("dst")).distinct()
    own = nodes.select("node", "n", "own.*").withColumnRenamed("none", "row_none").join(cand, "node")
    whole = row_keys(texts).dropDuplicates(list(_ROW)).select(*_ROW, "text")
    held = stored(own.join(whole, list(_ROW)).select("node", "n", "text"), "held")
    run = lambda dealt: dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_confirm(k, percent), _EDGE)
    text = held.select("node", "text")

    # Each candidate against its likeliest neighbour; the children of one neighbour are dealt by number.
    parent = stored(near.groupBy(F.col("src").alias("node")).agg(F.max_by("dst", F.struct("estimate", "dst")).alias("comp")), "parents")
    parts = stored(parent.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK_CHILDREN).cast("int").alias("all_blocks")).withColumn("few_blocks", F.lit(1)), "parts")
    centre = parts.select("comp", F.col("comp").alias("node"))
    sure = stored(components(run(_blocks(centre, parent, "comp", parts).join(text, "node"))), "sure")

    # Groups of parts that are near but not joined yet: whatever is outside the largest part of a group against everything.
    part = lambda node, name: F.coalesce(name, node).alias(name)
    to = lambda name, node: sure.select(F.col("node").alias(node), F.col("comp").alias(name))
    ends = near.select("src", "dst").join(to("a", "src"), "src", "left").join(to("b", "dst"), "dst", "left").select(part("src", "a"), part("dst", "b"))
    groups = components(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    told = held.select("node", "n").join(sure.withColumnRenamed("comp", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")).join(groups.withColumnRenamed("node", "part"), "part")
    told = stored(told.select("comp", "part", "node", "n"), "told")
    sizes = told.groupBy("comp", "part").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sizes = sizes.groupBy("comp").agg(F.max_by("part", F.struct("m", "part")).alias("core"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.max("m").alias("core_m"))
    blocks = lambda share: F.greatest(F.ceil(F.col("m") * share / BLOCK_DOCS), F.ceil(F.col("n") * share / BLOCK_SHINGLES)).cast("int")
    sizes = stored(sizes.select("comp", "core", blocks(F.lit(1.0)).alias("all_blocks"), blocks((F.col("m") - F.col("core_m")) / F.col("m")).alias("few_blocks")), "sizes")
    few = told.join(sizes, "comp").where("part <> core").select("comp", "node")
    more = stored(run(_blocks(few, told.select("comp", "node"), "comp", sizes.drop("core")).join(text, "node")), "more")
    mine = told.select(F.col("node").alias("src"), F.col("part").alias("a"))
    joined = components(more.join(mine, "src").join(mine.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    last = joined.select(F.col("node").alias("comp"), F.col("comp").alias("last"))
    alone = joined.join(sure.select(F.col("comp").alias("node")), "node", "left_anti")
    return sure.join(last, "comp", "left").select("node", F.coalesce("last", "comp").alias("comp")).unionByName(alone)


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, stays for each row of docs (doc_id, text); see the module.

    kept goes by the ids alone (doc_id = component_id, or null). stays marks one row of each component, that of the
    least doc_id (a null only if all are) and then of the least text_hash, and every row with an empty set; repeats of
    that row are marked as well.
    """
    r = rows_per_band(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stored(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketches(k, r), "doc_id long, text_hash long, n_shingles long, digest binary, registers binary, bands array<long>"), "sketches")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("row_id"), "text_hash")
    nodes = stored(
        seen.where("n_shingles > 0").groupBy("digest").agg(F.min(own).alias("own"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    final = _verified(nodes, texts, _candidates(nodes, percent / 100 - SLACK), percent, k)
    classes = stored(nodes.select("digest", "node", "own").join(final, "node", "left").select("digest", "own", F.coalesce("comp", "node").alias("comp")), "digests")
    least = stored(classes.groupBy("comp").agg(F.min("own").alias("least")), "least")
    named = stored(classes.join(least, "comp").select("digest", "least"), "named")
    return (
        seen.select("doc_id", "n_shingles", "text_hash", "digest")
        .join(named, "digest", "left")
        .withColumn("component_id", F.when(F.col("least").isNull(), F.col("doc_id")).when(~F.col("least.none"), F.col("least.row_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("doc_id").isNull())
        .withColumn("stays", F.col("least").isNull() | (F.col("least") == own))
        .select("doc_id", "n_shingles", "component_id", "kept", "text_hash", "stays")
    )
