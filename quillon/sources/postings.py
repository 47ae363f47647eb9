"""Stored inverted indexes: built by segments, merged, searched.

A row is (word, part, ids): the sorted ids of a word, cut into parts of PART ids by their range, so that the rows of a very
common word stay bounded. Parquet's second page format packs their differences into few bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.predicate import words_of

PART, BUCKETS = 1 << 16, 64
INDEX = "word string, part bigint, ids array<bigint>"


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of a table; ids go to the part of their range."""
    return merge([blocks(docs, key, text)])


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of an index for each Arrow batch of texts by itself, so that no row for a word of a text is sorted or shuffled."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), words_of(F.col(text)).alias("words"))
    return rows.mapInArrow(_turned(PART), INDEX)


def _turned(size: int) -> Callable:
    """Nested, as workers have no module of ours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.sort_by("id")  # the places of a word are then in order of the ids
            words = b.column("words")
            code = pc.list_flatten(words).dictionary_encode()
            ids = b.column("id").to_numpy()[pc.list_parent_indices(words).to_numpy()]
            number = code.indices.to_numpy()
            order = np.argsort(number, kind="stable")
            number, ids = number[order], ids[order]
            new = np.ones(len(ids), bool)
            new[1:] = (number[1:] != number[:-1]) | (ids[1:] != ids[:-1])
            number, ids = number[new], ids[new]
            part = ids // size
            first = np.ones(len(ids), bool)
            first[1:] = (number[1:] != number[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(first)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(number[at])), pa.array(part[at], pa.int64()), lists], ["word", "part", "ids"])

    return run


def _joined() -> Callable:
    def join(rows: pa.RecordBatch | pa.Table, new: np.ndarray) -> pa.RecordBatch:
        """new: whether a row is the first of its word and part."""
        ids, at = pc.list_flatten(rows["ids"]).to_numpy(), np.flatnonzero(new)
        number = (np.cumsum(new) - 1)[pc.list_parent_indices(rows["ids"]).to_numpy()]
        if len(at) < len(new):
            order = np.lexsort((ids, number))
            number, ids = number[order], ids[order]
            one = np.ones(len(ids), bool)
            one[1:] = (number[1:] != number[:-1]) | (ids[1:] != ids[:-1])
            number, ids = number[one], ids[one]
        ends = np.searchsorted(number, np.arange(len(at) + 1))
        return pa.RecordBatch.from_arrays([rows["word"].take(at), rows["part"].take(at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))], ["word", "part", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b.cast(held.schema) if held is not None else b])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks().to_batches()[0]
            same = pc.and_(pc.equal(rows["word"][1:], rows["word"][:-1]), pc.equal(rows["part"][1:], rows["part"][:-1]))
            new = np.append(True, ~same.to_numpy(zero_copy_only=False))
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield join(rows[:last], new[:last])
            held = pa.Table.from_batches([rows[last:]])  # the last list may go on in the next batch
        if held is not None:
            rows = held.combine_chunks().to_batches()[0]
            yield join(rows, np.arange(rows.num_rows) == 0)

    return run


def merge(indexes: list[DataFrame]) -> DataFrame:
    """One index of several: lists of the same word and part as one. Rows are dealt by their bucket, sorted, and joined where they meet, in blocks."""
    out = indexes[0]
    for i in indexes[1:]:
        out = out.unionByName(i)
    rows = out.select("word", "part", "ids").repartition(bucket(F.col("word"))).sortWithinPartitions("word", "part")
    return rows.mapInArrow(_joined(), INDEX)


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def gaps(ids: Column) -> Column:
    """A sorted list as its first number and the differences."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(ids, i - 1)))


def ungapped(d: Column) -> Column:
    """The list of its gaps again; for lists of some hundreds, as each number copies those before it."""
    return F.aggregate(d, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))


def save(index: DataFrame, path: str) -> None:
    """In folders by bucket and sorted by word, so that a search reads only the files and row groups of its words."""
    rows = index.select("word", "part", "ids", bucket(F.col("word")).alias("bucket")).sortWithinPartitions("bucket", "word", "part")
    rows.write.option("parquet.writer.version", "v2").partitionBy("bucket").mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _of_words(index: DataFrame, words: list[str]) -> DataFrame:
    rows = index.where(F.col("word").isin(words))
    return rows.where(F.col("bucket").isin([bucket(F.lit(w)) for w in words])) if "bucket" in index.columns else rows


def all_of(index: DataFrame, words: list[str]) -> DataFrame:
    """Ids with all the words: the lists of each part intersected, no row for each id before that."""
    wanted = list(dict.fromkeys(words))
    rows = _of_words(index, wanted).groupBy("part").agg(F.collect_list("ids").alias("lists"))
    rows = rows.where(F.size("lists") == len(wanted))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0)), F.array_intersect)
    return rows.select(F.explode(both).alias("id"))


def any_of(index: DataFrame, words: list[str]) -> DataFrame:
    rows = _of_words(index, words).groupBy("part").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    return rows.select(F.explode("ids").alias("id"))
