"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the corpus into segments of bounded size and stores for each segment a sorted term table and the
postings of every term (positions run over the segment's words, with the documents' offsets beside). Searches take a
phrase's rarest terms in a segment first and intersect the offset-adjusted posting lists; a phrase with an absent term
costs a binary search. Whole matches stay inside a document.

Scale: indexing is one pass without a shuffle, a segment is about SEGMENT bytes of text (one longer text makes one
longer segment), and the index is a table in the shared folder, so that lost executors cost a re-read. Workers hold one
segment at a time. The benchmark is taken in blocks of at most BLOCK characters (longer items are cut between words,
overlapping by a window); each is broadcast, run against all segments, stored and released before the next. Only with
several blocks are the documents' rows grouped. The hit share of a hot passage does not matter: nothing is grouped by
passage.

Edge cases: null and empty texts have no words (n_words 0, no hits); items without words have no windows; a null
item_id counts as an item named by the empty string; repeated item_ids count once; repeated documents are judged row by
row, and text_hash (xxhash64 of the text) tells rows of one doc_id apart; other columns are not read; an empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import stored

WINDOW = 10
SEGMENT = 1 << 20
BLOCK = 4_000_000
INDEX = "segment string, doc_ids array<long>, hashes array<long>, doc_at binary, terms binary, starts binary, positions binary"
HITS = "segment string, ord int, doc_id long, text_hash long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"
#: Rows of the index that a scan decodes at once; a row has about three times SEGMENT bytes.
SCAN_ROWS = 4


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _text.slices(whole, "text", SEGMENT):
            h, _, _, at = _text.words(*_text.buffer_of(batch.column("text")), _text.ALNUM)
            order = np.argsort(h, kind="stable")
            ranked = h[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), ranked[1:] != ranked[:-1]]))
            parts = at.astype(np.int32), ranked[first], np.append(first, len(h)).astype(np.int32), order.astype(np.int32)
            cols = [pa.array([uuid.uuid4().hex]), *(pa.array([batch.column(c).cast(pa.int64()).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "text_hash"))]
            yield pa.record_batch(cols + [pa.array([x.tobytes()], pa.binary()) for x in parts], names=["segment", "doc_ids", "hashes", "doc_at", "terms", "starts", "positions"])
    _text.release()


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text)."""
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text")).mapInArrow(_segments, INDEX), "postings")


class Phrases(NamedTuple):
    """Phrases of one length: term hashes (n x length); those of phrase i come from items owner[at[i]:at[i + 1]]."""

    terms: np.ndarray
    at: np.ndarray
    owner: np.ndarray


def windows(texts: list[str | None], size: int = WINDOW) -> list[Phrases]:
    """Every window of size words of each text (a shorter text's words are one window), equal ones joined."""
    h, _, _, at = _text.words(*_text.buffer_of(pa.array(texts, pa.string())), _text.ALNUM)
    by: dict[int, tuple[list, list]] = {}
    for i in range(len(texts)):
        own = h[at[i] : at[i + 1]]
        n = min(len(own), size)
        if n:
            rows = np.lib.stride_tricks.sliding_window_view(own, n)
            for to, what in zip(by.setdefault(n, ([], [])), (rows, np.full(len(rows), i)), strict=True):
                to.append(what)
    out = []
    for rows, owners in by.values():
        terms, where = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([where.ravel(), np.concatenate(owners)], axis=1), axis=0)
        out.append(Phrases(terms, np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1]))
    return out


class Segment:
    """One row of the index; its arrays lie in the Arrow buffers."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.doc_at, self.terms, self.starts, self.positions = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("doc_at", np.int32), ("terms", np.uint64), ("starts", np.int32), ("positions", np.int32)))
        self.doc_ids, self.hashes = (batch.column(c)[i].values for c in ("doc_ids", "hashes"))
        self.name = batch.column("segment")[i].as_py()
        self.stride = len(self.positions) + 1
        # All posting lists end to end, each moved to a range of its own: one sorted array.
        self.postings = np.repeat(np.arange(len(self.terms), dtype=np.int64) * self.stride, np.diff(self.starts)) + self.positions

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's posting list."""
        at = term * self.stride + position
        i = np.minimum(np.searchsorted(self.postings, at), len(self.postings) - 1)
        return self.postings[i] == at

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ordinal in the segment and number of postings (0: absent) of each term."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return i, np.where(self.terms[i] == terms, self.starts[i + 1] - self.starts[i], 0)

    def exact(self, terms: np.ndarray, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of each occurrence of the phrases (n x length)."""
        length = terms.shape[1]
        term, count = self.lookup(terms)
        alive = np.flatnonzero((count > 0).all(axis=1))
        rank = np.argsort(count[alive], axis=1, kind="stable")
        load = np.cumsum(count[alive].min(axis=1).astype(np.int64)) if len(alive) else np.zeros(0, np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at = 0
        while at < len(alive):
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + most)))
            own, by = alive[at:to], rank[at:to]
            rare = by[:, 0]
            t = term[own, rare]
            n = self.starts[t + 1] - self.starts[t]
            phrase = np.repeat(np.arange(len(own)), n)
            inside = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[self.starts[t][phrase] + inside].astype(np.int64) - rare[phrase]
            doc = np.searchsorted(self.doc_at, start, side="right") - 1
            keep = (start >= 0) & (start + length <= self.doc_at[np.minimum(doc + 1, len(self.doc_at) - 1)])
            phrase, start = phrase[keep], start[keep]
            for k in range(1, length):
                off = by[phrase, k]
                keep = self.holds(term[own[phrase], off], start + off)
                phrase, start = phrase[keep], start[keep]
            found.append((own[phrase], start))
            at = to
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """First words where each term of the phrase stands at most slop words from its place, in one document (by the rarest term)."""
        term, count = self.lookup(terms)
        if not len(terms) or not count.all():
            return np.zeros(0, np.int64)
        order = np.argsort(count, kind="stable")
        lists = [self.positions[self.starts[t] : self.starts[t + 1]].astype(np.int64) for t in term]
        start = lists[order[0]] - order[0]
        low = self.doc_at[np.searchsorted(self.doc_at, lists[order[0]], side="right") - 1]
        high = self.doc_at[np.searchsorted(self.doc_at, lists[order[0]], side="right")]
        keep = np.ones(len(start), bool)
        for o in order[1:]:
            k = np.searchsorted(lists[o], np.maximum(start + o - slop, low))
            k_in = np.minimum(k, len(lists[o]) - 1)
            keep &= (k < len(lists[o])) & (lists[o][k_in] <= np.minimum(start + o + slop, high - 1))
        return start[keep]


def _hits(phrases: list[Phrases], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch, i)
                n = len(seg.doc_ids)
                cover, owned = np.zeros(int(seg.doc_at[-1]) + 1, np.int64), []
                for p in phrases:
                    which, start = seg.exact(p.terms)
                    if not len(start):
                        continue
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + p.terms.shape[1], -1)
                    doc = np.searchsorted(seg.doc_at, start, side="right") - 1
                    pairs = np.unique(np.stack([doc, which], axis=1), axis=0)
                    many = p.at[pairs[:, 1] + 1] - p.at[pairs[:, 1]]
                    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    owned.append(np.stack([np.repeat(pairs[:, 0], many), p.owner[np.repeat(p.at[pairs[:, 1]], many) + inside]], axis=1))
                spans: list[list] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                if owned:
                    hit = np.cumsum(cover)[:-1] > 0
                    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        d = int(np.searchsorted(seg.doc_at, s, side="right")) - 1
                        while s < e:  # runs of neighbouring documents are cut
                            to = min(e, int(seg.doc_at[d + 1]))
                            if s < to:
                                spans[d].append({"s": s - int(seg.doc_at[d]), "e": to - int(seg.doc_at[d])})
                            s, d = max(s, to), d + 1
                    for d, item in np.unique(np.concatenate(owned), axis=0).tolist():
                        items[d].add(names[item])
                yield pa.record_batch(
                    [pa.array([seg.name] * n, pa.string()), pa.array(range(n), pa.int32()), seg.doc_ids, seg.hashes, pa.array(np.diff(seg.doc_at).astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["segment", "ord", "doc_id", "text_hash", "n_words", "spans", "items"],
                )
        _text.release()

    return run


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _pieces(text: str, size: int, most: int) -> Iterator[str]:
    """The text, or pieces of about most characters that hold each run of size words in one of them at least."""
    if len(text) <= most:
        yield text
        return
    begin, starts = 0, []
    for m in _WORD.finditer(text):
        starts.append(m.start())
        if m.end() - begin > most and len(starts) >= size:
            yield text[begin : m.end()]
            starts = starts[len(starts) - size + 1 :]
            begin = starts[0] if starts else m.end()
    if len(starts) >= size or not begin:
        yield text[begin:]


def _blocks(items: DataFrame, size: int) -> Iterator[tuple[list[str], list[str | None]]]:
    names, texts, held = [], [], 0
    for r in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        for piece in _pieces(r[1] or "", size, BLOCK):
            names.append(r[0] or "")
            texts.append(piece)
            held += len(piece)
            if held >= BLOCK:
                yield names, texts
                names, texts, held = [], [], 0
    yield names, texts


def phrase_hits(index: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """For each document: n_words, the word spans that windows of items cover, and the items found (HITS), stored."""
    spark, parts = index.sparkSession, []
    for names, texts in _blocks(items, size):
        if texts or not parts:
            held = spark.sparkContext.broadcast((windows(texts, size), names))
            parts.append(stored(index.mapInArrow(lambda b, held=held: _hits(*held.value)(b), HITS), "hits", SCAN_ROWS))
            held.destroy()
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("segment", "ord").agg(*(F.max(c).alias(c) for c in ("doc_id", "text_hash", "n_words")), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def proximity_hits(index: DataFrame, items: DataFrame, slop: int = 2) -> DataFrame:
    """item, doc_id, word: where every word of an item stands at most slop words from its place, counted from the rarest.

    Items are whole here (one longer than BLOCK makes a longer block); an item with an absent term costs one lookup.
    """
    spark, out = index.sparkSession, None
    for names, texts in _blocks(items, 1 << 62):
        h, _, _, at = _text.words(*_text.buffer_of(pa.array(texts, pa.string())), _text.ALNUM)
        held = spark.sparkContext.broadcast((names, h, at))

        def run(batches, held=held):
            names, h, at = held.value
            for batch in batches:
                for i in range(batch.num_rows):
                    seg, got = Segment(batch, i), []
                    absent = np.concatenate([[0], np.cumsum(seg.lookup(h)[1] == 0)])
                    for k in np.flatnonzero((absent[at[1:]] == absent[at[:-1]]) & (at[1:] > at[:-1])).tolist():
                        for s in seg.near(h[at[k] : at[k + 1]], slop).tolist():
                            d = min(max(int(np.searchsorted(seg.doc_at, max(s, 0), side="right")) - 1, 0), len(seg.doc_ids) - 1)
                            got.append((names[k], seg.doc_ids[d].as_py(), s - int(seg.doc_at[d])))
                    cols = list(zip(*got, strict=True)) or [(), (), ()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "word"])
            _text.release()

        part = stored(index.mapInArrow(run, "item string, doc_id long, word long"), "near-hits", SCAN_ROWS)
        held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash for each row of docs."""
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(F.greatest(a.end, x.e).alias("end"), (a.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, a.end))).alias("n")), lambda a: a.n.cast("long"))
    return phrase_hits(build_index(docs), items, size).select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "text_hash"
    )
