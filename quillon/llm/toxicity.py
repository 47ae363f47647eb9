"""Toxicity: logistic regression over hashed word features, trained by FTRL-proximal.

Features (present or absent in a text, hashed to 32 bits): words, their first 4, 5 and 6 bytes where longer (inflected
forms share these), pairs of neighbouring words and pairs with one word between (skip-grams). FTRL-proximal gives each
coordinate its own rate, and L1 leaves few weights, which are broadcast (their number is checked, MOST_WEIGHTS).

Training takes at most TRAIN_ROWS labelled rows, those of least hash of doc_id (a documented bound; the features of
that many whole texts reach the driver). Scoring is one pass over all rows and whole texts without a shuffle.

Edge cases: null and empty texts score by the bias alone; rows with a null label don't train; without any training
row of either class every score is the share of the positive class, held between 1e-6 and 1 - 1e-6. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from . import _text
from ._labels import sample

TRAIN_ROWS = 10_000
LEAST_ROWS = 5  # texts that a feature must be in
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 3.0, 0.5
MOST_WEIGHTS = 2_000_000
_FILTER_BITS = 22


class Model(NamedTuple):
    keys: np.ndarray  # sorted, unsigned 32 bits
    weights: np.ndarray
    bias: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 32-bit feature) of each occurrence."""
    data, off = _text.buffer_of(texts)
    h, begin, end, at = _text.words(data, off, _text.ALNUM)
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    size = end - begin
    keys, rows = [h], [row]
    p = np.zeros(len(h), dtype=_text.U)
    for k in range(1, 7):
        if k > 1 or len(h):
            own = size > k
            p = np.where(size >= k, p * np.uint64(0x100000001B3) + _text.LOWER[data[np.minimum(begin + k - 1, max(len(data) - 1, 0))]].astype(_text.U) + np.uint64(1), p)
            if k >= 4:
                keys.append(_text.mix(p[own] ^ np.uint64(0xA5A5 + k)))
                rows.append(row[own])
    for gap in (1, 2):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            keys.append(_text.mix(h[:-gap][same] * _text._C[0] + h[gap:][same] * _text._C[1] + np.uint64(gap)))
            rows.append(row[:-gap][same])
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(32)).astype(np.uint32)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _text.slices(whole, "text"):
            row, key = features(batch.column("text"))
            both = np.unique((row.astype(np.uint64) << np.uint64(32)) | key)
            cut = np.searchsorted(both >> np.uint64(32), np.arange(batch.num_rows + 1))
            low = both.astype(np.uint32)
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "label", "features"])
    _text.release()


def ftrl(rows: list[np.ndarray], labels: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights of n coordinates and the bias; rows hold the coordinates present in each example."""
    z, q, bz, bq = np.zeros(n), np.zeros(n), 0.0, 0.0
    rate = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rate.permutation(len(rows)):
            x = rows[i]
            zx, qx = z[x], np.sqrt(q[x])
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + qx) / ALPHA + L2))
            b = -bz / ((BETA + np.sqrt(bq)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - labels[i]
            z[x] += g - (np.sqrt(q[x] + g * g) - qx) / ALPHA * w
            q[x] += g * g
            bz += g - (np.sqrt(bq + g * g) - np.sqrt(bq)) / ALPHA * b
            bq += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(q)) / ALPHA + L2))
    return w, -bz / ((BETA + np.sqrt(bq)) / ALPHA)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All features end to end, and the rows' offsets (n + 1) into them."""
    parts = [_text.buffer_of(c) for c in column.chunks]
    size = np.concatenate([np.zeros(1, np.int64), *(np.diff(off) // 4 for _, off in parts)])
    flat, at = np.empty(int(size.sum()), np.uint32), 0
    for data, _ in parts:
        flat[at : at + len(data) // 4] = np.frombuffer(data.tobytes(), np.uint32)
        at += len(data) // 4
    return flat, np.cumsum(size)


def train(docs: DataFrame, labels: DataFrame, label: str) -> Model:
    """From docs (doc_id, text) and labels (doc_id, label); see the module for the bound."""
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample(labels, label, TRAIN_ROWS)), "doc_id")
    got = some.mapInArrow(_extract, "doc_id long, label int, features binary").toArrow()
    ids, y = got["doc_id"].to_pylist(), got["label"].to_numpy().astype(np.float64)
    flat, off = _flat(got["features"])
    del got
    _text.release()
    none = np.zeros(0, np.uint32)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], y[i], xxhash.xxh3_64_intdigest(flat[off[i] : off[i + 1]])))
    every = np.sort(flat)
    first = np.flatnonzero(np.diff(every, prepend=every[:1] ^ np.uint32(1)) != 0)
    keys = every[first][np.diff(first, append=len(every)) >= LEAST_ROWS]
    del every, first
    # Each row's features become coordinates in the same memory; they are fewer at most.
    at, place = 0, flat.view(np.int32)
    ends = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        x = flat[a:b].copy()
        i = np.searchsorted(keys, x)
        i[i == len(keys)] = 0
        own = i[keys[i] == x] if len(keys) else i[:0]
        place[at : at + len(own)] = own
        ends.append((at, at + len(own)))
        at += len(own)
    coordinates, y = [place[slice(*ends[i])] for i in order], y[order]
    w, bias = ftrl(coordinates, y, len(keys))
    del coordinates, place, flat
    _text.release()
    kept = np.flatnonzero(w)
    if len(kept) > MOST_WEIGHTS:
        raise ValueError(f"{len(kept)} weights are more than are broadcast; raise L1")
    return Model(keys[kept], w[kept], float(bias))


def scores(texts: pa.Array, model: Model, seen: np.ndarray) -> np.ndarray:
    total = np.full(len(texts), model.bias)
    if len(model.keys):
        row, key = features(texts)
        hit = seen[key >> np.uint32(32 - _FILTER_BITS)]
        row, key = row[hit], key[hit]
        i = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
        found = model.keys[i] == key
        pair = np.unique(row[found].astype(np.int64) * len(model.keys) + i[found])
        np.add.at(total, pair // len(model.keys), model.weights[pair % len(model.keys)])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (double) and predicted (int); columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[model.keys >> np.uint32(32 - _FILTER_BITS)] = True
        for texts in batches:
            parts = [scores(b.column(0), model, seen) for b in _text.slices(pa.record_batch([texts], names=["text"]), "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))
        _text.release()

    return docs.withColumn("score", F.arrow_udf(run, "double", ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
