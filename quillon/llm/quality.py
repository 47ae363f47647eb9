"""Quality: a sparse ensemble of rules over text statistics, compiled to Column expressions.

Boosted shallow trees on the statistics give candidate rules (the conjunction of splits on each path); a lasso
logistic regression keeps few of them; each kept rule becomes a CASE in one Spark expression, so that scoring is a
projection over the statistics. The statistics are sums over bytes, words and lines of whole texts.

Training takes at most TRAIN_ROWS labelled rows, those of least hash of doc_id (a documented bound); only their
statistics reach the driver. No shuffle carries texts.

Edge cases: null and empty texts have all statistics 0 and are scored like any other; rows with a null label don't
train; with one class only, every score is that class's smoothed share. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from . import _text
from ._labels import sample

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LASSO = 40, 3, 48, 0.3, 0.0015
STATS = (
    "n_chars", "n_words", "n_lines", "word_len", "line_words", "upper", "digits", "space", "marks", "symbols", "pipes", "bangs", "beyond_ascii", "distinct_words", "top_word", "dup_lines", "bare_words", "long_words", "short_words",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = [
    _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b" \t\n\r\v\f"), _table(b".,;:?'\"()-"), _table(b"#$%&*+/<=>@[]\\^_`{}~"), _table(b"|"), _table(b"!"), _table(bytes(range(192, 256))), _table(bytes(range(128, 192))),
]
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text."""
    data, off = _text.buffer_of(texts)
    n = len(off) - 1
    sums = []
    for t in _CLASSES:
        c = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(t[data], out=c[1:])
        sums.append(c[off[1:]] - c[off[:-1]])
    upper, digits, space, marks, symbols, pipes, bangs, leads, follows = sums
    chars = (off[1:] - off[:-1]) - follows
    h, s, e, at = _text.words(data, off, _text.SPACED)
    words = np.diff(at)
    row = np.repeat(np.arange(n), words)
    size = e - s
    per = lambda x: np.bincount(row, weights=x, minlength=n)
    order = np.lexsort((h, row))
    hh, rr = h[order], row[order]
    new = np.ones(len(hh), dtype=bool)
    new[1:] = (hh[1:] != hh[:-1]) | (rr[1:] != rr[:-1])
    first = np.flatnonzero(new)
    distinct = np.bincount(rr[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, rr[first], np.diff(first, append=len(hh)))
    letters = np.zeros(256, dtype=np.int64)
    letters[65:91] = letters[97:123] = letters[128:] = 1
    c = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(letters[data], out=c[1:])
    bare = (c[e] - c[s]) == 0
    lh, _, _, lat = _text.words(data, off, _LINE)
    lines = np.diff(lat)
    lrow = np.repeat(np.arange(n), lines)
    lorder = np.lexsort((lh, lrow))
    lnew = np.ones(len(lh), dtype=bool)
    lnew[1:] = (lh[lorder][1:] != lh[lorder][:-1]) | (lrow[lorder][1:] != lrow[lorder][:-1])
    uniq = np.bincount(lrow[lorder][lnew], minlength=n)
    share = lambda x, of: x / np.maximum(of, 1)
    return np.stack(
        [chars, words, lines, share(per(size), words), share(words, lines), share(upper, chars), share(digits, chars), share(space, chars), share(marks, chars), share(symbols, chars), share(pipes, chars), share(bangs, chars), share(leads, chars), share(distinct, words), share(top, words), 1 - share(uniq, np.maximum(lines, 1)) - (lines == 0), share(per(bare), words), share(per(size > 18), words), share(per(size < 3), words)],
        axis=1,
    ).astype(np.float64)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct column stats."""

    def run(batches):
        for texts in batches:
            parts = [statistics(b.column(0)) for b in _text.slices(pa.record_batch([texts], names=["text"]), "text")]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], names=list(STATS))
        _text.release()

    return docs.withColumn("stats", F.arrow_udf(run, ", ".join(f"{c} double" for c in STATS), ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string")))


class Rule(NamedTuple):
    """Conditions (statistic, is it above, bound), all of which must hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for j, above, bound in self.conditions:
            out &= x[:, j] > bound if above else x[:, j] <= bound
        return out

    def sql(self) -> str:
        return " AND ".join(f"stats.{STATS[j]} {'>' if above else '<='} {bound!r}D" for j, above, bound in self.conditions)


class Model(NamedTuple):
    rules: list[tuple[Rule, float]]
    bias: float

    def column(self) -> Column:
        total = " + ".join([f"{self.bias!r}D", *(f"(CASE WHEN {r.sql()} THEN {w!r}D ELSE 0D END)" for r, w in self.rules)])
        return F.expr(f"1D / (1D + exp(-({total})))")


def _rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct paths of boosted trees; splits by gain over quantile bins."""
    rng, found = np.random.default_rng(11), {}
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))

    def grow(rows: np.ndarray, path: tuple, depth: int, g: np.ndarray, h: np.ndarray, columns: np.ndarray) -> None:
        if path:
            found[Rule(tuple(sorted(path)))] = None
        best = (1e-3, None)
        if depth < DEPTH and len(rows) >= 20:
            all_g, all_h = g[rows].sum(), h[rows].sum()
            for j in columns:
                gs, hs, ns = (np.cumsum(np.bincount(binned[rows, j], weights=v, minlength=len(cuts[j]) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                if len(gs):
                    gain = gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1)
                    gain[(ns < 8) | (len(rows) - ns < 8)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (int(j), k))
        if best[1] is None:
            score[rows] += RATE * -g[rows].sum() / (h[rows].sum() + 1)
            return
        j, k = best[1]
        left = binned[rows, j] <= k
        for part, above in ((rows[left], False), (rows[~left], True)):
            grow(part, (*path, (j, above, float(cuts[j][k]))), depth + 1, g, h, columns)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        columns = np.sort(rng.permutation(x.shape[1])[: max(6, x.shape[1] // 2)])
        grow(np.arange(len(y)), (), 0, p - y, p * (1 - p), columns)
    return list(found)


def _lasso(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of an L1 logistic regression by accelerated proximal steps; the bias is free."""
    m = np.concatenate([m, np.ones((len(m), 1))], axis=1)
    v = np.ones(m.shape[1])
    for _ in range(30):
        v = m.T @ (m @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / max(float(v @ (m.T @ (m @ v))), 1e-9)
    w = z = np.zeros(m.shape[1])
    t = 1.0
    for _ in range(800):
        g = m.T @ (1 / (1 + np.exp(-np.clip(m @ z, -35, 35))) - y) / len(y)
        u = z - step * g
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * LASSO, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = u + (t - 1) / s * (u - w), u, s
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model([], float(np.log(share / (1 - share))))
    rules = _rules(x, y)
    w, bias = _lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64), y) if rules else (np.zeros(0), float(np.log(y.mean() / (1 - y.mean()))))
    return Model([(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6], bias)


def train(docs: DataFrame, labels: DataFrame, label: str) -> Model:
    some = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample(labels, label, TRAIN_ROWS)), "doc_id")
    got = with_statistics(some).select("doc_id", "label", "stats.*").toPandas().sort_values(["doc_id", "label", *STATS], kind="stable")
    return fit(got[list(STATS)].to_numpy(dtype=np.float64), got["label"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with score (double) and predicted (int); columns of these names and stats are replaced."""
    return with_statistics(docs).withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("stats")
