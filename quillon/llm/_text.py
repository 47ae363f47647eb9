"""Whole-batch word hashing over Arrow string buffers: no Python work per word or per document.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed; words of over LONG bytes,
for which such polynomials can be made to collide, take xxh3 of their bytes. Equal words have equal hashes wherever
they stand, so long texts are hashed piece by piece, cut between words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_B = 0xD6E8FEB86659FD93
_INV = pow(_B, -1, 1 << 64)
PIECE = 1 << 20
LONG = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space (space, tab to carriage return).
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Runs of digits, letters and whatever lies beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; those for a piece are kept."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for b in (_B, _INV):
            p = np.full(max(n, PIECE), b, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * PIECE:
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def release() -> None:
    """Give freed memory back to the system at the end of a task: a worker goes on to other stages' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string (UTF-8) or binary array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_binary(texts.type):
        texts = texts.cast(pa.large_string()).fill_null("")
    else:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each lower-cased (A-Z) word, and the texts' offsets (n + 1) into these."""
    hashes, begins, ends = [], [], []
    at, total = 0, len(data)
    edge = np.unique(off[(off > 0) & (off < total)])
    while at < total:
        to = min(at + PIECE, total)
        while to < total:  # cut between words
            gap = np.flatnonzero(~is_word[LOWER[data[to : to + PIECE]]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + PIECE, total)
        low = LOWER[data[at:to]]
        m = is_word[low]
        first, last = m.copy(), m.copy()
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        cut = edge[(edge > at) & (edge < to)] - at
        first[cut] |= m[cut]
        last[cut - 1] |= m[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            power, inverse = _tables(len(low))
            sums = np.zeros(len(low) + 1, dtype=U)
            np.cumsum((low.astype(U) + U(1)) * power[: len(low)], out=sums[1:])
            h = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15))
            for i in np.flatnonzero(e - s > LONG).tolist():
                h[i] = xxhash.xxh3_64_intdigest(low[s[i] : e[i]].tobytes())
            hashes.append(h)
            begins.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U), z, z, np.zeros(len(off), dtype=np.int64)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, off)


_C = [U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (k up to 8), by its first word; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = h[:n] * _C[0]
    for j in range(1, k):
        out += h[j : j + n] * _C[j]
    return mix(out)


def sequence(h: np.ndarray) -> int:
    """Hash of a whole short sequence, apart from those of longer runs."""
    x = 0x2545F4914F6CDD1D * (len(h) + 1)
    for j, v in enumerate(h.tolist()):
        x += v * int(_C[j % 8])
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=U))[0])


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles of k words; all its words as one where it has fewer; empty without words."""
    data, off = buffer_of(texts)
    h, _, _, at = words(data, off, SPACED)
    every = shingles(h, k)
    for i in range(len(off) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield np.array([sequence(h[a:b])], dtype=U)
        else:
            yield np.zeros(0, dtype=U)


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most so many bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    _, off = buffer_of(batch.column(column))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to
