"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Each match of the split pattern is encoded by itself. Two tiers: a minimal perfect hash over the vocabulary resolves
pre-tokens that are tokens; the others merge bytes by rank with a heap over a doubly linked list of parts, so that a
run of n bytes costs n log n. Results of both are remembered in a bounded memo, as words repeat; no match of SPACED
runs on from other characters into white space, so under it the memo takes a word with the white space before it.

Scale: a map over rows without a shuffle; the broadcast holds the vocabulary only, whose size is checked (MOST_TOKENS).
Texts are taken whole, and memory follows one text.

Edge cases: null and empty texts have no ids and decode to nothing; other columns pass through ``encode`` untouched,
unless they have the names of the new ones, which replace them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, LongType

_M = (1 << 64) - 1
MATCHES, PIECES = 600_000, 300_000  # words that a worker remembers, unless told otherwise
RUN_BYTES = 2 << 20
MOST_TOKENS = PAIR = 1_000_000
#: A split pattern whose matches have no white space after other characters, and none that looks behind.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        got = sorted((int(r), base64.b64decode(t)) for t, r in (x.split() for x in f if x.strip()))
    if [r for r, _ in got] != list(range(len(got))):
        raise ValueError("ranks aren't 0, 1, 2, ...")
    if len(got) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens isn't broadcast")
    return [t for _, t in got]


class PerfectHash:
    """Minimal perfect hash by displacement: n keys in n slots; buckets of one key store their slot."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = n // 2 + 1
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * n
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, i))
        free = None
        for b, own in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                free = free or iter([s for s in range(n) if self.slots[s] < 0])
                s = next(free)
                self.shift[b], self.slots[s] = -s - 1, own[0][1]
                continue
            d = 0
            while True:
                at = [self._place(h, d) for h, _ in own]
                if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, i) in zip(at, own, strict=True):
                self.slots[s] = i
        self.keys = keys

    def _place(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & _M) >> 20) % self.n

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = self.slots[-d - 1 if d < 0 else self._place(h, d)]
        return i if self.keys[i] == key else -1


def joins(tokens: list[bytes]) -> dict[int, int]:
    """Pair of tokens (left * PAIR + right) -> the token of both together."""
    ranks = {t: i for i, t in enumerate(tokens)}
    return {(left * PAIR) + right: i for t, i in ranks.items() for k in range(1, len(t)) if (left := ranks.get(t[:k])) is not None and (right := ranks.get(t[k:])) is not None}


def merge(ids: list[int], joined: dict[int, int]) -> list[int]:
    """Ids of a piece from those of its bytes: the adjacent pair of least rank, leftmost first, is joined until none is a token."""
    n, join = len(ids), joined.get
    b = n.bit_length()
    low = (1 << b) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # A pair is (rank, its first byte), packed into one number; it is stale if it doesn't make that token any more.
    heap = [(r << b) + i for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if (r := join(x * PAIR + y)) is not None]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        top = pop(heap)
        i, r = top & low, top >> b
        j = after[i]
        if j >= n or ids[i] < 0 or join(ids[i] * PAIR + ids[j]) != r:
            continue
        k, h = after[j], before[i]
        ids[i], after[i], ids[j] = r, k, -1
        if k < n:
            before[k] = i
            if (s := join(r * PAIR + ids[k])) is not None:
                push(heap, (s << b) + i)
        if h >= 0 and (s := join(ids[h] * PAIR + r)) is not None:
            push(heap, (s << b) + h)
    return [x for x in ids if x >= 0]


class Memo(dict):
    """Remembers what make gives for short keys, so many at most."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= 32:
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out


class Codec:
    """Text to ids, as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, tokens: list[bytes], perfect: PerfectHash, pattern: str, remembered: tuple[int, int] = (MATCHES, PIECES)):
        self.tokens, self.perfect, self.split = tokens, perfect, regex.compile(pattern)
        self.bytes = [perfect.get(bytes([i])) for i in range(256)]
        self.match = Memo(self._match, remembered[0])
        self.piece = Memo(self._piece, remembered[1]) if pattern == SPACED else self.match
        self.pieces = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+") if pattern == SPACED else self.split

    @cached_property
    def joined(self) -> dict[int, int]:
        return joins(self.tokens)

    def _match(self, match: str) -> bytes:
        raw = match.encode()
        i = self.perfect.get(raw)
        ids = [i] if i >= 0 else merge([self.bytes[x] for x in raw], self.joined)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.match.__getitem__, self.split.findall(piece)))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[str, Codec] = {}


def _codec(key: str, held) -> Codec:
    """A worker keeps its codec, and what that remembers, from task to task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*held.value)
    return _codecs[key]


def _broadcast(df: DataFrame, path: str, pattern: str, remembered: tuple[int, int] = (MATCHES, PIECES)) -> Callable[[], Codec]:
    tokens = load_ranks(path)
    key = xxhash.xxh3_128_hexdigest(b"\n".join([repr((pattern, remembered)).encode(), *map(base64.b64encode, tokens)]))
    held = df.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens), pattern, remembered))
    return partial(_codec, key, held)


def _added(docs: DataFrame, column: str, added: dict[str, DataType], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """docs with columns made from one of theirs, run by run of rows, so that memory follows a few megabytes or one long row."""
    kept = [c for c in docs.columns if c not in added or c == column]
    out = [c for c in kept if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * RUN_BYTES // max(1, whole.column(column).nbytes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                yield pa.record_batch([batch.column(c) for c in out] + make(batch.column(column)), names=out + list(added))

    schema = docs.select(*out).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return docs.select(*kept).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", verify: str | None = None, remembered: tuple[int, int] = (MATCHES, PIECES)) -> DataFrame:
    """docs with token_ids (array<long>) of whole texts, and if verify is a name, whether decoding them gives the text back.

    remembered bounds the matches and pieces that a worker keeps; it changes time and memory only.
    """
    codec = _broadcast(docs, path, pattern, remembered)

    def make(texts: pa.Array) -> list[pa.Array]:
        c = codec()
        own = [x or "" for x in texts.cast(pa.string()).to_pylist()]
        ids = [c.encode(x) for x in own]
        values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
        made = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)), pa.array(values))]
        return made + ([pa.array([c.decode(i) == x.encode() for i, x in zip(ids, own, strict=True)], pa.bool_())] if verify else [])

    return _added(docs, column, {"token_ids": ArrayType(LongType())} | ({verify: BooleanType()} if verify else {}), make)


def decode(docs: DataFrame, path: str, pattern: str, column: str = "token_ids") -> DataFrame:
    """docs with decoded (binary), the bytes of the ids; an id outside the vocabulary is an error."""
    codec = _broadcast(docs, path, pattern)

    def make(lists: pa.Array) -> list[pa.Array]:
        c = codec()
        return [pa.array([c.decode(np.asarray(x or [], dtype="<u4").tobytes()) for x in lists.to_pylist()], pa.binary())]

    return _added(docs, column, {"decoded": BinaryType()}, make)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's whole text, encoded and then decoded from the ids."""
    codec = _broadcast(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for b in batches:
            n, ids_sha, out_sha = [], [], []
            for text in b.column("text"):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                out_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
