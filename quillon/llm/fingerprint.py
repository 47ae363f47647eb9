"""Document fingerprints: a wide hash of the canonical text, in DataFrame expressions only.

Canonical form: compatibility decomposition with combining marks in canonical order, case folding (lower of upper),
white space folded to single spaces and trimmed. The fingerprint is two xxhash64 values of it, in hexadecimal. Equal
fingerprints are confirmed by comparing canonical bytes: within a row where both texts are there, else against the
bucket's least document (``exact_groups``).

Scale: a projection; ``with_next`` shuffles the texts once by buckets between quantiles of doc_id, in which windows run, and only one row a bucket is handed to its neighbour. ``exact_groups`` shuffles digests, and texts only of rows
in equal buckets; its hot buckets are summed before the shuffle and joined, never collected.

Edge cases: a null text counts as empty; repeated doc_ids are ordered by their texts' hash, then by the text; null
doc_ids stand after all others; a table of one row is its own next. Hangul syllables
are decomposed by arithmetic, not by the table.
"""

from __future__ import annotations

import json
import math
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

#: Leading consonants, vowels and trailing consonants (the first is none) of Hangul syllables, in the order of their code points.
LEADS, VOWELS, TRAILS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
BUCKET_ROWS, MOST_BUCKETS = 2000, 65536


@cache
def _tables() -> tuple[str, str]:
    """Decompositions and combining classes by code point, as JSON pages of 256."""
    out = []
    for what in (
        lambda c: (d if (d := unicodedata.normalize("NFKD", c)) != c else None) if not "가" <= c <= "힣" else None,
        lambda c: unicodedata.combining(c) or None,
    ):
        pages = [[what(chr(p * 256 + i)) for i in range(256)] if not 0xD8 <= p <= 0xDF else [] for p in range((sys.maxunicode >> 8) + 1)]
        pages = [p if any(x is not None for x in p) else None for p in pages]
        while pages[-1] is None:
            pages.pop()
        out.append(json.dumps(pages, ensure_ascii=True))
    return out[0], out[1]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical(text: Column) -> Column:
    """The canonical form of a string column; plain ASCII takes a short way."""
    decompositions, classes = (F.from_json(F.lit(t), k) for t, k in zip(_tables(), ("array<array<string>>", "array<array<int>>"), strict=True))
    entry = lambda table, c: F.get(F.get(table, F.shiftright(F.ascii(c), 8)), F.ascii(c).bitwiseAND(255))
    jamo = lambda letters, i: F.substring(F.lit(letters), i + 1, 1)
    zero = lambda c: F.coalesce(entry(classes, c), F.lit(0))
    folded = lambda t: F.trim(F.regexp_replace(t, r"[\s\p{Z}]+", " "))

    def syllable(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        trail = F.when(n % 28 > 0, jamo(TRAILS, n % 28 - 1)).otherwise("")
        return F.concat(jamo(LEADS, F.floor(n / 588).cast("int")), jamo(VOWELS, F.floor(n % 588 / 28).cast("int")), trail)

    def decomposed(t: Column) -> Column:
        found = F.array_distinct(F.split(F.regexp_replace(t, r"[\x00-\x7F]+", ""), ""))
        pairs = F.filter(F.transform(found, lambda c: F.struct(c.alias("c"), F.when(F.ascii(c).between(0xAC00, 0xD7A3), syllable(c)).otherwise(entry(decompositions, c)).alias("d"))), lambda x: x.d.isNotNull())
        return F.aggregate(pairs, t, lambda a, x: F.replace(a, x.c, x.d))

    def ordered(run: Column) -> Column:
        """A run of marks, those between two starters sorted by class."""
        key = lambda chars: F.transform(chars, lambda c, i: F.struct(F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: zero(x) == 0)).alias("g"), zero(c).alias("k"), i.alias("i"), c.alias("c")))
        return _let(F.split(run, ""), lambda chars: F.array_join(F.transform(F.array_sort(key(chars)), lambda x: x.c), ""))

    def marked(t: Column) -> Column:
        runs = F.transform(F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\p{M}{2,}"), F.lit(0))), lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), lambda x: x.r)
        return F.when(F.rlike(t, F.lit(r"\p{M}{2}")), F.aggregate(runs, t, lambda a, r: F.replace(a, r, ordered(r)))).otherwise(t)

    wide_text = lambda t: F.lower(F.upper(_let(decomposed(t), marked)))
    return _let(F.coalesce(text.cast("string"), F.lit("")), lambda t: folded(F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(wide_text(t))))


def wide(canon: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(*x))), 16, "0") for x in ((canon,), (F.lit("quillon"), canon))))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the column of the fingerprint of a text column."""
    return docs.withColumn(f"_{name}", canonical(F.col(text))).withColumn(name, wide(F.col(f"_{name}"))).drop(f"_{name}")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint, group_id of each row: the least doc_id of the documents with the same canonical bytes (null ids count only where all are null).

    Rows are grouped by fingerprint; in groups of several the canonical bytes of each are compared with those of its least
    document, and rows that differ from these (collisions of 128 bits) are grouped by the bytes themselves. The least
    documents and the digests are tables, so a hot group is one side of a join that Spark can split.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marked = stored(df.select("doc_id", "text_hash", wide(canonical(F.col("text"))).alias("fingerprint")), "digests")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    bucket = stored(marked.groupBy("fingerprint").agg(F.min(order).alias("first"), F.count("*").alias("n")), "fingerprints")
    name = F.when(~F.col("first.none"), F.col("first.id")).alias("group_id")
    told = marked.join(bucket, "fingerprint")
    single = told.where("n = 1").select("doc_id", "text_hash", "fingerprint", name)
    many = stored(told.where("n > 1").select("doc_id", "text_hash", "fingerprint", "first").distinct(), "many")
    key = lambda d: d.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0))})
    texts = key(df).join(key(many).drop("doc_id"), ["_none", "_id", "text_hash"]).select("doc_id", "text_hash", "fingerprint", "first", canonical(F.col("text")).alias("canon"))
    lead = stored(texts.where(order == F.col("first")).groupBy("fingerprint").agg(F.first("canon").alias("lead")), "leads")
    same = texts.join(lead, "fingerprint")
    agree = same.where("canon = lead").select("doc_id", "text_hash", "fingerprint", name)
    other = same.where("canon <> lead")
    apart = other.join(other.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id")), ["fingerprint", "canon"]).select("doc_id", "text_hash", "fingerprint", "group_id")
    return single.unionByName(agree).unionByName(apart)


def _places(n: int) -> int:
    return max(1, min(MOST_BUCKETS, math.ceil(n / BUCKET_ROWS)))


def _bucket(key: Column, order: Column, bounds: list[int]) -> Column:
    """The place of a row among sorted bounds by binary search; rows on a bound that comes several times are dealt over its places by ``order`` (in [0, 1), falling)."""
    if not bounds:
        return F.lit(0)
    table, steps = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), len(bounds).bit_length()

    def below(less) -> Column:
        """How many bounds meet less(bound)."""
        halves = F.array(*(F.lit(1 << i) for i in reversed(range(steps))))
        return F.aggregate(halves, F.lit(0), lambda at, h: F.when((at + h <= len(bounds)) & less(F.get(table, at + h - 1)), at + h).otherwise(at))

    low, high = below(lambda x: x < key), below(lambda x: x <= key)
    return _let(F.struct(low.alias("a"), high.alias("b")), lambda x: (x.a + F.floor((1 - order) * (x.b - x.a + F.when(x.b > x.a, 1).otherwise(0)))).cast("int"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, fingerprint) with next_text and next_fingerprint, of the next document by descending doc_id; after the last comes the first.

    Windows run in buckets of about BUCKET_ROWS rows between quantiles of doc_id, whatever the ids' spread; rows of one id
    (or without one) go by the text's hash, and over several buckets where they are many. Only rows equal in both
    share a bucket for certain.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = docs.count()
    buckets = _places(n)
    bounds = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 and n else []
    share = (F.xxhash64("text") / 2.0**64) + 0.5  # of the order by hash, in [0, 1)
    df = docs.withColumns({"_k": key, "_h": F.xxhash64("text"), "_b": _bucket(key, F.least(F.greatest(share, F.lit(0.0)), F.lit(1 - 2.0**-53)), [int(x) for x in bounds]), "_last": F.lit(0)})
    first = F.struct(F.col("_k").alias("k"), (-F.col("_h").cast("decimal(20,0)")).alias("h"))
    tops = df.groupBy("_b").agg(F.max(first).alias("_top"))
    # One row for each bucket, MOST_BUCKETS + 1 at most.
    order = Window.orderBy(F.desc("_b"))
    handed = tops.select("_b", F.coalesce(F.lead("_top").over(order), F.max("_top").over(Window.partitionBy())).alias("_t")).select("_b", F.col("_t.k").alias("_k"), (-F.col("_t.h")).cast("bigint").alias("_h"))
    ends = df.drop("_b", "_last").join(F.broadcast(handed), ["_k", "_h"]).withColumn("_last", F.lit(1)).dropDuplicates(["_b"])
    w = Window.partitionBy("_b").orderBy("_last", F.desc("_k"), "_h", "text")
    both = df.unionByName(ends.select(*df.columns)).withColumns({"next_text": F.lead("text").over(w), "next_fingerprint": F.lead("fingerprint").over(w)})
    return both.where("_last = 0").drop("_k", "_h", "_b", "_last")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row; groups are ``exact_groups``'."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_next(with_fingerprint(df)).withColumn("n_chars", F.length("text"))
    edited = F.expr("concat(left(text, n_chars - n_chars div 2), left(next_text, cast(n_chars div 2 AS int)))")
    df = df.withColumn("edited", edited).withColumn("edited_fingerprint", wide(canonical(F.col("edited"))))
    alike = lambda f, t: F.when(F.col("fingerprint") == F.col(f), (canonical(F.col("text")) == canonical(F.col(t))).cast("double")).otherwise(0.0)
    return df.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", alike("edited_fingerprint", "edited").alias("near_edited"), alike("next_fingerprint", "next_text").alias("near_next"))
