"""Secrets in text: three base patterns and character Markov models, in Spark SQL expressions only.

Base spans are leftmost and non-overlapping for each kind: ``assign`` (a named credential with a value of 6 or more
characters), ``access`` (AKIA keys of 20 or more) and ``hex`` (runs of 24 or more). A match that fails its length is
used up all the same. The method adds ``markov`` spans: runs of LEAST or more token characters whose log-likelihood
ratio under two character bigram models (random strings against ordinary identifiers) exceeds MARGIN; where base spans
overlap a run, its parts outside them are kept. The models are counted from labelled samples, and their table is bounded by
the alphabet's square.

Scale: a projection without a shuffle. Offsets come from the lengths of matches and of the gaps between them.

Edge cases: a null text counts as empty; a text without spans has the digest and the list of the empty string. Offsets
are code points, ends exclusive. Other columns pass through ``scan`` unless they have the names of the new ones.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
LEAST, MARGIN = 20, 10.0
RUN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_SPANS = "array<struct<s:int,o:int,e:int>>"

_WORDS = (
    "get set add remove user name file path list index count value config client server request response handler manager factory builder parser reader writer stream buffer cache table column row "
    "query result error message event queue thread process network socket address port host token session account order item price total amount date time zone format string number integer double "
    "boolean array object class method function module package import export default public private static final abstract interface implementation test case suite mock stub assert equal true false "
    "null empty first last next previous current active enabled disabled visible hidden start stop begin end open close read write load save update delete create insert select where group join left "
    "right inner outer internationalization configuration authentication authorization notification application description information organization administrator environment transaction collection"
).split()


def labelled_samples(spark: SparkSession, n: int = 1500) -> DataFrame:
    """sample, random (1 or 0): strings drawn from usual key alphabets, and identifiers, slugs, paths and constants put together from words, and rules of one character."""
    rng, rows = random.Random(5), []
    alphabets = (ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + "0123456789", "0123456789abcdef")
    for i in range(n):
        a = alphabets[i % len(alphabets)]
        rows.append(("".join(rng.choice(a) for _ in range(rng.randint(20, 44))), 1))
        parts = [rng.choice(_WORDS) for _ in range(rng.randint(2, 6))]
        digits = str(rng.randint(0, 2025)) if rng.random() < 0.6 else ""
        style = i % 5
        text = "".join(p.title() for p in parts) if style == 0 else "_".join(parts) if style == 1 else "-".join(parts) if style == 2 else "/".join(parts) if style == 3 else "".join(parts)
        rows.append((text + ("_" if style == 1 and digits else "") + digits, 0))
    for i in range(n // 3):
        rows.append((("_" if i % 2 else "-").join(rng.choice(_WORDS).upper() for _ in range(rng.randint(2, 6))), 0))
        rows.append((rng.choice("-=_/+") * rng.randint(20, 60) if i % 2 else rng.choice(ALPHABET) * rng.randint(20, 40), 0))
    return spark.createDataFrame(rows, "sample string, random int")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of ALPHABET (first * size + second), from add-half counts of samples (sample, random)."""
    n = len(ALPHABET)
    pair = samples.where("sample IS NOT NULL AND random IS NOT NULL AND length(sample) > 1").select("random", F.expr("explode(transform(sequence(1, length(sample) - 1), i -> substr(sample, i, 2)))").alias("pair"))
    counts = np.full((2, n, n), 0.5)
    for label, p, c in pair.groupBy("random", "pair").count().where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect():
        counts[int(label > 0), ALPHABET.index(p[0]), ALPHABET.index(p[1])] += c
    p = counts / counts.sum(axis=2, keepdims=True)
    return [round(float(x), 4) for x in np.log(p[1] / p[0]).ravel()]


def _at(text: str, pattern: str, hits: str, keep: str, kind: int) -> Column:
    """Spans of the hits that pass keep (over i, the hit's number); text is split by the pattern only where there are hits."""
    sql = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        f"if(size({hits}) = 0, cast(array() AS {_SPANS}), aggregate(sequence(1, size({hits})), "
        f"named_struct('g', transform(split({text}, '{sql}', -1), x -> length(x)), 'p', 0, 'out', cast(array() AS {_SPANS})), "
        f"(a, i) -> named_struct('g', a.g, 'p', a.p + a.g[i - 1] + length({hits}[i - 1]), 'out', "
        f"if({keep}, array_append(a.out, named_struct('s', a.p + a.g[i - 1], 'o', {kind}, 'e', a.p + a.g[i - 1] + length({hits}[i - 1]))), a.out)), a -> a.out))"
    )


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with base_spans and spans: sorted arrays of (s, o, e), o the number of the kind in KINDS."""
    n = len(ALPHABET)
    all_of = lambda p, group=0: F.regexp_extract_all("_text", F.lit(p), F.lit(group))
    none = F.expr("cast(array() AS array<string>)")
    df = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumns({"_assign": all_of(ASSIGN), "_access": F.when(F.contains("_text", F.lit("AKIA")), all_of(ACCESS)).otherwise(none), "_hex": all_of(HEX), "_run": all_of(RUN)})
    df = df.withColumn("_values", F.when(F.size("_assign") > 0, all_of(ASSIGN, 2)).otherwise(none))
    at = lambda c, i: f"instr('{ALPHABET}', substr({c}, {i}, 1))"
    ratio = f"aggregate(sequence(1, length(t) - 1), 0D, (s, k) -> s + _ratio[({at('t', 'k')} - 1) * {n} + {at('t', 'k + 1')} - 1])"
    df = df.withColumn("_ratio", F.lit(ratios)).withColumn("_odds", F.expr(f"transform(_run, t -> {ratio})"))
    df = df.withColumns(
        {
            "_a": _at("_text", ASSIGN, "_assign", "length(_values[i - 1]) >= 6", 0), "_k": _at("_text", ACCESS, "_access", "length(_access[i - 1]) >= 20", 1), "_h": _at("_text", HEX, "_hex", "true", 2),
            "_m": F.expr(f"if(exists(_odds, x -> x > {MARGIN}D), true, false)"),
        }
    )
    df = df.withColumn("base_spans", F.array_sort(F.concat("_a", "_k", "_h")))
    df = df.withColumn("_m", F.when(F.col("_m"), _at("_text", RUN, "_run", f"_odds[i - 1] > {MARGIN}D", 3)).otherwise(F.expr(f"cast(array() AS {_SPANS})")))
    part = lambda s, e: f"array_append(a.out, named_struct('s', {s}, 'o', 3, 'e', {e}))"
    rest = (
        f"aggregate(filter(base_spans, b -> b.s < m.e AND m.s < b.e), named_struct('p', m.s, 'out', cast(array() AS {_SPANS})), (a, b) -> named_struct('p', greatest(a.p, b.e), 'out', "
        f"if(b.s > a.p, {part('a.p', 'b.s')}, a.out)), a -> if(a.p < m.e, {part('a.p', 'm.e')}, a.out))"
    )
    df = df.withColumn("spans", F.when(F.size("_m") == 0, F.col("base_spans")).otherwise(F.expr(f"array_sort(concat(base_spans, flatten(transform(_m, m -> {rest}))))")))
    return df.drop("_text", "_assign", "_access", "_hex", "_run", "_values", "_ratio", "_odds", "_a", "_k", "_h", "_m")


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.o], ':', x.s, ':', x.e)), ',')")


def report(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row."""
    found = scan(docs.select("doc_id", "text"), ratios)
    count = lambda o: F.expr(f"cast(size(filter(base_spans, x -> x.o = {o})) AS long)")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans in text replaced by mark; null texts stay null."""
    cut = (
        "aggregate(spans, named_struct('p', 0, 'out', cast(array() AS array<string>)), (a, x) -> named_struct('p', greatest(a.p, x.e), 'out', "
        "if(x.s >= a.p, array_append(a.out, substr(text, a.p + 1, x.s - a.p)), a.out)), a -> array_append(a.out, substr(text, a.p + 1)))"
    )
    found = scan(docs, ratios)
    return found.withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.array_join(F.expr(cut), mark))).drop("base_spans", "spans")
