"""Word-count classifier, phrase blacklist and patterns over messages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import full_simplify, simplify
from quillon.operators.predicate import words_of

BLOCK = 100_000  # patterns in one automaton; more take further passes
EXTREME_WORDS, SPAM_AT, PRIOR = 10, 0.9, 3.5


def _blocks(small: DataFrame, size: int) -> Iterator[list]:
    held = []
    for r in small.toLocalIterator():
        held.append(r)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def multi_pattern(docs: DataFrame, patterns: DataFrame, text: str = "text", most: int = BLOCK) -> DataFrame:
    """docs without the text, and id, for each pattern (id, pattern) that stands in the text.

    The patterns of a block make one automaton (Aho-Corasick), which is broadcast; a text is read once whatever their number.
    """
    rest = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    out = docs.select(*rest).withColumn("id", F.lit(None).cast(patterns.schema["id"].dataType)).where("false")
    for block in _blocks(patterns.where("pattern IS NOT NULL AND pattern <> ''").select("id", "pattern"), most):
        held = docs.sparkSession.sparkContext.broadcast([(r["id"], r["pattern"]) for r in block])

        def run(batches, held=held):
            import ahocorasick
            import pyarrow as pa

            found, ids = ahocorasick.Automaton(), {}
            for i, p in held.value:
                ids.setdefault(p, []).append(i)
            for p in ids:
                found.add_word(p, p)
            found.make_automaton()
            for b in batches:
                row, hit = [], []
                for k, t in enumerate(b.column(text)):
                    for p in {p for _, p in found.iter(t.as_py())} if t.is_valid else ():
                        for i in ids[p]:
                            row.append(k)
                            hit.append(i)
                at = pa.array(row, pa.int64())
                yield pa.record_batch([b.column(c).take(at) for c in rest] + [pa.array(hit)] if row else [b.column(c).slice(0, 0) for c in rest] + [pa.array([], pa.int64())], names=[*rest, "id"])

        part = docs.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(run, (schema + ", " if schema else "") + "id bigint")
        out = out.unionByName(part.withColumn("id", F.col("id").cast(patterns.schema["id"].dataType)))
    return out


def blacklisted(docs: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """docs that contain any of the phrases (phrase), in any case."""
    one = phrases.select(F.lower("phrase").alias("pattern")).distinct().withColumn("id", F.lit(1).cast("bigint"))
    own = docs.withColumn("_key", F.monotonically_increasing_id())
    hit = multi_pattern(own.select("_key", F.lower(text).alias(text)), one, text).select("_key").distinct()
    return own.join(hit, "_key", "left_semi").drop("_key")


def match_patterns(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """id of each pattern and the doc's columns but text, for each pattern that fits: ip and uahash equal or 0, and the pattern within the text (flags 16: simplified, 32: fully)."""
    kinds = [("(flags & 48) = 0", F.col(text)), ("(flags & 16) <> 0", simplify(F.col(text))), ("(flags & 16) = 0 AND (flags & 32) <> 0", full_simplify(F.col(text)))]
    told, out = patterns.select("id", F.col("ip").alias("_ip"), F.col("uahash").alias("_ua")), None
    for where, form in kinds:
        part = multi_pattern(docs.withColumn(text, form), patterns.where(where), text)
        out = part if out is None else out.unionByName(part)
    rest = [c for c in docs.columns if c != text]
    return out.join(told, "id").where("(_ip = 0 OR _ip = ip) AND (_ua = 0 OR _ua = uahash)").select("id", *rest)


def word_counts(docs: DataFrame, label: str, text: str = "text") -> DataFrame:
    """word, bad, good: the number of texts of each class with the word."""
    words = docs.select(F.col(label).cast("int").alias("y"), F.explode(words_of(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good"))


def spam_probability(docs: DataFrame, counts: DataFrame, n_bad: int, n_good: int, key: str, text: str = "text") -> DataFrame:
    """key and p for each text with a known word: the EXTREME_WORDS words farthest from 1/2 (ties: lower first), their clipped shares combined."""
    weight = PRIOR * n_bad / max(n_bad + n_good, 1)
    share = F.col("bad") / (F.col("bad") + F.col("good") * F.lit(weight))
    p = counts.withColumn("p", F.least(F.greatest(share, F.lit(0.01)), F.lit(0.99))).select("word", "p")
    words = docs.select(key, F.explode(words_of(F.col(text))).alias("word")).join(p, "word")
    top = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs(F.col("p") - 0.5), 12)), "p", "word")
    best = words.withColumn("r", F.row_number().over(top)).where(F.col("r") <= EXTREME_WORDS)
    a, b = F.exp(F.sum(F.log("p"))), F.exp(F.sum(F.log(1 - F.col("p"))))
    return best.groupBy(key).agg((a / (a + b)).alias("p"))
