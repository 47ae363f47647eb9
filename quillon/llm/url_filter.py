"""URL filter: rules by host and path, else logistic regression on hashed character n-grams of both.

The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from there to ``?``, ``#``
or the end. A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, and of
equally long ones that which blocks. The model's weights are one array of WEIGHTS doubles, trained on the driver from a
small labelled table of URLs (at most TRAIN_ROWS), and looked up inside Spark expressions.

Scale: a projection without a shuffle. Edge cases: a null url, or one without ``://``, has an empty host and path and is
judged by the bias; other columns pass through ``judge`` unless they have the names of the new ones.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHTS = 1 << 15
TRAIN_ROWS = 20_000
GRAMS = (3, 4)

#: Words of unwanted and of ordinary hosts. A host is one of them or two joined; ordinary hosts may also be names of syllables.
SPAM = (
    "casino bonus betting jackpot roulette slots poker bets gamble lottery winner prize giveaway freebie coupon payday loan loans credit refinance debt viagra cialis pharma pharmacy meds pill pills diet slimming detox miracle cure enlarge "
    "replica rolex counterfeit fake knockoff outlet cheap discount deal deals porn xxx adult escort sexy webcam cams hookup dating nude erotic crack keygen warez torrent serial nulled pirated hack cheats adserver adclick tracker tracking "
    "popup banner affiliate traffic backlinks seo spam farm scam phish phishing clickbait viral shocking followers likes airdrop doubler forex binary signals profit richquick earncash cashback moneyfast surveys sweepstakes"
).split()
PLAIN = (
    "news weather sports library university research journal science history music cooking garden travel health school museum theatre market council city county archive data wiki forum docs support blog photo family recipes books education "
    "park radio hospital engineering physics chemistry biology mathematics language dictionary maps transport railway airport energy water forest community local parish church choir orchestra gallery poetry novel essay review press gazette "
    "times herald tribune chronicle observer institute academy college faculty laboratory observatory geology climate ocean river mountain valley harbour bridge station police fire court law rights charity foundation union society club"
).split()
ONSETS, NUCLEI = "b d f g k l m n p r s t v br dr gr kr pl st tr".split(), "a e i o u ai ea io ou".split()


def labelled_urls(spark: SparkSession, n: int = 6000, spam: list[str] = SPAM, plain: list[str] = PLAIN) -> DataFrame:
    """url, bad (1 or 0): a small labelled table, made by rule from the words."""
    rng, rows = random.Random(3), []
    name = lambda: "".join(rng.choice(ONSETS) + rng.choice(NUCLEI) for _ in range(rng.randint(2, 5)))
    for i in range(n):
        bad = int(i % 3 == 0)  # most hosts are ordinary, so that unknown ones are allowed
        words = spam if bad else plain
        core = rng.choice(words) + (rng.choice(("", "-")) + rng.choice(words if rng.random() < 0.5 else plain) if rng.random() < 0.6 else "")
        core = name() if not bad and rng.random() < 0.5 else core
        host = rng.choice(("", "www.", "blog.", "m.")) + core + rng.choice((".example", "")) + rng.choice((".com", ".net", ".org", ".info", ".eu"))
        path = rng.choice(("/en/", "/fr/", "/de/", "/es/", "/", "/p/")) + rng.choice((str(rng.randint(1, 9999)), name(), "index")) + rng.choice(("", ".html", "/", "?id=1"))
        rows.append((f"{rng.choice(('http', 'https'))}://{host}{path}", bad))
    return spark.createDataFrame(rows, "url string, bad int")


def _parts(df: DataFrame) -> DataFrame:
    whole = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.expr("substring(coalesce(cast(url AS string), ''), instr(coalesce(cast(url AS string), ''), '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumn("_rest", rest).withColumns({"host": F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), upper, lower), "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)}).drop("_rest")


def _grams(df: DataFrame) -> DataFrame:
    """df with _grams: the buckets of all n-grams of host and path, with marks at the host's ends."""
    s = "concat('^', host, '$', path)"
    parts = ", ".join(f"if(length(_s) < {n}, cast(array() AS array<string>), transform(sequence(1, length(_s) - {n - 1}), i -> substr(_s, i, {n})))" for n in GRAMS)
    return df.withColumn("_s", F.expr(s)).withColumn("_grams", F.expr(f"transform(array_distinct(concat({parts})), g -> cast(pmod(xxhash64(g), {WEIGHTS}) AS int))")).drop("_s")


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights and bias from rows (url, bad); L2-regularised, by gradient steps over the rows' distinct buckets."""
    rows = _grams(_parts(labelled.where("bad IS NOT NULL"))).orderBy(F.xxhash64("url"), "url", "bad").limit(TRAIN_ROWS).select("_grams", "bad").collect()
    w, b = np.zeros(WEIGHTS), 0.0
    y = np.array([r["bad"] for r in rows], dtype=np.float64)
    if len(rows):
        row = np.concatenate([np.full(len(set(r["_grams"])), i) for i, r in enumerate(rows)])
        col = np.concatenate([sorted(set(r["_grams"])) for r in rows]).astype(np.int64)
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col], minlength=len(rows)) + b, -35, 35)))
            g = p - y
            w -= 0.5 * (np.bincount(col, weights=g[row], minlength=WEIGHTS) / len(rows) * 20 + 0.002 * w)
            b -= 0.5 * g.mean()
    return [round(float(x), 5) for x in w], float(b)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: tuple[list[float], float], threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, score, verdict; rules are (allow or block, host, path)."""
    weights, bias = model
    df = _grams(_parts(pages)).withColumn("_w", F.from_json(F.lit(json.dumps(weights)), "array<double>"))
    df = df.withColumn("score", F.expr(f"1D / (1D + exp(-aggregate(array_distinct(_grams), {bias!r}D, (a, g) -> a + _w[g])))"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return df.withColumns({"rule": rule, "verdict": verdict}).drop("_grams", "_w")
