"""Held-out accuracy and recall: these fail if scores are constant, or if a scan finds nothing but the templates themselves."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import license_scan, queries, secret_scan, url_filter
from tests.conftest import DATA


def shares(scored, labels, label):
    rows = scored.where("held_out").join(labels.groupBy("doc_id").agg(F.max(label).alias("y")), "doc_id").where("y IS NOT NULL").groupBy("y").agg(F.avg("predicted").alias("p"), F.avg("score").alias("s")).collect()
    return {r["y"]: (r["p"], r["s"]) for r in rows}


@pytest.mark.parametrize(("query", "label", "caught", "wrong"), [(queries.op4_toxicity, "toxic", 0.85, 0.02), (queries.op10_quality, "quality", 0.95, 0.05)])
def test_held_out_labels(spark, query, label, caught, wrong):
    path = f"{DATA}/sf0.1"
    got = shares(query(spark, path), spark.read.parquet(f"{path}/labels.parquet"), label)
    assert got[1][0] >= caught and got[0][0] <= wrong and got[1][1] > got[0][1] + 0.5


def test_urls_of_words_never_seen(spark):
    """A fifth of the words stays out of training; hosts of these words alone are judged."""
    pick = lambda words, part: [w for i, w in enumerate(words) if (i % 5 == 0) == part]
    spam, plain = url_filter.SPAM, url_filter.PLAIN
    model = url_filter.train(url_filter.labelled_urls(spark, 6000, pick(spam, False), pick(plain, False)))
    weights, _ = model
    assert 1000 < sum(abs(w) > 1e-4 for w in weights) < 0.6 * url_filter.WEIGHTS  # buckets in use: most grams have one of their own
    rng = random.Random(1)
    rows = [(f"http://{w}{rng.choice(pick(words, True))}.com/a", b) for words, b in ((spam, 1), (plain, 0)) for w in pick(words, True)]
    seen = url_filter.judge(spark.createDataFrame(rows, "url string, bad int"), [], model).groupBy("bad").agg(F.avg((F.col("verdict") == "block").cast("double")).alias("p")).collect()
    told = {r["bad"]: r["p"] for r in seen}
    assert told[1] - told[0] >= 0.15 and told[0] <= 0.35, told
    known = [(f"https://www.{a}-{b}.net/", bad) for words, bad in ((spam, 1), (plain, 0)) for a, b in zip(pick(words, False), pick(words, False)[7:], strict=False)]
    told = {r["bad"]: r["p"] for r in url_filter.judge(spark.createDataFrame(known, "url string, bad int"), [], model).groupBy("bad").agg(F.avg((F.col("verdict") == "block").cast("double")).alias("p")).collect()}
    assert told[1] >= 0.95 and told[0] <= 0.05


def test_secrets_of_fresh_keys(spark):
    rng = random.Random(11)
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)) for _ in range(200)]
    names = [rng.choice("get set load make find read".split()) + "".join(w.capitalize() for w in rng.sample("user order index value stream table column record batch window offset length".split(), 4)) for _ in range(200)]
    rows = [(i, f"x {w} y") for i, w in enumerate(keys + names)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum("markov" in got[i] for i in range(200)) >= 195 and sum("markov" in got[i] for i in range(200, 400)) <= 6


def test_licences_with_small_changes(spark):
    """Texts with a few words changed are still found, prose isn't."""
    rng, rows, want = random.Random(5), [], {}
    for i, (n, text) in enumerate(license_scan.TEMPLATES):
        words = text.split()
        if len(words) < 40:
            continue
        for k in rng.sample(range(len(words)), len(words) // 25):
            words[k] = "changed"
        rows.append((i, "Some prose before it.\n\n" + " ".join(words)))
        want[i] = n
    rows.append((999, "The committee grants the members permission to use the hall free of charge, and to copy the keys, subject to the following conditions of the house. " * 20))
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == n for i, n in want.items()) >= 0.8 * len(want) and got[999] is None
