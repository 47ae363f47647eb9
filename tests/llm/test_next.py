"""The next document where ids are far apart, repeated or missing."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import fingerprint


@pytest.mark.parametrize("ids", ["spread", "ties", "nulls"])
def test_next_in_small_buckets(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)
    rng = random.Random(3)
    make = {"spread": lambda i: [i, i * 10**12, -(10**17) + i][i % 3], "ties": lambda i: i // 40, "nulls": lambda i: None if i % 2 else i}[ids]
    rows = [(make(i), f"text {rng.random()}") for i in range(300)]
    df = fingerprint.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))
    hashed = df.withColumn("h", F.xxhash64("text")).collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = {r["text"]: order[(i + 1) % len(order)]["text"] for i, r in enumerate(order)}
    assert {r["text"]: r["next_text"] for r in fingerprint.with_next(df).collect()} == want
