"""An index is made of blocks of texts, without a row for each word of a text."""

import random

from pyspark.sql import functions as F

from quillon.sources import postings
from tests.test_one_pass import WORDS, _words


def test_index_by_blocks(spark):
    r = random.Random(6)
    ids = [*range(-3, 40), 7, 65535, 65536, 65537, 200_000]
    r.shuffle(ids)
    rows = [(i, None if i == 5 else " ".join(r.choice(WORDS) for _ in range(r.randrange(9)))) for i in ids] + [(None, "the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    blocks = postings.blocks(docs)
    assert "Generate" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, text in rows:
        for w in _words(text) if i is not None else ():
            want.setdefault((w, i >> 16), set()).add(i)
    want = sorted((w, p, sorted(x)) for (w, p), x in want.items())
    parts = [docs.where(F.col("doc_id").isNull() | (F.pmod("doc_id", F.lit(2)) == k)) for k in range(2)]
    for index in (postings.build(docs), postings.merge([postings.blocks(x) for x in parts]), postings.merge([postings.build(x) for x in parts])):
        assert sorted(map(tuple, index.collect())) == want
