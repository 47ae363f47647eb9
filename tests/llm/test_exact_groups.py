"""Groups of equal canonical texts, Hangul among them."""

import unicodedata
from collections import defaultdict

import pytest

from quillon.llm import fingerprint, queries
from tests.llm import brute
from tests.llm.test_contracts import frame


def canon(t):
    return " ".join(unicodedata.normalize("NFKD", brute.text(t)).upper().lower().split())


def test_hangul(spark):
    every = "".join(map(chr, range(0xAC00, 0xD7A4)))
    texts = [every, unicodedata.normalize("NFD", every), "한국어", unicodedata.normalize("NFD", "한국어"), "한국"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in fingerprint.exact_groups(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert [r["c"] for r in docs.orderBy("doc_id").select(fingerprint.canonical(docs.text).alias("c")).collect()] == [canon(t) for t in texts]


@pytest.mark.parametrize("where", ["sf_small", "edge", "empty"])
def test_groups(spark, request, where):
    docs = frame(request.getfixturevalue(where), "documents")
    own = defaultdict(list)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        own[canon(t)].append(brute.number(i))
    want = [(i, min((x for x in ids if x is not None), default=None)) for ids in own.values() for i in ids]
    got = queries.op6_exact_groups(spark, request.getfixturevalue(where))
    assert sorted(((r["doc_id"], r["group_id"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
