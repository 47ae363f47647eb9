"""The pipeline's stages against plain versions, each on its own input."""

import base64
from collections import Counter

import pandas as pd
import pytest

import corpus_pipeline as pipeline
from quillon.llm import near_dedup, toxicity
from tests.llm import brute
from tests.llm.test_contracts import frame


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def given(frame):
    return Counter((brute.number(i), brute.none(t)) for i, t in zip(frame.doc_id, frame.text, strict=True))


@pytest.mark.parametrize("where", ["sf_small", "edge", "empty"])
def test_stages(spark, request, where, tmp_path):
    path = request.getfixturevalue(where)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs.select("doc_id", "text").toPandas()
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "toxicity":
            assert rows(out) <= given(before)
        elif name == "near_dedup":
            left = brute.one_of_each(before, 80)
            assert {i for i, _ in left} == set(ids(out)) and len(left) == out.count()
            assert rows(out) <= given(before)
        elif name == "decontamination":
            bad = [r[5] for r in brute.contamination(before, frame(path, "benchmark"))]
            assert sorted(rows(out).elements(), key=repr) == sorted(given(before[[not b for b in bad] if bad else slice(0)]).elements(), key=repr)
        elif name == "secret_scan":
            assert out.count() == len(before)
            assert not any(brute.base_spans(brute.text(r["text"]).replace("[SECRET]", " ")) for r in out.collect())
        elif name == "bpe":
            assert out.count() == len(before) and out.where("NOT round_trip").count() == 0
        if name != "bpe":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out


@pytest.mark.parametrize("where", ["sf_small", "edge", "empty"])
def test_run_is_its_stages(spark, request, where):
    """run() against the plain versions: toxic rows by the model's own scores, then one of each group, then clean ones, redacted, as ids."""
    import public_tokenizers

    path = request.getfixturevalue(where)
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels, "toxic"), 0.3).where("predicted = 0").toPandas()
    left = brute.one_of_each(scored, 80)
    bad = [r[5] for r in brute.contamination(pd.DataFrame(left, columns=["doc_id", "text"], dtype=object), frame(path, "benchmark"))]
    clean = sorted((i for (i, _), b in zip(left, bad, strict=True) if not b), key=repr)
    out = pipeline.run(spark, path)
    got = out.collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == clean
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    back = {v: k for k, v in ranks.items()}
    for r in got:
        text = b"".join(back[i] for i in r["token_ids"]).decode()
        assert r["round_trip"] and r["n_tokens"] == len(r["token_ids"])
        assert not brute.base_spans(text.replace("[SECRET]", " "))


def test_rows_of_one_id_are_judged_apart(spark, edge):
    text = "aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq rr ss tt"
    item = frame(edge, "benchmark").text[0]
    docs = spark.createDataFrame([(None, item), (None, text), (1, text + " more"), (1, item + " tail"), (2, text)], "doc_id long, text string")
    assert rows(pipeline.drop_contaminated(spark, docs, edge)) == Counter([(None, text), (1, text + " more"), (2, text)])
    assert rows(pipeline.drop_near_duplicates(spark, docs, edge)) == Counter([(1, text + " more"), (1, item + " tail")])


def test_named_methods():
    assert near_dedup.rows_per_band(0.85) > near_dedup.rows_per_band(0.8) > 1
    assert toxicity.TRAIN_ROWS == 10_000
