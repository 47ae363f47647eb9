"""Every query against its plain version, on given tables, odd rows and empty tables."""

import base64
import unicodedata

import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from quillon.llm import queries
from tests.llm import brute

CASES = ["sf_small", "edge", "empty"]


def table(path, name):
    return pq.read_table(f"{path}/{name}.parquet").to_pandas(types_mapper={}.get)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(spark, path, query, columns, want):
    assert rows(query(spark, path), columns) == sorted(want, key=repr)


@pytest.fixture(params=CASES)
def path(request):
    return request.getfixturevalue(request.param)


def frame(path, name):
    t = pq.read_table(f"{path}/{name}.parquet")
    return pd.DataFrame({c: pd.Series(t.column(c).to_pylist(), dtype=object) for c in t.column_names})


def test_secrets(spark, path):
    same(spark, path, queries.op1_secret_scan, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], brute.secrets(frame(path, "documents")))


def test_secret_spans_keep_the_base(spark, edge):
    docs = frame(edge, "documents")
    want = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        want.setdefault(brute.number(i), []).append({f"{k}:{s}:{e}" for k, s, e in brute.base_spans(brute.text(t))})
    for r in queries.op1_secret_scan(spark, edge).collect():
        spans = r["spans"].split(",") if r["spans"] else []
        assert any(w <= set(spans) for w in want[r["doc_id"]])
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)


def test_bpe(spark, path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    same(spark, path, queries.op3_bpe, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], brute.bpe(frame(path, "documents"), ranks, public_tokenizers.PATTERN))


def test_contamination(spark, path):
    same(spark, path, queries.op5_decontamination, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], brute.contamination(frame(path, "documents"), frame(path, "benchmark")))


def test_fingerprint(spark, path):
    docs = frame(path, "documents")
    got = queries.op6_fingerprint(spark, path).collect()
    if "edge" not in path:
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(brute.edited(docs), key=repr)
    assert len(got) == len(docs)
    canon = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        canon.setdefault(brute.number(i), set()).add(" ".join(unicodedata.normalize("NFKD", brute.text(t)).upper().lower().split()))
    by = {}
    for r in got:
        if len(canon[r["doc_id"]]) == 1:
            by.setdefault(r["fingerprint"], set()).update(canon[r["doc_id"]])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    assert len({c for x in by.values() for c in x}) == len(by)


def test_url_rules(spark, path):
    pages = frame(path, "pages")
    want = [(brute.number(i), *brute.ruled(u, queries.RULES)) for i, u in zip(pages.page_id, pages.url, strict=True)]
    got = queries.op7_url_filter(spark, path)
    assert rows(got, ["page_id", "host", "path", "rule"]) == sorted((w[:4] for w in want), key=repr)
    told = {(w[0], w[1], w[2]): w[4] for w in want}
    for r in got.collect():
        assert r["verdict"] == (told[r["page_id"], r["host"], r["path"]] or ("block" if r["score"] >= 0.5 else "allow"))


def test_near_duplicates(spark, path):
    same(spark, path, queries.op8_near_dedup, ["doc_id", "n_shingles", "component_id", "kept"], brute.near_duplicates(frame(path, "documents"), 85))


def test_warc(spark, path):
    same(spark, path, queries.op9_warc, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], brute.warc(frame(path, "pages")))


def test_licences_run_on_odd_rows(spark, path):
    assert queries.op2_license_scan(spark, path).count() == len(frame(path, "documents"))


@pytest.mark.parametrize("query", [queries.op4_toxicity, queries.op10_quality])
def test_scores_of_odd_rows(spark, path, query):
    got = query(spark, path).collect()
    assert len(got) == len(frame(path, "documents"))
    at = 0.3 if query is queries.op4_toxicity else 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at) for r in got)
