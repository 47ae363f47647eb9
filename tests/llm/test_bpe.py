"""Encoding against the library's, and decoding back."""

import base64

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENS = bpe.load_ranks(PATH)
CODEC = bpe.Codec(TOKENS, bpe.PerfectHash(TOKENS), public_tokenizers.PATTERN)
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


def test_the_hash_is_minimal_and_perfect():
    h = CODEC.perfect
    assert sorted(h.slots) == list(range(len(TOKENS)))
    assert all(h.get(t) == i for i, t in enumerate(TOKENS))
    assert h.get(b"not in the vocabulary") == -1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x1c\x1f\x85  'sabre1")), max_size=60))
def test_ids_are_the_librarys(text):
    ids = CODEC.encode(text)
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == REAL.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_pieces():
    for text in ("ab" * 5000, " " * 3000 + "x", "é" * 2000, "a" * 10000):
        ids = CODEC.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == REAL.encode_ordinary(text)


def test_columns(spark):
    df = spark.createDataFrame([(1, "some text", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, token_ids string")
    out = bpe.encode(df, PATH, public_tokenizers.PATTERN, verify="same")
    assert out.columns == ["doc_id", "text", "token_ids", "same"]
    back = {r["doc_id"]: r for r in bpe.decode(out, PATH, public_tokenizers.PATTERN).collect()}
    assert [bytes(back[i]["decoded"]) for i in (1, 2, 3)] == [b"some text", b"", b""]
    assert all(r["same"] for r in back.values())
