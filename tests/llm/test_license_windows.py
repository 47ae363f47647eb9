"""Licences of several paragraphs, and notices inside a line."""

import pytest

from quillon.llm import license_scan

TEXT = {}
for _name, _text in license_scan.TEMPLATES:
    TEXT[_name] = max(TEXT.get(_name, ""), _text, key=len)
CODE = "\n".join(f"def function_{i}(value): return value * {i} + other_{i}" for i in range(40))


def blocks(text, n=3):
    w = text.split()
    return "\n\n".join(" ".join(w[len(w) * k // n : len(w) * (k + 1) // n]) for k in range(n))


@pytest.fixture(scope="module")
def found(spark):
    texts = {
        "mit": f"Some project\n\nCopyright 2020 Somebody\n\n{blocks(TEXT['MIT'])}\n\n{CODE}", "gpl": f"{blocks(TEXT['GPL-3.0'])}\n\n{CODE}", "line": "This library is released under the MIT License and comes with " + "plain words that say nothing about anything at all " * 5,
        "two": f"{CODE}\n{blocks(TEXT['MIT'])}\n{CODE}\n\n{blocks(TEXT['Apache-2.0'])}\n{CODE}", "own line": "one two three\nReleased under the MIT License.\nfour five six", "none": CODE, "short": "the", "empty": "", "null": None,
        "again": " ".join(f"w{i} released under the mit license" for i in range(50)),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    return {r["doc_id"]: (r["license"], round(r["dice"], 6), r["n_matches"]) for r in license_scan.scan(docs).collect()}


def test_paragraphs(found):
    assert found["mit"] == ("MIT", 1.0, 1)
    assert found["gpl"] == ("GPL-3.0", 1.0, 1)
    assert found["two"][1:] == (1.0, 2)


def test_in_line(found):
    assert found["line"] == ("MIT", 1.0, 1)
    assert found["again"] == ("MIT", 1.0, 1)


def test_others_stay(found):
    assert found["own line"] == ("MIT", 1.0, 1)
    assert all(found[x] == (None, 0.0, 0) for x in ("none", "short", "empty", "null"))
