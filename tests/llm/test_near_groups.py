"""Groups that the blocks and rounds of near_dedup must not lose: chains, crowds of half-alike texts, many copies."""

import random

import numpy as np
import pandas as pd

from quillon.llm import _graph, decontam, near_dedup
from tests.llm import brute


def same(spark, rows, percent=80):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    want = brute.near_duplicates(pd.DataFrame(rows, columns=["doc_id", "text"], dtype=object), percent)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr) == sorted(want, key=repr)
    return got


def test_chains_and_crowds(spark, monkeypatch):
    rng = random.Random(5)
    for name, value in (("BLOCK_DOCS", 3), ("BLOCK_SKETCHES", 4), ("BLOCK_SHINGLES", 400)):
        monkeypatch.setattr(near_dedup, name, value)
    words = [f"w{i}" for i in range(4000)]
    rows, at = [], 0
    for g in range(6):  # chains: each text is some words on from the one before
        own = rng.sample(words, 200)
        for i in range(12):
            rows.append((at := at + 1, " ".join(own[4 * i : 4 * i + 110])))
    shared = rng.sample(words, 60)
    for g in range(30):  # a passage that many share, half of each text; some have a near copy
        own = rng.sample(words, 60)
        rows.append((at := at + 1, " ".join(shared + own)))
        if g % 3 == 0:
            rows.append((None if g % 2 else (at := at + 1), " ".join(shared + own[:-2])))
    copies = rng.sample(words, 150)
    for _ in range(40):  # copies with one word changed each
        text = list(copies)
        text[rng.randrange(150)] = rng.choice(words)
        rows.append((at := at + 1, " ".join(text)))
    rng.shuffle(rows)
    same(spark, rows)


def test_links_run_through_rows_without_an_id(spark):
    text = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(text[:50])), (None, " ".join(text[3:53])), (7, " ".join(text[6:56])), (3, "quite another text of the same id with its own words")]
    got = same(spark, rows)
    assert sum(r["stays"] for r in got) == 2


def test_components_of_random_edges(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2100)]
    forest = near_dedup.Forest(3000)
    for a, b in edges:
        forest.join(a, b)
    got = {r["node"]: r["comp"] for r in _graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: forest.find(n) for n in {x for e in edges for x in e if e[0] != e[1]}}


def test_recall_of_sketches_at_the_threshold(spark):
    """Pairs just above the threshold are found, estimates are near the truth."""
    rng, found, off = np.random.default_rng(2), 0, []
    for _ in range(200):
        common, a, b = rng.integers(0, 2**63, 820, dtype=np.uint64), *(rng.integers(0, 2**63, 90, dtype=np.uint64) for _ in range(2))
        x, y = (near_dedup.sketch(np.sort(np.concatenate([common, s]) * np.uint64(2))) for s in (a, b))
        off.append(float(near_dedup.estimate((x == y).mean())) - 0.82)
        r = near_dedup.rows_per_band(0.8)
        found += bool((near_dedup.band_keys(x[None], r) == near_dedup.band_keys(y[None], r)).any())
    assert found == 200 and abs(np.mean(off)) < 0.02 and max(map(abs, off)) < near_dedup.SLACK


def test_items_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 120)
    words = [f"q{i}" for i in range(90)]
    docs = spark.createDataFrame([(i, " ".join(["x"] + words[i : i + 10] + ["y"])) for i in range(81)] + [(99, " ".join(words[:9]))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.contamination(docs, spark.createDataFrame([("a", " ".join(words)), ("b", "z")], "item_id string, text string")).collect()}
    assert got == {**{i: (10, 1) for i in range(81)}, 99: (0, 0)}


def near_places(doc, item, slop):
    """First words by the rarest term, as proximity_hits counts them."""
    counts = [doc.count(w) for w in item]
    if not item or not all(counts):
        return []
    o = min(range(len(item)), key=lambda k: counts[k])
    at = [p - o for p, w in enumerate(doc) if w == item[o]]
    return [s for s in at if all(any(doc[p] == w for p in range(max(s + k - slop, 0), min(s + k + slop, len(doc) - 1) + 1)) for k, w in enumerate(item) if k != o)]


def test_proximity(spark):
    rng = random.Random(9)
    docs = [(i, [f"t{rng.randrange(12)}" for _ in range(rng.randrange(0, 60))]) for i in range(40)]
    items = [(f"i{k}", [f"t{x}" for x in rng.sample(range(14), 3)]) for k in range(12)]
    for slop in (0, 2):
        got, want = [], []
        for i, text in docs[:10]:  # rarity counts within a segment, so each document is a segment of its own here
            want += [(name, i, s) for name, item in items for s in near_places(text, item, slop)]
            index = decontam.build_index(spark.createDataFrame([(i, " ".join(text))], "doc_id long, text string"))
            got += [(r["item"], r["doc_id"], r["word"]) for r in decontam.proximity_hits(index, spark.createDataFrame([(n, " ".join(x)) for n, x in items], "item_id string, text string"), slop).collect()]
        assert sorted(got) == sorted(want)
