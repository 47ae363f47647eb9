"""Searches of a batch cut the texts to words once."""

import random

from quillon.engines import search
from quillon.engines.search import Search

WORDS = ["the", "of", "und", "Straße", "x1", "tag", "é"]
NAMES = ["red", "tag", "x1"]


def _items(spark, n=120):
    r = random.Random(5)
    rows = []
    for i in range(n):
        text = None if i % 17 == 3 else "".join(r.choice(WORDS) + r.choice([" ", ", ", "\t", "-"]) for _ in range(r.randrange(6)))
        tags = None if i % 3 else r.sample(NAMES, r.randrange(3))
        rows.append(([i, i % 5], i % 4, {0: r.randrange(50), 2: r.randrange(9)}, text, tags))
    return rows, spark.createDataFrame(rows, "id array<int>, hash bigint, rates map<int,int>, text string, tags array<string>")


def _words(text):
    out, now = set(), ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            now += c
        elif now:
            out.add(now)
            now = ""
    return out


#: (request, what an item has to have by its words, title's words and tags)
ASKED = [
    ({"flags": 2 + 4, "limit": 1000, "query": "the of"}, lambda w, t, g: {"the", "of"} <= w),
    ({"flags": 2, "limit": 7, "query": "UND, und"}, lambda w, t, g: "und" in w),
    ({"flags": 2 + 256, "limit": 1000, "query": "the"}, lambda w, t, g: "the" in t),
    ({"flags": 2 + 65536, "limit": 1000, "query": "the of und"}, lambda w, t, g: bool({"the", "of", "und"} & w)),
    ({"flags": 2, "limit": 1000, "query": "straße *red"}, lambda w, t, g: "straße" in w and "red" in g),
    ({"flags": 2, "limit": 1000, "query": "tag"}, lambda w, t, g: "tag" in w),
    ({"flags": 2, "limit": 1000, "query": ""}, lambda w, t, g: True),
    ({"flags": 2 + 8192, "limit": 1000, "query": "(und | the) & !of"}, lambda w, t, g: bool({"und", "the"} & w) and "of" not in w),
    ({"flags": 2 + 8192 + 256, "limit": 1000, "query": "*red | x1"}, lambda w, t, g: "red" in g or "x1" in w),
    ({"flags": 2 + 16 + 8192, "limit": 1000, "hash": 3, "query": "é"}, lambda w, t, g: "é" in w),
]


def test_a_batch_of_searches(spark):
    rows, items = _items(spark)
    e = Search(spark, {"items": items})
    got = e.batch("search.search", search.asked(e, [a for a, _ in ASKED])).orderBy("rq", "pos").collect()
    for rq, (a, fits) in enumerate(ASKED):
        found = []
        for key, own, rates, text, tags in rows:
            w = _words(text)
            if text is None and a["query"] and not a["flags"] & 8192:  # tags of an item without text count in extended queries only
                continue
            ok = fits(w, _words((text or "").split("\t")[0]), set(tags or []))
            if ok and not (a["flags"] & 16 and own != a["hash"]):
                found.append((-rates[0] if a["flags"] & 4 else rates[0], key))
        found.sort()
        mine = [(r["pos"], r["total"], r["id"], r["rate"]) for r in got if r["rq"] == rq]
        assert mine == [(i + 1, len(found), k, abs(v)) for i, (v, k) in enumerate(found[: a["limit"]])], a


def test_optional_words_rank(spark):
    _, items = _items(spark)
    e = Search(spark, {"items": items.where("text IS NOT NULL")})
    got = e.call("search.search", **search.NEUTRAL | {"flags": 128 + 512, "limit": 1000, "query": "the ?of ?tag ?x1 ?*red", "opttag_coeff": 1.0}).orderBy("pos").collect()
    rows = {tuple(r["id"]): r for r in items.collect()}
    score = [len({"of", "tag", "x1"} & (_words(rows[tuple(r["id"])]["text"]) | set(rows[tuple(r["id"])]["tags"] or []))) for r in got]
    assert score and score == sorted(score, reverse=True)


def test_texts_are_cut_once(spark):
    _, items = _items(spark)
    e = Search(spark, {"items": items})
    out = e.batch("search.search", search.asked(e, [a for a, _ in ASKED[:2] + ASKED[7:9]]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(text") == 1  # and the title's where there is a tab


def test_letters_of_a_batch(spark):
    _, items = _items(spark)
    e = Search(spark, {"items": items})
    searches = [("r", 5, "the"), ("R", 5, "the"), ("XI", 4, "the | und")]
    got = search.batch_by_letters(e, searches).orderBy("rq", "pos").collect()
    for rq, s in enumerate(searches):
        one = search.by_letters(e, *s)
        want = [r["id"] for r in (one if "I" in s[0] else one.orderBy("pos")).collect()]
        assert [r["id"] for r in got if r["rq"] == rq] == want and want
