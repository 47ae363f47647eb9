"""Middle nodes of many neighbours count like all others."""

from collections import Counter

from quillon.operators import sets


def test_suggestions_through_hubs(spark):
    edges = [(u, v) for u in range(2500) for v in (-1, -2) if v == -1 or u % 2 == 0] + [(0, 7), (9, -3), (2, -3), (0, -3)]
    near = {u: {v for x, v in edges if x == u} for u in range(2500)}
    want = Counter({(u, o): len(near[u] & near[o]) for u in (0, 9) for o in near if o != u and o not in near[u] and near[u] & near[o]})
    df = spark.createDataFrame(edges, "u long, v long")
    got = sets.suggestions(df, spark.createDataFrame([(0,), (9,)], "u long"), limit=1 << 30)
    assert {(r["u"], r["other"]): r["common"] for r in got.collect()} == want


def test_suggestions_in_blocks(spark, monkeypatch):
    """Many small blocks, rows given out early: the same pairs, and the same best of each user."""
    for name, n in (("OWN", 40), ("FAR", 50), ("HELD", 60)):
        monkeypatch.setattr(sets, name, n)
    edges = sorted({(u, u * k * 7 % 31) for u in range(120) for k in range(1, 6)})
    near = {u: {v for x, v in edges if x == u} for u in range(120)}
    asked = range(0, 120, 3)
    want = {(u, o): len(near[u] & near[o]) for u in asked for o in near if o not in (u, 13) and o not in near[u] and len(near[u] & near[o]) >= 2}
    df = spark.createDataFrame([*edges, (None, 5), (6, None)], "u long, v long")
    users = spark.createDataFrame([(u,) for u in asked], "u long")
    apart = users.selectExpr("u", "13L AS other")
    pairs = sets.suggestions(df, users, 2, None, apart)
    # No pair is shuffled: what follows the counting has no exchange.
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert {(r["u"], r["other"]): r["common"] for r in pairs.collect()} == want
    got = {(r["u"], r["rank"]): (r["other"], r["common"]) for r in sets.suggestions(df, users, 2, 4, apart).collect()}
    best = {u: sorted((-n, o) for (x, o), n in want.items() if x == u)[:4] for u in asked}
    assert got == {(u, i + 1): (o, -n) for u, b in best.items() for i, (n, o) in enumerate(b)}
