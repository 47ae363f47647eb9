"""Users of many items count like all others."""

from quillon.operators import recsys


def test_similarity_of_hot_users(spark):
    rows = [(1, i, float(i % 7 + 1)) for i in range(1500)] + [(2, i, 2.0) for i in (3, 4, 1499)] + [(None, 1, 1.0), (None, 2, 1.0)]
    score = {u: {i: v for x, i, v in rows if x == u} for u in (1, 2)}
    want = {(i, j): score[1][i] * score[1][j] + score[2].get(i, 0) * score[2].get(j, 0) + 0.2 for i in range(1500) for j in range(i + 1, 1500)}
    got = recsys.similarity(spark.createDataFrame(rows, "user long, item long, value double")).toPandas()
    assert len(got) == len(want)
    assert all(abs(want[i, j] - s) < 1e-9 for i, j, s in zip(got.i.tolist(), got.j.tolist(), got.sim.tolist(), strict=True))


def test_suggestions_in_blocks(spark, monkeypatch):
    """Items of one user, ties and many small blocks: the best of all items."""
    monkeypatch.setattr(recsys, "PAIRS", 40)
    rows = [(u, u * k * 11 % 37, float(k)) for u in range(60) for k in range(5)] + [(99, 1000, 1.0)]
    scores = spark.createDataFrame(rows, "user long, item long, value double")
    sim = recsys.similarity(scores)
    near = {}
    for r in sim.collect():
        near.setdefault(r.i, {})[r.j] = near.setdefault(r.j, {})[r.i] = r.sim
    users = spark.createDataFrame([(u,) for u in (0, 7, 12, 12, 99, 500)], "user long")
    want = {}
    for u in (0, 7, 12, 99):
        own, total = {}, {}
        for x, i, v in rows:
            if x == u:
                own[i] = own.get(i, 0) + v
        for i, v in own.items():
            for j, s in near.get(i, {}).items():
                if j not in own:
                    total[j] = total.get(j, 0) + min(max(v, 1), 100) * s
        for n, (j, s) in enumerate(sorted(total.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]):
            want[u, n + 1] = (j, round(s, 6))
    got = recsys.suggest_items(scores, sim, users, 4)
    assert {(r.user, r["rank"]): (r.item, round(r.score, 6)) for r in got.collect()} == want
