"""Prefixes are met by equal keys, not by comparing each request with each row."""

from quillon.engines import engines


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wildcards_of_many_requests(spark):
    keys = [[1, 2], [1, 2, 3], [1], [2, 2], [], [1, 3]]
    e = engines()["seqmap"](spark, {"entries": spark.createDataFrame([(k, [9]) for k in keys], "key array<int>, value array<int>")})
    asked = [[1], [1, 2], [], [7], [1, 2, 3, 4], [1], None]
    r = spark.createDataFrame(list(enumerate(asked)), "rq long, key array<int>").selectExpr("*", "100 AS limit")
    want = {i: sum(p is not None and k[: len(p)] == p for k in keys) for i, p in enumerate(asked)}
    n = e.batch("seqmap.getWildcardCount", r)
    # The sizes are one row, whose product with the entries is the only join without keys.
    assert plan_of(n).count("NestedLoopJoin") + plan_of(n).count("CartesianProduct") <= 1
    assert {x.rq: x.n for x in n.collect()} == want
    hits = e.batch("seqmap.getWildcard", r).collect()
    assert sorted((x.rq, *x.key) for x in hits) == sorted((i, *k) for i, p in enumerate(asked) for k in keys if p is not None and k[: len(p)] == p)


def test_wildcards_of_texts(spark):
    e = engines()["memcache"](spark, {})
    e.batch("memcache.set", spark.createDataFrame([(i, k, "v", 0, 0) for i, k in enumerate(["ab", "abc", "b", "éa"])], "rq long, key string, value string, flags int, delay int"))
    r = spark.createDataFrame([(0, "ab"), (1, ""), (2, "é"), (3, "abcd"), (4, None)], "rq long, prefix string")
    got = sorted((x.rq, x.key) for x in e.batch("memcache.getWildcard", r).collect())
    assert got == [(0, ""), (0, "c"), (1, "ab"), (1, "abc"), (1, "b"), (1, "éa"), (2, "a")]
