"""Spell checks against a list shuffle no word of a text, and agree with those against a table."""

from quillon.operators.textsearch import spell_check


def test_list_is_judged_by_broadcast(spark):
    docs = spark.createDataFrame([(1, "The cat, the cta; then dog"), (2, "dot dot x"), (3, ""), (4, None), (None, "cat the"), (1, "cat")], "doc_id long, text string")
    words = ["the", "cat", "dog"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spell_check(docs, words)
        assert "BroadcastHashJoin [word" in out._jdf.queryExecution().sparkPlan().toString()
        rows = sorted(map(repr, map(tuple, out.collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sorted(map(repr, [(1, 5, 1, 1), (2, 0, 2, 1), (None, 2, 0, 0)]))
    assert rows == sorted(map(repr, map(tuple, spell_check(docs, spark.createDataFrame([(w,) for w in words], "word string")).collect())))
