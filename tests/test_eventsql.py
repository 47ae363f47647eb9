"""A SELECT without LIMIT gives every row."""

from quillon.operators import eventsql


def test_no_rows_are_cut(spark):
    e = spark.range(100_007).selectExpr("id", "'a' AS type", "id AS uid", "id AS time", "1.0D AS value", "cast(id % 9 AS int) AS k")
    assert eventsql.select(e, "SELECT id, k FROM *").count() == 100_007
    assert eventsql.select(e, "SELECT LENGTH id FROM a").first()[0] == 100_007
    assert eventsql.select(e, "SELECT id FROM * LIMIT 100005").count() == 100_005
    assert eventsql.select(e, "SELECT LENGTH id FROM a LIMIT 10").first()[0] == 10
