"""Work isn't left to one task."""

from quillon.plans import registry
from quillon.sources import logs


def test_small_files_are_spread(spark, tmp_path):
    spark.range(12_001).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    df = registry.spread(registry.table(spark, str(tmp_path), "t"))
    assert df.rdd.getNumPartitions() == 3
    assert df.count() == 12_001


def test_places_of_merged_logs(spark):
    rows = spark.range(5000).selectExpr("id AS seq", "id * 7 % 50 AS ts", "id AS key", "'set' AS op", "cast(id AS string) AS payload", "0L AS crc")
    both = logs.placed(logs.merge([rows.where("key % 2 = 1"), rows.where("key % 2 = 0")]))
    assert "Window" not in both.where("place % 50 = 1")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    got = [r.key for r in both.orderBy("place").collect()]
    assert got == sorted(range(5000), key=lambda i: (i * 7 % 50, 1 - i % 2, i))
    assert both.agg({"place": "max"}).first()[0] == 5000
