"""Queries against their SQL over small tables of odd rows."""

import datetime

import duckdb

from quillon.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def same(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for k, df in tables.items():
        df.write.parquet(f"{tmp_path}/{k}.parquet")
        con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{tmp_path}/{k}.parquet/*.parquet'")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    got = [tuple(r[n] for n in names) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    plain = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(got) == plain(want.fetchall())
    return got


def events(spark, users):
    at = datetime.datetime(2024, 1, 20, 3)
    rows = [(i, at + datetime.timedelta(hours=i), u, ("view", "click", "purchase")[i % 3], 1.5 * i, f'{{"k": {i}}}') for i, u in enumerate(users)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_half_lives_of_all_users(spark, tmp_path):
    same(spark, tmp_path, "a29_half_life_table", events=events(spark, [3, 999, 1002, 1002, 30_000, 30_001]))


def test_texts_without_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b A"), (2, " ..., "), (3, ""), (4, None)], "doc_id long, text string")
    assert same(spark, tmp_path, "a42_distinct_words", documents=docs) == [(1, 2)]


def test_numbers_beyond_16_bits(spark, tmp_path):
    same(spark, tmp_path, "sf9_encodings", events=events(spark, [7, 65_535, 65_536, 900_001]))


def test_every_user_has_an_auction(spark, tmp_path):
    customers = spark.createDataFrame([(i, i % 3) for i in range(1, 8)] + [(50, None), (100, 1)], "c_custkey long, c_nationkey int")
    parts = spark.createDataFrame([(i, f"Brand#{i // 25 % 7}", i // 50 % 4, 100.0 + i // 100) for i in range(1, 1000)], "p_partkey long, p_brand string, p_size int, p_retailprice double")
    got = same(spark, tmp_path, "w15_ad_auction", customer=customers, part=parts)
    assert {r[0] for r in got} == {1, 2, 3, 4, 5, 6, 7, 100}
