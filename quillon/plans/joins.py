"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import sets
from quillon.plans.registry import query, table

P = "WITH p AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word, doc_id FROM documents) "


def posts(spark, d):
    return sets.postings(table(spark, d, "documents"))


@query(P + "SELECT doc_id FROM p WHERE word IN ('the', 'of', 'and') GROUP BY 1 HAVING count(*) = 3")
def j1_all_words(spark, d):
    return sets.all_words(posts(spark, d), ["the", "of", "and"])


@query(P + "(SELECT doc_id FROM p WHERE word IN ('the', 'of') GROUP BY 1 HAVING count(*) = 2 UNION SELECT doc_id FROM p WHERE word = 'der') EXCEPT SELECT doc_id FROM p WHERE word = 'with'")
def j2_boolean_postings(spark, d):
    p = posts(spark, d)
    return sets.but_words(sets.all_words(p, ["the", "of"]).union(sets.any_words(p, ["der"])).distinct(), p, ["with"])


A, B = "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 250000"


def _two(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), o.where("o_totalprice > 250000").select(F.col("o_custkey").alias("id"))


@query(f"{A} INTERSECT {B}")
def j3_intersection(spark, d):
    a, b = _two(spark, d)
    return a.intersect(b)


@query(f"{A} UNION {B}")
def j4_union(spark, d):
    a, b = _two(spark, d)
    return a.union(b).distinct()


@query(f"{A} EXCEPT {B}")
def j5_difference(spark, d):
    a, b = _two(spark, d)
    return a.subtract(b)


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 9)")
def j6_list_intersection(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").where("p_size = 9")
    return li.join(p, li.l_partkey == p.p_partkey, "left_semi").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)")
def j7_list_subtraction(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").where("p_size < 45")
    return li.join(p, li.l_partkey == p.p_partkey, "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'P')")
def j8_prefix_intersection(spark, d):
    """Composite ids matched by their first two numbers."""
    li = table(spark, d, "lineitem").withColumn("id", F.array(F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey")))
    prefix = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.array(F.col("o_orderkey"), F.lit(2).cast("bigint")).alias("prefix"))
    return li.join(prefix, F.slice("id", 1, 2) == F.col("prefix"), "left_semi").select("l_orderkey", "l_partkey", "l_linenumber")


@query(
    """WITH r AS (SELECT s_suppkey * 1000 AS "start", s_suppkey * 1000 + 50 * (s_suppkey % 90) AS "end", s_name AS code FROM supplier UNION ALL SELECT 0, 100000, 'all'),
    e AS (SELECT event_id, CAST(event_id * 7919 % 120000 AS BIGINT) AS ip FROM events)
    SELECT event_id, ip, (SELECT code FROM r WHERE e.ip BETWEEN r."start" AND r."end" ORDER BY r."end" - r."start", -r."start", code LIMIT 1) AS code FROM e"""
)
def j9_ip_range_join(spark, d):
    s = table(spark, d, "supplier")
    ranges = s.select((F.col("s_suppkey") * 1000).alias("start"), (F.col("s_suppkey") * 1000 + 50 * (F.col("s_suppkey") % 90)).alias("end"), F.col("s_name").alias("code"))
    ranges = ranges.union(spark.createDataFrame([(0, 100_000, "all")], "start long, end long, code string"))
    return sets.range_join(table(spark, d, "events").select("event_id", (F.col("event_id") * 7919 % 120000).cast("bigint").alias("ip")), ranges, "ip", 12)


G = "WITH g AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS v FROM lineitem) "


def graph(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).distinct()


@query(G + "SELECT b.u AS other, count(*) AS common FROM g a JOIN g b ON a.v = b.v AND a.u = 7 AND b.u <> 7 GROUP BY 1")
def j10_common_friends(spark, d):
    return sets.common_neighbours(graph(spark, d), 7)


F_EDGES = "WITH g AS (SELECT DISTINCT o_custkey AS u, o_orderkey % 211 AS v FROM orders) "


@query(
    F_EDGES + """,
    p AS (SELECT a.u, b.u AS other, count(*) AS common FROM g a JOIN g b ON a.v = b.v AND a.u <> b.u AND a.u % 50 = 0 GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT p.u, p.other, p.common FROM p WHERE (p.u, p.other) NOT IN (SELECT u, v FROM g)"""
)
def j11_friends_of_friends(spark, d):
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 211).alias("v")).distinct()
    users = g.where("u % 50 = 0").select("u")
    return sets.suggestions(g, users, least=2, limit=None).select("u", "other", "common")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (3, 5, 8) ORDER BY turn DESC, conv_id LIMIT 6")
def j12_join_peers(spark, d):
    return table(spark, d, "conversations").where(F.col("conv_id").isin(3, 5, 8)).orderBy(F.desc("turn"), "conv_id").limit(6).select("conv_id", "turn", "role")


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1")
def j13_reverse_lookup(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"), F.min("l_orderkey").alias("first"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def j14_scatter_gather_top(spark, d):
    """Each shard's own top rows and the merge of these are what one top-k plans to; shards that overlap are made distinct first."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.where("o_orderkey % 2 = 0").union(o.where("o_orderkey % 2 = 1")).union(o.where("o_orderkey % 7 = 0")).distinct().orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


@query("SELECT e.event_id, e.user_id FROM events e JOIN (SELECT DISTINCT event_type, user_id FROM events WHERE event_type = 'purchase' AND value > 50) b ON e.event_type = 'view' AND e.user_id = b.user_id")
def j15_bookmarks_updates(spark, d):
    e = table(spark, d, "events")
    marks = e.where("event_type = 'purchase' AND value > 50").select("user_id").distinct()
    return e.where("event_type = 'view'").join(marks, "user_id").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (2, 3, 5, 7, 11)")
def j16_feeds_of_users(spark, d):
    users = spark.createDataFrame([(i,) for i in (2, 3, 5, 7, 11)], "user_id long")
    return table(spark, d, "events").join(F.broadcast(users), "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT c_custkey AS id, 1 AS ad FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 3 FROM customer WHERE NOT c_nationkey = 3 AND c_acctbal <= 0")
def j17_targeting(spark, d):
    from quillon.operators.ads import targeting
    from quillon.plans.predicates import KEYWORDS, entities

    return targeting(entities(spark, d), {1: "nation=3", 2: "balance>=5000 & segment=building", 3: "!nation=3 & balance<=0"}, KEYWORDS)


@query("SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING bool_or(o_orderkey % 10 = 3)")
def j18_group_membership(spark, d):
    groups = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.col("o_orderkey") % 10).alias("groups"))
    return groups.where(F.array_contains("groups", F.lit(3).cast("bigint"))).select("id")


@query("SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (c_acctbal >= 1000) AS rich, count(*) FILTER (c_mktsegment = 'BUILDING') AS build FROM customer GROUP BY 1")
def j19_auxiliary_labels(spark, d):
    from quillon.operators.predicate import compiled
    from quillon.plans.predicates import KEYWORDS, entities

    aux = {"rich": "balance>=1000", "build": "segment=building"}
    return entities(spark, d).groupBy("nation").agg(F.count("*").alias("n"), *(F.count_if(compiled(t, KEYWORDS)).alias(k) for k, t in aux.items()))
