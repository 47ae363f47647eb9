"""Typed operations in batches over whole tables: writes followed by reads, as rows (op, rq, pos, x)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.engines import engines
from quillon.plans.events import E, log
from quillon.plans.registry import query, table


def _rows(op: str, df: DataFrame, x: str, pos: str = "0") -> DataFrame:
    return df.select(F.lit(op).alias("op"), F.col("rq").cast("bigint").alias("rq"), F.expr(pos).cast("bigint").alias("pos"), F.expr(x).cast("string").alias("x"))


def _places(ops: list[str], df: DataFrame, x: str) -> DataFrame:
    """The places of a batch whose requests, by rq from 0, are the operations of these names."""
    return df.select(F.get(F.array(*(F.lit(o) for o in ops)), F.col("rq").cast("int")).alias("op"), F.lit(0).cast("bigint").alias("rq"), F.col("pos").cast("bigint").alias("pos"), F.expr(x).cast("string").alias("x"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def engine(name: str, spark, state: dict[str, DataFrame], now: int = 0):
    return engines()[name](spark, state, now)


LISTS = "WITH e AS (SELECT l_suppkey AS s, l_orderkey AS o, l_linenumber AS l, max(l_quantity::INT % 16)::INT AS f, max(epoch(l_shipdate)::INT) AS d, max(l_partkey) AS v FROM lineitem GROUP BY 1, 2, 3) "


def _lists(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.array(F.col("l_suppkey").cast("int")).alias("list_id"), F.array(F.col("l_orderkey").cast("int"), "l_linenumber").alias("object_id"))
    return engine("lists", spark, {"entries": li.agg(F.max(F.col("l_quantity").cast("int") % 16).alias("flags"), F.max(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("int")).alias("date"), F.max("l_partkey").alias("value"))})


def _entries(spark, d, line: int, **columns) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_linenumber") == line).select("l_suppkey", "l_orderkey", "l_linenumber").distinct()
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rq"), F.array("l_suppkey").alias("list_id"), F.array("l_orderkey", "l_linenumber").alias("object_id"), *(F.lit(v).alias(k) for k, v in columns.items()))


@query(
    LISTS + """, a AS (SELECT s, o, l, d, CASE WHEN l = 1 THEN f | 9 WHEN l = 2 THEN f & ~6 WHEN l = 3 THEN (f & ~3) | 16 WHEN l = 4 THEN 21 ELSE f END AS f, CASE WHEN l = 5 THEN v + 7 WHEN l = 6 THEN v - 3 WHEN l = 7 THEN 1000 ELSE v END AS v FROM e),
    b AS (SELECT s, o, l, d, CASE WHEN s % 3 = 0 AND f & 7 = 2 THEN 3 WHEN s % 3 = 1 AND f & 7 = 2 THEN (f & ~4) | 32 WHEN s % 3 = 2 AND xor(f, 1) & 9 = 0 THEN f | 64 ELSE f END AS f, v FROM a),
    c AS (SELECT * FROM b WHERE NOT (s % 5 = 0 AND f & 7 = 4) AND NOT (s % 5 = 1 AND xor(f, 5) & 7 = 0) AND s <> 7),
    n AS (SELECT s, o + 1000000000 AS o, 1 AS l, 4 AS f, 11 AS v FROM a WHERE l = 1 AND s <> 7)
    SELECT 'entry' AS op, o * 10 + l AS rq, s AS pos, f || ' ' || v AS x FROM (SELECT s, o, l, f, v FROM c UNION ALL SELECT * FROM n)"""
)
def e1_lists_written(spark, d):
    e = _lists(spark, d)
    e.batch("lists.incrFlags", _entries(spark, d, 1, flags=9))
    e.batch("lists.decrFlags", _entries(spark, d, 2, flags=6))
    e.batch("lists.changeFlags", _entries(spark, d, 3, set_flags=16, clear_flags=3))
    e.batch("lists.setFlags", _entries(spark, d, 4, flags=21))
    e.batch("lists.incrValue", _entries(spark, d, 5, value=7))
    e.batch("lists.decrValue", _entries(spark, d, 6, value=3))
    e.batch("lists.setValue", _entries(spark, d, 7, value=1000))
    lists = table(spark, d, "supplier").select(F.col("s_suppkey").alias("rq"), F.array("s_suppkey").alias("list_id"), *(F.lit(v).alias(k) for k, v in {"flags": 2, "new_flags": 3, "new_or_mask": 32, "new_nand_mask": 4}.items()))
    e.batch("lists.setListFlags", lists.where("rq % 3 = 0"))
    e.batch("lists.changeListFlags", lists.where("rq % 3 = 1"))
    e.batch("lists.changeListFlagsEx", lists.where("rq % 3 = 2").withColumns({"xor_mask": F.lit(1), "and_mask": F.lit(9), "new_or_mask": F.lit(64), "new_nand_mask": F.lit(0)}))
    e.batch("lists.deleteSublist", lists.where("rq % 5 = 0").withColumn("flags", F.lit(4)))
    e.batch("lists.deleteSublistEx", lists.where("rq % 5 = 1").withColumns({"xor_mask": F.lit(5), "and_mask": F.lit(7)}))
    new = _entries(spark, d, 1, flags=4, value=11, date=0, text="t").withColumn("object_id", F.array(F.col("object_id")[0] + 1_000_000_000, F.lit(1)))
    e.batch("lists.addEntry", new)
    e.batch("lists.addEntry", new.withColumn("value", F.lit(99)))
    e.batch("lists.replaceEntry", new.withColumn("list_id", F.array(F.lit(-1))).drop("text"))
    e.batch("lists.deleteList", lists.where("rq = 7"))
    return e.state["entries"].select(F.lit("entry").alias("op"), (F.col("object_id")[0].cast("bigint") * 10 + F.col("object_id")[1]).alias("rq"), F.col("list_id")[0].cast("bigint").alias("pos"), F.concat_ws(" ", "flags", "value").alias("x"))


@query(
    LISTS + """, top AS (SELECT s, o, l, f, v, row_number() OVER (PARTITION BY s ORDER BY o DESC, l DESC) AS r, count(*) OVER (PARTITION BY s) AS n FROM e WHERE f & 7 = 3),
    late AS (SELECT s, o, l, row_number() OVER (PARTITION BY s ORDER BY d, o, l) AS r FROM e),
    rich AS (SELECT s, o, l, row_number() OVER (PARTITION BY s ORDER BY v DESC, d, o, l) AS r FROM e WHERE xor(f, 1) & 1 = 0)
    SELECT 'counts' AS op, s AS rq, 0 AS pos, count(*) || ' ' || count(*) FILTER (f & 7 = 0) || ' ' || count(*) FILTER (f & 7 = 5) AS x FROM e GROUP BY s
    UNION ALL SELECT 'count3', s_suppkey, 0, count(o)::VARCHAR FROM supplier LEFT JOIN e ON s = s_suppkey AND f & 7 = 3 GROUP BY 2
    UNION ALL SELECT 'down', s, r, n || ' ' || o || ':' || l || ' ' || f FROM top WHERE r BETWEEN 2 AND 4
    UNION ALL SELECT 'dates', s, r, o || ':' || l FROM late WHERE r <= 3
    UNION ALL SELECT 'rich', s, r, o || ':' || l FROM rich WHERE r <= 5
    UNION ALL SELECT 'distr', s, b, count(*)::VARCHAR FROM (SELECT s, CASE WHEN d < 820454400 THEN -1 WHEN d >= 883612800 THEN 2 ELSE (d - 820454400) // 31579200 END AS b FROM e) GROUP BY 2, 3
    UNION ALL SELECT 'sum', s, 0, sum(CASE WHEN l IN (1, 2) THEN l * 10 ELSE 0 END)::VARCHAR FROM e WHERE o = 32 GROUP BY 2
    UNION ALL SELECT 'wild', s, 0, count(*)::VARCHAR FROM e WHERE o IN (32, 33) GROUP BY 2
    UNION ALL SELECT 'one', o * 10 + l, 0, f || ' ' || v FROM e WHERE l = 4"""
)
def e2_lists_read(spark, d):
    e = _lists(spark, d)
    by = lambda **kw: table(spark, d, "supplier").select(F.col("s_suppkey").alias("rq"), F.array("s_suppkey").alias("list_id"), *(F.expr(v).alias(k) if isinstance(v, str) else F.lit(v).alias(k) for k, v in kw.items()))
    given = "array(array(32, 1), array(32, 2), array(-1, -1))"
    at = "concat(object_id[0], ':', object_id[1])"
    return _all(
        _rows("counts", e.batch("lists.getSublistsCount", by()).where("n > 0"), "concat_ws(' ', n, s0, s5)"),
        _rows("count3", e.batch("lists.getSublistCount", by(mode=3)), "n"),
        _rows("down", e.batch("lists.getListFullLimit", by(mode=3 + 16 + 64, limit=3, offset=1)), f"concat(total, ' ', {at}, ' ', flags)", "pos"),
        _rows("dates", e.batch("lists.getListLimit", by(mode=32, limit=3, offset=0)), at, "pos"),
        _rows("rich", e.batch("lists.sortedListLimit", by(xor_mask=1, and_mask=1, mode=2, limit=5)), at, "pos"),
        _rows("distr", e.batch("lists.datedistr", by(mode=0, min_date=820454400, max_date=883612800, step=31579200)).where("n > 0"), "n", "bucket"),
        _rows("sum", e.batch("lists.sumlistWeighted", by(mode=0, object_list=given, weights="array(10, 20, 5)")).join(e.batch("lists.sumlistWild", by(mode=0, object_list="array(array(32))")).where("sum > 0").select("rq"), "rq"), "sum"),
        _rows("wild", e.batch("lists.intersectWild", by(mode=0, object_list="array(array(32), array(33))")).groupBy("rq").agg(F.count("*").alias("n")), "n"),
        _rows("one", e.batch("lists.getEntry", _entries(spark, d, 4, mode=64 + 512)), "concat_ws(' ', flags, value)"),
    )


FRIENDS = "WITH f AS (SELECT DISTINCT (o_custkey % 97)::INT AS u, (o_orderkey % 101)::INT AS v FROM orders), m AS (SELECT u, v, (v % 7 + 1)::INT AS mask, (u * 100 + v)::INT AS t FROM f) "


@query(
    FRIENDS + """, g AS (SELECT u, v, t, CASE WHEN v % 5 = 0 THEN mask | 8 WHEN v % 5 = 1 THEN mask & ~1 ELSE mask END AS mask FROM m WHERE NOT (u = 3 OR v % 11 = 0)),
    h AS (SELECT u, v, t, CASE WHEN v IN (2, 4, 6) THEN mask | 32 ELSE mask & ~32 END AS mask FROM g), r AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY t DESC, v) AS r, count(*) OVER (PARTITION BY u) AS n FROM h)
    SELECT 'ids' AS op, u AS rq, row_number() OVER (PARTITION BY u ORDER BY v) AS pos, v::VARCHAR AS x FROM h WHERE mask & 8 <> 0
    UNION ALL SELECT 'count', u, 0, count(*) FILTER (mask & 32 <> 0)::VARCHAR FROM h GROUP BY 2
    UNION ALL SELECT 'recent', u, r, n || ' ' || v FROM r WHERE r <= 4
    UNION ALL SELECT 'common', a.u, 0, count(*)::VARCHAR FROM h a JOIN h b ON a.v = b.v AND b.u = 5 GROUP BY 2
    UNION ALL SELECT 'may', u, 0, CASE WHEN EXISTS (SELECT 1 FROM h k WHERE k.u = q.u AND k.v = 12) THEN '0' WHEN EXISTS (SELECT 1 FROM h k WHERE k.u = q.u AND k.v = 9 AND (mask >> 1) & 1 = 1) THEN '1' ELSE '0' END FROM (SELECT DISTINCT u FROM h) q WHERE false
    UNION ALL SELECT 'privacy', u, 9, CASE WHEN max(mask >> 1 & 1) FILTER (v = 9) = 1 THEN '1' WHEN count(*) FILTER (v = 9) > 0 THEN '0' ELSE '0' END FROM h GROUP BY 2"""
)
def e3_friends(spark, d):
    f = table(spark, d, "orders").select((F.col("o_custkey") % 97).cast("int").alias("uid"), (F.col("o_orderkey") % 101).cast("int").alias("friend")).distinct()
    e = engine("friends", spark, {"friends": f.withColumns({"mask": F.col("friend") % 7 + 1, "time": F.col("uid") * 100 + F.col("friend")})})
    pair = f.withColumn("rq", F.col("uid").cast("bigint") * 1000 + F.col("friend"))
    e.batch("friends.incrFriend", pair.where("friend % 5 = 0").withColumn("mask", F.lit(8)))
    e.batch("friends.decrFriend", pair.where("friend % 5 = 1").withColumn("mask", F.lit(1)))
    e.batch("friends.deleteFriend", pair.where("friend % 11 = 0"))
    e.call("friends.deleteUser", uid=3)
    users = f.select("uid").distinct().withColumn("rq", F.col("uid").cast("bigint"))
    e.batch("friends.setCatList", users.withColumns({"cat": F.lit(5), "friends": F.expr("array(2, 4, 6)")}))
    e.batch("friends.setPrivacy", users.withColumns({"key": F.lit("wall"), "text": F.lit("+*1 -A")}))
    own = users.where("uid <> 3")
    return _all(
        _rows("ids", e.batch("friends.getFriendsId", own.withColumn("mask", F.lit(8))), "friend", "pos"),
        _rows("count", e.batch("friends.getFriendsCnt", own.withColumn("mask", F.lit(32))), "n"),
        _rows("recent", e.batch("friends.getRecentFriends", own.withColumn("num", F.lit(4))), "concat_ws(' ', total, friend)", "pos"),
        _rows("common", e.batch("friends.getCommonFriendsNum", own.withColumn("users", F.expr("array(5)"))).where("n > 0"), "n"),
        _rows("privacy", e.batch("friends.checkPrivacy", own.withColumns({"test_uid": F.lit(9), "key": F.lit("wall")})), "coalesce(allowed, 0)", "9"),
    )


@query(
    E + """, f AS (SELECT DISTINCT k, 'http://h/' || k AS url FROM e WHERE type = 'view'), a AS (SELECT k, sum(pow(2.0, -(1706600000 - 1706600000) / 86400.0)) AS v FROM e WHERE type = 'view' GROUP BY 1), s AS (SELECT f.k, url, v, CASE WHEN f.k % 3 = 0 THEN f.k * 10 END AS size FROM f JOIN a USING (k)),
    t AS (SELECT k, url, v, size, row_number() OVER (ORDER BY v DESC, url) AS r FROM s WHERE size IS NULL)
    SELECT 'size' AS op, k AS rq, 0 AS pos, coalesce(size::VARCHAR, 'none') AS x FROM s UNION ALL SELECT 'top', 0, r, url || ' ' || round(v)::BIGINT FROM t WHERE r <= 10
    UNION ALL SELECT 'copy', k, 0, CASE WHEN k % 4 = 1 THEN 'none' ELSE 'cs' || (k % 4 + 1) || '_2/d3/' || k END FROM s UNION ALL SELECT 'copies', k, 0, 'cs' || (k % 4 + 1) || '_2/d3/' || k || ' ' || CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END FROM s
    UNION ALL SELECT 'servers', 0, k % 4 + 1, count(*)::VARCHAR || ' ' || sum(coalesce(size, 0))::BIGINT FROM s GROUP BY 3"""
)
def e4_cache(spark, d):
    views = log(spark, d).where("type = 'view'")
    e = engine("cache", spark, {}, 1_706_600_000)
    one = views.select(F.col("id").alias("rq"), F.lit(1).alias("cache_id"), F.concat(F.lit("http://h/"), "k").alias("url"), "k")
    e.batch("cache.access", one)
    files = one.groupBy("k", "url").agg(F.first("cache_id").alias("cache_id")).withColumn("rq", F.col("k").cast("bigint"))
    e.batch("cache.setFileSize", files.where("k % 3 = 0").withColumn("size", F.col("k") * 10))
    local = files.withColumnRenamed("url", "global_url").withColumn("local_url", F.expr("concat('cs', k % 4 + 1, '_2/d3/', k)"))
    e.batch("cache.setNewLocalCopy", local)
    e.call("cache.disableServer", cache_id=1, node_id=2, server_id=2)
    return _all(
        _rows("size", e.batch("cache.getFileSize", files), "coalesce(cast(size AS string), 'none')"),
        _rows("top", e.call("cache.getTopAccess", cache_id=1, t=86400, limit=10, flags=1 + 8, min_rate=0), "concat(url, ' ', cast(round(value) AS bigint))", "pos"),
        _rows("copy", e.batch("cache.convert", files), "coalesce(local_url, 'none')"),
        _rows("copies", e.batch("cache.getLocalCopies", files), "concat(local_url, ' ', flags)"),
        _rows("servers", e.call("cache.getServerStats", cache_id=1, sorting_flags=0), "concat(files, ' ', all_files_size)", "node_id"),
    )


@query(
    """WITH o AS (SELECT (p_partkey % 20)::INT AS u, (p_size % 3 + 1)::INT AS t, p_partkey::INT AS id, p_name AS text FROM part), r AS (SELECT u, t, id, text, (id % 10 + CASE WHEN id % 7 = 0 THEN 5 ELSE 0 END)::DOUBLE AS rating FROM o WHERE id % 13 <> 0),
    h AS (SELECT u, id, t, rating, row_number() OVER (PARTITION BY u ORDER BY rating DESC, t, id) AS r, count(*) OVER (PARTITION BY u) AS n FROM r WHERE text LIKE 'sm%' OR text LIKE '% sm%')
    SELECT 'hints' AS op, u AS rq, r AS pos, n || ' ' || t || ':' || id || ' ' || rating::INT AS x FROM h WHERE r <= 5
    UNION ALL SELECT 'text', id, 0, CASE WHEN id % 13 = 0 THEN 'none' ELSE text END FROM o
    UNION ALL SELECT 'sort', u, row_number() OVER (PARTITION BY u ORDER BY rating DESC, t, id), t || ':' || id FROM (SELECT u, t, id, rating FROM r WHERE u = 4 AND id IN (4, 24, 44))"""
)
def e5_hints(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 20).cast("int").alias("user_id"), (F.col("p_size") % 3 + 1).cast("int").alias("type"), F.col("p_partkey").cast("int").alias("object_id"), F.col("p_name").alias("text"), F.col("p_partkey").alias("rq"))
    e = engine("hints", spark, {}, 1_000_000)
    e.batch("hints.setText", p)
    e.batch("hints.setRating", p.withColumns({"rating_num": F.lit(0), "rating": (F.col("object_id") % 10).cast("double")}))
    e.batch("hints.incrementRating", p.where("object_id % 7 = 0").withColumns({"cnt": F.lit(5), "rating_num": F.lit(0)}))
    e.batch("hints.deleteObject", p.where("object_id % 13 = 0"))
    users = p.select("user_id").distinct().withColumn("rq", F.col("user_id").cast("bigint"))
    some = p.where("user_id = 4 AND object_id IN (4, 24, 44)").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("type", "object_id"))).alias("objects")).withColumns({"rq": F.lit(4), "limit": F.lit(9), "rating_num": F.lit(0)})
    return _all(
        _rows("hints", e.batch("hints.getHintsRating", users.withColumns({"type": F.lit(0), "limit": F.lit(5), "rating_num": F.lit(0), "query": F.lit("sm")})), "concat(total, ' ', type, ':', object_id, ' ', cast(rating AS int))", "pos"),
        _rows("text", e.batch("hints.getObjectText", p.drop("text")), "coalesce(text, 'none')"),
        _rows("sort", e.batch("hints.sort", some), "concat(type, ':', object_id)", "pos"),
    )


@query(
    """WITH q AS (SELECT lower(p_type) AS q, (p_size % 2)::INT AS t, count(*) AS n FROM part GROUP BY 1, 2), a AS (SELECT q, sum(n)::BIGINT AS n FROM q WHERE NOT contains(q, 'promo') GROUP BY 1)
    SELECT 'top' AS op, 0 AS rq, row_number() OVER (ORDER BY n DESC, q) AS pos, q || ' ' || n AS x FROM a QUALIFY pos <= 4 UNION ALL SELECT 'hints', 0, row_number() OVER (ORDER BY n DESC, q), q FROM a WHERE q LIKE 's%'
    UNION ALL SELECT 'types', 0, t, round(n / sum(n) OVER (), 6)::VARCHAR FROM q WHERE q = 'standard'
    UNION ALL SELECT 'wish', 0, 0, 'standard'"""
)
def e6_isearch(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("rq"), F.lit(1).alias("user_id"), (F.col("p_size") % 2).cast("int").alias("type"), F.lit(1).alias("count"), F.col("p_type").alias("query"))
    e = engine("isearch", spark, {})
    e.batch("isearch.addSearchQuery", p)
    e.call("isearch.addBlackList", query="Promo")
    return _all(
        _rows("top", e.call("isearch.getTop", limit=4), "concat(query, ' ', n)", "pos"), _rows("hints", e.call("isearch.getHints", query="S"), "query", "pos"),
        _rows("types", e.call("isearch.getTypes", query="Standard"), "round(p, 6)", "type"), _rows("wish", e.call("isearch.getSuggestion", query="standerd"), "suggestion"),
    )


@query(
    E + """, k AS (SELECT uid, count(*) AS n FROM e GROUP BY 1), v AS (SELECT 'user' || uid AS key, uid, CASE WHEN uid % 4 = 0 THEN (n * 2 - 1)::VARCHAR ELSE n::VARCHAR END AS val FROM k WHERE uid % 5 <> 3)
    SELECT 'get' AS op, k.uid AS rq, 0 AS pos, coalesce(val, 'none') AS x FROM k LEFT JOIN v USING (uid)
    UNION ALL SELECT 'wild', 0, uid, val FROM v WHERE key LIKE 'user1%'"""
)
def e7_memcache(spark, d):
    k = log(spark, d).groupBy("uid").agg(F.count("*").alias("n")).select(F.col("uid").alias("rq"), F.concat(F.lit("user"), "uid").alias("key"), F.col("n").cast("string").alias("value"), F.lit(0).alias("flags"), F.when(F.col("uid") % 5 == 3, 1).otherwise(0).alias("delay"))
    e = engine("memcache", spark, {}, 100)
    e.batch("memcache.add", k)
    e.batch("memcache.add", k.withColumn("value", F.lit("later")))
    e.batch("memcache.replace", k.withColumns({"key": F.concat("key", F.lit("?"))}))
    some = k.where("rq % 4 = 0").withColumn("value", F.col("value").cast("bigint"))
    e.batch("memcache.incr", some)
    e.batch("memcache.decr", some.withColumn("value", F.lit(1)))
    e.now = 200
    return _all(_rows("get", e.batch("memcache.get", k), "coalesce(value, 'none')"), _rows("wild", e.call("memcache.getWildcard", prefix="user").where("key LIKE '1%'"), "value", "cast(key AS bigint)"))


@query(
    E + """, u AS (SELECT uid::INT AS id, CASE type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS t, k % 5 AS owner, k % 3 AS place, time, id AS eid FROM e), m AS (SELECT * FROM u WHERE id IN (1, 2, 3, 4) AND t IN (1, 2) AND time >= 1704844800 AND time < 1705708800 AND NOT (id = 4 AND t <> 1)),
    g AS (SELECT t, owner, place, time // 86400 AS day, id, max(time) AS last FROM m GROUP BY 1, 2, 3, 4, 5), w AS (SELECT t, owner, place, day, max(last) AS newest, count(*) AS total FROM g GROUP BY 1, 2, 3, 4), s AS (SELECT *, row_number() OVER (ORDER BY newest DESC, t, owner, place, day) AS r FROM w)
    SELECT 'raw' AS op, id AS rq, t AS pos, count(*)::VARCHAR AS x FROM m GROUP BY 2, 3 UNION ALL SELECT 'groups', 0, r, t || ' ' || owner || ' ' || place || ' ' || newest || ' ' || total FROM s WHERE r <= 20"""
)
def e8_news(spark, d):
    u = log(spark, d).select(F.col("uid").cast("int").alias("id"), F.when(F.col("type") == "view", 1).when(F.col("type") == "click", 2).otherwise(3).alias("type"), (F.col("k") % 5).cast("int").alias("owner"), (F.col("k") % 3).cast("int").alias("place"), F.col("time").cast("int").alias("date"), F.col("id").alias("tag"), F.lit(False).alias("hidden"), F.col("uid").cast("int").alias("user"))
    e = engine("news", spark, {"updates": u})
    e.call("news.setPrivacyMask", id=4, type_mask=2)
    return _all(
        _rows("raw", e.call("news.getRawUpdates", type_mask=6, start_date=1_704_844_800, end_date=1_705_708_800, user_list=[1, 2, 3, 4]).groupBy("id", "type").agg(F.count("*").alias("n")).withColumn("rq", F.col("id")), "n", "type"),
        _rows("groups", e.call("news.getGroupedUpdates", type_mask=6, date=1_704_844_800, timestamp=0, end_date=1_705_708_800, grouping=3, limit=20, user_list=[1, 2, 3, 4]), "concat_ws(' ', type, owner, place, newest, total)", "pos"),
    )


@query(
    E + """, u AS (SELECT uid::INT AS id, 1 AS t, k % 5 AS owner, k % 3 AS place, (id % 40)::INT AS action, time FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY id, owner, place, action ORDER BY time DESC) AS r FROM u WHERE id BETWEEN 1 AND 9),
    s AS (SELECT owner, place, count(DISTINCT id) AS users, sum(id * (action % 4) * pow(2.0, -greatest(1706600000 - time, 0) / 864000.0)) AS w FROM o WHERE action >= 32 OR r = 1 GROUP BY 1, 2)
    SELECT 'best' AS op, 0 AS rq, row_number() OVER (ORDER BY w DESC, owner, place) AS pos, owner || ' ' || place || ' ' || users || ' ' || round(w, 3)::DECIMAL(18,3) AS x FROM s WHERE users >= 2 QUALIFY pos <= 8
    UNION ALL SELECT 'marks', 0, owner, count(*)::VARCHAR FROM u WHERE place = 1 AND owner <> 3 GROUP BY 3
    UNION ALL SELECT 'seen', id, 0, count(*)::VARCHAR FROM u WHERE owner <> 2 GROUP BY 2"""
)
def e9_other_news(spark, d):
    u = log(spark, d).select(F.col("uid").cast("int").alias("id"), F.lit(1).alias("type"), (F.col("k") % 5).cast("int").alias("owner"), (F.col("k") % 3).cast("int").alias("place"), F.lit(7).alias("item"), (F.col("id") % 40).cast("int").alias("action"), F.col("time").cast("int").alias("date"), F.col("time").cast("int").alias("created"), F.col("id").alias("tag"), F.lit(False).alias("hidden"), F.col("uid").cast("int").alias("user"))
    r = engine("rnews", spark, {"updates": u})
    r.batch("rnews.setRate", spark.range(40).select(F.col("id").alias("rq"), F.lit(1).alias("type"), F.col("id").cast("int").alias("action"), (F.col("id") % 4).cast("double").alias("rate")))
    users = F.expr("transform(sequence(1, 9), i -> named_struct('id', i, 'rate', cast(i AS double)))")
    asked = spark.range(1).select(F.lit(0).alias("rq"), F.lit(2).alias("type_mask"), F.lit(0).alias("start_date"), F.lit(2_000_000_000).alias("end_date"), F.lit(0).alias("id"), F.lit(864_000).alias("t"), F.lit(1_706_600_000).alias("timestamp"), F.lit(2).alias("acting_users_limit"), F.lit(8).alias("limit"), users.alias("user_list"))
    c = engine("cnews", spark, {"updates": u})
    c.batch("cnews.addBookmark", spark.range(5).select(F.col("id").alias("rq"), F.lit(1).alias("type"), F.col("id").cast("int").alias("owner"), F.lit(1).alias("place"), F.lit(77).alias("user_id")))
    c.call("cnews.delBookmark", type=1, owner=3, place=1, user_id=77)
    n = engine("nnews", spark, {"updates": u})
    n.batch("nnews.deleteUpdate", spark.range(3).select(F.col("id").alias("rq"), F.lit(1).alias("type"), F.lit(2).alias("owner"), F.col("id").cast("int").alias("place"), F.lit(7).alias("item")))
    mine = u.select("id").distinct().select(F.col("id").alias("rq"), F.col("id").alias("user_id"), F.lit(2).alias("mask"), F.lit(0).alias("date"), F.lit(2_000_000_000).alias("end_date"), F.lit(0).alias("timestamp"), F.lit(1_000_000).alias("limit"))
    return _all(
        _rows("best", r.batch("rnews.getGroupedUpdates", asked), "concat_ws(' ', owner, place, users, cast(round(weight, 3) AS decimal(18,3)))", "pos"),
        _rows("marks", c.call("cnews.getRawUserUpdates", type_mask=2, start_date=0, end_date=2_000_000_000, user_id=77).groupBy("owner").agg(F.count("*").alias("n")).withColumn("rq", F.lit(0)), "n", "owner"),
        _rows("seen", n.batch("nnews.getUpdates", mine).groupBy("rq").agg(F.count("*").alias("n")), "n"),
    )


@query(
    """WITH p AS (SELECT (l_suppkey)::INT AS own, max(l_partkey % 10 + 1)::INT AS album, (l_orderkey * 8 + l_linenumber)::INT AS id, max(l_quantity::INT) AS h FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber), a AS (SELECT own, album, id, CASE WHEN id % 4 = 0 THEN h + 100 ELSE h END AS h, CASE WHEN id % 6 = 0 THEN 5 ELSE 0 END AS views FROM p WHERE id % 9 <> 0),
    r AS (SELECT own, album, id, h, row_number() OVER (PARTITION BY own ORDER BY id DESC) AS r, count(*) OVER (PARTITION BY own) AS n FROM a WHERE album = 3 AND h > 20)
    SELECT 'count' AS op, s_suppkey AS rq, 0 AS pos, count(id)::VARCHAR AS x FROM supplier LEFT JOIN a ON own = s_suppkey AND album = 2 AND (h > 40 OR views = 5) GROUP BY 2
    UNION ALL SELECT 'shown', own, r - 1, n || ' ' || id || ' ' || h FROM r WHERE r BETWEEN 2 AND 4
    UNION ALL SELECT 'over', own, 0, count(*)::VARCHAR FROM a WHERE album IN (1, 5) GROUP BY 2"""
)
def e10_photo(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.lit("photo").alias("kind"), F.col("l_suppkey").cast("int").alias("owner_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("id")).agg(F.max(F.col("l_partkey") % 10 + 1).cast("int").alias("album_id"), F.max(F.col("l_quantity").cast("int")).alias("height")).withColumn("place", F.col("id").cast("double"))
    e = engine("photo", spark, {"objects": p})
    one = p.select(F.col("id").alias("rq"), "owner_id", F.col("id").alias("photo_id"), "height")
    nothing = {c: F.lit(None) for c in ("album_id", "user_id", "width")}
    place = "array<struct<server:int,server2:int,user_id:int,orig_album:int,photo:string,rotate:int,size:string,volume_id:int>>"
    e.batch("photo.changePhoto", one.where("rq % 4 = 0").withColumn("height", F.col("height") + 100).withColumns({k: v.cast("int") for k, v in nothing.items()} | {c: F.lit(None).cast(place) for c in ("location", "original_location")}))
    e.batch("photo.incrementPhotoField", one.where("rq % 6 = 0").withColumns({"field": F.lit("views"), "cnt": F.lit(5)}))
    e.batch("photo.deletePhoto", one.where("rq % 9 = 0"))
    by = lambda **kw: table(spark, d, "supplier").select(F.col("s_suppkey").alias("rq"), F.col("s_suppkey").alias("owner_id"), *(F.expr(v[1:]).alias(k) if isinstance(v, str) and v[:1] == "=" else F.lit(v).alias(k) for k, v in kw.items()))
    return _all(
        _rows("count", e.batch("photo.getPhotosCount", by(album_id=2, condition="height > 40 || views = 5")), "n"),
        _rows("shown", e.batch("photo.getPhotosWithCount", by(album_id=3, fields_mask=1 + 16, offset=1, limit=3, is_reverse=True, condition="height > 20")), "concat_ws(' ', total, id, height)", "pos - 1"),
        _rows("over", e.batch("photo.getPhotosOverview", by(album_ids="=array(1, 5)", fields_mask=1, offset=0, limit=1_000_000, is_reverse=False)).groupBy("rq").agg(F.count("*").alias("n")), "n"),
    )


WORDS = "WITH i AS (SELECT doc_id::INT AS id, n_chars AS rate, (doc_id % 30)::BIGINT AS h, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents WHERE doc_id % 17 <> 0), j AS (SELECT id, CASE WHEN id % 2 = 0 THEN rate + 1000 ELSE rate END AS rate, h, w FROM i) "


@query(
    WORDS + """, a AS (SELECT id, rate, row_number() OVER (ORDER BY rate DESC, id) AS r, count(*) OVER () AS n FROM j WHERE list_has_all(w, ['the', 'of'])), b AS (SELECT id, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS n FROM j WHERE (list_contains(w, 'und') OR list_contains(w, 'the')) AND NOT list_contains(w, 'of')),
    c AS (SELECT id, rate, h, row_number() OVER (PARTITION BY CASE WHEN h <> 0 THEN h ELSE 1000000 + id END ORDER BY rate, id) AS q FROM j WHERE list_contains(w, 'and'))
    SELECT 'rate' AS op, 0 AS rq, r AS pos, n || ' ' || id || ' ' || rate AS x FROM a WHERE r <= 10 UNION ALL SELECT 'bool', 0, r, n || ' ' || id FROM b WHERE r <= 10
    UNION ALL SELECT 'group', 0, row_number() OVER (ORDER BY rate, id), id::VARCHAR FROM c WHERE q = 1
    UNION ALL SELECT 'get', id, 0, rate::VARCHAR FROM j"""
)
def e11_search(spark, d):
    from quillon.engines import search

    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("rq"), F.array(F.col("doc_id").cast("int")).alias("id"), F.col("n_chars").cast("int").alias("rate"), F.lit(0).alias("sate"), "text")
    e = engine("search", spark, {})
    e.batch("search.setItem", docs)
    e.batch("search.setHash", docs.withColumn("hash", F.col("rq") % 30))
    e.batch("search.incrRate", docs.where("rq % 2 = 0").withColumns({"rate_type": F.lit(0), "rate_value": F.lit(1000)}))
    e.batch("search.deleteItem", docs.where("rq % 17 = 0"))
    found = e.batch("search.search", search.asked(e, [{"flags": 2 + 4, "limit": 10, "query": "the of"}, {"flags": 8192, "limit": 10, "query": "(und | the) & !of"}, {"flags": 2 + 32, "limit": 1_000_000, "query": "and"}]))
    return _all(
        _places(["rate", "bool", "group"], found, "if(rq = 2, cast(id[0] AS string), concat_ws(' ', total, id[0], rate))"),
        _rows("get", e.batch("search.getRate", docs.where("rq % 17 <> 0").select("rq", "id", F.lit(0).alias("rate_type"))), "rate"),
    )


@query(
    """WITH s AS (SELECT (l_suppkey)::INT AS a, (l_orderkey % 50)::INT AS b, max(l_partkey)::INT AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT a, b, CASE WHEN b = 7 THEN 5 ELSE v END AS v FROM s WHERE b <> 9)
    SELECT 'get' AS op, a * 100 + b AS rq, 0 AS pos, coalesce((SELECT v::VARCHAR FROM t WHERE t.a = s.a AND t.b = s.b), 'none') AS x FROM s WHERE b IN (7, 8, 9)
    UNION ALL SELECT 'range', 0, row_number() OVER (ORDER BY a, b), count(*) OVER () || ' ' || a || ' ' || b || ' ' || v FROM t WHERE (a = 3 AND b >= 10) OR (a = 4 AND b < 5) QUALIFY row_number() OVER (ORDER BY a, b) <= 12
    UNION ALL SELECT 'wild', a, 0, count(*)::VARCHAR FROM t GROUP BY 2"""
)
def e12_seqmap(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("a"), (F.col("l_orderkey") % 50).cast("int").alias("b")).agg(F.max("l_partkey").cast("int").alias("v"))
    e = engine("seqmap", spark, {}, 10)
    r = s.select((F.col("a") * 100 + F.col("b")).alias("rq"), F.array("a", "b").alias("key"), F.array("v").alias("value"), F.when(F.col("b") == 9, 5).otherwise(0).alias("time"), "a", "b")
    e.batch("seqmap.set", r)
    e.batch("seqmap.add", r.withColumn("value", F.array(F.lit(-1))))
    e.batch("seqmap.replace", r.where("b = 7").withColumn("value", F.array(F.lit(5))))
    e.now = 100
    own = r.select("a").distinct().select(F.col("a").alias("rq"), F.array("a").alias("key"))
    return _all(
        _rows("get", e.batch("seqmap.get", r.where("b IN (7, 8, 9)")), "coalesce(cast(value[0] AS string), 'none')"),
        _rows("range", e.call("seqmap.getRange", left=[3, 10], right=[4, 5], limit=12), "concat_ws(' ', total, key[0], key[1], value[0])", "pos"),
        _rows("wild", e.batch("seqmap.getWildcardCount", own), "n"),
    )


@query(
    E + """, u AS (SELECT CASE type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS c, uid, id, (uid % 2 + 1)::INT AS sex, (k % 3)::INT AS city FROM e WHERE type IN ('view', 'click', 'error')), f AS (SELECT c, uid, count(*) AS v, arg_min(city, id) AS city, any_value(sex) AS sex FROM u WHERE c <> 3 GROUP BY 1, 2)
    SELECT 'counter' AS op, c AS rq, 0 AS pos, sum(v)::BIGINT || ' ' || count(*) || ' ' || count(*) FILTER (sex = 1) || ' ' || count(*) FILTER (city = 2) AS x FROM f GROUP BY c UNION ALL SELECT 'views', 3, 0, 'none'
    UNION ALL SELECT 'sub', c, s, count(*)::VARCHAR FROM (SELECT c, id % 4 AS s FROM u WHERE c <> 3) GROUP BY 2, 3
    UNION ALL SELECT 'days', 9, v, n::VARCHAR || ' ' || w FROM (SELECT time // 86400 * 86400 AS v, count(*) AS n, count(DISTINCT uid) AS w FROM e WHERE type = 'signup' GROUP BY 1)
    UNION ALL SELECT 'months', 9, 202401, count(DISTINCT uid)::VARCHAR FROM e WHERE type = 'signup'
    UNION ALL SELECT 'total', 9, 0, count(*)::VARCHAR FROM e WHERE type = 'signup' AND time // 86400 * 86400 BETWEEN 1704844800 AND 1705708800"""
)
def e13_statsx(spark, d):
    ev = log(spark, d)
    u = ev.where("type IN ('view', 'click', 'error')").select(F.col("id").alias("rq"), F.when(F.col("type") == "view", 1).when(F.col("type") == "click", 2).otherwise(3).alias("cnt_id"), F.col("uid").cast("int").alias("uid"), F.lit(33).alias("mode"), (F.col("uid") % 2 + 1).cast("int").alias("sex"), (F.col("k") % 3).cast("int").alias("city"), *(F.lit(None).cast("string").alias(c) for c in ("geoip_country", "country")), *(F.lit(None).cast("int").alias(c) for c in ("age", "marital_status", "political_views", "section", "source")))
    e = engine("statsx", spark, {}, 1_706_600_000)
    e.call("statsx.disableCounter", cnt_id=3)
    e.batch("statsx.incr", u)
    e.batch("statsx.incrSubcnt", u.withColumn("subcnt_id", F.col("rq") % 4))
    day = ev.where("type = 'signup'").select(F.col("id").alias("rq"), F.lit(9).alias("cnt_id"), (F.floor(F.col("time") / 86400) * 86400).cast("int").alias("version"), F.col("uid").cast("int").alias("uid"), F.lit(0).alias("mode"), *(F.lit(None).alias(c) for c in ("sex", "age", "marital_status", "political_views", "section", "city", "geoip_country", "country", "source")))
    e.batch("statsx.incrVersion", day)
    c = spark.range(1, 4).select(F.col("id").alias("rq"), F.col("id").alias("cnt_id"))
    whole = e.batch("statsx.getCounter", c)
    days = day.select("version").distinct().select(F.col("version").alias("rq"), F.lit(9).alias("cnt_id"), "version")
    both = e.batch("statsx.getViewsVersion", days).join(e.batch("statsx.getVisitorsVersion", days), "rq")
    return _all(
        _rows("counter", whole.where("rq < 3"), "concat_ws(' ', views, visitors, sex['1'], coalesce(city['2'], 0))"), _rows("views", e.batch("statsx.getViews", c.where("rq = 3")), "coalesce(cast(views AS string), 'none')"),
        _rows("sub", whole.where("rq < 3").select("rq", F.explode("extra").alias("s", "n")), "n", "s"), _rows("days", both.select(F.lit(9).alias("rq"), F.col("rq").alias("v"), "views", "visitors"), "concat_ws(' ', views, visitors)", "v"),
        _rows("months", e.call("statsx.getMonthlyVisitors", cnt_id=9).withColumn("rq", F.lit(9)), "count", "year * 100 + month"), _rows("total", e.call("statsx.getCountersSum", cnt_id=9, **{"from": 1_704_844_800, "to": 1_705_708_800}).withColumn("rq", F.lit(9)), "views"),
    )


@query(
    """WITH c AS (SELECT c_custkey::INT AS id, (c_nationkey % 3)::INT AS sex, c_nationkey::INT AS country, (c_custkey * 7 % 100)::INT AS rate, (1950 + c_custkey % 50)::INT AS y FROM customer), g AS (SELECT DISTINCT o_custkey::INT AS id, (o_orderkey % 9)::INT AS g FROM orders),
    a AS (SELECT 1 AS ad, 30 AS price, id FROM c WHERE sex = 1 UNION ALL SELECT 2, 20, id FROM c WHERE y >= 1980 UNION ALL SELECT 3, 25, id FROM c WHERE country = 4), p AS (SELECT id, ad, price, row_number() OVER (PARTITION BY id ORDER BY price DESC, ad) AS r FROM a),
    h AS (SELECT least(price, 29) AS b, count(*) AS n FROM p JOIN c USING (id) WHERE y >= 1975 AND r = 1 GROUP BY 1)
    SELECT 'reach' AS op, ad AS rq, 0 AS pos, count(*)::VARCHAR AS x FROM a GROUP BY 2
    UNION ALL SELECT 'price', 0, b, n::VARCHAR FROM h
    UNION ALL SELECT 'audience', 0, 0, count(*)::VARCHAR FROM c WHERE y >= 1975 UNION ALL SELECT 'audience', 0, 1, count(*)::VARCHAR FROM c WHERE y >= 1975 AND country = 4 UNION ALL SELECT 'audience', 0, 2, count(DISTINCT id)::VARCHAR FROM c JOIN g USING (id) WHERE y >= 1975 AND g = 5
    UNION ALL SELECT 'found', 0, row_number() OVER (ORDER BY rate DESC, id DESC), id::VARCHAR FROM c WHERE sex = 2 QUALIFY row_number() OVER (ORDER BY rate DESC, id DESC) <= 7
    UNION ALL SELECT 'ads', id, row_number() OVER (PARTITION BY id ORDER BY price DESC, ad), ad::VARCHAR FROM p"""
)
def e14_targ(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("rq"), F.col("c_custkey").cast("int").alias("uid"), (F.col("c_nationkey") % 3).cast("int").alias("value"), F.col("c_nationkey").cast("int").alias("country"), F.lit(0).alias("city"), (F.col("c_custkey") * 7 % 100).cast("int").alias("rate"), F.lit(0).alias("cute"), F.lit(1).alias("day"), F.lit(1).alias("month"), (1950 + F.col("c_custkey") % 50).cast("int").alias("year"))
    e = engine("targ", spark, {}, 1000)
    e.batch("targ.setSex", c)
    e.batch("targ.setCountryCity", c)
    e.batch("targ.setRates", c)
    e.batch("targ.setBirthday", c)
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("int").alias("uid")).agg(F.collect_set((F.col("o_orderkey") % 9).cast("int")).alias("groups")).withColumn("rq", F.col("uid"))
    e.batch("targ.addUserGroups", g)
    ads = spark.createDataFrame([(1, 30, "sex=1"), (2, 20, "bday_year>=1980"), (3, 25, "country=4")], "ad int, cost_per_click int, query string").withColumns({"rq": F.col("ad"), "mode": F.lit(0), "discount": F.lit(0)})
    reach = e.batch("targ.target", ads)
    base = "bday_year>=1975"
    return _all(
        _rows("reach", reach, "users"),
        _rows("price", e.call("targ.prices", mode=0, place=1, and_mask=0, xor_mask=0, limit=30, user_list=[], query=base).where("users > 0"), "users", "bucket"),
        _rows("audience", e.call("targ.audience", mode=0, user_list=[], aux_queries=["country=4", "group.id=5"], query=base), "total", "pos"),
        _rows("found", e.call("targ.search", mode=1 + 4, limit=7, user_list=[], query="sex=2"), "uid", "pos"),
        _rows("ads", e.batch("targ.userAds", c.withColumns({"limit": F.lit(10), "flags": F.lit(0), "and_mask": F.lit(0), "or_mask": F.lit(0), "cat_mask": F.lit(0)})), "ad", "pos"),
    )


@query(
    """WITH m AS (SELECT (conv_id % 20)::INT AS u, conv_id::INT AS peer, turn, text, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id * 1000 + turn)::INT AS l FROM conversations), f AS (SELECT *, CASE WHEN l % 3 = 0 THEN 5 WHEN l % 3 = 1 THEN 1 ELSE 0 END AS f FROM m WHERE NOT (l < 3 OR l % 10 = 0)),
    t AS (SELECT u, peer, max(l) AS l FROM f GROUP BY 1, 2), p AS (SELECT u, peer, l, row_number() OVER (PARTITION BY u ORDER BY l DESC) AS r, count(*) OVER (PARTITION BY u) AS n FROM t),
    s AS (SELECT u, l, row_number() OVER (PARTITION BY u ORDER BY l DESC) AS r, count(*) OVER (PARTITION BY u) AS n FROM f WHERE f & 1 = 1),
    q AS (SELECT u, l, row_number() OVER (PARTITION BY u ORDER BY l DESC) AS r, count(*) OVER (PARTITION BY u) AS n FROM f WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)'))
    SELECT 'flags' AS op, u * 100000 + l AS rq, 0 AS pos, f::VARCHAR AS x FROM f UNION ALL SELECT 'top', u, r, n || ' ' || peer || ' ' || l FROM p WHERE r <= 3 UNION ALL SELECT 'sub', u, r - 1, n || ' ' || l FROM s WHERE r BETWEEN 2 AND 5
    UNION ALL SELECT 'search', u, r, n || ' ' || l FROM q WHERE r <= 4 UNION ALL SELECT 'extra', u * 100000 + l, 2, (l * 3)::VARCHAR FROM f WHERE l % 4 = 0
    UNION ALL SELECT 'online', 1, x, '8' FROM (VALUES (2), (3)) v(x) UNION ALL SELECT 'online', 2, 1, '8' UNION ALL SELECT 'online', 2, 2, '9'"""
)
def e15_text(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("rq"), (F.col("conv_id") % 20).cast("int").alias("uid"), F.col("conv_id").cast("int").alias("peer_id"), "text")
    e = engine("text", spark, {}, 1000)
    e.batch("text.sendMessage", c.withColumns({"mode": F.lit(0), "flags": F.lit(0), "kludges": F.lit(""), "random_id": F.col("rq") + 1, **{k: F.lit(0) for k in ("date", "ip", "port", "front", "ua_hash", "legacy_id")}}))
    one = e.state["messages"].select((F.col("uid") * 100000 + F.col("local_id")).alias("rq"), "uid", "local_id")
    users = c.select("uid").distinct().withColumn("rq", F.col("uid").cast("bigint"))
    e.batch("text.deleteFirstMessages", users.withColumn("min_local_id", F.lit(3)))
    e.batch("text.deleteMessage", one.where("local_id % 10 = 0"))
    e.batch("text.incrMessageFlags", one.where("local_id % 3 = 0").withColumn("flags", F.lit(7)))
    e.batch("text.decrMessageFlags", one.where("local_id % 3 = 0").withColumn("flags", F.lit(2)))
    e.batch("text.setMessageFlags", one.where("local_id % 3 = 1").withColumn("flags", F.lit(1)))
    e.batch("text.incrMessageextra", one.where("local_id % 4 = 0").withColumns({"k": F.lit(2), "value": F.col("local_id") * 3}))
    left = one.where("NOT (local_id < 3 OR local_id % 10 = 0)")
    e.call("text.online", uid=2, friends=[1])
    e.call("text.online", uid=3, friends=[1])
    e.call("text.online", uid=1, friends=[2])
    e.call("text.online", uid=1, friends=[2])
    e.call("text.offline", uid=1, friends=[2])
    events = spark.range(1, 3).select(F.col("id").alias("rq"), F.col("id").cast("int").alias("uid"), F.lit(0).alias("timestamp"), F.lit(10).alias("limit"))
    h = e.batch("text.history", events)
    return _all(
        _rows("flags", e.batch("text.getMessageFlags", left), "flags"),
        _rows("top", e.batch("text.topMsgList", users.withColumns({"from": F.lit(1), "to": F.lit(3)})), "concat_ws(' ', total, peer_id, local_id)", "pos"),
        _rows("sub", e.batch("text.sublistShort", users.withColumns({"and_mask": F.lit(1), "or_mask": F.lit(1), "from": F.lit(2), "to": F.lit(5)})), "concat_ws(' ', total, local_id)", "pos"),
        _rows("search", e.batch("text.search", users.withColumns({"num": F.lit(4), "query": F.lit("the")})), "concat_ws(' ', total, local_id)", "pos"),
        _rows("extra", e.batch("text.getMessageextra", left.where("local_id % 4 = 0").withColumn("k", F.lit(2))), "value", "2"),
        _rows("online", h, "event_id", "if(rq = 2, pos, who)"),
    )


@query(
    E + """, w AS (SELECT (uid % 30)::INT AS v, (k % 4)::INT AS c, tanh(sum(atanh((k % 10 + 1) / 50.0))) AS x FROM e GROUP BY 1, 2)
    SELECT 'at' AS op, v * 10 + c AS rq, 0 AS pos, round(x * CASE WHEN c = 1 THEN 0.25 ELSE 0.5 END, 5)::DECIMAL(10,5)::VARCHAR AS x FROM w
    UNION ALL SELECT 'share', 0, v * 10 + c, round(x * CASE WHEN c = 1 THEN 0.25 ELSE 0.5 END, 5)::DECIMAL(10,5)::VARCHAR FROM w WHERE v % 7 = 2 AND c IN (1, 3)
    UNION ALL SELECT 'blob', 1, l, substr(p_name, 1, 4) FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS l FROM part WHERE p_partkey % 2 = 1)
    UNION ALL SELECT 'fits', 1, 0, 'true' UNION ALL SELECT 'random', 0, 0, '32'"""
)
def e16_weights_storage(spark, d):
    w = engine("weights", spark, {}, 0)
    ev = log(spark, d).select(F.col("id").alias("rq"), (F.col("uid") % 30).cast("int").alias("vector_id"), (F.col("k") % 4).cast("int").alias("coord_id"), ((F.col("k") % 10 + 1) / 50.0 * (1 << 30)).cast("int").alias("value"))
    w.call("weights.setHalfLife", coord_id=1, half_life=15 * 86400)
    w.batch("weights.incr", ev)
    w.now = 30 * 86400
    pairs = ev.select("vector_id", "coord_id").distinct().withColumn("rq", F.col("vector_id") * 10 + F.col("coord_id"))
    near = f"cast(cast(round(weight / {1 << 30}, 5) AS decimal(10,5)) AS string)"
    s = engine("storage", spark, {"volumes": spark.createDataFrame([(1, 1 << 40, True)], "volume_id bigint, capacity bigint, enabled boolean")})
    p = table(spark, d, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("rq"), F.lit(1).alias("volume_id"), F.base64(F.encode("p_name", "UTF-8")).alias("file_data"))
    at = s.batch("storage.uploadFile", p)
    parts = s.batch("storage.getPart", at.withColumns({"offset": F.lit(0), "limit": F.lit(4)})).join(at.select("rq", "local_id"), "rq")
    return _all(
        _rows("at", w.batch("weights.at", pairs), near),
        _rows("share", w.call("weights.subscribe", vector_rem=2, vector_mod=7, coord_ids=[1, 3], updates_start_time=0, updates_limit=1000), near, "vector_id * 10 + coord_id"),
        _rows("blob", parts.withColumns({"text": F.col("content").cast("string"), "rq": F.lit(1)}), "text", "local_id"),
        _rows("fits", s.call("storage.checkFile", volume_id=1, file_size=10, max_disk_used_space_percent=90.0).withColumn("rq", F.lit(1)), "ok"),
        _rows("random", engine("random", spark, {}).call("random.random", n=32), "octet_length(bytes)"),
    )


@query(
    LISTS + """, c AS (SELECT c_custkey AS id, c_nationkey AS n, c_custkey * 7 % 100 AS rate FROM customer), w AS (SELECT doc_id, n_chars, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
    t AS (SELECT s, o, l, f, d, v, row_number() OVER (PARTITION BY s ORDER BY o, l) AS r FROM e WHERE s % 5 = 2)
    SELECT 'bits' AS op, s AS rq, r AS pos, 'flags ' || f || ' date ' || d || ' value none' AS x FROM t WHERE r <= 3
    UNION ALL SELECT 'up', 0, row_number() OVER (ORDER BY n_chars, doc_id), doc_id::VARCHAR FROM w WHERE list_contains(w, 'the') QUALIFY row_number() OVER (ORDER BY n_chars, doc_id) <= 5
    UNION ALL SELECT 'down', 0, row_number() OVER (ORDER BY n_chars DESC, doc_id), doc_id::VARCHAR FROM w WHERE list_contains(w, 'the') QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 5
    UNION ALL SELECT 'ids', 0, row_number() OVER (ORDER BY doc_id DESC), doc_id::VARCHAR FROM w WHERE list_contains(w, 'the') OR list_contains(w, 'und') QUALIFY row_number() OVER (ORDER BY doc_id DESC) <= 5
    UNION ALL SELECT 'friends', c_custkey % 10, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey), c_nationkey + 1 || ' none' FROM customer WHERE c_custkey % 10 < 3
    UNION ALL SELECT 'seen', 1, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'gone' ELSE 'there' END FROM part WHERE p_partkey BETWEEN 1 AND 40
    UNION ALL SELECT 'fields', conv_id * 1000 + turn, 0, length(text) || ' none ' || conv_id FROM conversations WHERE turn = 1
    UNION ALL SELECT 'order', 0, row_number() OVER (ORDER BY id DESC), id::VARCHAR FROM c WHERE n = 4 QUALIFY row_number() OVER (ORDER BY id DESC) <= 6"""
)
def e17_mode_flags(spark, d):
    """Bits and letters that change what an operation shows or how it sorts."""
    from quillon.engines.search import batch_by_letters

    lists = _lists(spark, d)
    by = table(spark, d, "supplier").where("s_suppkey % 5 = 2").select(F.col("s_suppkey").alias("rq"), F.array("s_suppkey").alias("list_id"), F.lit(64 + 128).alias("mode"), F.lit(3).alias("limit"), F.lit(0).alias("offset"))
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    found = engine("search", spark, {"items": docs.select(F.array(F.col("doc_id").cast("int")).alias("id"), F.create_map(F.lit(0), F.col("n_chars").cast("int")).alias("rates"), "text")})
    c = table(spark, d, "customer")
    f = engine("friends", spark, {"friends": c.where("c_custkey % 10 < 3").select((F.col("c_custkey") % 10).cast("int").alias("uid"), F.col("c_custkey").cast("int").alias("friend"), (F.col("c_nationkey") + 1).alias("mask"), F.lit(5).alias("time"))})
    users = spark.range(3).select(F.col("id").alias("rq"), F.col("id").alias("uid"), F.lit(0).alias("mask"), F.lit(1).alias("mode"))
    p = table(spark, d, "part").where("p_partkey BETWEEN 1 AND 40").select(F.lit("photo").alias("kind"), F.lit(1).alias("owner_id"), F.col("p_partkey").cast("int").alias("id"), F.lit(2).alias("album_id"), (F.col("p_partkey") % 4 == 0).alias("deleted"), F.col("p_partkey").cast("double").alias("place"))
    photos = engine("photo", spark, {"objects": p})
    show = lambda mask: photos.call("photo.getPhotos", owner_id=1, album_id=2, fields_mask=mask, offset=0, limit=1000, is_reverse=False, condition="")
    every = show(1 + (1 << 29)).select("id").join(show(1).select("id", F.lit(True).alias("t")), "id", "left").select(F.lit(1).alias("rq"), "id", F.when(F.col("t"), "there").otherwise("gone").alias("s"))
    conv = table(spark, d, "conversations").where("turn = 1")
    texts = engine("text", spark, {"messages": conv.select(F.lit(1).alias("uid"), (F.col("conv_id") * 1000 + F.col("turn")).cast("int").alias("local_id"), F.col("conv_id").cast("int").alias("peer_id"), "text", F.lit(9).alias("date"))})
    one = texts.state["messages"].select(F.col("local_id").alias("rq"), "uid", "local_id", F.lit(16 + 128).alias("flags"), F.lit(0).alias("max_len"))
    t = engine("targ", spark, {"users": c.select(F.col("c_custkey").cast("int").alias("id"), F.col("c_nationkey").alias("country"), (F.col("c_custkey") * 7 % 100).cast("int").alias("rate"))})
    none = "coalesce(cast({} AS string), 'none')".format
    return _all(
        _rows("bits", lists.batch("lists.getListFullLimit", by), f"concat('flags ', flags, ' date ', date, ' value ', {none('value')})", "pos"),
        _places(["up", "down", "ids"], batch_by_letters(found, [("r", 5, "the"), ("R", 5, "the"), ("XI", 5, "the | und")]), "id[0]"),
        _rows("friends", f.batch("friends.getFriends", users), f"concat(mask, ' ', {none('time')})", "pos"), _rows("seen", every, "s", "id"),
        _rows("fields", texts.batch("text.getMessage", one), f"concat(length(text), ' ', {none('date')}, ' ', peer_id)"),
        _rows("order", t.call("targ.search", mode=2 + 4, limit=6, user_list=[], query="country=4"), "uid", "pos"),
    )


@query(
    LISTS + """SELECT 'list' AS op, 3 AS rq, row_number() OVER (ORDER BY o DESC, l DESC) AS pos, o || ':' || l AS x FROM e WHERE s = 3 QUALIFY row_number() OVER (ORDER BY o DESC, l DESC) <= 4
    UNION ALL SELECT 'value', 0, 0, '14' UNION ALL SELECT 'count', 4, 0, count(*)::VARCHAR FROM e WHERE s = 4 AND f & 7 <> 2 UNION ALL SELECT 'cached', 0, 0, '12'"""
)
def s15_text_commands(spark, d):
    from quillon.engines.protocol import execute

    e, m = _lists(spark, d), engine("memcache", spark, {})
    for command, value in (("set entry999_1:2", "3,10"), ("incr value999_1:2", "4"), ("delete list4,2", "")):
        execute(e, "lists", command, value)
    for command, value in (("set k", "7"), ("add k", "9"), ("incr k", "5")):
        execute(m, "memcache", command, value)
    return _all(
        _rows("list", execute(e, "lists", "get list3,16#4").withColumn("rq", F.lit(3)), "concat(object_id[0], ':', object_id[1])", "pos"), _rows("value", execute(e, "lists", "get value999_1:2"), "value"),
        _rows("count", execute(e, "lists", "get count4").withColumn("rq", F.lit(4)), "n"), _rows("cached", execute(m, "memcache", "get k"), "value"),
    )


@query("WITH s AS (SELECT event_type AS type, round(avg(value), 6) AS mean, floor(max(value) - min(value))::BIGINT AS spread, round(sum(value * 2 + user_id), 4) AS total FROM events GROUP BY 1) SELECT type, mean, spread, total, len(type) AS letters FROM s")
def sf10_user_code(spark, d):
    """A scalar, an SQL, an aggregate and a table function of the user's, and a formula."""
    from quillon.functions import user

    user.register_scalar(spark, "q_letters", len, "int")
    user.register_sql(spark, "q_double", "x DOUBLE", "DOUBLE", "x * 2")
    user.register_aggregate(spark, "q_spread", lambda v: float(int(v.max() - v.min())), "double")
    user.register_table(spark, "q_letters_of", lambda t: ((c,) for c in t), "c string")
    e = table(spark, d, "events").withColumn("own", user.formula(table(spark, d, "events"), "value * 2 + user_id"))
    e.createOrReplaceTempView("q_events")
    s = spark.sql("SELECT type, mean, cast(spread AS bigint) AS spread, total FROM (SELECT event_type AS type, round(sum(q_double(value)) / 2 / count(*), 6) AS mean, round(sum(own), 4) AS total FROM q_events GROUP BY event_type) JOIN (SELECT event_type AS type, q_spread(value) AS spread FROM q_events GROUP BY event_type) USING (type)")
    s.createOrReplaceTempView("q_sums")
    return spark.sql("SELECT type, mean, spread, total, count(c) AS letters FROM q_sums, LATERAL q_letters_of(type) GROUP BY type, mean, spread, total HAVING q_letters(type) = count(c)")
