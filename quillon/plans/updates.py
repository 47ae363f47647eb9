"""Keyed updates as tables of the last state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import lists
from quillon.plans.events import E, log
from quillon.plans.registry import query, table

C = "SELECT c_custkey AS id, c_acctbal AS v FROM customer "


def _base(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))


def _changes(spark, d):
    return table(spark, d, "customer").where("c_custkey % 9 = 0").select((F.col("c_custkey") * 2).alias("id"), F.lit(1.0).alias("v"))


N = "(SELECT c_custkey * 2 AS id, 1.0::DOUBLE AS v FROM customer WHERE c_custkey % 9 = 0) n"


@query(f"SELECT coalesce(n.id, b.id) AS id, coalesce(n.v, b.v) AS v FROM ({C}) b FULL JOIN {N} ON n.id = b.id")
def u1_set_entries(spark, d):
    return lists.upsert(_base(spark, d), _changes(spark, d), ["id"])


@query(f"SELECT coalesce(n.id, b.id) AS id, coalesce(b.v, n.v) AS v FROM ({C}) b FULL JOIN {N} ON n.id = b.id")
def u1_add_entries(spark, d):
    return lists.upsert(_base(spark, d), _changes(spark, d), ["id"], "add")


@query(f"SELECT b.id, coalesce(n.v, b.v) AS v FROM ({C}) b LEFT JOIN {N} ON n.id = b.id")
def u1_replace_entries(spark, d):
    return lists.upsert(_base(spark, d), _changes(spark, d), ["id"], "replace")


@query(f"SELECT b.id, b.v FROM ({C}) b ANTI JOIN {N} ON n.id = b.id")
def u1_delete_entries(spark, d):
    return lists.delete(_base(spark, d), _changes(spark, d), ["id"])


@query(E + "SELECT uid, CAST(sum(k) AS BIGINT) AS v FROM e WHERE k IS NOT NULL GROUP BY 1")
def u2_increment_entries(spark, d):
    e = log(spark, d).where("k IS NOT NULL").select("uid", F.col("k").cast("bigint").alias("v"))
    return lists.increment(e.select("uid").distinct().withColumn("v", F.lit(0).cast("bigint")), e, ["uid"], "v")


@query("SELECT p_partkey, CASE WHEN (p_size & 7) = 3 THEN (p_size & -8) | 5 ELSE p_size END AS flags FROM part")
def u3_bulk_flags(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("flags"))
    return lists.change_flags(p, F.col("flags").bitwiseAND(F.lit(7)) == 3, "flags", -8, 5)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def u4_fetch_entry(spark, d):
    return table(spark, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'edited' ELSE role END AS role, CASE WHEN turn = 1 THEN 9 ELSE 1 END AS flags FROM conversations WHERE turn <> 3")
def u5_messages(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lit(1).alias("flags"))
    c = lists.upsert(c, c.where("turn % 2 = 0").withColumn("role", F.lit("edited")), ["conv_id", "turn"])
    c = lists.change_flags(c, F.col("turn") == 1, "flags", -1, 8)
    return lists.delete(c, c.where("turn = 3"), ["conv_id", "turn"])


@query("SELECT conv_id, turn FROM conversations WHERE conv_id = 4 AND turn = 1")
def u6_message_lookup(spark, d):
    return table(spark, d, "conversations").where("conv_id = 4 AND turn = 1").select("conv_id", "turn")


@query('SELECT o_custkey AS "user", o_orderkey % 100 AS friend, max(o_orderkey) AS since FROM orders GROUP BY 1, 2 HAVING arg_max(o_orderstatus, o_orderkey) <> \'P\'')
def u7_friend_log(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), (F.col("o_orderkey") % 100).alias("friend"), F.col("o_orderkey").alias("since"), (F.col("o_orderstatus") == "P").alias("gone"))
    return lists.latest(o, ["user", "friend"], ["since"], "gone")


@query("SELECT id, rules FROM (VALUES (1, '+A'), (3, '+G')) t(id, rules)")
def u8_privacy_settings(spark, d):
    changes = spark.createDataFrame([(1, "+7", 1, False), (2, "+A", 1, False), (1, "+A", 2, False), (2, "", 3, True), (3, "+G", 4, False)], "id int, rules string, seq int, gone boolean")
    return lists.latest(changes, ["id"], ["seq"], "gone").select("id", "rules")


@query(E + "SELECT id, uid FROM e WHERE type = 'view' AND id NOT IN (SELECT id FROM e WHERE k % 4 = 0)")
def u9_hidden_items(spark, d):
    e = log(spark, d)
    return lists.delete(e.where("type = 'view'"), e.where("k % 4 = 0"), ["id"]).select("id", "uid")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def u10_retention(spark, d):
    return table(spark, d, "events").where("ts >= TIMESTAMP'2024-01-30' - INTERVAL 7 DAYS").select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey > 10 OR l_orderkey = 10 AND l_linenumber >= 2) AND (l_orderkey < 300 OR l_orderkey = 300 AND l_linenumber < 3)")
def u11_vector_key_range(spark, d):
    li = table(spark, d, "lineitem").withColumn("key", F.array(F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")))
    low, high = (F.array(*(F.lit(x).cast("bigint") for x in v)) for v in ((10, 2), (300, 3)))
    return li.where((F.col("key") >= low) & (F.col("key") < high)).select("l_orderkey", "l_linenumber")


@query("SELECT c_name, c_acctbal FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def u12_prefix_get(spark, d):
    return table(spark, d, "customer").where(F.startswith("c_name", F.lit("Customer#00000001"))).select("c_name", "c_acctbal")


@query(E + "SELECT uid, arg_max(value, time * 1000000 + id) AS value FROM e GROUP BY 1 HAVING max(time) + 200000 > 1706600000")
def u13_expiring_values(spark, d):
    return lists.latest(log(spark, d).select("uid", "value", "time", "id"), ["uid"], ["time", "id"]).where("time + 200000 > 1706600000").select("uid", "value")


@query("SELECT p_partkey, p_brand, CASE WHEN p_size > 45 THEN 'restored' ELSE 'plain' END AS state FROM part WHERE p_size > 45 OR p_size % 5 <> 0")
def u14_albums(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    log_ = p.select("p_partkey", "p_brand", F.lit("plain").alias("state"), F.lit(0).alias("v"), F.lit(False).alias("gone"))
    log_ = log_.union(p.where("p_size % 5 = 0").select("p_partkey", "p_brand", F.lit("gone"), F.lit(1), F.lit(True))).union(p.where("p_size > 45").select("p_partkey", "p_brand", F.lit("restored"), F.lit(2), F.lit(False)))
    return lists.latest(log_, ["p_partkey"], ["v"], "gone").select("p_partkey", "p_brand", "state")


@query("SELECT c_custkey AS id, c_nationkey AS city, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS school FROM customer")
def u15_profile_setters(spark, d):
    c = table(spark, d, "customer")
    sets = c.select(F.col("c_custkey").alias("id"), F.lit("city").alias("field"), F.col("c_nationkey").cast("string").alias("v")).union(c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("school"), "c_mktsegment"))
    return sets.groupBy("id").pivot("field", ["city", "school"]).agg(F.max("v")).select("id", F.col("city").cast("int").alias("city"), "school")


@query("SELECT p_partkey AS ad, CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE p_retailprice END AS price FROM part WHERE p_size % 11 <> 0")
def u16_ad_settings(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ad"), F.col("p_retailprice").alias("price"), "p_size")
    out = lists.upsert(p, p.where("p_size % 2 = 0").withColumn("price", F.lit(0.0)), ["ad"])
    return out.where("p_size % 11 <> 0").select("ad", "price")


@query("SELECT o_orderkey AS t, o_custkey AS account, -o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, -1, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def u17_ledger(spark, d):
    """Both legs of each committed transaction; they add up to zero."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("t"), F.explode(F.array(F.struct(F.col("o_custkey").alias("account"), (-F.col("o_totalprice")).alias("amount")), F.struct(F.lit(-1).cast("bigint").alias("account"), F.col("o_totalprice").alias("amount")))).alias("leg")).select("t", "leg.account", "leg.amount")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 6 <> 0")
def u18_disabled_copies(spark, d):
    s = table(spark, d, "supplier")
    return lists.delete(s, s.where("s_suppkey % 6 = 0"), ["s_suppkey"]).select("s_suppkey", "s_nationkey", "s_acctbal")


@query("SELECT event_type AS type, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def u19_counter_time_zone(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("type"), F.date_format(F.from_utc_timestamp("ts", "+03:00"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(sum(w) AS BIGINT) AS w FROM (SELECT doc_id, 1 AS w FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, -1 FROM labels WHERE toxic = 1 AND doc_id % 3 = 0) GROUP BY 1 HAVING sum(w) > 0")
def u20_training_operations(spark, d):
    y = table(spark, d, "labels").where("toxic = 1")
    ops = y.select("doc_id", F.lit(1).alias("w")).union(y.where("doc_id % 3 = 0").select("doc_id", F.lit(-1)))
    return ops.groupBy("doc_id").agg(F.sum("w").alias("w")).where("w > 0")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 13 <> 0")
def u21_exceptions(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return lists.delete(o, o.where("o_orderkey % 13 = 0"), ["o_custkey", "o_orderkey"])


@query("SELECT p_partkey, p_type AS text FROM part WHERE p_size > 10")
def u22_hint_objects(spark, d):
    p = table(spark, d, "part")
    log_ = p.select("p_partkey", F.col("p_name").alias("text"), F.lit(0).alias("v"), "p_size").union(p.select("p_partkey", F.col("p_type"), F.lit(1), "p_size"))
    return lists.latest(log_, ["p_partkey"], ["v"]).where("p_size > 10").select("p_partkey", "text")


@query("SELECT o_orderkey AS task, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END AS priority FROM orders WHERE o_orderstatus <> 'F'")
def u23_task_queue(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), "o_custkey", "o_orderstatus")
    changed = lists.upsert(o, o.where("o_custkey % 7 = 0").withColumn("priority", F.lit(1)), ["task"])
    return changed.where("o_orderstatus <> 'F'").select("task", "priority")


@query("SELECT 16 AS n, count(*) AS tokens FROM range(100)")
def u24_random_bytes(spark, d):
    r = spark.range(100).select(F.hex(F.substring(F.unhex(F.sha2(F.concat(F.uuid(), F.col("id").cast("string")), 256)), 1, 8)).alias("h"))
    return r.groupBy(F.length("h").alias("n")).agg(F.count("*").alias("tokens"))


LEDGER = """WITH l AS (SELECT o_orderkey AS t, o_custkey AS a, o_orderstatus AS s, o_totalprice AS x, o_orderkey % 7 AS k FROM orders),
s AS (SELECT *, CASE WHEN k = 0 THEN 'cancelled' WHEN k = 1 THEN 'locked' WHEN k = 2 THEN 'declared' WHEN k = 3 THEN 'locked' ELSE 'committed' END AS state FROM l) """


def _ledger(spark, d):
    """Orders as transactions from a customer to account -1: locked and committed, cancelled, left open, or committed after the lock has run out."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_custkey").alias("a"), F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 7).alias("k"))
    legs = o.select("t", F.explode(F.array(F.struct(F.col("a").alias("account"), (-F.col("x")).alias("amount")), F.struct(F.lit(-1).cast("bigint").alias("account"), F.col("x").alias("amount")))).alias("l")).select("t", "l.account", F.lit(1).alias("currency"), "l.amount")
    ops = F.expr("CASE WHEN k = 0 THEN array('declare', 'cancel', 'lock', 'commit') WHEN k = 1 THEN array('declare', 'lock') WHEN k = 2 THEN array('declare', 'commit', 'declare') WHEN k = 3 THEN array('declare', 'lock', 'wait', 'commit') ELSE array('declare', 'lock', 'commit', 'cancel') END")
    events = o.select("t", F.posexplode(ops).alias("seq", "op")).withColumns({"at": F.when(F.col("op") == "commit", F.col("seq") * 100).otherwise(F.col("seq")).cast("bigint"), "until": F.when(F.col("op") == "lock", 250).cast("bigint")})
    return legs, events


@query(LEDGER + "SELECT t, state FROM s")
def u17_transaction_states(spark, d):
    from quillon.operators import ledger

    return ledger.states(_ledger(spark, d)[1])


@query(LEDGER + ", b AS (SELECT a AS account, -x AS amount, state FROM s UNION ALL SELECT -1, x, state FROM s) SELECT account, round(sum(CASE WHEN state = 'committed' THEN amount ELSE 0 END), 2) AS balance, round(sum(CASE WHEN state = 'locked' AND amount < 0 THEN -amount ELSE 0 END), 2) AS locked FROM b GROUP BY 1")
def u17_balances_and_locks(spark, d):
    from quillon.operators import ledger

    legs, events = _ledger(spark, d)
    return ledger.balances(legs, ledger.states(events)).select("account", F.round("balance", 2).alias("balance"), F.round("locked", 2).alias("locked"))


@query("SELECT conv_id, turn, md5(text) AS patched, true AS smaller FROM conversations WHERE turn > 0")
def t15_diff_and_patch(spark, d):
    """Each turn as a patch of itself with a passage put in the middle."""
    from quillon.operators import diffs

    c = table(spark, d, "conversations").where("turn > 0").select("conv_id", "turn", "text")
    old = F.concat(F.substring("text", 1, 40), F.lit("~~ something else that goes again ~~"), F.substring("text", 41, 1 << 30))
    c = c.withColumn("old", old).withColumn("p", diffs.diff_column(F.col("old"), F.col("text")))
    return c.select("conv_id", "turn", F.md5(diffs.patch_column(F.col("old"), F.col("p"))).alias("patched"), (F.octet_length("p") < F.octet_length("text") + 40).alias("smaller"))
