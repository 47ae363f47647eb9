"""Logs, snapshots, indexes and outside formats (s), streams (x): each written or streamed, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators.sets import range_join
from quillon.plans.events import E, log
from quillon.plans.predicates import B, _born
from quillon.plans.registry import query, table
from quillon.sources import dumps, logs, postings
from quillon.sources.scratch import new_path
from quillon.streaming import queues

CHANGES = E + ", c AS (SELECT id AS seq, time AS ts, uid AS key, CASE WHEN type = 'error' AND k % 3 = 0 THEN 'delete' ELSE 'set' END AS op, k || ':' || type AS payload FROM e) "


def _changes(spark, d):
    e = log(spark, d)
    op = F.when((F.col("type") == "error") & (F.col("k") % 3 == 0), "delete").otherwise("set")
    return e.select(F.col("id").alias("seq"), F.col("time").cast("bigint").alias("ts"), F.col("uid").cast("bigint").alias("key"), op.alias("op"), F.concat_ws(":", "k", "type").alias("payload"))


def _log(spark, d, name="log"):
    path = new_path(spark, name)
    logs.create(spark, path, 7)
    logs.append(_changes(spark, d).withColumn("seq", F.col("seq") + 1), path)
    return logs.read(spark, path).withColumn("seq", F.col("seq") - 1), path


LAST = "l AS (SELECT key, arg_max(op, seq) AS op, arg_max(payload, seq) AS payload, max(seq) AS seq FROM c {} GROUP BY key) "


@query(CHANGES + ", " + LAST.format("WHERE ts <= 1705708800") + "SELECT key, seq, payload FROM l WHERE op <> 'delete'")
def s1_replay_to_a_time(spark, d):
    return logs.replay(_log(spark, d)[0], 1_705_708_800)


@query(CHANGES + "SELECT count(*) + 1 AS n, max(seq) + 1 AS seq FROM c")
def s2_append(spark, d):
    _, path = _log(spark, d)
    return logs.tag(logs.read(spark, path)).select("n", "seq")


@query(CHANGES + ", " + LAST.format("") + "SELECT key, seq, payload FROM l WHERE op <> 'delete'")
def s3_snapshot_and_tail(spark, d):
    rows, _ = _log(spark, d)
    at = new_path(spark, "snapshot")
    middle = rows.agg(F.percentile_approx("seq", 0.5)).first()[0]
    logs.save_aside(logs.replay(rows.where(F.col("seq") <= middle)), at).result()
    # A key that was deleted before the snapshot isn't in it; one deleted behind it goes with the tail.
    return logs.load(spark, at, rows, middle)


@query(CHANGES + ", " + LAST.format("") + "SELECT key, seq, payload FROM l WHERE op <> 'delete' AND key IN (3, 5, 8)")
def s5_point_lookup(spark, d):
    at = new_path(spark, "keyed")
    logs.write_keyed(logs.replay(_log(spark, d)[0]), "key", at, 8)
    return logs.lookup(spark, at, "key", [3, 5, 8], 8).select("key", "seq", "payload")


@query(CHANGES + "SELECT key % 4 AS part, count(*) AS n, max(seq) AS seq FROM c GROUP BY 1")
def s7_split(spark, d):
    rows, _ = _log(spark, d)
    at = new_path(spark, "split")
    logs.split(rows.drop("crc"), 4, at)
    out = spark.read.parquet(at).where("op <> 'start'")
    return out.groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count("*").alias("n"), F.max("seq").alias("seq"))


@query(CHANGES + "SELECT key, ts, payload, CAST(row_number() OVER (ORDER BY ts, CASE WHEN key % 2 = 1 THEN 0 ELSE 1 END, seq) AS BIGINT) AS place FROM c QUALIFY place % 50 = 1")
def s8_merge(spark, d):
    rows, _ = _log(spark, d)
    both = logs.placed(logs.merge([logs.owned(rows, "key", 2, 1), logs.owned(rows, "key", 2, 0)]))
    assert logs.check(both.drop("place")).limit(1).count() == 0
    return both.where("place % 50 = 1").select("key", "ts", "payload", "place")


@query("SELECT o_custkey::INT AS uid, (o_orderkey % 100000)::INT AS friend, ((o_orderkey % 8)::INT | 1) AS mask FROM orders WHERE o_orderkey % 3 <> 0")
def s9_dump_import(spark, d):
    o = table(spark, d, "orders").select(F.concat_ws("\t", F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 100000, F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1), F.col("o_orderkey") % 8).alias("value"))
    at = new_path(spark, "dump")
    o.write.text(at)
    return dumps.friends_of(dumps.read_dump(spark, at, "friends"))


INDEXED = "WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents) "


@query(INDEXED + "SELECT word, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS s FROM p WHERE word <> '' GROUP BY 1")
def s10_index_build(spark, d):
    at = new_path(spark, "index")
    postings.save(postings.build(table(spark, d, "documents")), at)
    rows = postings.load(spark, at).select("word", F.explode("ids").alias("id"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.sum("id").alias("s"))


@query(INDEXED + "SELECT doc_id AS id FROM p WHERE word IN ('the', 'of') GROUP BY 1 HAVING count(*) = 2")
def s11_index_merge(spark, d):
    docs = table(spark, d, "documents")
    at = new_path(spark, "index")
    postings.save(postings.merge([postings.blocks(docs.where(f"doc_id % 3 = {k}")) for k in range(3)]), at)
    return postings.all_of(postings.load(spark, at), ["the", "of"])


@query("SELECT l_orderkey AS k, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS ids FROM lineitem GROUP BY 1")
def s12_list_codec(spark, d):
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_set("l_partkey")).alias("ids"))
    back = lists.withColumn("ids", postings.ungapped(postings.gaps(F.col("ids"))))
    return back.select("k", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(CHANGES + "SELECT count(*) + 1 AS n, max(seq) + 1 AS seq, 1 AS again FROM c")
def s13_replica(spark, d):
    """The second call has nothing to bring."""
    _, path = _log(spark, d)
    target, mark = new_path(spark, "replica"), new_path(spark, "replica-checkpoint")
    for _ in range(2):
        logs.replicate(spark, path, target, mark)
    t = logs.tag(logs.read(spark, target))
    return t.select("n", "seq", F.lit(1).alias("again"))


@query(CHANGES + ", b AS (SELECT min(seq) AS b FROM c WHERE seq % 997 = 500) SELECT (SELECT count(*) FROM c WHERE seq % 997 = 500) AS bad, count(*) AS left_rows FROM c, b WHERE b IS NULL OR seq < b")
def s14_check_and_repair(spark, d):
    rows, _ = _log(spark, d)
    whole = logs.read(spark, _).where("op <> 'start'")
    damaged = whole.withColumn("payload", F.when((F.col("seq") - 1) % 997 == 500, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    at = new_path(spark, "packed")
    logs.pack(logs.repair(damaged), at)
    return logs.check(damaged).agg(F.count("*").alias("bad")).join(logs.read(spark, at).agg(F.count("*").alias("left_rows")))


@query("SELECT 1 AS n, 7 AS schema")
def s20_empty_log(spark, d):
    at = new_path(spark, "fresh")
    logs.create(spark, at, 7, 4, 0, 1)
    return logs.read(spark, at).select(F.lit(1).alias("n"), F.get_json_object("payload", "$.schema").cast("int").alias("schema"))


@query(E + "SELECT type, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM e GROUP BY 1")
def s21_dump_merge(spark, d):
    part = lambda r: log(spark, d).where(F.col("uid") % 3 == r).groupBy("type").agg(F.count("*").alias("n"), F.sum("k").cast("bigint").alias("s"))
    return logs.merge_dumps([part(0), part(1), part(2)], ["type"], ["n", "s"])


@query("WITH r AS (SELECT n_nationkey * 1000 AS s, n_nationkey * 1000 + 599 AS e, n_name AS code FROM nation UNION ALL SELECT n_nationkey * 1024, n_nationkey * 1024 + 255, 'net' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0) SELECT o_orderkey, (SELECT arg_min(code, (e - s) * 1000000 - s) FROM r WHERE o_orderkey % 26000 BETWEEN s AND e) AS code FROM orders")
def s22_geoip_table(spark, d):
    at = new_path(spark, "geoip")
    n = table(spark, d, "nation")
    whole = n.select(F.concat_ws(",", F.col("n_nationkey") * 1000, F.col("n_nationkey") * 1000 + 599, "n_name").alias("value"))
    masks = n.where("n_nationkey % 5 = 0").select(F.expr("concat('0.0.', n_nationkey * 1024 div 256, '.0/24,net', n_nationkey)").alias("value"))
    whole.unionByName(masks).write.text(at)
    points = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 26000).alias("ip"))
    return range_join(points, dumps.read_ranges(spark, at), "ip").select("o_orderkey", "code")


def _stream(spark, d, name="events"):
    return queues.follow(spark, f"{d}/{name}.parquet", table(spark, d, name))


def _events(spark, d):
    return _stream(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("type"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(E + "SELECT id, type FROM e WHERE k & 5 = 4")
def x1_published(spark, d):
    return queues.drain(queues.published(_events(spark, d).withColumn("y", F.lit(4)), "k", 5, "y").select(F.col("event_id").alias("id"), "type"))


@query(E + ", s AS (SELECT DISTINCT (o_custkey % 50) AS source, (o_orderkey % 20) AS target FROM orders) SELECT target AS queue, count(*) AS n FROM e JOIN s ON s.source = e.uid GROUP BY 1")
def x2_fanned_out(spark, d):
    s = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("source"), (F.col("o_orderkey") % 20).alias("target")).distinct()
    out = queues.drain(queues.fanned_out(_events(spark, d).withColumnRenamed("user_id", "source").select("source", "event_id"), s))
    return out.groupBy("queue").agg(F.count("*").alias("n"))


@query(E + "SELECT uid, id FROM e WHERE id > uid * 60")
def x3_polled(spark, d):
    got = queues.drain(_events(spark, d).select(F.col("user_id").alias("uid"), F.col("event_id").alias("id")))
    at = got.select("uid").distinct().withColumn("position", F.col("uid") * 60)
    return queues.after(got, at, "uid", "id")


GONE = """WITH e AS (SELECT user_id AS uid, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY uid ORDER BY ts, event_id) AS g FROM e),
s AS (SELECT uid, g, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM g GROUP BY 1, 2) SELECT uid, epoch_us(began) AS began, epoch_us(ended) AS ended, n FROM s WHERE ended <= (SELECT max(ts) FROM events)"""


@query(GONE)
def x4_expired(spark, d):
    out = queues.drain(queues.expired(_events(spark, d).withColumnRenamed("user_id", "uid"), "uid", "ts", "6 hours"))
    return out.select("uid", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "n")


@query(INDEXED + ", w AS (SELECT 1 AS watch, unnest(['the', 'of']) AS word UNION ALL SELECT 2, unnest(['und', 'der']) UNION ALL SELECT 3, 'que'), n AS (SELECT watch, count(*) AS n FROM w GROUP BY 1) SELECT doc_id, watch FROM p JOIN w USING (word) JOIN n USING (watch) GROUP BY 1, 2, n HAVING count(*) = n")
def x5_watched(spark, d):
    w = spark.createDataFrame([(1, ["the", "of"]), (2, ["und", "der"]), (3, ["que"])], "watch int, words array<string>")
    return queues.drain(queues.watched(_stream(spark, d, "documents").select("doc_id", "text"), w))


@query(E + ", r AS (SELECT uid, id, type, row_number() OVER (PARTITION BY uid ORDER BY id) AS r FROM e WHERE id > 200) SELECT uid, id, type FROM r WHERE r <= 5")
def x6_history(spark, d):
    from quillon.operators.lists import with_rank

    got = queues.drain(_events(spark, d).select(F.col("user_id").alias("uid"), F.col("event_id").alias("id"), "type"))
    return with_rank(got.where("id > 200"), ["uid"], ["id"]).where("pos <= 5").select("uid", "id", "type")


@query(GONE.replace("SELECT uid, epoch_us(began) AS began, epoch_us(ended) AS ended, n FROM s WHERE", "SELECT uid, count(*) AS n FROM s WHERE").replace("6 HOUR", "300 SECOND") + " GROUP BY 1")
def x7_presence(spark, d):
    """How often each user went offline by timeout."""
    out = queues.drain(queues.expired(_events(spark, d).withColumnRenamed("user_id", "uid"), "uid", "ts", "300 seconds"))
    return out.groupBy("uid").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT ts, event_type AS type FROM events), w AS (SELECT type, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE * (i + 1) AS ended FROM e, range(3) t(i)) SELECT type, epoch_us(ended) AS ended, count(*) AS n FROM w WHERE ended <= (SELECT max(ts) FROM events) GROUP BY 1, 2")
def x8_sliding_counts(spark, d):
    out = queues.drain(queues.sliding_counts(_events(spark, d), ["type"], "ts", "30 minutes", "10 minutes"))
    return out.select("type", F.unix_micros("ended").alias("ended"), "n")


@query(E + "SELECT uid, CAST(sum(k) AS BIGINT) AS s FROM e WHERE uid % 3 = 1 GROUP BY 1")
def x9_pushed_vectors(spark, d):
    folder = new_path(spark, "push")
    sink, read = queues.latest_sink(spark, ["uid"], folder)
    queues.drain(_events(spark, d).where("user_id % 3 = 1").groupBy(F.col("user_id").alias("uid")).agg(F.sum("k").alias("s")), folder, "update", sink)
    return read()


@query("SELECT event_type AS type, epoch_us(time_bucket(INTERVAL 1 DAY, ts, INTERVAL 3 HOUR)) AS version, count(*) AS views FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, max(ts), INTERVAL 3 HOUR) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)")
def x10_versions(spark, d):
    out = queues.drain(queues.versions(_events(spark, d), ["type"], "ts", "3 hours"))
    return out.select("type", F.unix_micros("version").alias("version"), "views")


@query(E + "SELECT uid, round(sum(value * pow(2.0, -(1706600000 - time) / 86400.0)), 6) AS v FROM e GROUP BY 1")
def x11_late_increments(spark, d):
    folder, now, base = new_path(spark, "decayed"), 1_706_600_000, 1_704_067_200
    sink, read = queues.latest_sink(spark, ["uid"], folder)
    stream = _events(spark, d).select(F.col("user_id").alias("uid"), "value", F.unix_seconds("ts").alias("time"))
    queues.drain(queues.decayed_sums(stream, ["uid"], "value", "time", 86400.0, base), folder, "update", sink)
    return read().select("uid", F.round(F.col("s") * 2.0 ** -((now - base) / 86400.0), 6).alias("v"))


@query(E + ", b AS (SELECT c_custkey AS key, 100 AS v FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT uid AS key, id, CASE WHEN k % 10 = 0 THEN 'set' WHEN k % 10 = 1 THEN 'delete' ELSE 'add' END AS op, k AS v FROM e), l AS (SELECT key, arg_max(op, id) AS op, arg_max(v, id) AS v, max(id) AS at_id FROM o WHERE op <> 'add' GROUP BY 1), a AS (SELECT o.key, sum(o.v)::BIGINT AS v FROM o LEFT JOIN l USING (key) WHERE o.op = 'add' AND (at_id IS NULL OR id > at_id) GROUP BY 1), r AS (SELECT key, CASE WHEN l.op IS NULL THEN b.v WHEN l.op = 'set' THEN l.v END AS s, a.v AS m FROM b FULL JOIN l USING (key) FULL JOIN a USING (key)) SELECT key, (coalesce(s, 0) + coalesce(m, 0))::BIGINT AS v FROM r WHERE s IS NOT NULL OR m IS NOT NULL")
def x12_postponed(spark, d):
    base = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit(100).cast("bigint").alias("v"))
    ops = log(spark, d).select(F.col("uid").alias("key"), "id", F.when(F.col("k") % 10 == 0, "set").when(F.col("k") % 10 == 1, "delete").otherwise("add").alias("op"), F.col("k").cast("bigint").alias("v"))
    return queues.with_pending(base, ops, "key", "v", "id")


AGED = B + ", a AS (SELECT id, DATE '{}' AS d, date_sub('year', born, DATE '{}') AS age FROM b), p AS (SELECT id, 1 AS ad FROM a WHERE age >= 30 UNION ALL SELECT id, 2 FROM a WHERE age <= 25)"


@query(AGED.format("2011-06-15", "2011-06-15") + ", q AS (SELECT id, date_sub('year', born, DATE '2011-05-15') AS age FROM b), o AS (SELECT id, 1 AS ad FROM q WHERE age >= 30 UNION ALL SELECT id, 2 FROM q WHERE age <= 25) SELECT id, ad, 'add' AS change FROM p WHERE (id, ad) NOT IN (SELECT id, ad FROM o) UNION ALL SELECT id, ad, 'drop' FROM o WHERE (id, ad) NOT IN (SELECT id, ad FROM p)")
def x13_retargeted(spark, d):
    day = lambda t: F.lit(t).cast("date")
    ads, users = {1: "age>=30", 2: "age<=25"}, _born(spark, d)
    return queues.retargeted(users, ads, day("2011-06-15"), queues.retargeted(users, ads, day("2011-05-15")))
