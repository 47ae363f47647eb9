"""Event-log queries: the SELECT dialect, its operators and functions, catalog and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import eventsql
from quillon.plans.registry import query, table


def log(spark: SparkSession, d: str) -> DataFrame:
    """id, type, uid, time (seconds), value, k of each event."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("uid"), F.unix_timestamp("ts").alias("time"), "value", F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("int").alias("k"))


E = """WITH e AS (SELECT event_id AS id, event_type AS type, user_id AS uid, CAST(floor(epoch(ts)) AS BIGINT) AS time, value,
CAST(regexp_extract(props, '"k": ?(\\d+)', 1) AS INT) AS k FROM events) """

#: name -> (query of the dialect, SQL)
SELECTS = {
    "l1_event_select": (
        "SELECT [uid % 10] AS b, COUNT(*) AS c, SUM([k * 2]) AS s FROM click WHERE value > 1 LIMIT 100 ORDER BY c,DESC",
        "SELECT uid % 10 AS b, count(*) AS c, CAST(sum(k * 2) AS BIGINT) AS s FROM e WHERE type = 'click' AND value > 1 GROUP BY 1",
    ),
    "l2_from_all": ("SELECT type, COUNT(*) AS n FROM * ", "SELECT type, count(*) AS n FROM e GROUP BY 1"),
    "l2_from_type_and_field": ("SELECT id, time, value FROM view, uid=7 WHERE k >= 0", "SELECT id, time, value FROM e WHERE type = 'view' AND uid = 7"),
    "l3_projection_expressions": ("SELECT id, [k * 3 - 1] AS a, [value / 2] AS h, [k / 7] AS q, type AS t FROM * WHERE uid < 20", "SELECT id, k * 3 - 1 AS a, value / 2 AS h, k // 7 AS q, type AS t FROM e WHERE uid < 20"),
    "l4_where_missing_dropped": ("SELECT id, k FROM * WHERE k > 50 || uid = 3", "SELECT id, k FROM e WHERE k IS NOT NULL AND (k > 50 OR uid = 3)"),
    "l5_default": ("SELECT DEFAULT id, [k + 1] AS k1 FROM signup WHERE k < 1000", "SELECT id, coalesce(k, 0) + 1 AS k1 FROM e WHERE type = 'signup' AND coalesce(k, 0) < 1000"),
    "l6_distinct": ("SELECT DISTINCT type, [uid % 4] AS r FROM *", "SELECT DISTINCT type, uid % 4 AS r FROM e"),
    "l7_length": ("SELECT LENGTH id FROM purchase WHERE value > 10", "SELECT count(*) AS length FROM e WHERE type = 'purchase' AND value > 10"),
    "l8_aggregates": ("SELECT uid, SUM(k) AS s, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi FROM *", "SELECT uid, CAST(sum(k) AS BIGINT) AS s, count(*) AS n, min(value) AS lo, max(value) AS hi FROM e GROUP BY 1"),
    "l9_having": ("SELECT uid, COUNT(*) AS n, MAX(k) AS m FROM click WHERE value > 0, n > 12 && m > 50", "SELECT uid, count(*) AS n, max(k) AS m FROM e WHERE type = 'click' AND value > 0 GROUP BY 1 HAVING count(*) > 12 AND max(k) > 50"),
    "l10_limit_offset": ("SELECT id, time FROM error LIMIT 10, 25", "SELECT id, time FROM e WHERE type = 'error' ORDER BY time DESC, id DESC LIMIT 25 OFFSET 10"),
    "l10_limit_time": ("SELECT id, uid FROM * LIMIT T 1706000000, 500", "SELECT id, uid FROM e WHERE time >= 1706000000 ORDER BY time DESC, id DESC LIMIT 500"),
    "l11_order_by": (
        "SELECT uid, COUNT(*) AS n FROM * LIMIT 20 ORDER BY n,ASC",
        "SELECT uid, n FROM (SELECT uid, count(*) AS n, max(time) AS t, max(id) AS i FROM e GROUP BY 1) ORDER BY n, t DESC, i DESC LIMIT 20",
    ),
    "l12_operators": (
        "SELECT id, [k & 12] AS a, [k | 3] AS o, [k ^ 5] AS x, [k << 2] AS l, [k >> 1] AS r, [k % 9] AS m, [~k] AS c, [-k] AS g FROM * WHERE !(uid = 1) && (k <= 40 || k != 50) && uid >= 2 && k <> 41 && uid == uid",
        "SELECT id, k & 12 AS a, k | 3 AS o, xor(k, 5) AS x, CAST(k AS BIGINT) << 2 AS l, CAST(k AS BIGINT) >> 1 AS r, k % 9 AS m, ~k AS c, -k AS g FROM e WHERE uid <> 1 AND (k <= 40 OR k <> 50) AND uid >= 2 AND k <> 41",
    ),
    "l13_substring": ("SELECT id, type FROM * WHERE type >> 'c' && 'click view' << type || 'xsignupx' >> type", "SELECT id, type FROM e WHERE contains(type, 'c') AND contains(type, 'click view') OR contains('xsignupx', type)"),
    "l14_in_list": ("SELECT id, uid FROM * WHERE uid IN (1, 5, 9) && type IN ('view', 'error')", "SELECT id, uid FROM e WHERE uid IN (1, 5, 9) AND type IN ('view', 'error')"),
    "l15_functions": (
        "SELECT id, [@length(type)] AS n, [@toupper(type)] AS u, [@tolower('ABC')] AS lo, [@simplify('A-b c!')] AS s, [@full_simplify('É-t é')] AS f, [@deunicode('é')] AS d, [@sort(type)] AS o, [@bit_count(k)] AS b, [@int(value)] AS i, [@long(k)] AS g, [@double(k)] AS e, [@string(k)] AS t FROM * WHERE uid < 10",
        "SELECT id, CAST(length(type) AS INT) AS n, upper(type) AS u, 'abc' AS lo, 'abc' AS s, 'ete' AS f, 'e' AS d, array_to_string(list_sort(string_split(type, '')), '') AS o, CAST(bit_count(k) AS INT) AS b, CAST(trunc(value) AS INT) AS i, CAST(k AS BIGINT) AS g, CAST(k AS DOUBLE) AS e, CAST(k AS VARCHAR) AS t FROM e WHERE uid < 10",
    ),
}


def _register(name: str, text: str, sql: str) -> None:
    query(E + sql, name)(lambda spark, d: eventsql.select(log(spark, d), text, now=1_706_600_000))


for _n, (_t, _s) in SELECTS.items():
    _register(_n, _t, _s)


@query(E + "SELECT id, uid FROM e WHERE time >= 1706600000 - 86400 ORDER BY time DESC, id DESC LIMIT 100")
def l10_limit_last_seconds(spark, d):
    return eventsql.select(log(spark, d), "SELECT id, uid FROM * LIMIT T -86400, 100", now=1_706_600_000)


@query("SELECT event_id AS id, 'x' AS extra, CAST(0 AS INT) AS level FROM events WHERE event_type = 'signup'")
def l16_added_field(spark, d):
    """A field added later is missing in old rows and reads as a default."""
    e = log(spark, d).withColumn("level", F.lit(None).cast("int")).withColumn("extra", F.lit("x"))
    return eventsql.select(e, "SELECT DEFAULT id, extra, level FROM signup")


@query(E + "SELECT count(*) AS n, max(id) AS last FROM (SELECT id FROM e UNION ALL SELECT 1000000000)")
def l17_add_event(spark, d):
    e = log(spark, d)
    new = spark.createDataFrame([(1_000_000_000, "click", 1, 1_706_700_000, 1.0, 1)], "id long, type string, uid long, time long, value double, k int")
    return e.unionByName(new).agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query(E + "SELECT type, count(*) AS n, min(time) AS oldest FROM e GROUP BY 1")
def l18_types_and_sizes(spark, d):
    return eventsql.type_sizes(log(spark, d))


@query(E + "SELECT id, CASE WHEN uid BETWEEN 10 AND 40 THEN xor(uid & 255, 3) ELSE uid END AS color FROM e WHERE type = 'view'")
def l19_colors(spark, d):
    e = log(spark, d)
    colors = eventsql.change_color(e.select(F.col("uid").alias("value"), F.col("uid").alias("color")).distinct(), 10, 40, 255, 3)
    return eventsql.with_color(e.where("type = 'view'"), "uid", colors).select("id", "color")
