"""Feeds: news of users, comments on objects with bookmarks, notifications, and recommendations by rated users.

Grouped forms join updates of one day, type, owner and place into one row: newest date, total, and the newest ``grouping``
members (the feature), best first by date; limit rows at most. Types are bits of the masks; a mask of 0 lets none through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, change, drop, get, operations, put

RAW = ["date", "tag", "type", "user", "group", "owner", "place", "item"]
UPDATE = "id int, date int, tag bigint, type int, user int, `group` int, owner int, place int, item int, action int, created int, hidden boolean"
OF_TYPE = "(shiftright({}, type) & 1) = 1"


def _append(e: Engine, requests: DataFrame) -> DataFrame:
    """A new update now; its tag is a hash of what it says and when."""
    names = [f.name for f in e.state["updates"].schema]
    have = requests.columns
    fixed = {"date": F.lit(e.now), "hidden": F.lit(False), "tag": F.xxhash64(F.lit(e.now), *(F.col(c) for c in have))}
    rows = requests.withColumn("created", F.col("item_creation_time") if "item_creation_time" in have else F.lit(e.now))
    rows = rows.select(*((fixed[n] if n in fixed else F.col(n) if n in rows.columns else F.lit(None)).cast(e.state["updates"].schema[n].dataType).alias(n) for n in names))
    e.state["updates"] = e.state["updates"].unionByName(rows)
    return requests.select("rq", F.lit(True).alias("ok"))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy(F.desc("date"), F.desc("tag")))).select("rq", "pos", "id", *RAW)


def grouped(rows: DataFrame, day0: Column, member: str) -> DataFrame:
    """rows (rq, limit, grouping, date, ...) as groups; members are counted before they are ranked."""
    keys = ["rq", "limit", "grouping", "type", "owner", "place", "day"]
    rows = rows.withColumn("day", F.floor((F.col("date") - day0) / 86400))
    one = rows.groupBy(*keys, member).agg(F.max("date").alias("at"))
    whole = one.groupBy(*keys).agg(F.max("at").alias("newest"), F.count("*").alias("total"))
    top = one.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at"), member))).where("r <= grouping")
    lists = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", member))), lambda x: x[member]).alias("members"))
    out = whole.join(lists, keys).withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy(F.desc("newest"), "type", "owner", "place", "day")))
    return out.where("pos <= limit").select("rq", "pos", "type", "owner", "place", "newest", "total", "members")


class News(Engine):
    """News of users, seen by those who name them."""

    tables = {"updates": Table(UPDATE, ("tag",)), "masks": Table("id int, type_mask int", ("id",))}


op = operations(News)
op("news.update", "id:int type:int user:int group:int owner:int place:int item:int", _append)
op("news.deleteUpdates", "id:int", drop("updates", on=["id"]))
op("news.setPrivacyMask", "id:int type_mask:int", put("masks"))
op("news.getPrivacyMask", "id:int", get("masks", "type_mask"))


def _of_users(e: Engine, requests: DataFrame, first: str, last: str) -> DataFrame:
    """Updates in first <= date < last of the listed users, of types in the mask and not hidden by the user's own mask."""
    q = requests.withColumnRenamed("date", "q_date") if "date" in requests.columns else requests
    q = q.withColumn("id", F.explode(F.array_distinct("user_list")))
    rows = q.join(e.state["updates"].where("NOT hidden"), "id").where(OF_TYPE.format("type_mask")).where(F.expr(f"date >= {first} AND date < {last}"))
    masks = e.state["masks"].withColumnRenamed("type_mask", "_own")
    return rows.join(masks, "id", "left").where("_own IS NULL OR " + OF_TYPE.format("_own"))


op("news.getRawUpdates", "type_mask:int start_date:int end_date:int user_list:ints", lambda e, r: _ranked(_of_users(e, r, "start_date", "end_date")), "Newest first.")
op("news.getGroupedUpdates", "type_mask:int date:int timestamp:int end_date:int grouping:int limit:int user_list:ints", lambda e, r: grouped(_of_users(e, r, "q_date", "end_date"), F.pmod("timestamp", F.lit(86400)), "id"), "The members are users; days begin at the timestamp's time of day.")


class Cnews(Engine):
    """News on objects (type, owner, place): comments, seen by those with a bookmark."""

    tables = {"updates": Table(UPDATE, ("tag",)), "bookmarks": Table("user_id int, type int, owner int, place int", ("user_id", "type", "owner", "place"))}


op = operations(Cnews)
PLACE = "type:int owner:int place:int"
ON, ITEM = ["type", "owner", "place"], ["type", "owner", "place", "item"]
op("cnews.update", f"{PLACE} user:int group:int item:int", _append)
op("cnews.deleteUpdates", PLACE, drop("updates", on=ON))
op("cnews.deleteUpdate", f"{PLACE} item:int", change("updates", {"hidden": "true"}, on=ITEM))
op("cnews.undeleteUpdate", f"{PLACE} item:int", change("updates", {"hidden": "false"}, on=ITEM))
op("cnews.addBookmark", f"{PLACE} user_id:int", put("bookmarks", "add"))
op("cnews.delBookmark", f"{PLACE} user_id:int", drop("bookmarks"))


def _of_objects(e: Engine, requests: DataFrame, first: str, last: str) -> DataFrame:
    q = requests.withColumnRenamed("date", "q_date") if "date" in requests.columns else requests
    q = q.withColumn("o", F.explode(F.array_distinct("object_list"))).withColumns({c: F.col(f"o.{c}") for c in ON})
    return q.join(e.state["updates"].where("NOT hidden"), ON).where(F.expr(f"date >= {first} AND date < {last}"))


def _of_bookmarks(e: Engine, requests: DataFrame, first: str, last: str) -> DataFrame:
    q = requests.withColumnRenamed("date", "q_date") if "date" in requests.columns else requests
    rows = q.join(e.state["bookmarks"], "user_id").join(e.state["updates"].where("NOT hidden"), ON)
    return rows.where(OF_TYPE.format("type_mask")).where(F.expr(f"date >= {first} AND date < {last}"))


OBJECTS = "object_list:array<struct<type:int,owner:int,place:int>>"
op("cnews.getRawUpdates", f"start_date:int end_date:int {OBJECTS}", lambda e, r: _ranked(_of_objects(e, r, "start_date", "end_date")))
op("cnews.getGroupedUpdates", f"date:int timestamp:int end_date:int grouping:int limit:int {OBJECTS}", lambda e, r: grouped(_of_objects(e, r, "q_date", "end_date"), F.pmod("timestamp", F.lit(86400)), "user"))
op("cnews.getRawUserUpdates", "type_mask:int start_date:int end_date:int user_id:int", lambda e, r: _ranked(_of_bookmarks(e, r, "start_date", "end_date")))
op("cnews.getGroupedUserUpdates", "type_mask:int date:int timestamp:int end_date:int grouping:int limit:int user_id:int", lambda e, r: grouped(_of_bookmarks(e, r, "q_date", "end_date"), F.pmod("timestamp", F.lit(86400)), "user"))


class Nnews(Engine):
    """Notifications of one user."""

    tables = {"updates": Table(UPDATE, ("tag",))}


op = operations(Nnews)
op("nnews.update", "id:int type:int user:int owner:int place:int item:int", _append)
op("nnews.deleteUpdates", PLACE, drop("updates", on=ON))
op("nnews.deleteUpdate", f"{PLACE} item:int", change("updates", {"hidden": "true"}, on=ITEM))
op("nnews.undeleteUpdate", f"{PLACE} item:int", change("updates", {"hidden": "false"}, on=ITEM))
op("nnews.deleteUserUpdate", f"user_id:int {PLACE} item:int", change("updates", {"hidden": "true"}, by={"user_id": "id"}, on=["id", *ITEM]))
op("nnews.undeleteUserUpdate", f"user_id:int {PLACE} item:int", change("updates", {"hidden": "false"}, by={"user_id": "id"}, on=["id", *ITEM]))


def _of_user(e: Engine, requests: DataFrame) -> DataFrame:
    q = requests.withColumnsRenamed({"date": "q_date", "user_id": "id"})
    return q.join(e.state["updates"].where("NOT hidden"), "id").where(OF_TYPE.format("mask")).where("date >= q_date AND date < end_date")


op("nnews.getUpdates", "user_id:int mask:int date:int end_date:int timestamp:int limit:int", lambda e, r: _ranked(_of_user(e, r)).join(r.select("rq", "limit"), "rq").where("pos <= limit").drop("limit"))
op("nnews.getGroupedUpdates", "user_id:int mask:int date:int end_date:int grouping:int timestamp:int limit:int", lambda e, r: grouped(_of_user(e, r), F.pmod("timestamp", F.lit(86400)), "user"))


class Rnews(Engine):
    """Actions of users on objects, scored by action rates and the asker's rates of users, halved every t seconds."""

    tables = {"updates": Table(UPDATE, ("tag",)), "rates": Table("type int, action int, rate double", ("type", "action"))}


op = operations(Rnews)
op("rnews.update", "id:int type:int owner:int place:int action:int item:int item_creation_time:int", _append)
op("rnews.setRate", "type:int action:int rate:double", put("rates"))
op("rnews.getRate", "type:int action:int", get("rates", "rate"))
RATED = "user_list:array<struct<id:int,rate:double>>"


def _rated(e: Engine, requests: DataFrame) -> DataFrame:
    """Actions of the listed users; a user's repeated action below 32 counts once, at its latest time."""
    q = requests.withColumnRenamed("id", "asker").withColumn("u", F.explode("user_list")).withColumns({"id": F.col("u.id"), "user_rate": F.col("u.rate")})
    rows = q.join(e.state["updates"].where("NOT hidden"), "id").where(OF_TYPE.format("type_mask")).where("date >= start_date AND date < end_date")
    keys = ["rq", "id", "type", "owner", "place", "action"]
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created"), F.desc("tag")))).where("action >= 32 OR r = 1")
    rate = F.col("user_rate") * F.coalesce("rate", F.lit(0.0)) * F.pow(F.lit(2.0), -F.greatest(F.col("timestamp") - F.col("created"), F.lit(0)) / F.col("t"))
    return once.join(e.state["rates"], ["type", "action"], "left").withColumn("weight", rate)


op("rnews.getRawUpdates", f"type_mask:int start_date:int end_date:int id:int t:int timestamp:int {RATED}", lambda e, r: _rated(e, r).select("rq", "id", "type", "owner", "place", "action", "item", "date", "weight"))


@op("rnews.getGroupedUpdates", f"type_mask:int start_date:int end_date:int id:int t:int timestamp:int acting_users_limit:int limit:int {RATED}")
def _recommended(e: Engine, requests: DataFrame) -> DataFrame:
    """Objects with at least acting_users_limit users, by summed weight."""
    s = _rated(e, requests).groupBy("rq", "acting_users_limit", "limit", "type", "owner", "place").agg(F.countDistinct("id").alias("users"), F.sum("weight").alias("weight")).where("users >= acting_users_limit")
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy(F.desc("weight"), "type", "owner", "place"))).where("pos <= limit").select("rq", "pos", "type", "owner", "place", "users", "weight")
