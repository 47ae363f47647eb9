"""Friends with category masks and dates, requests, and privacy rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, bits, change, counted, drop, first_of, get, listed, operations, put
from quillon.operators.predicate import minimal_privacy, privacy_rules


class Friends(Engine):
    tables = {
        "friends": Table("uid int, friend int, mask int, time int", ("uid", "friend"), {"mask": 1}),
        "requests": Table("uid int, friend int, mask int, time int", ("uid", "friend"), {"mask": 0}),
        "privacy": Table("uid int, key string, text string", ("uid", "key")),
    }


op = operations(Friends)
PAIR, MASK = "uid:int friend:int", "uid:int friend:int mask:int"
IN = "(q_mask = 0 OR (mask & q_mask) <> 0)"


def _now(table: str, mode: str):
    return lambda e, r: put(table, mode, values={"time": F.lit(e.now)})(e, r)


op("friends.deleteUser", "uid:int", first_of(drop("friends", on=["uid"]), drop("requests", on=["uid"]), drop("privacy", on=["uid"])))
op("friends.getFriendsId", "uid:int mask:int", listed("friends", ["uid"], ["friend"], ["friend"], where=IN))
op("friends.getFriends", "uid:int mask:int mode:int", lambda e, r: listed("friends", ["uid"], ["friend", "q_mode", "mask", "time"], ["friend"], where=IN)(e, r).select("rq", "pos", "friend", F.expr("if((q_mode & 1) <> 0, mask, null)").alias("mask"), F.expr("if((q_mode & 2) <> 0, time, null)").alias("time")), "mode 1: with masks, 2: with times.")
op("friends.getFriendsCnt", "uid:int mask:int", counted("friends", ["uid"], where=IN))
op("friends.getRecentFriends", "uid:int num:int", listed("friends", ["uid"], ["friend", "mask", "time"], ["-time", "friend"], limit="q_num", total=True))
op("friends.getFriend", "uid:int id:int", get("friends", "mask", by={"id": "friend"}))
op("friends.setFriend", MASK, first_of(_now("friends", "set"), drop("requests")))
op("friends.replaceFriend", MASK, put("friends", "replace"))
op("friends.deleteFriend", PAIR, drop("friends"))
op("friends.incrFriend", MASK, bits("friends", "mask", amount="mask"))
op("friends.decrFriend", MASK, bits("friends", "mask", clear=True, amount="mask"))
op("friends.getFriendReq", "uid:int id:int", get("requests", "mask", by={"id": "friend"}))
op("friends.addFriendReq", MASK, _now("requests", "add"))
op("friends.setFriendReq", MASK, _now("requests", "set"))
op("friends.replaceFriendReq", MASK, _now("requests", "replace"))
op("friends.deleteFriendReq", PAIR, drop("requests"))
op("friends.deleteReqs", "uid:int", drop("requests", on=["uid"]))
op("friends.getReqs", "uid:int limit:int", listed("requests", ["uid"], ["friend", "mask", "time"], ["-time", "friend"], limit="q_limit", total=True))


@op("friends.setCatList", "uid:int cat:int friends:ints")
def _set_category(e: Engine, requests: DataFrame) -> DataFrame:
    """Exactly the given friends are in the category (1 to 30)."""
    return change("friends", {"mask": "if(array_contains(q_friends, friend), mask | shiftleft(1, q_cat), mask & ~shiftleft(1, q_cat))"}, on=["uid"])(e, requests.where("cat BETWEEN 1 AND 30"))


op("friends.deleteCat", "uid:int cat:int", change("friends", {"mask": "mask & ~shiftleft(1, q_cat)"}, on=["uid"]))


def _canonical(text: str | None) -> str | None:
    """Rules without idle ones, in the canonical order; null for what aren't rules."""
    try:
        rules = minimal_privacy(privacy_rules(text or ""))
    except ValueError:
        return None
    names = {"all": "A", "friends": "G", "nobody": "0"}
    return "".join(("+" if s > 0 else "-") + (names[k] if k in names else f"*{v}" if k == "cat" else str(v)) for s, k, v in rules)


def _privacy(mode: str):
    def run(e: Engine, requests: DataFrame) -> DataFrame:
        told = requests.withColumn("text", F.udf(_canonical, "string", useArrow=True)("text"))
        ok = put("privacy", mode)(e, told.where("text IS NOT NULL"))
        return requests.select("rq").join(ok, "rq", "left").select("rq", F.coalesce("ok", F.lit(False)).alias("ok"))

    return run


op("friends.setPrivacy", "uid:int key:string text:string", _privacy("set"), "Stored in the minimal form; not ok for what aren't rules.")
op("friends.replacePrivacy", "uid:int key:string text:string", _privacy("replace"))
op("friends.getPrivacy", "uid:int key:string", get("privacy", "text"))
op("friends.deletePrivacy", "uid:int key:string", drop("privacy"))


def _checked(e: Engine, asked: DataFrame) -> DataFrame:
    """asked (id, uid, test_uid, key) with allowed: 1, 0, or null where there are no rules; the first rule that fits decides."""
    pattern = r"([+-])(\*?)(\d+|[AG])|/(\d+)"
    rules = e.state["privacy"].select("uid", "key", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("at", "rule"))
    body = F.regexp_replace("rule", r"^[+-]", "")
    rules = rules.withColumns({"yes": F.rlike("rule", F.lit(r"^[+/]")), "kind": F.when(body == "A", "all").when(body == "G", "friends").when(F.rlike(body, F.lit(r"^[*/]")), "cat").when(body == "0", "nobody").otherwise("user"), "value": F.regexp_extract("rule", r"(\d+)$", 1)})
    known = asked.join(e.state["friends"].select("uid", F.col("friend").alias("test_uid"), "mask"), ["uid", "test_uid"], "left")
    fits = F.expr("kind = 'all' OR kind = 'nobody' OR kind = 'friends' AND mask IS NOT NULL OR kind = 'user' AND value = cast(test_uid AS string) OR kind = 'cat' AND (shiftright(coalesce(mask, 0), cast(value AS int)) & 1) = 1")
    told = known.join(rules, ["uid", "key"]).groupBy("id").agg(F.min_by(F.when(fits, F.col("yes") & (F.col("kind") != "nobody")), F.when(fits, F.col("at"))).alias("_yes"))
    return asked.join(told.withColumn("_rules", F.lit(True)), "id", "left").withColumn("allowed", F.when(F.col("_rules"), F.coalesce("_yes", F.lit(False)).cast("int")))


@op("friends.checkPrivacy", "uid:int test_uid:int key:string")
def _check(e: Engine, requests: DataFrame) -> DataFrame:
    """1 or 0 by the first rule that fits, null without rules."""
    return _checked(e, requests.withColumn("id", F.col("rq"))).select("rq", "allowed")


@op("friends.checkPrivacyList", "uid:int test_uid:int key_list:strings")
def _check_list(e: Engine, requests: DataFrame) -> DataFrame:
    """The same for each key, by place pos from 1."""
    one = requests.select("rq", "uid", "test_uid", F.posexplode("key_list").alias("pos", "key")).withColumn("id", F.struct("rq", "pos"))
    return _checked(e, one).select("rq", (F.col("pos") + 1).alias("pos"), "key", "allowed")


@op("friends.getCommonFriendsNum", "uid:int users:ints")
def _common_number(e: Engine, requests: DataFrame) -> DataFrame:
    """For each of the users the number of friends in common with uid."""
    f = e.state["friends"].select("uid", "friend")
    other = requests.select("rq", "uid", F.posexplode("users").alias("pos", "other"))
    n = other.join(f, "uid").join(f.toDF("other", "friend"), ["other", "friend"]).groupBy("rq", "pos").agg(F.count("*").alias("n"))
    return other.join(n, ["rq", "pos"], "left").select("rq", (F.col("pos") + 1).alias("pos"), "other", F.coalesce("n", F.lit(0)).alias("n"))


@op("friends.getCommonFriends", "uid:int uid2:int")
def _common(e: Engine, requests: DataFrame) -> DataFrame:
    f = e.state["friends"].select("uid", "friend")
    return requests.join(f, "uid").join(f.toDF("uid2", "friend"), ["uid2", "friend"]).select("rq", "friend")
