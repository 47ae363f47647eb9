"""Objects of users with texts and decayed ratings: autocomplete (hints) and ordering (rating).

A rating halves every HALF_LIFE seconds; rating_num tells several ratings of one object apart. The rating engine has the same
operations without texts. Text queries match if every word is the beginning of one of the object's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, change, drop, first_of, get, operations, put
from quillon.operators.predicate import words_of
from quillon.operators.textsearch import other_layout, transliterate

HALF_LIFE = 7 * 86400.0
WIN = 0.25  # share of the difference that a loser gives to the winner


class Hints(Engine):
    tables = {
        "users": Table("user_id int, info int, enabled boolean", ("user_id",), {"enabled": True}),
        "objects": Table("user_id int, type int, object_id int, text string", ("user_id", "type", "object_id")),
        "ratings": Table("user_id int, type int, object_id int, rating_num int, rating double, at int", ("user_id", "type", "object_id", "rating_num"), {"rating": 0.0}),
    }


class Rating(Hints):
    operations: dict = {}


OBJECT, ID = "user_id:int type:int object_id:int", ["user_id", "type", "object_id"]


def _now_rating(e: Engine) -> Column:
    return F.coalesce("rating", F.lit(0.0)) * F.pow(F.lit(2.0), -(F.lit(e.now) - F.coalesce("at", F.lit(e.now))) / HALF_LIFE)


def _ratings(e: Engine) -> DataFrame:
    return e.state["ratings"].select(*ID, "rating_num", _now_rating(e).alias("rating"))


def _move_type(everywhere: bool):
    """The object gets another type in both tables, unless one of that type is there."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        on = ["type", "object_id"] if everywhere else ID
        q = requests.groupBy(*on).agg(F.max_by("new_type", "rq").alias("_new"), F.min("rq").alias("_rq"))
        n = None
        for name in ("objects", "ratings"):
            old = e.state[name]
            keys = list(e.tables[name].keys)
            hit = old.join(q, on)
            moved = hit.withColumn("type", F.col("_new")).select(*old.columns)
            rest = old.join(q.select(*on), on, "left_anti")
            e.state[name] = rest.join(moved.select(*keys), keys, "left_anti").unionByName(moved)
            n = hit.groupBy("_rq").agg(F.count("*").alias("n")) if n is None else n
        return requests.select("rq").join(n.withColumnRenamed("_rq", "rq"), "rq", "left").select("rq", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"))

    return run


def _increment(e: Engine, requests: DataFrame) -> DataFrame:
    """cnt more on the rating as it is now; only for users whose ratings are on."""
    off = e.state["users"].where("NOT enabled").select("user_id")
    r = requests.join(off, "user_id", "left_anti")
    total = r.groupBy(*ID, "rating_num").agg(F.sum("cnt").cast("double").alias("_d"))
    joined = e.state["ratings"].join(total, [*ID, "rating_num"], "full")
    e.state["ratings"] = joined.select(*ID, "rating_num", F.when(F.col("_d").isNotNull(), _now_rating(e) + F.col("_d")).otherwise(F.col("rating")).alias("rating"), F.when(F.col("_d").isNotNull(), F.lit(e.now)).otherwise(F.col("at")).alias("at"))
    return requests.select("rq", "user_id").join(off.withColumn("_off", F.lit(True)), "user_id", "left").select("rq", F.col("_off").isNull().alias("ok"))


def _set_rating(e: Engine, requests: DataFrame) -> DataFrame:
    return put("ratings", values={"at": F.lit(e.now)})(e, requests)


def _winner(e: Engine, requests: DataFrame) -> DataFrame:
    """Each loser rated above the winner gives it a share of the difference; batches take the last request of a winner."""
    r = requests.groupBy("user_id", "type", "rating_num").agg(F.max_by(F.struct("winner", "losers"), "rq").alias("q"))
    r = r.select("user_id", "type", "rating_num", F.col("q.winner").alias("object_id"), F.col("q.losers").alias("losers"))
    cur = _ratings(e)
    win = r.join(cur, [*ID, "rating_num"], "left").withColumn("own", F.coalesce("rating", F.lit(0.0))).drop("rating")
    lost = win.select("user_id", "type", "rating_num", F.col("object_id").alias("winner"), "own", F.explode("losers").alias("object_id")).join(cur, [*ID, "rating_num"])
    lost = lost.where("rating > own").withColumn("give", (F.col("rating") - F.col("own")) * WIN)
    delta = lost.select(*ID, "rating_num", (-F.col("give")).alias("_d")).unionByName(lost.select("user_id", "type", F.col("winner").alias("object_id"), "rating_num", F.col("give").alias("_d"))).groupBy(*ID, "rating_num").agg(F.sum("_d").alias("_d"))
    joined = e.state["ratings"].join(delta, [*ID, "rating_num"], "full")
    e.state["ratings"] = joined.select(*ID, "rating_num", F.when(F.col("_d").isNotNull(), _now_rating(e) + F.col("_d")).otherwise(F.col("rating")).alias("rating"), F.when(F.col("_d").isNotNull(), F.lit(e.now)).otherwise(F.col("at")).alias("at"))
    return requests.select("rq", F.lit(True).alias("ok"))


def _sort(random: bool):
    """The given objects by rating, best first; or at random with the ratings as weights (by a hash of request and object, so that runs agree)."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        own = requests.select("rq", "user_id", "limit", "rating_num", F.posexplode("objects").alias("at_pos", "o")).select("rq", "user_id", "limit", "rating_num", "at_pos", F.col("o.type").alias("type"), F.col("o.object_id").alias("object_id"))
        own = own.join(_ratings(e), [*ID, "rating_num"], "left").withColumn("rating", F.coalesce("rating", F.lit(0.0)))
        u = (F.pmod(F.xxhash64("rq", *ID), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        by = F.pow(u, 1 / F.greatest("rating", F.lit(1e-9))).desc() if random else F.desc("rating")
        return own.withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy(by, "at_pos"))).where("pos <= limit").select("rq", "pos", "type", "object_id")

    return run


def _found(text: str | None, latin: bool, exceptions: bool, random: bool, columns: list[str]):
    """The user's objects of a type (0: any) that fit, by rating; total counts all that fit."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        q = requests.withColumnsRenamed({"type": "q_type"})
        rows = q.join(e.state["objects"], "user_id").where("q_type = 0 OR type = q_type")
        if text:
            own = words_of(F.col("text"))
            forms = lambda w: F.array(w, transliterate(w), other_layout(w)) if latin else F.array(w)
            rows = rows.where(F.forall(words_of(F.col("query")), lambda w: F.exists(own, lambda x: F.exists(forms(w), lambda f: F.startswith(x, f)))))
        if exceptions:
            rows = rows.where(~F.array_contains(F.transform(F.coalesce("exceptions", F.array().cast("array<struct<type:int,object_id:int>>")), lambda x: F.struct(x.type.alias("type"), x.object_id.alias("object_id"))), F.struct(F.col("type"), F.col("object_id"))))
        rows = rows.join(_ratings(e), [*ID, "rating_num"], "left").withColumn("rating", F.coalesce("rating", F.lit(0.0)))
        u = (F.pmod(F.xxhash64("rq", *ID), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        by = F.pow(u, 1 / F.greatest("rating", F.lit(1e-9))).desc() if random else F.desc("rating")
        rows = rows.withColumns({"pos": F.row_number().over(Window.partitionBy("rq").orderBy(by, "type", "object_id")), "total": F.count("*").over(Window.partitionBy("rq"))})
        return rows.where("pos <= limit").select("rq", "pos", "total", "type", "object_id", *columns)

    return run


def _common(cls: type[Engine], name: str) -> None:
    op = operations(cls)
    op(f"{name}.nullifyRating", "user_id:int", change("ratings", {"rating": "0.0"}, on=["user_id"]))
    op(f"{name}.setRatingState", "user_id:int rating_enabled:bool", put("users", values={"enabled": "rating_enabled"}))
    op(f"{name}.setInfo", "user_id:int info:int", put("users"))
    op(f"{name}.getInfo", "user_id:int", get("users", "info"))
    op(f"{name}.setWinner", "user_id:int type:int winner:int losers:ints rating_num:int", _winner)
    op(f"{name}.setRating", f"{OBJECT} rating_num:int rating:double", _set_rating)
    op(f"{name}.setType", f"{OBJECT} new_type:int", _move_type(False))
    op(f"{name}.setTypeGlobal", "type:int object_id:int new_type:int", _move_type(True))
    op(f"{name}.sort", "user_id:int limit:int rating_num:int objects:array<struct<type:int,object_id:int>>", _sort(False))
    op(f"{name}.getRandom", "user_id:int limit:int rating_num:int objects:array<struct<type:int,object_id:int>>", _sort(True))
    op(f"{name}.deleteObject", OBJECT, first_of(drop("objects"), drop("ratings", on=ID)))
    op(f"{name}.deleteObjectGlobal", "type:int object_id:int", first_of(drop("objects", on=["type", "object_id"]), drop("ratings", on=["type", "object_id"])))
    op(f"{name}.incrementRating", f"{OBJECT} cnt:int rating_num:int", _increment)


_common(Hints, "hints")
_common(Rating, "rating")

op = operations(Hints)
op("hints.setText", f"{OBJECT} text:string", put("objects"))
op("hints.setTextGlobal", "type:int object_id:int text:string", change("objects", {"text": "q_text"}, on=["type", "object_id"]))
op("hints.getObjectText", OBJECT, get("objects", "text"))
for _latin in ("", "Latin"):
    for _more, _columns in (("", []), ("Rating", ["rating"]), ("Text", ["text"]), ("Full", ["rating", "text"])):
        op(f"hints.getHints{_latin}{_more}", "user_id:int type:int limit:int rating_num:int query:string", _found("query", bool(_latin), False, False, _columns))

op = operations(Rating)
op("rating.addObject", OBJECT, put("objects", "add"))
for _random in ("", "Random"):
    for _more, _columns in (("", []), ("Rating", ["rating"])):
        op(f"rating.get{_random}Hints{_more}", "user_id:int type:int limit:int rating_num:int exceptions:array<struct<type:int,object_id:int>>", _found(None, False, True, bool(_random), _columns))
