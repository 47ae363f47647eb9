"""Targeted advertising: profiles of users, advertisements with audience queries, views and clicks, prices and auctions.

Queries are those of ``quillon.operators.predicate``; the different queries of a batch (or of all enabled ads) are compiled
side by side into one pass over users, MOST_QUERIES at a time in blocks. mode bits: 0 order by rate, 1 order by id, 2
reverse, 17 masks on users' flags, 18 a bound on users, 19 a list of users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, change, drop, first_of, get, operations, put
from quillon.operators.ads import estimated_gain
from quillon.operators.predicate import compiled, words_of

MOST_QUERIES = 500
RECENT = 300  # seconds
NUMBERS = "sex operator browser region height smoking alcohol personal_priority important_in_others hidden countries_visited gcountry privacy political status timezone rate cute flags country city bday_day bday_month bday_year online has_photo uses_apps pays_money".split()
CUSTOM = [f"custom{i}" for i in range(1, 16)]
TEXTS = ("name", "religion", "hometown", "proposal")
CHILDREN = {
    "education": "country int, city int, university int, faculty int, chair int, graduation int, form int, status int, `primary` int",
    "school": "country int, city int, id int, start int, finish int, graduation int, class int, type int, spec string",
    "company": "country int, city int, id int, start int, finish int, name string, job string",
    "military": "unit int, start int, finish int",
    "address": "type int, country int, city int, district int, station int, street int, name string, house string",
    "interest": "type int, name string",
    "group": "id int, type int",
    "lang": "id int",
}
SUMS = ("sump0", "sump1", "sump2")


class Targ(Engine):
    tables = {
        "users": Table("id int, " + ", ".join(f"{c} int" for c in NUMBERS + CUSTOM) + ", " + ", ".join(f"{c} string" for c in TEXTS), ("id",), {c: 0 for c in NUMBERS}),
        **{name: Table("uid int, " + columns, ("uid", *([] if name not in ("group", "lang") else ["id"]))) for name, columns in CHILDREN.items()},
        "group_types": Table("uid int, type int", ("uid", "type")),
        "ads": Table("ad int, query string, price int, enabled boolean, clicks0 bigint, views0 bigint, " + ", ".join(f"{s} bigint" for s in SUMS) + ", aud int, max_views int, rate_limit int, sites int, factor int, domain int, category int, subcategory int, `group` int", ("ad",), {"clicks0": 0, "views0": 0, "enabled": True, "sites": 255, "factor": 1000000, "price": 0, **{s: 0 for s in SUMS}}),
        "events": Table("uid int, ad int, kind string, price int, time int", ("uid", "ad", "time")),
        "visits": Table("uid int, name string, time int", ("uid", "time")),
    }


op = operations(Targ)
AD, USER = "ad:int", "uid:int"

# Advertisements

op("targ.adEnable", AD, change("ads", {"enabled": "true"}))
op("targ.adEnablePrice", f"{AD} price:int", change("ads", {"enabled": "true", "price": "q_price"}))
op("targ.adDisable", AD, change("ads", {"enabled": "false"}))
op("targ.adSetCtr", f"{AD} clicks:long views:long", change("ads", {"clicks0": "q_clicks", "views0": "q_views"}))
op("targ.adSetSump", f"{AD} sump0:long sump1:long sump2:long", change("ads", {s: f"q_{s}" for s in SUMS}))
op("targ.adSetCtrSump", f"{AD} clicks:long views:long sump0:long sump1:long sump2:long", change("ads", {"clicks0": "q_clicks", "views0": "q_views"} | {s: f"q_{s}" for s in SUMS}))
for _name, _argument, _column in (("SetAud", "aud", "aud"), ("LimitedViews", "max_views", "max_views"), ("ViewsRateLimit", "max_views", "rate_limit"), ("Sites", "mask", "sites"), ("SetFactor", "factor", "factor"), ("SetDomain", "domain", "domain"), ("SetGroup", "group", "group")):
    op(f"targ.ad{_name}", f"{AD} {_argument}:int", change("ads", {_column: f"q_{_argument}"}))
op("targ.adSetCategories", f"{AD} category:int subcategory:int", change("ads", {"category": "q_category", "subcategory": "q_subcategory"}))
op("targ.adQuery", AD, get("ads", "query"))


def _numbers(e: Engine) -> DataFrame:
    """ads with clicks, views, money and recent_views; a user's views after their first click of an ad don't count."""
    ev = e.state["events"]
    first = ev.where("kind = 'click'").groupBy("uid", "ad").agg(F.min("time").alias("_first"))
    rows = ev.join(first, ["uid", "ad"], "left")
    view = (F.col("kind") == "view") & (F.col("_first").isNull() | (F.col("time") <= F.col("_first")))
    n = rows.groupBy("ad").agg(F.count_if(F.col("kind") == "click").alias("c"), F.count_if(view).alias("v"), F.sum(F.when(F.col("kind") == "click", F.col("price"))).alias("m"), F.count_if((F.col("kind") == "view") & (F.col("time") > e.now - RECENT) & (F.col("time") <= e.now)).alias("r"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return e.state["ads"].join(n, "ad", "left").withColumns({"clicks": zero("clicks0") + zero("c"), "views": zero("views0") + zero("v"), "money": zero("m"), "recent_views": zero("r")}).drop("c", "v", "m", "r")


def _ad(*columns: str):
    def run(e: Engine, requests: DataFrame) -> DataFrame:
        return requests.select("rq", "ad").join(_numbers(e).select("ad", *(c for c in columns if c != "ad")), "ad", "left").select("rq", *columns)

    return run


for _name, _columns in (("Clicks", ["clicks"]), ("Views", ["views"]), ("Money", ["money"]), ("RecentViews", ["recent_views"]), ("Ctr", ["clicks", "views", "clicks0", "views0"]), ("Sump", list(SUMS)), ("CtrSump", ["clicks", "views", "clicks0", "views0", *SUMS])):
    op(f"targ.ad{_name}", AD, _ad(*_columns))


@op("targ.adInfo", AD)
def _info(e: Engine, requests: DataFrame) -> DataFrame:
    """All that is known of an ad, with its expected gain."""
    rows = _numbers(e).withColumn("expected_gain", estimated_gain(F.col("price"), F.col("clicks"), F.col("views")))
    return requests.join(rows, "ad", "left").drop("ad").select("rq", F.col("query").isNotNull().alias("found"), *(c for c in rows.columns if c != "ad"))


# Views and clicks


def _event(kind: str):
    def run(e: Engine, requests: DataFrame) -> DataFrame:
        """Known users and ads only."""
        r = requests.join(e.state["users"].select(F.col("id").alias("uid")), "uid", "left_semi").join(e.state["ads"].select("ad"), "ad", "left_semi")
        rows = r.select("uid", "ad", F.lit(kind).alias("kind"), (F.col("price") if kind == "click" else F.lit(0)).alias("price"), F.lit(e.now).alias("time"))
        e.state["events"] = e.state["events"].unionByName(rows)
        return requests.select("rq").join(r.select("rq", F.lit(True).alias("ok")), "rq", "left").select("rq", F.coalesce("ok", F.lit(False)).alias("ok"))

    return run


op("targ.userClick", f"{USER} ad:int price:int", _event("click"))
op("targ.userView", f"{USER} ad:int", _event("view"))
op("targ.userClickedAd", f"{USER} ad:int", lambda e, r: r.join(e.state["events"].where("kind = 'click'").groupBy("uid", "ad").agg(F.count("*").alias("n")), ["uid", "ad"], "left").select("rq", F.coalesce("n", F.lit(0)).alias("clicks")))
op("targ.userFlags", USER, get("users", "flags", by={"uid": "id"}))
op("targ.userGroups", USER, lambda e, r: r.join(e.state["group"], "uid").select("rq", F.col("id").alias("group")))


def _recent(e: Engine) -> DataFrame:
    return e.state["events"].where((F.col("kind") == "view") & (F.col("time") > e.now - RECENT) & (F.col("time") <= e.now))


def _most(rows: DataFrame, by: str, limited: bool = True) -> DataFrame:
    """rows (rq, limit, views, by) with pos, most views first."""
    rows = rows.withColumns({"pos": F.row_number().over(Window.partitionBy("rq").orderBy(F.desc("views"), by)), "total": F.count("*").over(Window.partitionBy("rq"))})
    return rows.where("pos <= limit") if limited else rows


op("targ.recentViewsStats", "mode:int limit:int", lambda e, r: _most(r.join(_recent(e).groupBy("ad").agg(F.count("*").alias("views")), F.lit(True)), "ad").select("rq", "pos", "total", "ad", "views"))
op("targ.recentAdViewers", f"{AD} mode:int limit:int", lambda e, r: _most(r.join(_recent(e).groupBy("ad", "uid").agg(F.count("*").alias("views")), "ad"), "uid").select("rq", "pos", "total", "uid", "views"))
op("targ.recentUserAds", f"{USER} mode:int limit:int", lambda e, r: _most(r.join(_recent(e).groupBy("uid", "ad").agg(F.count("*").alias("views")), "uid"), "ad").select("rq", "pos", "ad"))
op("targ.recentUserAdsCnt", f"{USER} mode:int limit:int", lambda e, r: _most(r.join(_recent(e).groupBy("uid", "ad").agg(F.count("*").alias("views")), "uid"), "ad").select("rq", "pos", "ad", "views"))
op("targ.userVisit", f"{USER} name:string", lambda e, r: _visit(e, r))


def _visit(e: Engine, requests: DataFrame) -> DataFrame:
    e.state["visits"] = e.state["visits"].unionByName(requests.select("uid", "name", F.lit(e.now).alias("time")))
    change("users", {"online": str(e.now)}, by={"uid": "id"})(e, requests.select("rq", "uid"))
    return requests.select("rq", F.lit(True).alias("ok"))


# Profiles

ID = {"uid": "id"}
for _name, _column in zip("Sex Operator Browser Region Height Smoking Alcohol Ppriority Iiothers Hidden Cvisited Gcountry Privacy Political Mstatus Timezone Rate Cute Flags".split(), NUMBERS[:19], strict=True):
    op(f"targ.set{_name}", f"{USER} value:int", put("users", by=ID, values={_column: "value"}))
op("targ.setRates", f"{USER} rate:int cute:int", put("users", by=ID))
op("targ.setCountryCity", f"{USER} country:int city:int", put("users", by=ID))
op("targ.setBirthday", f"{USER} day:int month:int year:int", put("users", by=ID, values={"bday_day": "day", "bday_month": "month", "bday_year": "year"}))
op("targ.setCustom", f"{USER} type:int value:int", change("users", {c: f"if(q_type = {i}, q_value, {c})" for i, c in enumerate(CUSTOM, 1)}, by=ID), "type 1 to 15; a batch takes the last request of each user.")
for _name, _column in (("Username", "name"), ("Religion", "religion"), ("Hometown", "hometown"), ("Proposal", "proposal")):
    op(f"targ.set{_name}", f"{USER} value:string", put("users", by=ID, values={_column: "value"}))
op("targ.deleteProposal", USER, change("users", {"proposal": "cast(NULL AS string)"}, by=ID))


def _child(table: str, values: dict[str, str]):
    """One more row of the user's."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        old = e.state[table]
        rows = requests.select(*(F.expr(values.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in old.schema))
        e.state[table] = old.unionByName(rows)
        return requests.select("rq", F.lit(True).alias("ok"))

    return run


op("targ.setSchool", f"{USER} country:int city:int school:int start:int finish:int grad:int sch_class:int sch_type:int spec:string", _child("school", {"id": "school", "graduation": "grad", "class": "sch_class", "type": "sch_type"}))
op("targ.setEducation", f"{USER} country:int city:int university:int faculty:int chair:int grad_year:int edu_form:int edu_status:int primary:int", _child("education", {"graduation": "grad_year", "form": "edu_form", "status": "edu_status", "primary": "`primary`"}))
op("targ.setCompany", f"{USER} country:int city:int company:int start:int finish:int company_name:string job:string", _child("company", {"id": "company", "name": "company_name"}))
op("targ.setMilitary", f"{USER} unit_id:int start:int finish:int", _child("military", {"unit": "unit_id"}))
op("targ.setAddress", f"{USER} atype:int country:int city:int district:int station:int street:int name:string house:string", _child("address", {"type": "atype"}))
op("targ.setInterest", f"{USER} type:int name:string", _child("interest", {}))


def _without(table: str, where: str | None = None):
    """The user's rows (that meet a condition over row and request) go."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        old = e.state[table]
        q = requests.select("uid", *(F.col(c).alias(f"q_{c}") for c in requests.columns if c != "uid")).distinct()
        if where is None:
            hit = q.select("uid").distinct()
            n = requests.select("rq", "uid").join(old.groupBy("uid").agg(F.count("*").alias("n")), "uid", "left")
            e.state[table] = old.join(hit, "uid", "left_anti")
            return n.select("rq", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"))
        o, r = old.alias("o"), q.alias("q")
        e.state[table] = o.join(r, (F.col("o.uid") == F.col("q.uid")) & F.expr(where), "left_anti")
        n = o.join(r, (F.col("o.uid") == F.col("q.uid")) & F.expr(where)).groupBy(F.col("q_rq").alias("rq")).agg(F.count("*").alias("n"))
        return requests.select("rq").join(n, "rq", "left").select("rq", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"))

    return run


for _name, _table, _where in (("Education", "education", None), ("Schools", "school", None), ("Work", "company", None), ("Addresses", "address", None), ("Military", "military", None), ("Groups", "group", None), ("PositiveGroups", "group", "o.id > 0"), ("NegativeGroups", "group", "o.id < 0"), ("Langs", "lang", None)):
    op(f"targ.delete{_name}", USER, _without(_table, _where))
op("targ.deleteInterests", f"{USER} type:int", _without("interest", "q_type = 0 OR o.type = q_type"))
op("targ.deleteUserGroup", f"{USER} group:int", _without("group", "o.id = q_group"))
op("targ.deleteUserGroups", f"{USER} groups:ints", _without("group", "array_contains(q_groups, o.id)"))
op("targ.deleteUserLang", f"{USER} lang:int", _without("lang", "o.id = q_lang"))
op("targ.deleteGroup", "gid:int", drop("group", by={"gid": "id"}, on=["id"]))
op("targ.deleteUser", USER, first_of(drop("users", by=ID), *(_without(t) for t in CHILDREN), _without("group_types")))


def _groups(table: str, argument: str, fresh: bool):
    """Groups (or languages, or types) are added; fresh: those there before go first."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        column = "type" if table == "group_types" else "id"
        many = dict(requests.dtypes)[argument].startswith("array")
        r = requests.select("rq", "uid", (F.explode(argument) if many else F.col(argument)).alias(column)).dropDuplicates(["uid", column])
        if fresh:
            _without(table)(e, requests.select("rq", "uid"))
        put(table, "add")(e, r)
        return requests.select("rq", F.lit(True).alias("ok"))

    return run


op("targ.setUserGroup", f"{USER} group:int", _groups("group", "group", False))
op("targ.addUserGroups", f"{USER} groups:ints", _groups("group", "groups", False))
op("targ.setUserGroups", f"{USER} groups:ints", _groups("group", "groups", True))
op("targ.setUserLang", f"{USER} value:int", _groups("lang", "value", False))
op("targ.setUserSingleGroupType", f"{USER} value:int", _groups("group_types", "value", False))
op("targ.setUserGroupTypes", f"{USER} types:ints", _groups("group_types", "types", True))


# Queries


def entities(e: Engine) -> DataFrame:
    """Users with their rows nested, as the query language sees them; children are gathered by user."""
    out = e.state["users"]
    for c in TEXTS:
        out = out.withColumn(c, words_of(F.coalesce(F.col(c), F.lit(""))))
    out = out.withColumn("name_interests", F.col("name"))
    worded = {("school", "spec"), ("company", "name"), ("company", "job"), ("address", "name"), ("address", "house")}
    for name in CHILDREN:
        rows = e.state[name]
        if name == "interest":
            own = rows.groupBy(F.col("uid").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list(words_of(F.col("name"))))).alias("interests"))
            out = out.join(own, "id", "left").withColumn("name_interests", F.array_union("name", F.coalesce("interests", F.array().cast("array<string>"))))
            continue
        element = F.struct(*((words_of(F.coalesce(F.col(c), F.lit(""))) if (name, c) in worded else F.col(c)).alias(c) for c in rows.columns if c != "uid"))
        out = out.join(rows.groupBy(F.col("uid").alias("id")).agg(F.collect_list(element).alias(name)), "id", "left")
    return out


def matches(e: Engine, queries: DataFrame) -> DataFrame:
    """query, id, rate, flags of every user that meets each different query; blocks of MOST_QUERIES take a pass over users each."""
    texts = sorted(r[0] for r in queries.select("query").where("query IS NOT NULL").distinct().toLocalIterator())
    users, out = entities(e), None
    for at in range(0, max(len(texts), 1), MOST_QUERIES):
        block = texts[at : at + MOST_QUERIES]
        hits = F.array_compact(F.array(*(F.when(compiled(t), F.lit(t)) for t in block))) if block else F.array().cast("array<string>")
        part = users.select("id", "rate", "flags", F.explode(hits).alias("query"))
        out = part if out is None else out.unionByName(part)
    return out


def _audience(e: Engine, requests: DataFrame) -> DataFrame:
    """rq, id, rate of the users of each request: those of the query that are in the list, if one is given, and pass the flags' mask."""
    r = requests
    for c, kind in (("user_list", "array<int>"), ("and_mask", "int"), ("xor_mask", "int")):
        r = r if c in r.columns else r.withColumn(c, F.lit(None).cast(kind))
    rows = r.join(matches(e, r), "query").where("(mode & 524288) = 0 OR array_contains(user_list, id)")
    return rows.where("(mode & 131072) = 0 OR ((coalesce(flags, 0) ^ xor_mask) & and_mask) = 0")


@op("targ.target", "mode:int ad:int cost_per_click:int discount:int query:string")
def _target(e: Engine, requests: DataFrame) -> DataFrame:
    """The ad gets a query and price and is enabled; the number of users it reaches."""
    put("ads", values={"price": "cost_per_click", "enabled": F.lit(True)})(e, requests.select("rq", "ad", "query", "cost_per_click"))
    n = requests.join(matches(e, requests), "query").groupBy("rq").agg(F.count("*").alias("users"))
    return requests.select("rq").join(n, "rq", "left").select("rq", F.coalesce("users", F.lit(0)).alias("users"))


def _prices(e: Engine) -> DataFrame:
    """id, ad, price of each user and each enabled ad that reaches them."""
    ads = e.state["ads"].where("enabled")
    return ads.select("ad", "price", "query").join(matches(e, ads), "query").select("id", "ad", "price")


def _histogram(e: Engine, users: DataFrame) -> DataFrame:
    """users (rq, place, limit, id): for each bucket of price under limit the users whose place-th best ad has it, higher prices in the last."""
    best = _prices(e).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("price"), "ad")))
    n = users.join(best.select("id", "r", "price"), "id").where("r = place").groupBy("rq", F.least(F.col("price"), F.col("limit") - 1).alias("bucket")).agg(F.count("*").alias("users"))
    every = users.select("rq", "limit").distinct().select("rq", F.explode(F.expr("sequence(0, limit - 1)")).alias("bucket"))
    total = users.groupBy("rq").agg(F.count("*").alias("total"))
    return every.join(n, ["rq", "bucket"], "left").join(total, "rq").select("rq", "total", "bucket", F.coalesce("users", F.lit(0)).alias("users"))


MASKS = "and_mask:int xor_mask:int"
op("targ.prices", f"mode:int place:int {MASKS} limit:int user_list:ints query:string", lambda e, r: _histogram(e, _audience(e, r).select("rq", "place", "limit", "id")))
op("targ.adPricing", f"mode:int ad:int place:int {MASKS} max_users_per_server:int limit:int", lambda e, r: _histogram(e, _audience(e, r.join(e.state["ads"].select("ad", "query"), "ad")).select("rq", "place", "limit", "id")), "All users of the ad count; max_users_per_server, a bound on work, isn't used.")


def _counts(requests: DataFrame, users: DataFrame, e: Engine, priced: bool) -> DataFrame:
    """A row for the query (pos 0) and each of its auxiliary queries within it: total and, priced, how many have the place at cpv or less."""
    aux = requests.select("rq", F.posexplode(F.concat(F.array("query"), F.coalesce("aux_queries", F.array().cast("array<string>")))).alias("pos", "aux"))
    hit = aux.join(matches(e, aux.select(F.col("aux").alias("query"))).select(F.col("query").alias("aux"), "id"), "aux").join(users.select("rq", "id"), ["rq", "id"], "left_semi")
    what = [F.count("*").alias("total")]
    if priced:
        best = _prices(e).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("price"), "ad")))
        own = requests.select("rq", "place", "cpv").join(users.select("rq", "id"), "rq").join(best.select("id", F.col("r").alias("place"), "price"), ["id", "place"], "left")
        hit = hit.join(own.select("rq", "id", (F.col("price").isNull() | (F.col("price") <= F.col("cpv"))).alias("top")), ["rq", "id"])
        what.append(F.count_if("top").alias("top_place"))
    n = hit.groupBy("rq", "pos").agg(*what)
    return aux.join(n, ["rq", "pos"], "left").select("rq", "pos", *(F.coalesce(c, F.lit(0)).alias(c) for c in n.columns if c not in ("rq", "pos")))


op("targ.audience", "mode:int user_list:ints aux_queries:strings query:string", lambda e, r: _counts(r, _audience(e, r), e, False))
op("targ.targAudience", f"mode:int place:int cpv:int {MASKS} max_users_per_server:int user_list:ints aux_queries:strings query:string", lambda e, r: _counts(r, _audience(e, r), e, True))


@op("targ.search", "mode:int limit:int user_list:ints query:string")
def _search(e: Engine, requests: DataFrame) -> DataFrame:
    """rq, pos, total, uid, rate by rate (mode 1), by id (2) or as they come (by id too); 4 turns the order round."""
    by = F.when(F.col("mode").bitwiseAND(F.lit(1)) != 0, F.coalesce("rate", F.lit(0))).otherwise(F.lit(0))
    turn = F.when(F.col("mode").bitwiseAND(F.lit(4)) != 0, -1).otherwise(1)
    rows = _audience(e, requests).withColumns({"pos": F.row_number().over(Window.partitionBy("rq").orderBy(by * turn, F.col("id") * turn)), "total": F.count("*").over(Window.partitionBy("rq"))})
    return rows.where("pos <= limit").select("rq", "pos", "total", F.col("id").alias("uid"), F.when(F.col("mode").bitwiseAND(F.lit(1)) != 0, F.col("rate")).alias("rate"))


@op("targ.userAds", "uid:int limit:int flags:int and_mask:int or_mask:int cat_mask:long")
def _user_ads(e: Engine, requests: DataFrame) -> DataFrame:
    """The user's best enabled ads by expected gain, one of each domain; sites pass ((sites ^ or_mask) & and_mask) = 0 under flag 17, else the default 255:1 (flag 16) or none. flags 1: with the gain, 2: the price."""
    ads = _numbers(e).where("enabled").withColumn("gain", estimated_gain(F.col("price"), F.col("clicks"), F.col("views")) * F.col("factor") / 1e6)
    seen = e.state["events"].where("kind = 'view'").groupBy(F.col("uid").alias("id"), "ad").agg(F.count("*").alias("viewed"))
    reach = matches(e, ads).join(ads, "query").join(seen, ["id", "ad"], "left").where("max_views IS NULL OR max_views = 0 OR coalesce(viewed, 0) < max_views")
    rows = requests.join(reach.withColumnsRenamed({"id": "uid", "flags": "_flags"}), "uid")
    rows = rows.where("(flags & 131072) = 0 OR ((sites ^ or_mask) & and_mask) = 0").where("(flags & 65536) = 0 OR (sites & 255) = 1").where("cat_mask = 0 OR category IS NULL OR (shiftright(cat_mask, category) & 1) = 1")
    one = rows.withColumn("r", F.row_number().over(Window.partitionBy("rq", F.coalesce("domain", -F.col("ad"))).orderBy(F.desc("gain"), "ad"))).where("r = 1")
    return one.withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy(F.desc("gain"), "ad"))).where("pos <= limit").select("rq", "pos", "ad", F.expr("if((flags & 1) <> 0, gain, null)").alias("expected_gain"), F.expr("if((flags & 2) <> 0, price, null)").alias("price"), F.coalesce("viewed", F.lit(0)).alias("viewed"))

