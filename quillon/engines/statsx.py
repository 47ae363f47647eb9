"""Counters of views and unique visitors by version (a day from the counter's midnight), with breakdowns.

mode bits of a counter: 0 sex, 1 age, 2 marital status, 3 political views, 4 section, 5 city, 6 country by address, 7 country, 8
source, 9 views, 10 visitors, 11 sex and age, 12 visitors of the last 30 days, 13 of the last 7, 14 deletes, 15 version, 16
end of the version, 17 sub-counters. Breakdowns are maps from a value to visitors, a visitor counting by their first event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, operations, put

PARTS = ("sex", "age", "marital_status", "political_views", "section", "city", "geoip_country", "country", "source")
TEXT = ("geoip_country", "country")
EVENTS = "cnt_id bigint, version int, uid int, op int, time int, n bigint, " + ", ".join(f"{p} {'string' if p in TEXT else 'int'}" for p in PARTS)


class Statsx(Engine):
    tables = {"events": Table(EVENTS, ("cnt_id", "uid", "n")), "subcounts": Table("cnt_id bigint, version int, sub int, n int", ("cnt_id", "version", "sub"), {"n": 0}), "counters": Table("cnt_id bigint, enabled boolean, timezone int", ("cnt_id",), {"enabled": True, "timezone": 0})}


op = operations(Statsx)


def _versions(e: Engine, requests: DataFrame) -> DataFrame:
    """requests with enabled, timezone (hours east) and current, the version that runs now."""
    c = requests.join(e.state["counters"], "cnt_id", "left").withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "timezone": F.coalesce("timezone", F.lit(0))})
    shift = F.col("timezone") * 3600
    return c.withColumn("current", (F.floor((F.lit(e.now) + shift) / 86400) * 86400 - shift).cast("int"))


def _event(sign: int, versioned: bool):
    """A view (or its withdrawal) by a visitor; disabled counters don't move. The result is the number of views then."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        r = requests.withColumnRenamed("version", "given") if versioned else requests
        r = _versions(e, r).where("enabled").withColumn("version", F.col("given") if versioned else F.col("current"))
        r = r.withColumns({p: F.when(F.shiftright("mode", i).bitwiseAND(F.lit(1)) == 1, F.col(p)) for i, p in enumerate(PARTS)})
        old = e.state["events"]
        rows = r.select("cnt_id", "version", "uid", F.lit(1 if sign < 0 else 0).alias("op"), F.lit(e.now).alias("time"), F.col("rq").alias("n"), *PARTS)
        e.state["events"] = old.unionByName(rows)
        views = e.state["events"].where("op = 0").groupBy("cnt_id", "version").agg(F.count("*").alias("views"))
        return requests.select("rq").join(r.select("rq", "cnt_id", "version").join(views, ["cnt_id", "version"], "left").select("rq", "views"), "rq", "left")

    return run


def _sub(sign: int, versioned: bool):
    """One more (or less) in sub-counter 0 to 63; the new number."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        r = requests.withColumnRenamed("version", "given") if versioned else requests
        r = _versions(e, r).where("enabled AND subcnt_id BETWEEN 0 AND 63").withColumn("version", F.col("given") if versioned else F.col("current"))
        total = r.groupBy("cnt_id", "version", F.col("subcnt_id").alias("sub")).agg((F.count("*") * sign).alias("_d"))
        old = e.state["subcounts"]
        e.state["subcounts"] = old.join(total, ["cnt_id", "version", "sub"], "full").select("cnt_id", "version", "sub", (F.coalesce("n", F.lit(0)) + F.coalesce("_d", F.lit(0))).cast("int").alias("n"))
        now = r.select("rq", "cnt_id", "version", F.col("subcnt_id").alias("sub")).join(e.state["subcounts"], ["cnt_id", "version", "sub"]).select("rq", "n")
        return requests.select("rq").join(now, "rq", "left")

    return run


ARGUMENTS = "uid:int mode:int " + " ".join(f"{p}:{'string' if p in TEXT else 'int'}" for p in PARTS)
for _name, _sign in (("incr", 1), ("decr", -1)):
    op(f"statsx.{_name}", f"cnt_id:long {ARGUMENTS}", _event(_sign, False))
    op(f"statsx.{_name}Version", f"cnt_id:long version:int {ARGUMENTS}", _event(_sign, True))
    op(f"statsx.{_name}Subcnt", "cnt_id:long subcnt_id:int", _sub(_sign, False))
    op(f"statsx.{_name}SubcntVersion", "cnt_id:long version:int subcnt_id:int", _sub(_sign, True))


def _asked(e: Engine, requests: DataFrame, versioned: bool) -> DataFrame:
    return requests if versioned else _versions(e, requests).withColumn("version", F.col("current")).select(*requests.columns, "version")


def _number(what: str, versioned: bool):
    def run(e: Engine, requests: DataFrame) -> DataFrame:
        n = e.state["events"].groupBy("cnt_id", "version").agg(F.count_if(F.col("op") == 0).alias("views"), F.countDistinct("uid").alias("visitors"))
        return _asked(e, requests, versioned).join(n, ["cnt_id", "version"], "left").select("rq", what)

    return run


for _what, _name in (("views", "getViews"), ("visitors", "getVisitors")):
    op(f"statsx.{_name}", "cnt_id:long", _number(_what, False))
    op(f"statsx.{_name}Version", "cnt_id:long version:int", _number(_what, True))
op("statsx.enableCounter", "cnt_id:long", put("counters", values={"enabled": "true"}))
op("statsx.disableCounter", "cnt_id:long", put("counters", values={"enabled": "false"}))
op("statsx.setTimezone", "cnt_id:long offset:int", put("counters", values={"timezone": "offset"}), "offset: hours east.")


def counter(e: Engine, asked: DataFrame) -> DataFrame:
    """asked (rq, cnt_id, version, mode) with the columns of a counter, null where their bit is off."""
    own = asked.select("cnt_id", "version").distinct().join(e.state["events"], ["cnt_id", "version"])
    first = own.groupBy("cnt_id", "version", "uid").agg(F.count_if(F.col("op") == 0).alias("v"), F.count_if(F.col("op") == 1).alias("d"), F.min_by(F.struct(*PARTS), F.struct("time", "n")).alias("p"))
    out = first.groupBy("cnt_id", "version").agg(F.sum("v").alias("views"), F.count("*").alias("visitors"), F.sum("d").alias("deletes"))
    both = [(p, F.col(f"p.{p}").cast("string")) for p in PARTS] + [("sex_age", F.when(F.col("p.sex").isNotNull() & F.col("p.age").isNotNull(), F.concat_ws("_", "p.sex", "p.age")))]
    for name, value in both:
        n = first.where(value.isNotNull()).groupBy("cnt_id", "version", value.alias("k")).agg(F.count("*").alias("c"))
        out = out.join(n.groupBy("cnt_id", "version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "c")))).alias(name)), ["cnt_id", "version"], "left")
    subs = e.state["subcounts"].groupBy("cnt_id", "version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sub", "n")))).alias("extra"))
    last = e.state["events"].groupBy("cnt_id", "uid").agg(F.max("version").alias("_last"))
    rows = asked.join(out, ["cnt_id", "version"], "left").join(subs, ["cnt_id", "version"], "left")
    recent = asked.join(last, "cnt_id").where("_last <= version").groupBy("rq").agg(F.count_if(F.expr("version - _last < 30 * 86400")).alias("month"), F.count_if(F.expr("version - _last < 7 * 86400")).alias("week"))
    rows = rows.join(recent, "rq", "left").withColumn("expires", F.col("version") + 86400).withColumn("_version", F.col("version"))
    bits = {**{p: i for i, p in enumerate(PARTS)}, "views": 9, "visitors": 10, "sex_age": 11, "month": 12, "week": 13, "deletes": 14, "_version": 15, "expires": 16, "extra": 17}
    return rows.select("rq", *(F.when(F.shiftright("mode", b).bitwiseAND(F.lit(1)) == 1, F.col(c)).alias("version" if c == "_version" else c) for c, b in bits.items()))


ALL = (1 << 18) - 1
op("statsx.getCounter", "cnt_id:long", lambda e, r: counter(e, _asked(e, r, False).withColumn("mode", F.lit(ALL))))
op("statsx.getCounterVersion", "cnt_id:long version:int", lambda e, r: counter(e, r.withColumn("mode", F.lit(ALL))))
op("statsx.getCounterMask", "cnt_id:long mode:int", lambda e, r: counter(e, _asked(e, r, False)))
op("statsx.getCounterMaskVersion", "cnt_id:long mode:int version:int", counter)
op("statsx.getVersions", "cnt_id:long", lambda e, r: r.join(e.state["events"].select("cnt_id", "version").distinct(), "cnt_id").select("rq", "version"))


def _monthly(visitors: bool):
    def run(e: Engine, requests: DataFrame) -> DataFrame:
        """Calendar months of the versions' days."""
        day = F.date_from_unix_date(F.floor(F.col("version") / 86400).cast("int"))
        rows = requests.join(e.state["events"].where("op = 0"), "cnt_id").withColumns({"year": F.year(day), "month": F.month(day)})
        return rows.groupBy("rq", "year", "month").agg((F.countDistinct("uid") if visitors else F.count("*")).alias("count"))

    return run


op("statsx.getMonthlyVisitors", "cnt_id:long", _monthly(True))
op("statsx.getMonthlyViews", "cnt_id:long", _monthly(False))


@op("statsx.getCountersSum", "cnt_id:long from:int to:int")
def _sum(e: Engine, requests: DataFrame) -> DataFrame:
    """Views, visitors and deletes over the versions from <= version <= to; a visitor counts once in each."""
    n = e.state["events"].groupBy("cnt_id", "version").agg(F.count_if(F.col("op") == 0).alias("views"), F.countDistinct("uid").alias("visitors"), F.count_if(F.col("op") == 1).alias("deletes"))
    s = requests.join(n, "cnt_id").where(F.col("version").between(F.col("from"), F.col("to"))).groupBy("rq").agg(*(F.sum(c).alias(c) for c in ("views", "visitors", "deletes")))
    return requests.select("rq").join(s, "rq", "left")


