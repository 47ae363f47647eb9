"""Popularity of files by URL, their local copies and the disks these are on.

Access counters are decayed sums by half-life (acounter); flags of lists: 1 value, 2 size, 4 values of all half-lives, 8
only unknown sizes, 16 only without local copies, 32 and 64 the yellow light's time so far and left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, change, drop, get, operations, put

HALF_LIVES = (3600, 86400, 7 * 86400, 30 * 86400)


class Cache(Engine):
    tables = {
        "access": Table("cache_id int, url string, time int", ("cache_id", "url", "time")),
        "files": Table("cache_id int, url string, size bigint", ("cache_id", "url")),
        "copies": Table("cache_id int, url string, local_url string, node_id int, server_id int, disk_id int, cached_at int, yellow_at int, yellow_until int", ("cache_id", "url", "local_url")),
        "disabled": Table("cache_id int, node_id int, server_id int, disk_id int", ("cache_id", "node_id", "server_id", "disk_id")),
    }


op = operations(Cache)
ONE, PAIR = "cache_id:int url:string", "cache_id:int global_url:string local_url:string"
GLOBAL = {"global_url": "url"}


def _place(part: str, text: str = "local_url") -> str:
    """node, server or disk in cs<node>_<server>/d<disk>/..."""
    i = {"node": 1, "server": 2, "disk": 3}[part]
    return f"cast(nullif(regexp_extract({text}, '^cs(\\\\d+)_(\\\\d+)/d(\\\\d+)/', {i}), '') AS int)"


@op("cache.access", ONE)
def _access(e: Engine, requests: DataFrame) -> DataFrame:
    """A view of a file now; the file becomes known."""
    new = requests.select("cache_id", "url", F.lit(e.now).alias("time"))
    e.state["access"] = e.state["access"].unionByName(new)
    known = requests.select("cache_id", "url").distinct().join(e.state["files"], ["cache_id", "url"], "left_anti").withColumn("size", F.lit(None).cast("bigint"))
    e.state["files"] = e.state["files"].unionByName(known)
    return requests.select("rq", F.lit(True).alias("ok"))


op("cache.setFileSize", f"{ONE} size:long", change("files", {"size": "q_size"}))
op("cache.getFileSize", ONE, get("files", "size"))
op("cache.setNewLocalCopy", PAIR, lambda e, r: put("copies", "add", by=GLOBAL, values={"node_id": _place("node"), "server_id": _place("server"), "disk_id": _place("disk"), "cached_at": F.lit(e.now)})(e, r), "The place is in the local URL.")
op("cache.deleteLocalCopy", PAIR, drop("copies", by=GLOBAL))
op("cache.setYellowTimeRemaining", f"{PAIR} time:int", lambda e, r: change("copies", {"yellow_at": f"if(q_time > 0, {e.now}, null)", "yellow_until": f"if(q_time > 0, {e.now} + q_time, null)"}, by=GLOBAL)(e, r), "The yellow light for so many seconds, 0: off.")
op("cache.getYellowTime", PAIR, lambda e, r: get("copies", {"remaining": f"greatest(coalesce(yellow_until, 0) - {e.now}, 0)", "enabled": f"if(yellow_until > {e.now}, {e.now} - yellow_at, 0)"}, by=GLOBAL)(e, r), "Seconds left and seconds so far.")

for _what, _cols in (("Server", "node_id:int server_id:int"), ("Disk", "node_id:int server_id:int disk_id:int")):
    _on = ["cache_id", "node_id", "server_id"] + (["disk_id"] if _what == "Disk" else [])
    _every = {} if _what == "Disk" else {"disk_id": "-1"}
    op(f"cache.disable{_what}", f"cache_id:int {_cols}", put("disabled", values=_every), "A server is disabled as disk -1.")
    op(f"cache.enable{_what}", f"cache_id:int {_cols}", drop("disabled", on=_on))
    op(f"cache.delete{_what}", f"cache_id:int {_cols}", drop("copies", on=_on))


def _live(e: Cache) -> DataFrame:
    """Local copies on servers and disks that aren't disabled."""
    off = e.state["disabled"]
    return e.state["copies"].join(off.where("disk_id >= 0"), ["cache_id", "node_id", "server_id", "disk_id"], "left_anti").join(off.where("disk_id < 0"), ["cache_id", "node_id", "server_id"], "left_anti")


@op("cache.convert", ONE)
def _convert(e: Engine, requests: DataFrame) -> DataFrame:
    """A live local copy without the yellow light, the first by name."""
    best = _live(e).where(f"coalesce(yellow_until, 0) <= {e.now}").groupBy("cache_id", "url").agg(F.min("local_url").alias("local_url"))
    return requests.join(best, ["cache_id", "url"], "left").select("rq", "local_url")


@op("cache.getLocalCopies", ONE)
def _copies(e: Engine, requests: DataFrame) -> DataFrame:
    """Each local copy; flags 1: its server or disk is disabled, 2: yellow light."""
    live = _live(e).select("cache_id", "url", "local_url", F.lit(0).alias("_off"))
    rows = e.state["copies"].join(live, ["cache_id", "url", "local_url"], "left")
    flags = F.coalesce("_off", F.lit(1)) + F.when(F.col("yellow_until") > e.now, 2).otherwise(0)
    return requests.join(rows, ["cache_id", "url"]).select("rq", "local_url", "node_id", "server_id", "disk_id", flags.alias("flags"), "cached_at")


def _decayed(now: int, half_life) -> Column:
    return F.sum(F.pow(F.lit(2.0), -(F.lit(now) - F.col("time")) / half_life))


@op("cache.getAcounter", f"{ONE} t:int")
def _acounter(e: Engine, requests: DataFrame) -> DataFrame:
    """Views of a file, each halved every t seconds."""
    v = requests.join(e.state["access"], ["cache_id", "url"]).groupBy("rq").agg(_decayed(e.now, F.col("t")).alias("value"))
    return requests.select("rq").join(v, "rq", "left")


def _ranked(disk: bool, top: bool):
    """Files (or local copies on a disk) by decayed views."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        q = requests
        hits = q.select("rq", "cache_id", "t").join(e.state["access"], "cache_id").groupBy("rq", "cache_id", "url").agg(_decayed(e.now, F.col("t")).alias("value"), *(_decayed(e.now, float(h)).alias(f"v{h}") for h in HALF_LIVES))
        size = e.state["files"].select("cache_id", "url", "size")
        rows = q.join(size, "cache_id").join(hits, ["rq", "cache_id", "url"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
        has = e.state["copies"].select("cache_id", "url").distinct().withColumn("_has", F.lit(True))
        if disk:
            rows = rows.join(e.state["copies"], ["cache_id", "url", "node_id", "server_id", "disk_id"])
        else:
            rate = F.when(F.col("min_rate") >= 1_000_000, F.col("min_rate") / 1e6).otherwise(F.col("min_rate"))
            rows = rows.join(has, ["cache_id", "url"], "left").where((F.col("min_rate") == 0) | (F.col("value") > rate)).where("((flags & 8) = 0 OR size IS NULL) AND ((flags & 16) = 0 OR _has IS NULL)")
        order = [F.desc("value") if top else F.asc("value"), "url"] + (["local_url"] if disk else [])
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy(*order))).where("pos <= limit")
        on = lambda bit, c: F.when(F.col("flags").bitwiseAND(F.lit(bit)) != 0, c)
        extra = [F.col("local_url"), on(32, F.when(F.col("yellow_until") > e.now, e.now - F.col("yellow_at"))).alias("yellow_enabled"), on(64, F.greatest(F.coalesce("yellow_until", F.lit(0)) - e.now, F.lit(0))).alias("yellow_remaining")] if disk else []
        values = F.array(*(F.coalesce(f"v{h}", F.lit(0.0)) for h in HALF_LIVES))
        return rows.select("rq", "pos", "url", on(1, F.col("value")).alias("value"), on(2, F.col("size")).alias("size"), on(4, values).alias("values"), *extra)

    return run


op("cache.getTopAccess", "cache_id:int t:int limit:int flags:int min_rate:int", _ranked(False, True))
op("cache.getBottomAccess", "cache_id:int t:int limit:int flags:int min_rate:int", _ranked(False, False))
op("cache.getTopDisk", "cache_id:int t:int limit:int flags:int node_id:int server_id:int disk_id:int", _ranked(True, True))
op("cache.getBottomDisk", "cache_id:int t:int limit:int flags:int node_id:int server_id:int disk_id:int", _ranked(True, False))


@op("cache.getServerStats", "cache_id:int sorting_flags:int")
def _servers(e: Engine, requests: DataFrame) -> DataFrame:
    """node_id, server_id, files, all_files_size and their share of all views; sorted (1: by share, 2: by size, else by number)."""
    views = e.state["access"].groupBy("cache_id", "url").agg(F.count("*").alias("views"))
    rows = e.state["copies"].join(e.state["files"], ["cache_id", "url"], "left").join(views, ["cache_id", "url"], "left")
    s = rows.groupBy("cache_id", "node_id", "server_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("all_files_size"), F.sum(F.coalesce("views", F.lit(0))).alias("_v"))
    total = s.groupBy("cache_id").agg(F.sum("_v").alias("_t"))
    out = requests.join(s.join(total, "cache_id"), "cache_id").withColumn("access_percent", F.when(F.col("_t") > 0, 100 * F.col("_v") / F.col("_t")).otherwise(0.0))
    by = F.when(F.col("sorting_flags") == 1, F.col("access_percent")).when(F.col("sorting_flags") == 2, F.col("all_files_size").cast("double")).otherwise(F.col("files").cast("double"))
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy(by.desc(), "node_id", "server_id"))).select("rq", "pos", "node_id", "server_id", "access_percent", "all_files_size", "files")

