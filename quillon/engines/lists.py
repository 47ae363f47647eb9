"""Lists of objects: entries by list and object, both vectors of numbers, with flags, date, value and text.

mode bits: 0-2 the sublist (flags & 7) of that number, 3 sublist 0, 4 descending, 5 by date, 6 to 15 columns of the
full forms: flags, date, global_id, value, text, ip, front_ip, port, ua_hash, object_id. In sorted lists bits 0 and 1 are
descending date and descending value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, add_to, bits, change, counted, drop, get, listed, operations, put

FIELDS = {"flags": 6, "date": 7, "global_id": 8, "value": 9, "text": 10, "ip": 11, "front_ip": 12, "port": 13, "ua_hash": 14}
IN_MODE = "((q_mode & 15) = 0 OR (q_mode & 8) <> 0 AND (flags & 7) = 0 OR (q_mode & 8) = 0 AND (flags & 7) = (q_mode & 7))"


class Lists(Engine):
    tables = {"entries": Table("list_id array<int>, object_id array<int>, flags int, date int, global_id bigint, value bigint, text string, ip int, front_ip int, port int, ua_hash int", ("list_id", "object_id"), {"flags": 0, "value": 0, "date": 0})}


op = operations(Lists)
KEY = "list_id:ints object_id:ints"
FULL = {"object_id": "object_id"} | {f: f"if(((q_mode >> {b}) & 1) = 1, {f}, null)" for f, b in FIELDS.items()}

op("lists.deleteList", "list_id:ints", drop("entries", on=["list_id"]))
op("lists.deleteObject", "object_id:ints", drop("entries", on=["object_id"]))
op("lists.deleteEntry", KEY, drop("entries"))
for _name, _mode in (("setEntry", "set"), ("addEntry", "add"), ("replaceEntry", "replace")):
    op(f"lists.{_name}", f"{KEY} flags:int value:long date:int" + (" text:string" if _mode != "replace" else ""), put("entries", _mode))
op("lists.setEntryText", f"{KEY} text:string", change("entries", {"text": "nullif(q_text, '')"}))
op("lists.setFlags", f"{KEY} flags:int", change("entries", {"flags": "q_flags"}))
op("lists.changeFlags", f"{KEY} set_flags:int clear_flags:int", change("entries", {"flags": "(flags & ~q_clear_flags) | q_set_flags"}))
op("lists.incrFlags", f"{KEY} flags:int", bits("entries", "flags"))
op("lists.decrFlags", f"{KEY} flags:int", bits("entries", "flags", clear=True))
op("lists.setValue", f"{KEY} value:long", change("entries", {"value": "q_value"}))
op("lists.incrValue", f"{KEY} value:long", add_to("entries", "value"))
op("lists.decrValue", f"{KEY} value:long", add_to("entries", "value", amount="-value"))
op("lists.incrValueOrCreate", f"{KEY} flags:int value:long", add_to("entries", "value", create=True, extra={"flags": "flags"}))
op("lists.decrValueOrCreate", f"{KEY} flags:int value:long", add_to("entries", "value", amount="-value", create=True, extra={"flags": "flags"}))
SUB, MASKED = "(flags & 7) = q_flags", "((flags ^ q_xor_mask) & q_and_mask) = 0"
op("lists.setListFlags", "list_id:ints flags:int new_flags:int", change("entries", {"flags": "q_new_flags"}, on=["list_id"], where=SUB))
op("lists.changeListFlags", "list_id:ints flags:int new_or_mask:int new_nand_mask:int", change("entries", {"flags": "(flags & ~q_new_nand_mask) | q_new_or_mask"}, on=["list_id"], where=SUB))
op("lists.changeListFlagsEx", "list_id:ints xor_mask:int and_mask:int new_or_mask:int new_nand_mask:int", change("entries", {"flags": "(flags & ~q_new_nand_mask) | q_new_or_mask"}, on=["list_id"], where=MASKED))
op("lists.deleteSublist", "list_id:ints flags:int", drop("entries", on=["list_id"], where=SUB))
op("lists.deleteSublistEx", "list_id:ints xor_mask:int and_mask:int", drop("entries", on=["list_id"], where=MASKED))

op("lists.getEntry", f"{KEY} mode:int", get("entries", {k: v for k, v in FULL.items() if k != "object_id"}))
for _name, _field in (("Flags", "flags"), ("Date", "date"), ("Value", "value"), ("GlobalId", "global_id"), ("Text", "text")):
    op(f"lists.getEntry{_name}", KEY, get("entries", _field))
op("lists.getEntryPos", "list_id:ints object:ints", counted("entries", ["list_id"], result={"pos": "cast(count_if(_row AND object_id <= q_object) AS int) - 1"}))


def _shown(full: bool, limit: bool, sort: bool = False, where: str | None = None, signature: str = ""):
    """Lists in a mode: ids only, or the columns of its bits; with or without a limit and an offset."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        names = list(FULL) if full else ["object_id"]
        if sort:
            down = lambda bit, c: F.expr(f"if((q_mode & {bit}) <> 0, -{c}, {c})").asc()
            order, turn, keep = [down(2, "value"), down(1, "coalesce(date, 0)"), "object_id"], None, MASKED
        else:
            order, turn, keep = [F.expr("if((q_mode & 32) <> 0, coalesce(date, 0), 0)"), "object_id"], "(q_mode & 16) <> 0", IN_MODE
        extra = ["q_mode"] if full else []
        f = listed("entries", ["list_id"], names + extra, order, where=" AND ".join(f"({x})" for x in (keep, where) if x), limit="q_limit" if limit else None, offset="q_offset" if limit and not sort and "offset" in signature else None, total=True, descending=turn)
        out = f(e, requests)
        return out.select("rq", "pos", "total", *(F.expr(FULL[n]).alias(n) for n in names)) if full else out

    return run


for _full in ("", "Full"):
    op(f"lists.getList{_full}", "list_id:ints mode:int", _shown(bool(_full), False))
    op(f"lists.getList{_full}Limit", "list_id:ints mode:int limit:int offset:int", _shown(bool(_full), True, signature="offset"))
    for _wild, _where in (("", "array_contains(q_object_list, object_id)"), ("Wild", "exists(q_object_list, p -> slice(object_id, 1, size(p)) = p)")):
        op(f"lists.intersect{_wild}{_full}", "list_id:ints mode:int object_list:array<array<int>>", _shown(bool(_full), False, where=_where))
        op(f"lists.intersect{_wild}{_full}Limit", "list_id:ints mode:int object_list:array<array<int>> limit:int", _shown(bool(_full), True, where=_where))
    op(f"lists.sortedList{_full}", "list_id:ints xor_mask:int and_mask:int mode:int", _shown(bool(_full), False, sort=True))
    op(f"lists.sortedList{_full}Limit", "list_id:ints xor_mask:int and_mask:int mode:int limit:int", _shown(bool(_full), True, sort=True))

op("lists.getListCount", "list_id:ints", counted("entries", ["list_id"]))
op("lists.getSublistCount", "list_id:ints mode:int", counted("entries", ["list_id"], where=IN_MODE))
op("lists.getSublistsCount", "list_id:ints", counted("entries", ["list_id"], result={"n": "count_if(_row)"} | {f"s{k}": f"count_if(_row AND (flags & 7) = {k})" for k in range(8)}))


def _subtract(limit: bool):
    """The given objects that aren't in the list (in its mode), in their own order."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        own = requests.select("rq", "list_id", F.col("mode").alias("q_mode"), *(["limit"] if limit else []), F.posexplode("object_list").alias("at", "object_id"))
        there = own.join(e.state["entries"], ["list_id", "object_id"]).where(IN_MODE).select("rq", "object_id").distinct()
        left = own.join(there, ["rq", "object_id"], "left_anti")
        w = F.row_number().over(_by("rq", "at"))
        out = left.withColumn("pos", w)
        out = out.where("pos <= limit") if limit else out
        return out.select("rq", "pos", "object_id")

    return run


def _by(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


op("lists.subtract", "list_id:ints mode:int object_list:array<array<int>>", _subtract(False))
op("lists.subtractLimit", "list_id:ints mode:int object_list:array<array<int>> limit:int", _subtract(True))


def _sumlist(wild: bool, weighted: bool):
    """Number, or sum of weights, of the list's entries (in its mode) that are given, or start with what is given."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        own = requests.select("rq", "list_id", F.col("mode").alias("q_mode"), F.explode(F.arrays_zip(F.col("object_list").alias("o"), (F.col("weights") if weighted else F.transform("object_list", lambda x: F.lit(1))).alias("w"))).alias("z")).select("rq", "list_id", "q_mode", F.col("z.o").alias("o"), F.col("z.w").alias("w"))
        fits = "slice(object_id, 1, size(o)) = o" if wild else "object_id = o"
        hit = own.join(e.state["entries"], "list_id").where(fits).where(IN_MODE)
        return requests.select("rq").join(hit.groupBy("rq").agg(F.sum("w").alias("s")), "rq", "left").select("rq", F.coalesce("s", F.lit(0)).cast("bigint").alias("sum"))

    return run


for _wild in ("", "Wild"):
    op(f"lists.sumlist{_wild}", "list_id:ints mode:int object_list:array<array<int>>", _sumlist(bool(_wild), False))
    op(f"lists.sumlistWeighted{_wild}", "list_id:ints mode:int object_list:array<array<int>> weights:ints", _sumlist(bool(_wild), True))


@op("lists.datedistr", "list_id:ints mode:int min_date:int max_date:int step:int")
def _datedistr(e: Engine, requests: DataFrame) -> DataFrame:
    """rq, bucket, n: entries by steps of date; bucket -1 is below min_date, the one after the last is from max_date on."""
    q = requests.withColumnsRenamed({"mode": "q_mode"})
    every = q.select("rq", F.explode(F.expr("sequence(-1, cast((max_date - min_date) div step AS int))")).alias("bucket"))
    bucket = F.expr("cast(CASE WHEN date < min_date THEN -1 WHEN date >= max_date THEN (max_date - min_date) div step ELSE (date - min_date) div step END AS int)")
    n = q.join(e.state["entries"], "list_id").where(IN_MODE).groupBy("rq", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(n, ["rq", "bucket"], "left").select("rq", "bucket", F.coalesce("n", F.lit(0)).alias("n"))
