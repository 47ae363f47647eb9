"""Photos, audio and video of owners in albums: fields, locations, order, deletion and conditions.

Kinds share one table. An object's location is a list of structs; changes add to it. fields_mask has a bit for each of a
kind's fields in their order; bit 29 also shows deleted objects. Conditions are those of ``predicate.condition``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, change, drop, operations, put
from quillon.operators.predicate import condition

PLACE = "array<struct<server:int,server2:int,user_id:int,orig_album:int,photo:string,rotate:int,size:string,volume_id:int>>"
FIELDS = {
    "photo": ("id", "album_id", "owner_id", "user_id", "height", "width", "location", "original_location"), "audio": ("id", "album_id", "owner_id", "uploaded", "duration", "location"), "video": ("id", "album_id", "owner_id", "date", "title", "description", "location", "flags"),
    "photo_album": ("id", "owner_id", "title", "description"), "audio_album": ("id", "owner_id", "title"), "video_album": ("id", "owner_id", "title"),
}
KIND_OF = {"user_id": "int", "height": "int", "width": "int", "uploaded": "int", "duration": "int", "date": "int", "title": "string", "description": "string", "flags": "int", "album_id": "int"}
NUMBERS = ("user_id", "height", "width", "uploaded", "duration", "date", "flags", "album_id", "views")
OBJECT = f"kind string, owner_id int, id int, album_id int, user_id int, height int, width int, uploaded int, duration int, date int, title string, description string, flags int, views int, rotation int, place double, deleted boolean, location {PLACE}, original_location {PLACE}, saved {PLACE}"
MOST_CONDITIONS = 1000


class Photo(Engine):
    tables = {"objects": Table(OBJECT, ("kind", "owner_id", "id"), {"deleted": False, "rotation": 0, "views": 0}), "volumes": Table("volume_id int, server_id int", ("volume_id",))}


op = operations(Photo)


def _kind(kind: str, run):
    """The operation on objects of one kind; photo_id and album_id name the object."""

    def of(e: Engine, requests: DataFrame) -> DataFrame:
        return run(e, requests.withColumn("kind", F.lit(kind)))

    return of


def _changed(kind: str):
    values = [f for f in FIELDS[kind] if f in KIND_OF]
    places = [f for f in FIELDS[kind] if f.endswith("location")]
    set_ = {f: f"coalesce(q_{f}, {f})" for f in values} | {p: f"concat(coalesce({p}, array()), coalesce(q_{p}, array()))" for p in places}
    return " ".join([f"{f}:{KIND_OF[f]}" for f in values] + [f"{p}:{PLACE}" for p in places]), set_


def _empty(column: str) -> str:
    return f"cast(array() AS {PLACE})" if column else ""


for _name, _kind_name in (("Photo", "photo"), ("Audio", "audio"), ("Video", "video"), ("PhotoAlbum", "photo_album"), ("AudioAlbum", "audio_album"), ("VideoAlbum", "video_album")):
    _signature, _set = _changed(_kind_name)
    _id = "album_id" if "Album" in _name else "photo_id"
    op(f"photo.change{_name}", f"owner_id:int {_id}:int {_signature}", _kind(_kind_name, change("objects", _set, by={_id: "id"})), "Null leaves a field as it is; locations are added.")


def _increment(kind: str, key: str):
    """cnt more in a named field of numbers; ok is whether there is such a field and object."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        r = requests.withColumnRenamed(key, "id").withColumn("kind", F.lit(kind))
        total = r.groupBy("kind", "owner_id", "id").agg(*(F.sum(F.when(F.col("field") == f, F.col("cnt"))).alias(f"_{f}") for f in NUMBERS))
        old = e.state["objects"]
        e.state["objects"] = old.join(total, ["kind", "owner_id", "id"], "left").select(*(F.when(F.col(f"_{c}").isNotNull(), (F.coalesce(F.col(c), F.lit(0)) + F.col(f"_{c}")).cast("int")).otherwise(F.col(c)).alias(c) if c in NUMBERS else F.col(c) for c in old.columns))
        there = old.select("kind", "owner_id", "id").withColumn("_there", F.lit(True))
        return r.join(there, ["kind", "owner_id", "id"], "left").select("rq", (F.coalesce("_there", F.lit(False)) & F.col("field").isin(*NUMBERS)).alias("ok"))

    return run


for _name in ("Photo", "Audio", "Video"):
    op(f"photo.increment{_name}Field", "owner_id:int photo_id:int field:string cnt:int", _increment(_name.lower(), "photo_id"))
op("photo.incrementAlbumField", "owner_id:int album_id:int field:string cnt:int", _increment("photo_album", "album_id"))
op("photo.setVolumeServer", "volume_id:int server_id:int", put("volumes"))

PHOTO = "owner_id:int photo_id:int"
BY = {"photo_id": "id"}
for _what, _column in (("Location", "location"), ("OriginalLocation", "original_location")):
    op(f"photo.delete{_what}Storage", f"{PHOTO} rotate:int size:string", _kind("photo", change("objects", {_column: f"filter({_column}, x -> NOT (x.rotate <=> q_rotate AND x.size <=> q_size))"}, by=BY)))
    op(f"photo.delete{_what}", PHOTO, _kind("photo", change("objects", {_column: _empty(_column)}, by=BY)))
    for _n, _field in (("", "server"), ("2", "server2")):
        _moved = ", ".join(f"'{f}', " + ("q_new_server_id" if f == _field else f"x.{f}") for f in ("server", "server2", "user_id", "orig_album", "photo", "rotate", "size", "volume_id"))
        op(f"photo.change{_what}Server{_n}", f"{PHOTO} new_server_id:int", _kind("photo", change("objects", {_column: f"transform({_column}, x -> named_struct({_moved}))"}, by=BY)))
op("photo.savePhotoLocation", PHOTO, _kind("photo", change("objects", {"saved": "location"}, by=BY)))
op("photo.restorePhotoLocation", PHOTO, _kind("photo", change("objects", {"location": "coalesce(saved, location)", "saved": f"cast(NULL AS {PLACE})"}, by=BY)))
op("photo.rotatePhoto", f"{PHOTO} dir:int", _kind("photo", change("objects", {"rotation": "pmod(rotation + q_dir, 4)", "width": "if(pmod(q_dir, 2) = 1, height, width)", "height": "if(pmod(q_dir, 2) = 1, width, height)"}, by=BY)), "dir quarter turns.")


def _order(kind: str, key: str, album: bool):
    """The object moves right after (is_next) or before another one; its place becomes the middle of its neighbours'. A batch takes the last request of each object."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        old = e.state["objects"]
        own = old.where(F.col("kind") == kind).select("owner_id", "id", *(["album_id"] if album else []), "place")
        group = ["owner_id", "album_id"] if album else ["owner_id"]
        w = Window.partitionBy(*group).orderBy("place", "id")
        near = own.withColumns({"after": F.lead("place").over(w), "before": F.lag("place").over(w)}).withColumnsRenamed({"id": "id_near", "place": "at"})
        r = requests.withColumnRenamed(key, "id").join(own.select("owner_id", "id"), ["owner_id", "id"], "left_semi").join(near.select("owner_id", "id_near", "at", "after", "before"), ["owner_id", "id_near"]).where("id <> id_near")
        new = F.when(F.col("is_next"), F.coalesce((F.col("at") + F.col("after")) / 2, F.col("at") + 1)).otherwise(F.coalesce((F.col("at") + F.col("before")) / 2, F.col("at") - 1))
        moved = r.groupBy("owner_id", "id").agg(F.max_by(new, "rq").alias("_place")).withColumn("kind", F.lit(kind))
        e.state["objects"] = old.join(moved, ["kind", "owner_id", "id"], "left").withColumn("place", F.coalesce("_place", "place")).select(*old.columns)
        return requests.select("rq").join(r.select("rq", F.lit(True).alias("_ok")), "rq", "left").select("rq", F.coalesce("_ok", F.lit(False)).alias("ok"))

    return run


for _name in ("Photo", "Audio", "Video"):
    op(f"photo.change{_name}Order", f"{PHOTO} id_near:int is_next:bool", _order(_name.lower(), "photo_id", True))
op("photo.changeAlbumOrder", "owner_id:int album_id:int id_near:int is_next:bool", _order("photo_album", "album_id", False))


def _new(kind: str, force: bool):
    """A new object at the end; its id is given (force; null if taken) or the owner's next."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        old = e.state["objects"]
        album = kind.endswith("album")
        last = old.where(F.col("kind") == kind).groupBy("owner_id").agg(F.max("id").alias("_id"), F.max("place").alias("_place"))
        n = F.row_number().over(Window.partitionBy("owner_id").orderBy("rq"))
        given = "album_id" if album else "photo_id"
        r = requests.join(last, "owner_id", "left").withColumn("_n", n)
        r = r.withColumn("id", F.col(given) if force else (F.coalesce("_id", F.lit(0)) + F.col("_n")).cast("int")).withColumn("kind", F.lit(kind)).withColumn("place", F.coalesce("_place", F.lit(0.0)) + F.col("_n"))
        if force:
            r = r.withColumn("_first", F.row_number().over(Window.partitionBy("owner_id", "id").orderBy("rq"))).where("_first = 1").join(old.select("kind", "owner_id", "id"), ["kind", "owner_id", "id"], "left_anti")
        have = {"kind", "owner_id", "id", "place"} | ({"album_id"} if not album else set())
        fixed = {"deleted": F.lit(False), "rotation": F.lit(0), "views": F.lit(0)}
        rows = r.select(*((F.col(f.name) if f.name in have else fixed.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in old.schema))
        e.state["objects"] = old.unionByName(rows)
        return requests.select("rq").join(r.select("rq", "id"), "rq", "left")

    return run


for _name in ("Photo", "Audio", "Video"):
    op(f"photo.new{_name}Force", "owner_id:int album_id:int photo_id:int", _new(_name.lower(), True))
    op(f"photo.new{_name}", "owner_id:int album_id:int", _new(_name.lower(), False))
    for _verb, _flag in (("delete", "true"), ("restore", "false")):
        op(f"photo.{_verb}{_name}", PHOTO, _kind(_name.lower(), change("objects", {"deleted": _flag}, by=BY, where=f"deleted <> {_flag}")))
op("photo.newAlbumForce", "owner_id:int album_id:int", _new("photo_album", True))
op("photo.newAlbum", "owner_id:int", _new("photo_album", False))


@op("photo.deleteAlbum", "owner_id:int album_id:int")
def _delete_album(e: Engine, requests: DataFrame) -> DataFrame:
    """The album goes, its photos are deleted."""
    change("objects", {"deleted": "true"}, on=["kind", "owner_id", "album_id"])(e, requests.withColumn("kind", F.lit("photo")))
    return _kind("photo_album", drop("objects", by={"album_id": "id"}))(e, requests)


def _meets(requests: DataFrame) -> Column:
    """Whether a row meets its request's condition; the different conditions of a batch are parsed side by side, MOST_CONDITIONS at most."""
    texts = [r[0] for r in requests.select("condition").where("condition IS NOT NULL AND condition <> ''").distinct().limit(MOST_CONDITIONS + 1).collect()]
    if len(texts) > MOST_CONDITIONS:
        raise ValueError("too many different conditions; go in batches")
    out = F.coalesce(F.col("condition") == "", F.lit(True))
    for t in texts:
        out = out | ((F.col("condition") == t) & condition(t))
    return out


def _rows(e: Engine, requests: DataFrame, kind: str, of_album: bool) -> DataFrame:
    q = requests.withColumnRenamed("album_id", "q_album") if "album_id" in requests.columns else requests
    rows = q.join(e.state["objects"].where(F.col("kind") == kind), "owner_id")
    rows = rows.where("album_id = q_album") if of_album else rows
    shown = F.expr("NOT deleted OR (fields_mask & 536870912) <> 0") if "fields_mask" in requests.columns else F.expr("NOT deleted")
    rows = rows.where(shown)
    return rows.where(_meets(requests)) if "condition" in requests.columns else rows


def _shown(kind: str, rows: DataFrame, total: bool) -> DataFrame:
    rows = rows.withColumns({"total": F.count("*").over(Window.partitionBy("rq")), "pos": F.row_number().over(Window.partitionBy("rq").orderBy(F.when(F.col("is_reverse"), -F.col("place")).otherwise(F.col("place")), F.when(F.col("is_reverse"), -F.col("id")).otherwise(F.col("id"))))})
    rows = rows.where("pos > offset AND pos <= offset + limit")
    return rows.select("rq", "pos", *(["total"] if total else []), *_masked(kind))


def _masked(kind: str) -> list[Column]:
    return [F.expr(f"if((shiftright(fields_mask, {i}) & 1) = 1, {f}, null)").alias(f) for i, f in enumerate(FIELDS[kind])]


SHOW = "fields_mask:int offset:int limit:int is_reverse:bool"
for _count in ("", "Count"):
    op(f"photo.getPhotosOverview{_count}", f"owner_id:int album_ids:ints {SHOW}", lambda e, r, t=bool(_count): _shown("photo", _rows(e, r, "photo", False).where("array_contains(album_ids, album_id)"), t), "Photos of several albums as one list.")
for _name in ("Photo", "Audio", "Video"):
    _k = _name.lower()
    op(f"photo.get{_name}sCount", "owner_id:int album_id:int condition:string", lambda e, r, k=_k: r.select("rq").join(_rows(e, r, k, True).groupBy("rq").agg(F.count("*").alias("n")), "rq", "left").select("rq", F.coalesce("n", F.lit(0)).alias("n")))
    for _with in ("", "WithCount"):
        op(f"photo.get{_name}s{_with}", f"owner_id:int album_id:int {SHOW} condition:string", lambda e, r, k=_k, t=bool(_with): _shown(k, _rows(e, r, k, True), t))
        op(f"photo.get{_name}Albums{_with}", f"owner_id:int {SHOW} condition:string", lambda e, r, k=f"{_k}_album", t=bool(_with): _shown(k, _rows(e, r, k, False), t))
    op(f"photo.get{_name}", f"{PHOTO} fields_mask:int", lambda e, r, k=_k: r.select("rq").join(_rows(e, r, k, False).where("id = photo_id").select("rq", *_masked(k)), "rq", "left"))
    op(f"photo.get{_name}Album", "owner_id:int album_id:int fields_mask:int", lambda e, r, k=f"{_k}_album": r.select("rq").join(_rows(e, r, k, False).where("id = q_album").select("rq", *_masked(k)), "rq", "left"))
op("photo.getAlbumsCount", "owner_id:int condition:string", lambda e, r: r.select("rq").join(_rows(e, r, "photo_album", False).groupBy("rq").agg(F.count("*").alias("n")), "rq", "left").select("rq", F.coalesce("n", F.lit(0)).alias("n")))
