"""Mailboxes: messages by user and local number with flags, extras, peers, sublists, search, history and presence.

mode bits of a message: 0 global_id, 1 legacy_id, 2 peer_msg_id, 3 kludges, 4 text, 5 flags, 6 date, 7 peer_id, 8 ip, 9 port, 10
front, 11 ua_hash, 14 local_id, 15 random_id, 16 to 23 extra0 to 7, 24 to 27 Extra0 to 3 (large_0 to large_3 here, as names
of columns have no case). A sublist is (flags ^ or_mask) & and_mask = 0. Places from and to count from 1, under 0 from the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, bits, change, counted, drop, first_of, get, operations, put
from quillon.operators.predicate import words_of

FIELDS = {"global_id": (0, "int"), "legacy_id": (1, "int"), "peer_msg_id": (2, "int"), "kludges": (3, "string"), "text": (4, "string"), "flags": (5, "int"), "date": (6, "int"), "peer_id": (7, "int"), "ip": (8, "int"), "port": (9, "int"), "front": (10, "int"), "ua_hash": (11, "bigint"), "random_id": (15, "bigint")}
FIELDS |= {f"extra{k}": (16 + k, "int") for k in range(8)} | {f"large_{k}": (24 + k, "bigint") for k in range(4)}
SUBLISTS = [(1, 1), (2, 0), (2, 2), (64, 64), (128, 128)]  # (and_mask, or_mask)
HOLD = 300  # seconds for which a user counts as online
ONLINE, OFFLINE = 8, 9  # kinds of history events


class Text(Engine):
    tables = {
        "messages": Table("uid int, local_id int, " + ", ".join(f"{c} {t}" for c, (_, t) in FIELDS.items()), ("uid", "local_id"), {"flags": 0}),
        "history": Table("uid int, seq int, event_id int, who int, data int, persistent boolean", ("uid", "seq")),
        "online": Table("uid int, friend int, seen int", ("uid", "friend")),
        "secrets": Table("uid int, secret string", ("uid",)),
        "users": Table("uid int, loaded boolean", ("uid",)),
        "settings": Table("name string, value int", ("name",)),
    }


op = operations(Text)
ONE = "uid:int local_id:int"


def _masked(mode: str = "q_mode") -> dict[str, str]:
    return {c: f"if((shiftright({mode}, {b}) & 1) = 1, {c}, null)" for c, (b, _) in FIELDS.items()}


SHORT = 1 + 32 + 64 + 128 + 4096 + 2048
op("text.getMessageShort", ONE, lambda e, r: get("messages", _masked())(e, r.withColumn("mode", F.lit(SHORT))))
op("text.getMessage", f"{ONE} flags:int max_len:int", lambda e, r: get("messages", _masked() | {"text": "if((q_mode & 16) <> 0, if(q_max_len > 0, substring(text, 1, q_max_len), text), null)"})(e, r.withColumnRenamed("flags", "mode")))
for _name, _column, _kind in (("Legacy", "legacy_id", "int"), ("Random", "random_id", "long")):
    op(f"text.convert{_name}Id", f"uid:int {_column.replace('_id', '')}_id:{_kind}", lambda e, r, c=_column: r.join(e.state["messages"].where(F.col(c) != 0).groupBy("uid", c).agg(F.max("local_id").alias("local_id")), ["uid", c], "left").select("rq", "local_id"))


def _span(rows: DataFrame, order: list) -> DataFrame:
    """rows (rq, from, to) from place to place, newest first; total is the whole number."""
    rows = rows.withColumns({"place": F.row_number().over(Window.partitionBy("rq").orderBy(*order)), "total": F.count("*").over(Window.partitionBy("rq"))})
    at = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.col("total") + F.col(c) + 1)
    rows = rows.withColumns({"_a": at("from"), "_b": at("to")})
    rows = rows.where(F.col("place").between(F.least("_a", "_b"), F.greatest("_a", "_b")))
    return rows.withColumn("pos", F.when(F.col("_a") <= F.col("_b"), F.col("place") - F.col("_a") + 1).otherwise(F.col("_a") - F.col("place") + 1).cast("int"))




def _messages(e: Engine, requests: DataFrame, where: str) -> DataFrame:
    q = requests.select("uid", "rq", *(F.col(c).alias(c if c in ("from", "to") else f"q_{c}") for c in requests.columns if c not in ("uid", "rq")))
    return q.join(e.state["messages"], "uid").where(F.expr(where))


op("text.peerMsgList", "uid:int peer:int from:int to:int", lambda e, r: _span(_messages(e, r, "peer_id = q_peer"), [F.desc("local_id")]).select("rq", "pos", "total", "local_id"))
op("text.peerMsgListPos", "uid:int peer:int local_id:int", lambda e, r: _place(e, r, "peer_id = q_peer"))


def _place(e: Engine, requests: DataFrame, where: str) -> DataFrame:
    """The message's place from the newest among those that fit; null if it isn't one of them."""
    rows = _messages(e, requests, where)
    n = rows.groupBy("rq").agg(F.count_if(F.col("local_id") >= F.col("q_local_id")).cast("int").alias("pos"), F.max((F.col("local_id") == F.col("q_local_id")).cast("int")).alias("_in"))
    return requests.select("rq").join(n.where("_in = 1").select("rq", "pos"), "rq", "left")


@op("text.topMsgList", "uid:int from:int to:int")
def _top(e: Engine, requests: DataFrame) -> DataFrame:
    """The newest message of each peer, newest first."""
    last = e.state["messages"].groupBy("uid", "peer_id").agg(F.max("local_id").alias("local_id"))
    return _span(requests.join(last, "uid"), [F.desc("local_id")]).select("rq", "pos", "total", "peer_id", "local_id")


SUB = "((flags ^ q_or_mask) & q_and_mask) = 0"
op("text.sublistShort", "uid:int and_mask:int or_mask:int from:int to:int", lambda e, r: _span(_messages(e, r, SUB), [F.desc("local_id")]).select("rq", "pos", "total", "local_id"))
op("text.sublist", "uid:int mode:int and_mask:int or_mask:int from:int to:int", lambda e, r: _span(_messages(e, r, SUB), [F.desc("local_id")]).select("rq", "pos", "total", "local_id", *(F.expr(x).alias(c) for c, x in _masked().items())))
op("text.sublistPos", "uid:int and_mask:int or_mask:int local_id:int", lambda e, r: _place(e, r, SUB))
op("text.sublistTypes", "", lambda e, r: r.select("rq", F.explode(F.array(*(F.struct(F.lit(a).alias("and_mask"), F.lit(o).alias("or_mask")) for a, o in SUBLISTS))).alias("s")).select("rq", "s.*"))
op("text.peermsgType", "", lambda e, r: r.select("rq", F.lit(0).alias("and_mask"), F.lit(0).alias("or_mask")))


@op("text.sendMessage", "uid:int mode:int flags:int peer_id:int text:string kludges:string date:int ip:int port:int front:int ua_hash:long legacy_id:int random_id:long")
def _send(e: Engine, requests: DataFrame) -> DataFrame:
    """A new message with the mailbox's next number; a random_id that is there already gives that message's number."""
    old = e.state["messages"]
    same = old.where("random_id <> 0").groupBy("uid", "random_id").agg(F.max("local_id").alias("_same"))
    r = requests.join(same, ["uid", "random_id"], "left")
    new = r.where("_same IS NULL").withColumn("_k", F.row_number().over(Window.partitionBy("uid", F.when(F.col("random_id") != 0, F.col("random_id")).otherwise(-F.col("rq") - 1)).orderBy("rq"))).where("_k = 1")
    last = old.groupBy("uid").agg(F.max("local_id").alias("_last"))
    new = new.join(last, "uid", "left").withColumn("local_id", (F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("uid").orderBy("rq"))).cast("int"))
    have = set(requests.columns) | {"local_id"}
    rows = new.select(*((F.coalesce("date", F.lit(e.now)) if f.name == "date" else F.coalesce("flags", F.lit(0)) if f.name == "flags" else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema))
    e.state["messages"] = old.unionByName(rows)
    given = r.select("rq", F.col("_same").alias("a")).join(new.select("rq", F.col("local_id").alias("b")), "rq", "left")
    return given.select("rq", F.coalesce("a", "b").alias("local_id"))


op("text.deleteMessage", ONE, drop("messages"))
op("text.deleteFirstMessages", "uid:int min_local_id:int", drop("messages", on=["uid"], where="local_id < q_min_local_id"))
op("text.getMessageFlags", ONE, get("messages", "flags"))
op("text.setMessageFlags", f"{ONE} flags:int", change("messages", {"flags": "q_flags"}))
op("text.incrMessageFlags", f"{ONE} flags:int", bits("messages", "flags"))
op("text.decrMessageFlags", f"{ONE} flags:int", bits("messages", "flags", clear=True))
for _large in (False, True):
    _name, _stem, _n, _kind = ("Extra", "large_", 4, "long") if _large else ("extra", "extra", 8, "int")
    _pick = "CASE q_k " + " ".join(f"WHEN {i} THEN {_stem}{i}" for i in range(_n)) + " END"
    op(f"text.getMessage{_name}", f"{ONE} k:int", get("messages", {"value": f"coalesce({_pick}, 0)"}))
    op(f"text.setMessage{_name}", f"{ONE} k:int value:{_kind}", change("messages", {f"{_stem}{i}": f"if(q_k = {i}, q_value, {_stem}{i})" for i in range(_n)}), "A batch takes the last request of each message.")

    def _more(sign: int, stem: str = _stem, n: int = _n, pick: str = _pick):
        def run(e: Engine, requests: DataFrame) -> DataFrame:
            total = requests.groupBy("uid", "local_id").agg(*(F.sum(F.when(F.col("k") == i, F.col("value") * sign)).alias(f"_{i}") for i in range(n)))
            old = e.state["messages"]
            add = lambda c, i: F.when(F.col(f"_{i}").isNotNull(), (F.coalesce(F.col(c), F.lit(0)) + F.col(f"_{i}")).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            own = {f"{stem}{i}": i for i in range(n)}
            e.state["messages"] = old.join(total, ["uid", "local_id"], "left").select(*(add(c, own[c]) if c in own else F.col(c) for c in old.columns))
            return get("messages", {"value": f"coalesce({pick}, 0)"})(e, requests.drop("value"))

        return run

    op(f"text.incrMessage{_name}", f"{ONE} k:int value:{_kind}", _more(1))
    op(f"text.decrMessage{_name}", f"{ONE} k:int value:{_kind}", _more(-1))
op("text.replaceMessageText", f"{ONE} new_text:string", change("messages", {"text": "q_new_text"}))
op("text.deleteUserdata", "uid:int", first_of(drop("messages", on=["uid"]), drop("history", on=["uid"]), drop("users", on=["uid"])))
op("text.getUserdata", "uid:int", counted("messages", ["uid"], result={"n": "cast(count_if(_row) AS int)"}))
op("text.loadUserdata", "uid:int force:int", put("users", values={"loaded": "true"}), "Nothing has to be loaded here; the user is known afterwards.")


@op("text.getExtraMask", "")
def _mask(e: Engine, requests: DataFrame) -> DataFrame:
    """The fields kept of messages, those kept by default, and all."""
    kept = e.state["settings"].where("name = 'extra_mask'").agg(F.max("value").alias("v"))
    every = sum(1 << b for b, _ in FIELDS.values())
    return requests.join(kept, F.lit(True)).select("rq", F.coalesce("v", F.lit(every)).alias("kept"), F.lit(every).alias("default"), F.lit(every).alias("all"))


op("text.setExtraMask", "mask:int", put("settings", values={"name": "'extra_mask'", "value": "mask"}))

PLAIN, EX = "uid:int num:int query:string", "uid:int num:int query:string flags:int and_mask:int or_mask:int min_time:int max_time:int peer_id:int"


def _search(extended: bool):
    """Messages with all the query's words and quoted phrases; num last ones, or first ones if num is under 0. Extended flags: 1 a sublist, 2 times, 4 a peer."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        q = requests.select("uid", "rq", "num", F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("need"), F.transform(F.regexp_extract_all("query", F.lit('"([^"]+)"'), F.lit(1)), F.lower).alias("phrases"), *(F.col(c).alias(f"q_{c}") for c in requests.columns if c not in ("uid", "rq", "num", "query")))
        rows = q.join(e.state["messages"], "uid").withColumn("own", words_of(F.col("text")))
        rows = rows.where(F.forall("need", lambda w: F.array_contains("own", w))).where(F.forall("phrases", lambda p: F.contains(F.lower("text"), p)))
        if extended:
            rows = rows.where(f"((q_flags & 1) = 0 OR {SUB}) AND ((q_flags & 2) = 0 OR date BETWEEN q_min_time AND q_max_time) AND ((q_flags & 4) = 0 OR peer_id = q_peer_id)")
        by = F.when(F.col("num") >= 0, -F.col("local_id")).otherwise(F.col("local_id"))
        rows = rows.withColumns({"pos": F.row_number().over(Window.partitionBy("rq").orderBy(by)), "total": F.count("*").over(Window.partitionBy("rq"))})
        return rows.where("pos <= abs(num)").select("rq", "pos", "total", "local_id")

    return run


op("text.search", PLAIN, _search(False))
op("text.searchEx", EX, _search(True))


def _timestamp(persistent: bool):
    """The number of the user's last event."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        h = e.state["history"].where("persistent") if persistent else e.state["history"]
        return requests.join(h.groupBy("uid").agg(F.max("seq").alias("timestamp")), "uid", "left").select("rq", F.coalesce("timestamp", F.lit(0)).alias("timestamp"))

    return run


def _history(persistent: bool):
    """Events after the timestamp, oldest first, limit at most."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        h = e.state["history"].where("persistent") if persistent else e.state["history"]
        rows = requests.join(h, "uid").where("seq > timestamp").withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy("seq")))
        return rows.where("pos <= limit").select("rq", "pos", "seq", "event_id", "who", "data")

    return run


for _name in ("getTimestamp", "getForceTimestamp"):
    op(f"text.{_name}", "uid:int", _timestamp(False))
op("text.getPTimestamp", "uid:int", _timestamp(True))
op("text.history", "uid:int timestamp:int limit:int", _history(False))
op("text.pHistory", "uid:int timestamp:int limit:int", _history(True))


def _log(e: Engine, events: DataFrame) -> None:
    """events (uid, rq, event_id, who, data) get the user's next numbers; kinds from 50 on aren't persistent."""
    last = e.state["history"].groupBy("uid").agg(F.max("seq").alias("_last"))
    n = F.row_number().over(Window.partitionBy("uid").orderBy("rq", "who"))
    rows = events.join(last, "uid", "left").select("uid", (F.coalesce("_last", F.lit(0)) + n).cast("int").alias("seq"), "event_id", "who", "data", (F.col("event_id") < 50).alias("persistent"))
    e.state["history"] = e.state["history"].unionByName(rows)


@op("text.historyAction", "uid:int event_id:int who:int data:int")
def _action(e: Engine, requests: DataFrame) -> DataFrame:
    _log(e, requests)
    return requests.select("rq", F.lit(True).alias("ok"))


def _presence(on: bool):
    """uid is seen (or leaves): each friend who has uid online so far or not gets an event only where that changes; those not seen for HOLD seconds are offline."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        pairs = requests.select("rq", F.explode("friends").alias("uid"), F.col("uid").alias("friend"))
        pairs = pairs.groupBy("uid", "friend").agg(F.max("rq").alias("rq"))
        old = e.state["online"]
        stale = old.where(F.col("seen") < e.now - HOLD)
        live = old.where(F.col("seen") >= e.now - HOLD)
        there = live.select("uid", "friend").withColumn("_on", F.lit(True))
        told = pairs.join(there, ["uid", "friend"], "left").where(F.col("_on").isNull() if on else F.col("_on").isNotNull())
        timed = stale.select("uid", F.lit(-1).cast("bigint").alias("rq"), F.lit(OFFLINE).alias("event_id"), F.col("friend").alias("who"), F.lit(1).alias("data"))
        _log(e, timed.unionByName(told.select("uid", "rq", F.lit(ONLINE if on else OFFLINE).alias("event_id"), F.col("friend").alias("who"), F.lit(0).alias("data"))))
        rest = live.join(pairs.select("uid", "friend"), ["uid", "friend"], "left_anti")
        e.state["online"] = rest.unionByName(pairs.select("uid", "friend", F.lit(e.now).alias("seen"))) if on else rest
        n = told.groupBy("rq").agg(F.count("*").alias("n"))
        return requests.select("rq").join(n, "rq", "left").select("rq", F.coalesce("n", F.lit(0)).alias("n"))

    return run


op("text.online", "uid:int friends:ints", _presence(True))
op("text.offline", "uid:int friends:ints", _presence(False))
op("text.onlineFriends", "uid:int mode:int", lambda e, r: r.join(e.state["online"].where(F.col("seen") >= e.now - HOLD), "uid").select("rq", "friend", F.when(F.col("mode").bitwiseAND(F.lit(1)) != 0, F.col("seen")).alias("seen")))
op("text.onlineFriendsId", "uid:int", lambda e, r: r.join(e.state["online"].where(F.col("seen") >= e.now - HOLD), "uid").select("rq", "friend"))
op("text.setSecret", "uid:int s:string", put("secrets", values={"secret": "s"}))
op("text.getSecret", "uid:int", get("secrets", "secret"))
op("text.deleteSecret", "uid:int", drop("secrets"))
