"""Engines of a few operations: search-query statistics, key-value caches, ordered maps, weights, random, the proxy and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, add_to, counted, drop, get, operations, put


class Isearch(Engine):
    """Counts of what users searched for, by type."""

    tables = {"queries": Table("query string, type int, n bigint", ("query", "type"), {"n": 0}), "blacklist": Table("query string", ("query",))}


op = operations(Isearch)
op("isearch.addSearchQuery", "user_id:int type:int count:int query:string", lambda e, r: add_to("queries", "n", amount="count", create=True)(e, r.withColumn("query", F.lower("query"))), "count more of a query of a type.")
op("isearch.addBlackList", "query:string", put("blacklist", "add"))
op("isearch.deleteBlackList", "query:string", drop("blacklist"))
op("isearch.getBlackList", "", lambda e, r: r.select("rq").join(e.state["blacklist"], F.lit(True)), "All phrases.")


@op("isearch.forceUpdateBlackList", "")
def _force(e: Engine, requests: DataFrame) -> DataFrame:
    """Queries with a phrase of the blacklist go."""
    e.state["queries"] = _allowed(e)
    return requests.select("rq", F.lit(True).alias("ok"))


def _allowed(e: Engine) -> DataFrame:
    """Queries without a phrase of the blacklist, joined on the phrases' words in a row."""
    phrases = e.state["blacklist"].select(F.lower("query").alias("phrase"), F.size(F.split("query", " ")).alias("m"))
    longest = F.split(F.lower("query"), " ")
    runs = e.state["queries"].select("query").distinct().withColumn("w", longest)
    sizes = phrases.select("m").distinct()
    grams = runs.join(F.broadcast(sizes), F.col("m") <= F.size("w")).select("query", F.explode(F.expr("transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("phrase"))
    bad = grams.join(phrases.select("phrase"), "phrase", "left_semi").select("query").distinct()
    return e.state["queries"].join(bad, "query", "left_anti")


def _sums(e: Engine) -> DataFrame:
    return _allowed(e).groupBy("query").agg(F.sum("n").alias("n"))


@op("isearch.getHints", "query:string")
def _hints(e: Engine, requests: DataFrame) -> DataFrame:
    """The five most frequent queries that begin with the text."""
    rows = requests.withColumn("q", F.lower("query")).select("rq", "q").join(_sums(e), F.startswith("query", F.col("q")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy(F.desc("n"), "query"))).where("pos <= 5").select("rq", "pos", "query")


@op("isearch.getTypes", "query:string")
def _types(e: Engine, requests: DataFrame) -> DataFrame:
    """Share of each type among searches of the query."""
    rows = requests.withColumn("query", F.lower("query")).join(e.state["queries"], "query")
    return rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("rq"))).select("rq", "type", "p")


@op("isearch.getSuggestion", "query:string")
def _suggestion(e: Engine, requests: DataFrame) -> DataFrame:
    """A much more frequent query at most two edits away, null if the query is good."""
    q = requests.select("rq", F.lower("query").alias("q")).join(_sums(e).toDF("q", "own"), "q", "left")
    near = q.select("rq", "q", F.coalesce("own", F.lit(0)).alias("own")).join(_sums(e), F.levenshtein("q", "query", 2).between(1, 2) & (F.col("n") > 10 * F.col("own")))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("rq").orderBy(F.levenshtein("q", "query"), F.desc("n"), "query"))).where("r = 1")
    return requests.select("rq").join(best.select("rq", F.col("query").alias("suggestion")), "rq", "left")


def _top(by):
    def run(e: Engine, requests: DataFrame) -> DataFrame:
        most = requests.agg(F.max("limit")).first()[0] or 0
        rows = by(e).limit(most)
        ranked = rows.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "query")))  # limit rows at most
        return requests.join(ranked, F.col("pos") <= F.col("limit")).select("rq", "pos", "query", "n")

    return run


op("isearch.getTop", "limit:int", _top(lambda e: _sums(e).orderBy(F.desc("n"), "query")), "The most frequent queries.")
op("isearch.getBest", "limit:int", _top(lambda e: _allowed(e).groupBy("query").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "query")), "By their most frequent type.")


class Memcache(Engine):
    """Keys with values, flags and a time to live (0: for ever)."""

    tables = {"values": Table("key string, value string, flags int, expires int", ("key",), {"flags": 0})}

    def live(self) -> DataFrame:
        return self.state["values"].where(F.col("expires").isNull() | (F.col("expires") > self.now))


op = operations(Memcache)


def _store(mode: str):
    def run(e: Engine, requests: DataFrame) -> DataFrame:
        e.state["values"] = e.live()
        expires = F.when(F.col("delay") > 0, F.when(F.col("delay") > 30 * 86400, F.col("delay")).otherwise(F.col("delay") + e.now))
        return put("values", mode, values={"expires": expires})(e, requests)

    return run


for _mode in ("set", "add", "replace"):
    op(f"memcache.{_mode}", "key:string flags:int delay:int value:string", _store(_mode), "delay: seconds to live, or a time if over 30 days.")


def _count(sign: int):
    """The number plus the sum of a batch's values (never under 0); null where the key isn't there or isn't a number."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        old = e.live()
        total = requests.groupBy("key").agg(F.sum(F.col("value") * sign).alias("_d"))
        number = F.expr("try_cast(value AS bigint)")
        e.state["values"] = old.join(total, "key", "left").withColumn("value", F.when(F.col("_d").isNotNull() & number.isNotNull(), F.greatest(number + F.col("_d"), F.lit(0)).cast("string")).otherwise(F.col("value"))).select(*old.columns)
        return requests.select("rq", "key").join(e.state["values"].select("key", number.alias("value")), "key", "left").select("rq", "value")

    return run


op("memcache.incr", "key:string value:long", _count(1))
op("memcache.decr", "key:string value:long", _count(-1))
op("memcache.delete", "key:string", drop("values"))


@op("memcache.get", "key:string")
def _get(e: Engine, requests: DataFrame) -> DataFrame:
    return requests.join(e.live(), "key", "left").select("rq", "value", "flags", F.col("value").isNotNull().alias("found"))


def _beginnings(rows: DataFrame, sizes: DataFrame, begin: str, size: str) -> DataFrame:
    """rows once for each of the sizes (_n) that their key reaches, with its first _n parts as prefix: prefixes are met by an equi-join."""
    own = sizes.where("_n >= 0").agg(F.collect_set("_n").alias("_sizes"))  # as many as lengths of a prefix
    each = rows.join(F.broadcast(own)).withColumn("_n", F.explode("_sizes")).where(F.expr(f"_n <= {size}"))
    return each.withColumn("prefix", F.expr(begin)).drop("_sizes", "_n")


@op("memcache.getWildcard", "prefix:string")
def _wild(e: Engine, requests: DataFrame) -> DataFrame:
    """Keys that begin with the prefix, without it."""
    rows = requests.join(_beginnings(e.live(), requests.select(F.length("prefix").alias("_n")), "substring(key, 1, _n)", "length(key)"), "prefix")
    return rows.select("rq", F.substr("key", F.length("prefix") + 1).alias("key"), "value")


class Seqmap(Engine):
    """An ordered map from vectors of numbers to vectors, with a time to live."""

    tables = {"entries": Table("key array<int>, value array<int>, time int, expires int", ("key",))}


op = operations(Seqmap)


def _live(e: Engine) -> DataFrame:
    return e.state["entries"].where(F.col("expires").isNull() | (F.col("expires") > e.now))


def _write(mode: str):
    def run(e: Engine, requests: DataFrame) -> DataFrame:
        e.state["entries"] = _live(e)
        return put("entries", mode, values={"expires": F.when(F.col("time") > 0, F.col("time") + e.now)})(e, requests)

    return run


for _mode in ("set", "add", "replace"):
    op(f"seqmap.{_mode}", "key:ints value:ints time:int", _write(_mode), "time: seconds to live, 0 for ever.")
op("seqmap.delete", "key:ints", drop("entries"))
op("seqmap.get", "key:ints", lambda e, r: r.join(_live(e), "key", "left").select("rq", "value"))


def _range(wild: bool, count: bool):
    """Entries with left <= key < right, or whose key begins with the given one, by key."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        rows = _live(e).select("key", "value")
        if wild:
            q = requests.withColumnRenamed("key", "prefix")
            each = _beginnings(rows, q.select(F.size("prefix").alias("_n")), "slice(key, 1, _n)", "size(key)")
            if count:
                each = each.groupBy("prefix").agg(F.count("*").alias("n"))
                return q.select("rq", "prefix").join(each, "prefix", "left").select("rq", F.coalesce("n", F.lit(0)).alias("n"))
            hit = q.join(each, "prefix")
        else:
            hit = requests.join(rows, F.expr("key >= left AND key < right"))
        if count:
            return requests.select("rq").join(hit.groupBy("rq").agg(F.count("*").alias("n")), "rq", "left").select("rq", F.coalesce("n", F.lit(0)).alias("n"))
        hit = hit.withColumns({"pos": F.row_number().over(Window.partitionBy("rq").orderBy("key")), "total": F.count("*").over(Window.partitionBy("rq"))})
        return hit.where("pos <= limit").select("rq", "pos", "total", "key", "value")

    return run


op("seqmap.getRange", "left:ints right:ints limit:int", _range(False, False))
op("seqmap.getWildcard", "key:ints limit:int", _range(True, False))
op("seqmap.getRangeCount", "left:ints right:ints", _range(False, True))
op("seqmap.getWildcardCount", "key:ints", _range(True, True))


class Weights(Engine):
    """Vectors of numbers in (-1, 1) as whole parts of 2**30, halving by each coordinate's half-life, under x # y = (x + y) / (1 + x y)."""

    tables = {"weights": Table("vector_id int, coord_id int, value double, at int", ("vector_id", "coord_id")), "half_lives": Table("coord_id int, half_life int", ("coord_id",))}
    UNIT = 1 << 30
    HALF_LIFE = 30 * 86400


op = operations(Weights)
op("weights.setHalfLife", "coord_id:int half_life:int", put("half_lives"))


def _decayed(e: Weights) -> DataFrame:
    """vector_id, coord_id, x: the weights as of now."""
    life = F.coalesce("half_life", F.lit(e.HALF_LIFE))
    rows = e.state["weights"].join(e.state["half_lives"], "coord_id", "left")
    return rows.select("vector_id", "coord_id", (F.col("value") * F.pow(F.lit(2.0), -(F.lit(e.now) - F.col("at")) / life)).alias("x"), "at")


@op("weights.incr", "vector_id:int coord_id:int value:int")
def _incr(e: Weights, requests: DataFrame) -> DataFrame:
    """All increments of a batch at once (the operation has no order at one time); the weight afterwards."""
    total = requests.groupBy("vector_id", "coord_id").agg(F.sum(F.atanh(F.col("value") / float(e.UNIT))).alias("_d"))
    joined = _decayed(e).join(total, ["vector_id", "coord_id"], "full")
    new = F.when(F.col("_d").isNotNull(), F.tanh(F.atanh(F.coalesce("x", F.lit(0.0))) + F.col("_d"))).otherwise(F.col("x"))
    e.state["weights"] = joined.select("vector_id", "coord_id", new.alias("value"), F.lit(e.now).alias("at"))
    out = e.state["weights"].select("vector_id", "coord_id", F.floor(F.col("value") * e.UNIT).cast("int").alias("weight"))
    return requests.select("rq", "vector_id", "coord_id").join(out, ["vector_id", "coord_id"], "left").select("rq", "weight")


@op("weights.at", "vector_id:int coord_id:int")
def _at(e: Weights, requests: DataFrame) -> DataFrame:
    return requests.join(_decayed(e), ["vector_id", "coord_id"], "left").select("rq", F.floor(F.coalesce("x", F.lit(0.0)) * e.UNIT).cast("int").alias("weight"))


@op("weights.getVector", "vector_id:int")
def _vector(e: Weights, requests: DataFrame) -> DataFrame:
    """One row for each coordinate that has a weight."""
    return requests.join(_decayed(e), "vector_id").select("rq", "coord_id", F.floor(F.col("x") * e.UNIT).cast("int").alias("weight"))


@op("weights.subscribe", "vector_rem:int vector_mod:int coord_ids:ints updates_start_time:int updates_limit:int")
def _subscribe(e: Weights, requests: DataFrame) -> DataFrame:
    """The subscriber's share: weights of vectors with id % vector_mod = vector_rem, of the given coordinates, changed since updates_start_time; oldest first, updates_limit vectors at most (the feature: the subscriber goes on from there)."""
    rows = requests.join(_decayed(e), F.expr("vector_id % vector_mod = vector_rem AND at >= updates_start_time AND array_contains(coord_ids, coord_id)"))
    order = rows.groupBy("rq", "vector_id", "updates_limit").agg(F.min("at").alias("first")).withColumn("pos", F.row_number().over(Window.partitionBy("rq").orderBy("first", "vector_id"))).where("pos <= updates_limit")
    return rows.join(order.select("rq", "vector_id", "pos"), ["rq", "vector_id"]).select("rq", "pos", "vector_id", "coord_id", F.floor(F.col("x") * e.UNIT).cast("int").alias("weight"), "at")


def _send(vector: bool):
    """The receiver's side: values as they are now replace what is held."""

    def run(e: Weights, requests: DataFrame) -> DataFrame:
        u = requests.select("rq", F.explode("updates").alias("u")).select("rq", "u.*")
        if vector:
            u = u.select("rq", "vector_id", F.posexplode("vector").alias("coord_id", "v"))
        else:
            u = u.withColumnRenamed("value", "v")
        put("weights", values={"value": F.col("v") / float(e.UNIT), "at": F.lit(e.now)})(e, u.select("rq", "vector_id", "coord_id", "v"))
        return requests.select("rq", F.lit(True).alias("ok"))

    return run


op("weights.sendUpdates", "updates:array<struct<vector_id:int,relaxation_time:int,vector:array<int>>>", _send(True))
op("weights.sendSmallUpdates", "updates:array<struct<vector_id:int,coord_id:int,relaxation_time:int,value:int>>", _send(False))


class Random(Engine):
    pass


op = operations(Random)
op("random.random", "n:int", lambda e, r: r.select("rq", F.expr("unhex(substring(array_join(transform(sequence(1, greatest(n, 1)), i -> replace(uuid(), '-', '')), ''), 1, 2 * n))").alias("bytes")), "n random bytes.")


class RpcProxy(Engine):
    """The servers of each cluster, and how they did."""

    tables = {"servers": Table("actor_id bigint, host string, port int, queries bigint, errors bigint, alive boolean", ("actor_id", "host", "port"), {"queries": 0, "errors": 0, "alive": True})}


op = operations(RpcProxy)
op("rpcProxy.getClusters", "", lambda e, r: r.select("rq").join(e.state["servers"].select("actor_id").distinct(), F.lit(True)))
op("rpcProxy.getClusterSize", "actor_id:long", counted("servers", ["actor_id"]))
op("rpcProxy.getClusterServers", "actor_id:long", lambda e, r: r.join(e.state["servers"], "actor_id").select("rq", "host", "port"))
op("rpcProxy.getClusterStats", "actor_id:long", counted("servers", ["actor_id"], result={"queries": "coalesce(sum(queries), 0)", "errors": "coalesce(sum(errors), 0)", "servers": "count_if(_row)"}))
op("rpcProxy.getBadTargets", "", lambda e, r: r.select("rq").join(e.state["servers"].where("NOT alive").select("actor_id", "host", "port"), F.lit(True)))


class Storage(Engine):
    """Blobs by volume and number, with a secret in the location; a volume's size is the sum of its files'."""

    tables = {"volumes": Table("volume_id bigint, capacity bigint, enabled boolean", ("volume_id",), {"enabled": True}), "files": Table("volume_id bigint, local_id int, secret bigint, type int, hidden boolean, content binary", ("volume_id", "local_id"), {"type": 0, "hidden": False})}


op = operations(Storage)
LOCATION = "volume_id:long local_id:int secret:long"


@op("storage.getVolumes", "")
def _volumes(e: Engine, requests: DataFrame) -> DataFrame:
    used = e.state["files"].groupBy("volume_id").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("used"))
    rows = e.state["volumes"].join(used, "volume_id", "left").select("volume_id", "capacity", "enabled", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("used", F.lit(0)).alias("used"))
    return requests.select("rq").join(rows, F.lit(True))


@op("storage.checkFile", "volume_id:long file_size:long max_disk_used_space_percent:double")
def _check_file(e: Engine, requests: DataFrame) -> DataFrame:
    """Whether a file of that size fits into the volume."""
    v = _volumes(e, requests.select("rq").limit(1)).drop("rq")
    fits = F.col("enabled") & ((F.col("used") + F.col("file_size")) * 100 <= F.col("capacity") * F.col("max_disk_used_space_percent"))
    return requests.join(v, "volume_id", "left").select("rq", F.coalesce(fits, F.lit(False)).alias("ok"))


def _upload(typed: bool):
    """The new file's location: the next number of the volume, and a secret from its content."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        last = e.state["files"].groupBy("volume_id").agg(F.max("local_id").alias("_last"))
        new = requests.join(e.state["volumes"].where("enabled").select("volume_id"), "volume_id", "left_semi").join(last, "volume_id", "left")
        new = new.withColumn("local_id", F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("volume_id").orderBy("rq")))
        new = new.withColumn("content", F.expr("try_to_binary(file_data, 'base64')")).withColumn("secret", F.xxhash64("content", "volume_id", "local_id"))
        rows = new.select("volume_id", "local_id", "secret", (F.col("file_type") if typed else F.lit(0)).alias("type"), F.lit(False).alias("hidden"), "content")
        e.state["files"] = e.state["files"].unionByName(rows)
        return requests.select("rq").join(new.select("rq", "volume_id", "local_id", "secret"), "rq", "left")

    return run


op("storage.uploadFile", "volume_id:long file_data:string", _upload(False), "file_data in base 64.")
op("storage.uploadFileExt", "volume_id:long file_type:int file_data:string", _upload(True))
_whole = get("files", {"content": "if(secret = q_secret AND NOT hidden, content, null)"})
_part = get("files", {"content": "if(secret = q_secret AND NOT hidden, substring(content, q_offset + 1, q_limit), null)"})
op("storage.getFile", LOCATION, _whole)
op("storage.getFileIndirect", f"{LOCATION} fwd:string", _whole, "The answer goes to fwd: who asks joins it there.")
op("storage.getPart", f"{LOCATION} offset:int limit:int", _part)
op("storage.getPartIndirect", f"{LOCATION} offset:int limit:int fwd:string", _part)
