"""Full-text search over items with ratings, a hash and tags, by typed requests.

Rating types: 0 rate, 1 sate, 2 and on the others; letters of the text protocol name them (``RATINGS``). A title is the
text up to the first tab. Flags: 2 sort by rate_type, 4 descending, 8 restrictions, 16 exact hash, 32 group by hash, 64 a
rating as the hash, 128 relevance, 256 title only, 512 coefficient of optional tags, 1024 weighted ratings, 2048 weight of
priority, 4096 decay, 8192 extended queries (& | ! and parentheses), 16384 number of query words as priority, 32768
random, 65536 weak (up to two words missing).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.engines.base import Engine, Table, change, drop, get, operations
from quillon.operators.predicate import words_of

RATINGS = "rsdbcfghklmn"  # the letter of each rating type: rate, sate, date and others; i is the id
MOST_QUERIES = 1000


class Search(Engine):
    tables = {"items": Table("id array<int>, hash bigint, rates map<int,int>, text string, tags array<string>", ("id",), {"hash": 0})}


op = operations(Search)
ONE = "id:ints"
NO_RATES = "cast(map() AS map<int,int>)"


def _rate(new: str) -> str:
    """The map with a rating set; old is what was there (0 if nothing)."""
    old = "coalesce(try_element_at(rates, q_rate_type), 0)"
    return f"map_concat(map_filter(coalesce(rates, {NO_RATES}), (k, v) -> k <> q_rate_type), map(q_rate_type, {new.replace('old', old)}))"


op("search.setRate", f"{ONE} rate_type:int rate_value:int", change("items", {"rates": _rate("q_rate_value")}))


def _add(sign: int):
    """All amounts of a batch on one rating are added."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        total = requests.groupBy("id", "rate_type").agg((F.sum("rate_value") * sign).cast("int").alias("d"), F.min("rq").alias("rq"))
        own = total.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("rate_type", "d"))).alias("_d"))
        old = e.state["items"]
        merged = F.expr(f"map_zip_with(coalesce(rates, {NO_RATES}), _d, (k, a, b) -> coalesce(a, 0) + coalesce(b, 0))")
        e.state["items"] = old.join(own, "id", "left").withColumn("rates", F.when(F.col("_d").isNotNull(), merged).otherwise(F.col("rates"))).select(*old.columns)
        return requests.select("rq", "id").join(old.select("id").withColumn("_there", F.lit(True)), "id", "left").select("rq", F.coalesce("_there", F.lit(False)).alias("ok"))

    return run


op("search.incrRate", f"{ONE} rate_type:int rate_value:int", _add(1))
op("search.decrRate", f"{ONE} rate_type:int rate_value:int", _add(-1))
op("search.getRate", f"{ONE} rate_type:int", get("items", {"rate": "coalesce(try_element_at(rates, q_rate_type), 0)"}))
op("search.setHash", f"{ONE} hash:long", change("items", {"hash": "q_hash"}))
op("search.getHash", ONE, get("items", "hash"))
op("search.deleteItem", ONE, drop("items"))


@op("search.setItem", f"{ONE} rate:int sate:int text:string")
def _set_item(e: Engine, requests: DataFrame) -> DataFrame:
    """A new text with rate and sate; hash, other ratings and tags of an old item of the id stay."""
    new = requests.groupBy("id").agg(F.max_by(F.struct("rate", "sate", "text"), "rq").alias("q"))
    old = e.state["items"]
    both = old.join(new, "id", "full")
    rates = F.expr(f"map_concat(map_filter(coalesce(rates, {NO_RATES}), (k, v) -> k > 1), map(0, q.rate, 1, q.sate))")
    e.state["items"] = both.select("id", F.coalesce("hash", F.lit(0).cast("bigint")).alias("hash"), F.when(F.col("q").isNotNull(), rates).otherwise(F.col("rates")).alias("rates"), F.coalesce("q.text", "text").alias("text"), "tags")
    return requests.select("rq", F.lit(True).alias("ok"))


op("search.addTags", f"{ONE} tags:string", change("items", {"tags": "array_union(coalesce(tags, cast(array() AS array<string>)), filter(split(q_tags, ' '), x -> x <> ''))"}))
op("search.deleteWithHash", "hash:long", drop("items", on=["hash"]))
op("search.deleteWithHashes", "hashes:longs", lambda e, r: drop("items", on=["hash"])(e, r.select("rq", F.explode("hashes").alias("hash"))).groupBy("rq").agg(F.sum("n").alias("n")))


@op("search.incrRateByHash", "rate_type:int rate:int hashes:longs")
def _by_hash(e: Engine, requests: DataFrame) -> DataFrame:
    """rate more in a rating of every item with one of the hashes."""
    r = requests.select("rq", "rate_type", F.col("rate").alias("rate_value"), F.explode("hashes").alias("hash"))
    return _add(1)(e, r.join(e.state["items"].select("id", "hash"), "hash").select("rq", "id", "rate_type", "rate_value"))


@op("search.changeRates", "rate_type:int rates:array<struct<old:int,new:int>>")
def _change_rates(e: Engine, requests: DataFrame) -> DataFrame:
    """Items whose rating is old get new; the last request of a pair counts."""
    pairs = requests.select("rq", F.col("rate_type").alias("q_rate_type"), F.explode("rates").alias("p")).select("rq", "q_rate_type", F.col("p.old").alias("old"), F.col("p.new").alias("new"))
    pairs = pairs.groupBy("q_rate_type", "old").agg(F.max_by("new", "rq").alias("new"))
    flat = e.state["items"].select("id", F.explode("rates").alias("q_rate_type", "old")).join(pairs, ["q_rate_type", "old"])
    own = flat.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("q_rate_type", "new"))).alias("_n"))
    old = e.state["items"]
    e.state["items"] = old.join(own, "id", "left").withColumn("rates", F.when(F.col("_n").isNotNull(), F.expr("map_zip_with(rates, _n, (k, a, b) -> coalesce(b, a))")).otherwise(F.col("rates"))).select(*old.columns)
    return requests.select("rq", F.lit(True).alias("ok"))


def extended(query: str, words: Column, tags: Column) -> Column:
    """Words joined by blanks or & (both), | (either), ! or - (not) and parentheses; *tag and ~tag test tags."""
    t = re.findall(r"[&|!()\-]|[*~]?[\w]+", query.lower())
    i = 0

    def either() -> Column:
        nonlocal i
        left = both()
        while i < len(t) and t[i] == "|":
            i += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal i
        left = term()
        while i < len(t) and t[i] not in "|)":
            i += t[i] == "&"
            left = left & term()
        return left

    def term() -> Column:
        nonlocal i
        if i >= len(t):
            raise ValueError("the query ends early")
        x = t[i]
        i += 1
        if x in "!-":
            return ~term()
        if x == "(":
            y = either()
            i += 1
            return y
        return F.array_contains(tags, x[1:]) if x[0] in "*~" else F.array_contains(words, x)

    out = either()
    if i < len(t):
        raise ValueError(f"unexpected {t[i]!r}")
    return F.coalesce(out, F.lit(False))


# What an item has beside its words and *tags begins with a character that no word of a query holds.
_THERE, _TAG, _TOLD = "\0", "\0t", "\0q"


def _own_words(items: DataFrame, told: list[str]) -> DataFrame:
    """word, id, title_words: each word of an item, *tag, tag that is no word, extended query that holds, and _THERE. title_words is null where all is title."""
    text = F.array().cast("array<string>")
    own = items.select("id", words_of(F.col("text")).alias("words"), F.coalesce("tags", text).alias("tags"), F.when(F.contains("text", F.lit("\t")), words_of(F.substring_index("text", "\t", 1))).alias("title_words"))
    tags = F.transform("tags", lambda x: F.concat(F.lit("*"), x))
    bare = F.transform(F.array_except("tags", "words"), lambda x: F.concat(F.lit(_TAG), x))
    holds = [F.when(extended(q, F.col("words"), F.col("tags")), F.lit(_TOLD + q)) for q in told]
    every = [F.coalesce(F.concat("words", F.array_distinct(tags), bare), text), F.array(F.lit(_THERE)), *([F.array_compact(F.array(*holds))] if holds else [])]
    return own.select("id", "title_words", F.explode(F.concat(*every)).alias("word"))


def _asked_words(requests: DataFrame, has) -> DataFrame:
    """rq, word, must, also (1 or 0), titled (the word is wanted in the title), least (number of wanted words found): what each request looks for."""
    need = F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}*~?]+"), lambda w: w != "")
    begins = lambda w, c: F.startswith(w, F.lit(c))
    r = requests.withColumn("need", need)
    r = r.withColumns({"wanted": F.array_distinct(F.filter("need", lambda w: ~begins(w, "?"))), "extra": F.array_distinct(F.transform(F.filter("need", lambda w: begins(w, "?")), lambda w: F.substring(w, 2, 1 << 20)))})
    one = lambda w, must, also, titled: F.struct(w.alias("word"), F.lit(must).alias("must"), F.lit(also).alias("also"), titled.alias("titled"))
    no = F.lit(False)
    plain = F.concat(
        F.transform("wanted", lambda w: one(w, 1, 0, has(256))),
        F.transform(F.filter("extra", lambda w: ~begins(w, "*")), lambda w: one(w, 0, 1, no)),
        F.transform("extra", lambda w: one(F.concat(F.lit(_TAG), w), 0, 1, no)),
        F.when(F.size("wanted") == 0, F.array(one(F.lit(_THERE), 0, 0, no))).otherwise(F.slice(F.array(one(F.lit(_THERE), 0, 0, no)), 1, 0)),
    )
    words = F.when(has(8192), F.array(one(F.concat(F.lit(_TOLD), F.col("query")), 1, 0, no))).otherwise(plain)
    least = F.when(has(8192), 0).otherwise(F.size("wanted") - F.when(has(65536), 2).otherwise(0))
    return r.select("rq", least.alias("least"), F.explode(words).alias("w")).select("rq", "least", "w.*")


@op("search.search", "flags:int limit:int rate_type:int restrictions:array<struct<rate_type:int,min_value:int,max_value:int>> hash:long use_relevance:double opttag_coeff:double rate_normalize:array<struct<rate_type:int,weight:double,fun:int>> priority_normalize:double decay:struct<rate_type:int,weight:double,fun:int> hash_change:int query:string")
def _search(e: Engine, requests: DataFrame) -> DataFrame:
    """rq, pos, total, id, rate, hash of the best items.

    Texts are cut to words once for the whole batch: what an item has (words, tags, extended queries that hold for it, and a
    mark that it is there) meets what the requests ask for. Different extended queries are MOST_QUERIES at most.
    """
    has = lambda bit: F.expr(f"(flags & {bit}) <> 0")
    told = requests.where(has(8192)).select("query").distinct().limit(MOST_QUERIES + 1).collect()
    if len(told) > MOST_QUERIES:
        raise ValueError("too many different extended queries; go in batches")
    wanted = _asked_words(requests.where("flags IS NOT NULL"), has)
    hit = wanted.join(_own_words(e.state["items"], [q for (q,) in told]), "word").where(~F.col("titled") | F.col("title_words").isNull() | F.array_contains("title_words", F.col("word")))
    hits = hit.groupBy("rq", "id").agg(F.sum("must").alias("n"), F.sum("also").alias("optional"), F.max("least").alias("least"), F.min("also").alias("_a")).where("_a = 0 AND n >= least").drop("_a", "least")
    items = e.state["items"].withColumnRenamed("hash", "own_hash").drop("text", "tags")
    rows = hits.join(requests.drop("query"), "rq").join(items, "id")
    rate = lambda k: F.coalesce(F.try_element_at("rates", k), F.lit(0))
    rows = rows.where(~has(16) | (F.col("own_hash") == F.col("hash")))
    rows = rows.where(~has(8) | F.forall(F.coalesce("restrictions", F.array().cast("array<struct<rate_type:int,min_value:int,max_value:int>>")), lambda x: rate(x.rate_type).between(x.min_value, x.max_value)))
    normal = F.aggregate(F.coalesce("rate_normalize", F.array().cast("array<struct<rate_type:int,weight:double,fun:int>>")), F.lit(0.0), lambda a, x: a + x.weight * F.when(x.fun == 0, F.log2(1 + F.greatest(rate(x.rate_type), F.lit(0))) / 31).otherwise(rate(x.rate_type) / 2147483647.0))
    age = F.lit(e.now) - rate(F.coalesce(F.col("decay.rate_type"), F.lit(0)))
    score = (normal + F.coalesce("priority_normalize", F.lit(0.0)) * F.col("n") + F.coalesce("opttag_coeff", F.lit(0.0)) * F.col("optional")) * F.when(has(4096), F.pow(F.lit(2.0), -age / F.col("decay.weight"))).otherwise(1.0)
    by = F.when(has(32768), F.xxhash64("rq", "id").cast("double")).when(has(128) | has(1024), -score).when(has(16384), -F.col("n").cast("double")).when(has(2), F.when(has(4), -rate(F.coalesce("rate_type", F.lit(0)))).otherwise(rate(F.coalesce("rate_type", F.lit(0)))).cast("double")).otherwise(0.0)
    rows = rows.withColumn("_by", by)
    group = F.when(has(32) & (F.col("own_hash") != 0), F.struct(F.col("own_hash").alias("h"), F.array().cast("array<int>").alias("i"))).when(has(64), F.struct(rate(F.coalesce("hash_change", F.lit(0))).cast("bigint").alias("h"), F.array().cast("array<int>").alias("i"))).otherwise(F.struct(F.lit(0).cast("bigint").alias("h"), F.col("id").alias("i")))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("rq", group).orderBy("_by", "id"))).where("_first = 1")
    rows = rows.withColumns({"pos": F.row_number().over(Window.partitionBy("rq").orderBy("_by", "id")), "total": F.count("*").over(Window.partitionBy("rq"))}).where("pos <= limit")
    return rows.select("rq", "pos", "total", "id", F.when(has(2), rate(F.coalesce("rate_type", F.lit(0)))).alias("rate"), F.when(has(32), F.col("own_hash")).alias("hash"))


def _by_letters(letters: str, limit: int, query: str) -> dict[str, object]:
    flags, rate = 0, 0
    for c in letters:
        if c in "XPUVT":
            flags |= {"X": 8192, "P": 16384, "U": 32, "V": 256, "T": 65536}[c]
        elif c == "?":
            flags |= 32768
        elif c.lower() in RATINGS:
            flags, rate = flags | 2 | (4 if c.isupper() else 0), RATINGS.index(c.lower())
        elif c.lower() != "i":
            raise ValueError(f"no order {c!r}")
    return {"flags": flags, "limit": limit if "I" not in letters else 2147483647, "rate_type": rate, "query": query}


def by_letters(e: Search, letters: str, limit: int, query: str) -> DataFrame:
    """The text protocol's ``search<letters>#<limit>(<query>)``: an order letter (lower case ascending, upper case descending, i by id, ? random) and modifiers X extended, P by number of words, U grouped by hash, V title only, T weak."""
    out = e.batch("search.search", asked(e, [_by_letters(letters, limit, query)]))
    return out.orderBy(F.desc("id")).limit(limit) if "I" in letters else out


def batch_by_letters(e: Search, searches: list[tuple[str, int, str]]) -> DataFrame:
    """``by_letters`` of several (letters, limit, query) in one pass over the texts; rq is the place in the list, pos the place in its order."""
    out = e.batch("search.search", asked(e, [_by_letters(*s) for s in searches]))
    limits = {i: n for i, (letters, n, _) in enumerate(searches) if "I" in letters}
    if not limits:
        return out
    turned = F.col("rq").isin(list(limits))
    most = F.try_element_at(F.create_map(*(F.lit(x) for i, n in limits.items() for x in (i, n))), F.col("rq").cast("int"))
    return out.withColumn("pos", F.when(turned, F.col("total") - F.col("pos") + 1).otherwise(F.col("pos")).cast("int")).where(~turned | (F.col("pos") <= most))


#: Arguments of search.search that change nothing.
NEUTRAL = {"rate_type": 0, "restrictions": [], "hash": 0, "use_relevance": 0.0, "opttag_coeff": 0.0, "rate_normalize": [], "priority_normalize": 0.0, "decay": None, "hash_change": 0}


def asked(e: Search, searches: list[dict[str, object]]) -> DataFrame:
    """Requests of ``search.search`` with rq from 0; arguments that aren't given are NEUTRAL."""
    return reduce(DataFrame.unionByName, (e.request("search.search", i, **NEUTRAL | s) for i, s in enumerate(searches)))
