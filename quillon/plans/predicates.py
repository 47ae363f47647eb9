"""Boolean predicates over entities: customers with their orders nested."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import predicate as P
from quillon.plans.registry import query, spread, table

#: Keywords over the standard tables, beside those of profiles.
KEYWORDS = P.KEYWORDS | {
    "nation": P.Keyword("eq", 0, 255), "balance": P.Keyword("range"), "segment": P.Keyword("words", column="segment_words"), "title": P.Keyword("words", column="name_words"),
    "orders": P.Keyword("compound"), "orders.status": P.Keyword("eq"), "orders.price": P.Keyword("range"), "orders.year": P.Keyword("range", 1900, 2033), "orders.urgency": P.Keyword("range", 1, 5),
    "group.price": P.Keyword("range"), "group.year": P.Keyword("range", 1900, 2033),
}


def entities(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), P.words_of(F.col("c_mktsegment")).alias("segment_words"), P.words_of(F.col("c_name")).alias("name_words"), "c_name", "c_mktsegment")


def nested(spark, d):
    o = table(spark, d, "orders")
    element = F.struct(F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year"), F.substring("o_orderpriority", 1, 1).cast("int").alias("urgency"))
    own = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(element).alias("orders"))
    return entities(spark, d).join(own, "id").withColumn("group", F.col("orders"))


def _search(name, text, sql, how=entities, columns=("id",)):
    query(sql, name)(lambda spark, d: P.search(how(spark, d), text, keywords=KEYWORDS).select(*columns))


O = "WITH o AS (SELECT o_custkey AS id, o_totalprice AS price, year(o_orderdate) AS year, CAST(substr(o_orderpriority, 1, 1) AS INT) AS urgency FROM orders) "  # noqa: E741
_search("f1_boolean_query", "nation=3 & (balance>=1000 | !balance<=0) & !segment=building", "SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3 AND (c_acctbal >= 1000 OR NOT c_acctbal <= 0) AND c_mktsegment <> 'BUILDING'")
_search("f2_true_false_keywords", "true & !false & id<=100", "SELECT c_custkey AS id FROM customer WHERE c_custkey BETWEEN 1 AND 100")
_search("f3_equality", "nation=7", "SELECT c_custkey AS id FROM customer WHERE c_nationkey = 7")
_search("f4_range", "balance>=100 & balance<=900", "SELECT c_custkey AS id FROM customer WHERE c_acctbal BETWEEN 100 AND 900")
_search("f5_word", "segment=machinery", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY'")
_search("f6_two_words", "segment=household | title=household", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
_search("f8_existential", "orders.(year=1996 & price>=300000) & !nation=3", O + "SELECT DISTINCT o.id FROM o JOIN customer c ON c.c_custkey = o.id WHERE o.year = 1996 AND o.price >= 300000 AND c.c_nationkey <> 3", nested)
_search("f8_independent_conditions", "group.(price>=400000 & year=1994)", O + "SELECT id FROM o GROUP BY id HAVING bool_or(price >= 400000) AND bool_or(year = 1994)", nested)


@query("SELECT c_custkey AS id FROM customer WHERE list_contains(string_split(lower(c_mktsegment), ' '), 'furniture') OR list_contains(string_split(lower(c_mktsegment), ' '), 'building')")
def f7_word_list(spark, d):
    e = entities(spark, d)
    return e.where(F.arrays_overlap("segment_words", F.array(F.lit("furniture"), F.lit("building")))).select("id")


_search("f8_group_precedence", "group.(price>=450000 | year=1994 & !price<=5000) & group.(!(year=1993 | price>=480000))", O + "SELECT id FROM o GROUP BY id HAVING (bool_or(price >= 450000) OR (bool_or(year = 1994) AND NOT bool_or(price <= 5000))) AND NOT (bool_or(year = 1993) OR bool_or(price >= 480000))", nested)
_search("f4_upper_bound_of_set_values", "bday_year<=1962 | bday_day<3", "WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1950 + c_custkey % 40 END AS y, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 29 END AS dd FROM customer) SELECT id FROM b WHERE (y BETWEEN 1900 AND 1962) OR (dd BETWEEN 1 AND 2)", lambda spark, d: entities(spark, d).withColumns({"bday_year": F.expr("if(id % 3 = 0, 0, 1950 + id % 40)"), "bday_day": F.expr("if(id % 5 = 0, 0, id % 29)")}))


@query(O + "SELECT DISTINCT o.id FROM o WHERE o.year = 1995 AND o.urgency <= 2")
def f9_lifted_quantifier(spark, d):
    """A row filter that every matching entity meets goes below the nesting; the quantifier itself stays above."""
    lifted = table(spark, d, "orders").where("year(o_orderdate) = 1995").select("o_custkey").distinct()
    return P.search(nested(spark, d).join(lifted, F.col("id") == F.col("o_custkey"), "left_semi"), "orders.(year=1995 & urgency<=2)", keywords=KEYWORDS).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey = 5")
def f10_in_list(spark, d):
    members = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct()
    told = entities(spark, d).join(members.withColumn("_member", F.lit(True)), "id", "left")
    return P.search(told, "in_list & nation=5", keywords=KEYWORDS, in_list=F.coalesce("_member", F.lit(False))).select("id")


def _born(spark, d):
    b = F.expr("date_add(DATE'1960-01-01', cast(c_custkey * 37 % 14000 AS int))")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.year(b).alias("bday_year"), F.month(b).alias("bday_month"), F.dayofmonth(b).alias("bday_day"))


B = "WITH b AS (SELECT c_custkey AS id, DATE '1960-01-01' + CAST(c_custkey * 37 % 14000 AS INT) AS born FROM customer) "


@query(B + "SELECT id FROM b WHERE (month(born) = 6 AND day(born) IN (15, 16))")
def f11_birthdays(spark, d):
    return _born(spark, d).where(P.compiled("birthday_today | birthday_tomorrow", today=F.lit("2011-06-15").cast("date"))).select("id")


@query(B + "SELECT id, CAST(date_sub('year', born, DATE '2011-06-15') AS INT) AS age FROM b WHERE date_sub('year', born, DATE '2011-06-15') BETWEEN 30 AND 35")
def f12_age(spark, d):
    today = F.lit("2011-06-15").cast("date")
    return _born(spark, d).where(P.compiled("age>=30 & age<=35", today=today)).select("id", P.age_on(today).alias("age"))


@query("SELECT c_custkey AS id FROM customer WHERE ('0x' || substr(md5(c_custkey || ':17'), 1, 15))::BIGINT % 1000 <= 100")
def f13_random(spark, d):
    """A seeded share of the entities, the same for each run."""
    return entities(spark, d).where(P.compiled("random<=100", seed=17)).select("id")


@query("SELECT user_id, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 2 DAY AND TIMESTAMP '2024-01-20' - INTERVAL 1 DAY GROUP BY 1")
def f14_online_interval(spark, d):
    now = F.lit("2024-01-20").cast("timestamp")
    e = table(spark, d, "events")
    return e.where(F.col("ts").between(now - F.expr("INTERVAL 2 DAYS"), now - F.expr("INTERVAL 1 DAY"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (xor(CAST(l_quantity AS INT), 5) & 7) = 0")
def f15_masked_flags(spark, d):
    return table(spark, d, "lineitem").where(P.masked("l_quantity", 5, 7)).select("l_orderkey", "l_linenumber")


@query("SELECT CAST(l_quantity AS INT) & 7 AS part, count(*) AS n FROM lineitem WHERE (CAST(l_quantity AS INT) & 7) IN (3, 4) GROUP BY 1")
def f16_sublist(spark, d):
    li = table(spark, d, "lineitem")
    return li.where(P.sublist("l_quantity", 3) | P.sublist("l_quantity", 4)).groupBy(F.col("l_quantity").cast("int").bitwiseAND(F.lit(7)).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE ((44 & ~8) >> CAST(substr(o_orderpriority, 1, 1) AS INT)) & 1 = 1")
def f17_type_mask(spark, d):
    o = table(spark, d, "orders").withColumn("type", F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.where(P.of_types(44 & ~8, "type")).select("o_orderkey")


@query(
    """WITH f AS (SELECT o_custkey AS owner, o_orderkey % 150 AS friend, bit_or(CAST(1 << (o_orderkey % 4) AS INT)) AS cat FROM orders GROUP BY 1, 2),
    c AS (SELECT DISTINCT o_custkey AS owner, o_orderkey % 97 AS viewer FROM orders)
    SELECT c.owner, c.viewer, CASE WHEN c.viewer = 12 THEN false WHEN cat IS NOT NULL AND (cat >> 2) & 1 = 1 THEN true WHEN cat IS NOT NULL AND (cat >> 1) & 1 = 1 THEN false WHEN cat IS NOT NULL THEN true ELSE false END AS allowed
    FROM c LEFT JOIN f ON f.owner = c.owner AND f.friend = c.viewer"""
)
def f18_privacy_check(spark, d):
    o = table(spark, d, "orders")
    friends = o.groupBy(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 150).alias("friend")).agg(F.bit_or(F.expr("shiftleft(1, cast(o_orderkey % 4 AS int))")).alias("cat"))
    checks = o.select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 97).alias("viewer")).distinct()
    rules = P.privacy_rules("-12 +*2 -*1 +G -0")
    rows = spark.createDataFrame([(i, s, k, v) for i, (s, k, v) in enumerate(rules)], "pos int, sign int, kind string, value long")
    owners = checks.select("owner").distinct()
    return P.check_privacy(checks, owners.join(F.broadcast(rows)), friends)


@query("SELECT * FROM (VALUES (0, 1, 'friends'), (1, -1, 'user'), (2, 1, 'all')) t(pos, sign, kind)")
def f19_minimal_privacy(spark, d):
    rules = P.minimal_privacy(P.privacy_rules("+G -6 +A -7"))
    return spark.createDataFrame([(i, s, k) for i, (s, k, _) in enumerate(rules)], "pos int, sign int, kind string")


@query("SELECT p_partkey FROM part WHERE (p_size > 40 OR p_brand = 'Brand#13') AND p_name IS NOT NULL AND NOT p_retailprice < 950")
def f20_album_condition(spark, d):
    return table(spark, d, "part").where(P.condition("(p_size > 40 || p_brand = 'Brand#13') && ?p_name && !p_retailprice < 950")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 12 AND 30 AND p_partkey % 16 = 5 AND (CAST(p_size AS INT) & 6) = 4")
def f21_restrictions(spark, d):
    p = table(spark, d, "part")
    return p.where(F.col("p_size").between(12, 30) & (F.col("p_partkey") % 16 == 5) & (F.col("p_size").cast("int").bitwiseAND(F.lit(6)) == 4)).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def f22_owner_lists(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    allowed, denied = c.where("c_nationkey = 1"), c.where("c_acctbal < 0")
    return o.join(allowed, o.o_custkey == allowed.c_custkey, "left_semi").join(denied, o.o_custkey == denied.c_custkey, "left_anti").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000 ORDER BY s_suppkey LIMIT 20")
def f23_nodes_by_field(spark, d):
    return table(spark, d, "supplier").where("s_acctbal > 3000").orderBy("s_suppkey").limit(20).select("s_suppkey")


BLACK = ("idiot", "worthless", "total trash", "the clown")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'worthless') OR contains(lower(text), 'total trash') OR contains(lower(text), 'the clown')")
def f24_phrase_blacklist(spark, d):
    from quillon.operators.classify import blacklisted

    return blacklisted(table(spark, d, "documents"), spark.createDataFrame([(x,) for x in BLACK], "phrase string")).select("doc_id")


@query(
    """WITH p(id, ip, ua, flags, pat) AS (VALUES (1, 0, 0, 0, 'and'), (2, 3, 0, 16, 'the'), (3, 0, 2, 0, 'Licensed'), (4, 1, 1, 16, 'on')),
    m AS (SELECT doc_id, doc_id % 5 AS ip, doc_id % 3 AS ua, text, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS plain FROM documents)
    SELECT p.id, count(*) AS n FROM m JOIN p ON (p.ip = 0 OR p.ip = m.ip) AND (p.ua = 0 OR p.ua = m.ua) AND contains(CASE WHEN p.flags = 16 THEN plain ELSE text END, p.pat) GROUP BY 1"""
)
def f25_pattern_match(spark, d):
    from quillon.operators.classify import match_patterns

    patterns = spark.createDataFrame([(1, 0, 0, 0, "and"), (2, 3, 0, 16, "the"), (3, 0, 2, 0, "Licensed"), (4, 1, 1, 16, "on")], "id int, ip int, uahash int, flags int, pattern string")
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("ip"), (F.col("doc_id") % 3).cast("int").alias("uahash"), "text")
    return match_patterns(docs, patterns).groupBy("id").agg(F.count("*").alias("n"))


def _keywords() -> list[tuple[str, str, str]]:
    """(name, query, SQL over the made profiles) for each keyword of the table, in each form its kind allows."""
    out = []
    for name, kw in P.KEYWORDS.items():
        column, low = name.replace(".", "_"), max(kw.least or 0, 1)
        v = min(max(low, 3), kw.most if kw.most is not None else 3)
        if kw.kind in ("eq", "range"):
            if name in ("age", "future_age", "random", "birthday_soon"):
                continue
            out.append((f"{name}=", f"{name}={v}", f"{column} = {v}"))
            if kw.kind == "range":
                floor = f" AND {column} >= {kw.least}" if kw.least is not None and kw.least > 0 else ""
                out += [(f"{name}>=", f"{name}>={v}", f"{column} >= {v}"), (f"{name}<=", f"{name}<={v}", f"{column} <= {v}{floor}")]
        elif kw.kind == "words":
            out.append((f"{name}=", f"{name}=w3", f"{column} = 3"))
    return out + [("true", "true", "true"), ("false", "false", "false")]


def _value(name: str) -> str:
    """A number for each customer and keyword: unset for some, and around what the keyword allows for the others."""
    kw, n = P.KEYWORDS[name], sum(map(ord, name)) % 97
    low = max(kw.least or 0, 1)
    return f"CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE {low} + (c_custkey * {n + 3}) % 5 END"


VALUED = [n for n, kw in P.KEYWORDS.items() if kw.kind in ("eq", "range", "words")]


@query("WITH p AS (SELECT c_custkey, " + ", ".join(f"({_value(n)})::INT AS {n.replace('.', '_')}" for n in VALUED) + ") " .replace(") ", " FROM customer) ") + " UNION ALL ".join(f"SELECT '{n}' AS keyword, count(*) AS n FROM p WHERE {s}" for n, _, s in _keywords()))
def f2_every_keyword(spark, d):
    """Each keyword in each form, over profiles with one row nested in each compound."""
    word = lambda n: F.array(F.concat(F.lit("w"), F.expr(f"cast({_value(n)} AS string)")))
    number = lambda n: F.expr(_value(n)).cast("int")
    make = lambda n: word(n) if P.KEYWORDS[n].kind == "words" else number(n)
    c = spread(table(spark, d, "customer").select("c_custkey"))
    flat = {n: make(n) for n in VALUED if "." not in n and n not in ("age", "future_age", "random")}
    nested = {k: F.array(F.struct(*(make(n).alias(n.split(".")[1]) for n in VALUED if n.startswith(k + ".")))) for k, kw in P.KEYWORDS.items() if kw.kind == "compound"}
    p = c.select("c_custkey", *(v.alias(k) for k, v in (flat | nested).items()))
    counts = p.agg(*(F.count_if(P.compiled(q)).alias(f"k{i}") for i, (_, q, _) in enumerate(_keywords())))
    names = F.array(*(F.struct(F.lit(n).alias("keyword"), F.col(f"k{i}").alias("n")) for i, (n, _, _) in enumerate(_keywords())))
    return counts.select(F.explode(names).alias("r")).select("r.*")
