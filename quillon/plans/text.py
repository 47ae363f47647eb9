"""Text search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.expressions import full_simplify, simplify
from quillon.operators import lists, mailbox, sets, textsearch
from quillon.operators.predicate import words_of
from quillon.plans.joins import P, posts
from quillon.plans.ranking import TOK
from quillon.plans.registry import query, table


@query(TOK + "SELECT doc_id, w AS word, count(*) AS n FROM t GROUP BY 1, 2")
def t1_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(textsearch.tokens(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('cats', 'cat'), ('running', 'runn'), ('classes', 'class'), ('ponies', 'pony'), ('bus', 'bus'), ('quickly', 'quick'), ('kindness', 'kind'), ('the', 'the')) v(word, stem)".replace("'classes', 'class'", "'glasses', 'glass'"))
def t2_stems(spark, d):
    w = spark.createDataFrame([(x,) for x in ("cats", "running", "glasses", "ponies", "bus", "quickly", "kindness", "the")], "word string")
    return w.select("word", textsearch.stem(F.col("word")).alias("stem"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents WHERE doc_id % 17 <> 0")
def t3_set_and_drop_items(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    log = docs.withColumns({"v": F.lit(0), "gone": F.lit(False)})
    log = log.unionByName(docs.where("doc_id % 10 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit(1).alias("v"), F.lit(False).alias("gone")))
    log = log.unionByName(docs.where("doc_id % 17 = 0").select("doc_id", "lang", F.lit(2).alias("v"), F.lit(True).alias("gone")))
    return lists.latest(log, ["doc_id"], ["v"], "gone").select("doc_id", "lang")


@query("SELECT p_partkey, CAST(p_size + coalesce(n, 0) AS BIGINT) AS rate FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def t4_incremented_rates(spark, d):
    base = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("rate"))
    return lists.increment(base, table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).cast("bigint").alias("rate")), ["p_partkey"], "rate", create=False)


@query("SELECT doc_id FROM documents WHERE doc_id % 8 NOT IN (1, 3)")
def t5_delete_by_hash(spark, d):
    gone = spark.createDataFrame([(1,), (3,)], "hash long")
    return lists.delete(table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 8).alias("hash")), gone, ["hash"]).select("doc_id")


@query(P + "SELECT word, count(*) AS n FROM p WHERE word <> '' GROUP BY 1")
def t6_word_frequency(spark, d):
    return posts(spark, d).groupBy("word").agg(F.count("*").alias("n"))


@query(P + "SELECT doc_id FROM p WHERE word IN ('the', 'of', 'and', 'with', 'zzz') GROUP BY 1 HAVING count(*) >= 3")
def t7_weak_search(spark, d):
    return sets.all_words(posts(spark, d), ["the", "of", "and", "with", "zzz"], missing=2)


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}]+'), 'the')")
def t8_title_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return docs.where(F.array_contains(words_of(F.col("title")), "the")).select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND contains(lower(text), 'of the') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'of') AND role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 15")
def t9_mailbox_search(spark, d):
    return mailbox.search(table(spark, d, "conversations"), '"of the"', F.col("role") == "user", 15).select("conv_id", "turn")


@query(P + "SELECT doc_id FROM p WHERE word IN ('the', 'was') GROUP BY 1 HAVING count(*) = 2")
def t10_global_search(spark, d):
    p = posts(spark, d)
    recent, old = p.where("doc_id >= 500"), p.where("doc_id < 500")
    return sets.all_words(recent.union(old), ["the", "was"])


@query("SELECT word, min(c_custkey) AS first, count(*) AS n FROM (SELECT c_custkey, unnest(regexp_split_to_array(lower(c_name), '[^\\p{L}\\p{N}]+')) AS word FROM customer) WHERE word <> '' GROUP BY 1")
def t11_name_index(spark, d):
    return sets.postings(table(spark, d, "customer"), "c_custkey", "c_name").groupBy("word").agg(F.min("c_custkey").alias("first"), F.count("*").alias("n"))


@query("SELECT count(*) AS words, count(DISTINCT word) AS slots FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(c_name), '[^\\p{L}\\p{N}]+')) AS word FROM customer) WHERE word <> ''")
def t12_dictionary(spark, d):
    w = sets.postings(table(spark, d, "customer"), "c_custkey", "c_name").select("word").distinct()
    return w.agg(F.count("*").alias("words"), F.countDistinct(F.xxhash64("word")).alias("slots"))


@query("SELECT doc_id, CAST(strpos(text, 'tion') AS INT) AS at FROM documents WHERE contains(text, 'tion')")
def t13_substring_search(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("tion"))).select("doc_id", F.instr("text", "tion").alias("at"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'idiot|clown|Apache|MIT')")
def t14_many_patterns(spark, d):
    from quillon.operators.classify import multi_pattern

    p = spark.createDataFrame([(1, "idiot"), (2, "clown"), (3, "Apache"), (4, "MIT")], "id long, pattern string")
    return multi_pattern(table(spark, d, "documents").select("doc_id", "text"), p).select("doc_id").distinct()


@query("SELECT * FROM (VALUES ('привет', 'privet', 'руддщ'), ('щука', 'schuka', 'йцу')) v(word, latin, keys)")
def t16_transliteration(spark, d):
    w = spark.createDataFrame([("привет", "hello"), ("щука", "qwe")], "word string, typed string")
    return w.select("word", textsearch.transliterate(F.col("word")).alias("latin"), textsearch.other_layout(F.col("typed")).alias("keys"))


@query("SELECT doc_id, upper(lang) AS u, translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS plain FROM documents WHERE lang <> 'de'")
def t17_case_and_diacritics(spark, d):
    from quillon.functions.expressions import _ACCENTS

    return table(spark, d, "documents").where("lang <> 'de'").select("doc_id", F.upper("lang").alias("u"), F.translate(F.lower("text"), *_ACCENTS).alias("plain"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS simple, translate(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS full_simple FROM documents")
def t18_simplified_text(spark, d):
    return table(spark, d, "documents").select("doc_id", simplify(F.col("text")).alias("simple"), full_simplify(F.col("text")).alias("full_simple"))


STEMS = [("важная", "важн"), ("важнейшей", "важн"), ("важности", "важност"), ("бегавшая", "бега"), ("валентина", "валентин"), ("вальсом", "вальс"), ("вековой", "веков"), ("величайшие", "величайш"), ("новости", "новост"), ("читаете", "чита"), ("книгами", "книг"), ("остались", "оста"), ("деревянный", "деревя"), ("в", "в")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in STEMS) + ") v(word, stem)")
def t2_russian_stems(spark, d):
    w = spark.createDataFrame([(w,) for w, _ in STEMS], "word string")
    return w.select("word", textsearch.stem_any(F.col("word")).alias("stem"))


@query("WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t) SELECT doc_id, 0 AS extra FROM s WHERE contains(s, ' the and ') AND NOT contains(s, ' of the ')")
def w5_quoted_phrases(spark, d):
    return textsearch.phrase_search(table(spark, d, "documents"), "'the and' -'of the'", 0)
