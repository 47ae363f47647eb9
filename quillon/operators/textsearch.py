"""Ranked text search: groups, relevance, phrases, prefixes, spelling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.predicate import words_of

_CYR, _LAT = "абвгдезийклмнопрстуфхыэ", "abvgdezijklmnoprstufhye"
_KEYS_CYR, _KEYS_LAT = "йцукенгшщзхъфывапролджэячсмитьбю", "qwertyuiop[]asdfghjkl;'zxcvbnm,."


def tokens(c: Column) -> Column:
    """All lower-case words in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def transliterate(c: Column) -> Column:
    for a, b in (("щ", "sch"), ("ш", "sh"), ("ч", "ch"), ("ж", "zh"), ("ц", "ts"), ("ю", "yu"), ("я", "ya"), ("ё", "yo"), ("ъ", ""), ("ь", "")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, _CYR, _LAT)


def other_layout(c: Column) -> Column:
    """What the keys of a Latin layout give under a Cyrillic one."""
    return F.translate(c, _KEYS_LAT, _KEYS_CYR)


def stem(c: Column) -> Column:
    """English suffix stripping: plurals, -ed, -ing, -ly, -ness, -ment where three letters remain."""
    c = F.regexp_replace(c, r"^(.{3,})(?:sses)$", "$1ss")
    c = F.regexp_replace(c, r"^(.{2,})ies$", "$1y")
    c = F.regexp_replace(c, r"^(.{2,}[^su])s$", "$1")
    return F.regexp_replace(c, r"^(.{3,}?)(?:ingly|edly|ing|ed|ly|ness|ment)$", "$1")


#: Fixed values of the Russian stemmer: vowels, and endings by step; those of a first group stand after а or я only.
_VOWELS = "аеиоуыэюя"
_GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
_PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"


def _ending(first: str, second: str) -> str:
    either = [f"(?<=[ая])(?:{'|'.join(first.split())})"] if first else []
    return "(?:" + "|".join([*either, *second.split()]) + ")"


def stem_russian(c: Column) -> Column:
    """The Snowball stemmer of Russian over lower-case words; ё counts as е. Words without a vowel stay."""
    word = F.replace(c, F.lit("ё"), F.lit("е"))
    head = F.regexp_extract(word, f"^[^{_VOWELS}]*[{_VOWELS}]", 0)
    adjectival = f"(?:{_ending(*_PARTICIPLE)})?(?:{'|'.join(_ADJECTIVE.split())})$"

    def changed(x: Column, pattern: str) -> Column:
        return F.regexp_replace(x, pattern, "")

    def first(rv: Column) -> Column:
        gerund = _ending(*_GERUND) + "$"
        bare = changed(rv, "(?:ся|сь)$")
        verb, noun = _ending(*_VERB) + "$", f"(?:{'|'.join(_NOUN.split())})$"
        rest = F.when(F.rlike(bare, F.lit(adjectival)), changed(bare, adjectival)).when(F.rlike(bare, F.lit(verb)), changed(bare, verb)).otherwise(changed(bare, noun))
        return F.when(F.rlike(rv, F.lit(gerund)), changed(rv, gerund)).otherwise(rest)

    rv = changed(first(F.substr(word, F.length(head) + 1)), "и$")
    out = F.concat(head, rv)
    second = f"[^{_VOWELS}]*[{_VOWELS}]+[^{_VOWELS}]"
    out = F.regexp_replace(out, f"^({second}{second}.*?)(?:ость|ост)$", "$1")
    out = F.when(F.rlike(out, F.lit("(?:ейше|ейш)$")), F.regexp_replace(changed(out, "(?:ейше|ейш)$"), "нн$", "н")).when(F.rlike(out, F.lit("нн$")), changed(out, "н$")).otherwise(changed(out, "ь$"))
    return F.when(head == "", c).otherwise(out)


def stem_any(c: Column) -> Column:
    """Russian or English by the word's letters."""
    return F.when(F.rlike(c, F.lit("[а-яё]")), stem_russian(c)).otherwise(stem(c))


def phrases_of(query: str) -> tuple[list[tuple[list[str], bool]], list[tuple[list[str], bool]]]:
    """Phrases wanted and excluded of a query: double quotes are matched by stems, single quotes word by word, a leading minus excludes; bare words are phrases of one word by stems."""
    wanted, excluded = [], []
    for m in re.finditer(r"""(-?)(?:"([^"]*)"|'([^']*)'|([^\s"']+))""", query.lower()):
        words = re.findall(r"\w+", m[2] or m[3] or m[4] or "")
        if words:
            (excluded if m[1] else wanted).append((words, m[3] is None))
    return wanted, excluded


def phrase_search(docs: DataFrame, query: str, most_extra: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, extra of the texts with all wanted phrases, and without any excluded one as it stands; extra is the worst phrase's number of words in between."""
    wanted, excluded = phrases_of(query)
    if not wanted:
        raise ValueError("a phrase is needed")
    plain = tokens(F.col(text))
    df = docs.select(key, plain.alias("_w"), F.transform(plain, stem_any).alias("_s"))
    stems = lambda words: [r[0] for r in docs.sparkSession.createDataFrame([(w,) for w in words], "w string").select(stem_any(F.col("w"))).collect()]
    extra = lambda p: extra_words(F.col("_s" if p[1] else "_w"), stems(p[0]) if p[1] else p[0])
    for p in excluded:
        df = df.where(F.coalesce(extra(p) > 0, F.lit(True)))
    cs = [extra(p).alias(f"_p{i}") for i, p in enumerate(wanted)]
    df = df.select(key, *cs)
    worst = F.greatest(*(F.col(f"_p{i}") for i in range(len(cs)))) if len(cs) > 1 else F.col("_p0")
    for i in range(len(cs)):
        df = df.where(F.col(f"_p{i}").isNotNull())
    return df.select(key, worst.cast("int").alias("extra")).where(F.col("extra") <= most_extra)


def best_of_groups(items: DataFrame, key: str, rating: str, group: str) -> DataFrame:
    """The best-rated item of each group (ties: lesser key), with groups, their number; group 0 is unset, each such item its own."""
    g = F.when(F.col(group) == 0, F.struct(F.lit(True).alias("own"), F.col(key).alias("id"))).otherwise(F.struct(F.lit(False).alias("own"), F.col(group).cast(items.schema[key].dataType).alias("id")))
    w = Window.partitionBy("_g").orderBy(F.desc(rating), key)
    best = items.withColumn("_g", g).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_g")
    return best.join(F.broadcast(best.agg(F.count("*").alias("groups"))))


def relevance(terms: list[tuple[Column, float, bool]], decay: tuple[Column, float] | None = None) -> Column:
    """Integer rating below 2**31: weighted sum of (normalised rating in [0, 1], weight, ascending), halved by (age, half-life)."""
    total = sum((F.lit(w) * ((1 - c) if up else c) for c, w, up in terms), F.lit(0.0)) / sum(w for _, w, _ in terms)
    if decay is not None:
        total = total * F.pow(F.lit(2.0), -decay[0] / decay[1])
    return F.least(F.greatest(F.floor(total * 2147483647), F.lit(0)), F.lit(2147483647)).cast("bigint")


def word_weights(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: cosine-like: squared frequencies of the query's words over the root of all squared frequencies."""
    t = docs.select(key, F.explode(tokens(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("f"))
    hit = F.sum(F.when(F.col("w").isin(query), F.col("f") * F.col("f")).otherwise(0))
    return t.groupBy(key).agg(hit.alias("_h"), F.sum(F.col("f") * F.col("f")).alias("_n")).where("_h > 0").select(key, (F.col("_h") / F.sqrt("_n")).alias("score"))


def extra_words(words: Column, phrase: list[str]) -> Column:
    """Least number of extra words where the phrase's words stand in order in an array of words; null if they never do.

    One pass over the places of the phrase's words keeps, for each beginning of the phrase, the latest place where it starts.
    """
    n, none = len(phrase), F.lit(None).cast("int")
    places = F.filter(F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda p: p.w.isin(phrase))
    state = F.struct(*(none.alias(f"s{j}") for j in range(n)), none.alias("best"))

    def step(a: Column, p: Column) -> Column:
        start = [F.when(p.w == phrase[j], a[f"s{j - 1}"] if j else p.i).otherwise(a[f"s{j}"]) for j in range(n)]
        extra = F.when(p.w == phrase[-1], p.i - (a[f"s{n - 2}"] if n > 1 else p.i) - (n - 1))
        return F.struct(*(c.alias(f"s{j}") for j, c in enumerate(start)), F.least(a["best"], extra).alias("best"))

    return F.aggregate(places, state, step, lambda a: a["best"])


def phrase_rank(docs: DataFrame, phrases: list[list[str]], minus: list[list[str]], most_extra: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, extra: the worst phrase's extra words, at most most_extra; texts that hold a minus-phrase without extra words are left out."""
    df = docs.select(key, tokens(F.col(text)).alias("_w"))
    df = df.select(key, *(extra_words(F.col("_w"), p).alias(f"_p{i}") for i, p in enumerate(phrases)), *(extra_words(F.col("_w"), p).alias(f"_m{i}") for i, p in enumerate(minus)))
    for i in range(len(minus)):
        df = df.where(F.coalesce(F.col(f"_m{i}") > 0, F.lit(True)))
    for i in range(len(phrases)):
        df = df.where(F.col(f"_p{i}").isNotNull())
    worst = F.greatest(*(F.col(f"_p{i}") for i in range(len(phrases)))) if len(phrases) > 1 else F.col("_p0")
    return df.select(key, worst.cast("int").alias("extra")).where(F.col("extra") <= most_extra)


def prefix_suggestions(counts: DataFrame, prefix: str, n: int = 5, typo: bool = False, word: str = "word", weight: str = "n") -> DataFrame:
    """The n most frequent words with the prefix, or whose prefix of that length is one edit away."""
    start = F.startswith(F.col(word), F.lit(prefix))
    near = F.levenshtein(F.substring(F.col(word), 1, len(prefix)), F.lit(prefix)) <= 1
    return counts.where(start | near if typo else start).orderBy(F.desc(weight), word).limit(n)


def correction(counts: DataFrame, text: str, most: int = 2, word: str = "word", weight: str = "n") -> DataFrame:
    """The word nearest to the text (most frequent of equally near ones), at most so many edits away; no row if it is a word itself or none is near."""
    d = counts.withColumn("edits", F.levenshtein(F.col(word), F.lit(text)))
    best = d.where(F.col("edits") <= most).orderBy("edits", F.desc(weight), word).limit(1)
    return best.where("edits > 0")


def _begins(words: Column, forms: list[Column]) -> Column:
    return F.exists(words, lambda x: F.array_contains(F.array(*(F.startswith(x, f) for f in forms)), True))


def hints(objects: DataFrame, query: str, limit: int, now: int, half_life: float = 4 * 7 * 86400.0, key: str = "id", text: str = "text", rating: str = "rating", seen: str = "seen", latin: bool = True) -> DataFrame:
    """Objects of whose keywords every query word is a prefix (as typed, transliterated or under the other layout), by decayed rating."""
    words = words_of(F.col(text))
    fits = F.lit(True)
    for w in query.lower().split():
        forms = [F.lit(w)] + ([transliterate(F.lit(w)), other_layout(F.lit(w))] if latin else [])
        fits = fits & _begins(words, forms)
    score = F.col(rating) * F.pow(F.lit(2.0), -(F.lit(now) - F.col(seen)) / half_life)
    return objects.where(fits).withColumn("score", score).orderBy(F.desc("score"), key).limit(limit)


def _shortened(c: Column) -> Column:
    """A word and all that it is with one letter left out: words one edit apart share one of these."""
    return F.array_union(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1))))


def nearest(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, edits (0 or 1), suggestion (the least of the nearest) for the words (word) at most one edit from one of the dictionary (word)."""
    own = words.select("word").distinct()
    a = own.select("word", F.explode(_shortened(F.col("word"))).alias("_key"))
    b = dictionary.select(F.col("word").alias("known")).distinct().select("known", F.explode(_shortened(F.col("known"))).alias("_key"))
    pairs = a.join(b, "_key").select("word", "known").distinct().withColumn("edits", F.levenshtein("word", "known", 1)).where("edits >= 0")
    best = pairs.groupBy("word").agg(F.min(F.struct("edits", "known")).alias("_b"))
    return best.select("word", F.col("_b.edits").alias("edits"), F.col("_b.known").alias("suggestion"))


def spell_check(docs: DataFrame, dictionary: list[str] | DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, known, misspelt, other: words in the dictionary, one edit from a word of it, and the rest; distinct words are judged once, over shortened forms, so that no word meets the whole dictionary. What is near the words of a list is broadcast, so that no word of a text is shuffled."""
    d = docs.sparkSession.createDataFrame([(x,) for x in dictionary], "word string") if isinstance(dictionary, list) else dictionary
    w = docs.select(key, F.explode(tokens(F.col(text))).alias("word"))
    near = nearest(w, d).select("word", "edits")
    if isinstance(dictionary, list):
        told = w.withColumn("n", F.lit(1).cast("bigint")).join(F.broadcast(near), "word", "left")
    else:
        told = w.groupBy(key, "word").agg(F.count("*").alias("n")).join(near, "word", "left")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return told.groupBy(key).agg(part(F.col("edits") == 0).alias("known"), part(F.col("edits") == 1).alias("misspelt"), part(F.col("edits").isNull()).alias("other"))


def answers(questions: DataFrame, asked: str, n: int, key: str = "id", text: str = "text") -> DataFrame:
    """The n stored questions most alike by shared words over all words; 1.0 is exact."""
    mine = words_of(F.lit(asked))
    own = words_of(F.col(text))
    score = F.size(F.array_intersect(own, mine)) / F.greatest(F.size(F.array_union(own, mine)), F.lit(1))
    return questions.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), key).limit(n)
