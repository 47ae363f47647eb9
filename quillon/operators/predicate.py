"""The boolean query language over entities and the condition language of albums, parsed to Columns.

``term ::= name (= | >= | <= | < | >) value``, flags without a value, ``!``, ``&``, ``|``, parentheses, ``true``, ``false``. A compound name binds one
nested element: ``education.(chair=1&graduation=2010)``; ``group`` and ``lang`` test each condition by itself. Every predicate
is checked against a keyword table (kind and range).
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.maths import rand

INDEPENDENT = ("group", "lang")


class Keyword(NamedTuple):
    """kind: eq, range, words, flag or compound; the column (default: the name); bounds of values."""

    kind: str
    least: int | None = None
    most: int | None = None
    column: str | None = None


#: The profile keywords with kind and bounds; numeric maxima that the public sources name only by constants are left open.
KEYWORDS: dict[str, Keyword] = {
    "id": Keyword("range", 1, 2000000000),
    "bday_day": Keyword("range", 1, 31),
    "bday_month": Keyword("range", 1, 12),
    "bday_year": Keyword("range", 1900, 2017),
    "browser": Keyword("range", 0),
    "hidden": Keyword("range", 0),
    "countries_visited": Keyword("range", 0),
    "timezone": Keyword("range"),
    "online": Keyword("range", 0, 2147483647),
    "random": Keyword("range", 0, 1000),
    "age": Keyword("range", 0, 127),
    "future_age": Keyword("range", 0, 127),
    "height": Keyword("range", 0),
    "education.graduation": Keyword("range", 1900, 2033),
    "school.graduation": Keyword("range", 1900, 2033),
    "military.start": Keyword("range", 1900, 2033),
    "military.finish": Keyword("range", 1900, 2033),
    "custom1": Keyword("range", 0),
    "custom2": Keyword("range", 0),
    "custom3": Keyword("range", 0),
    "custom4": Keyword("range", 0),
    "custom5": Keyword("range", 0),
    "custom6": Keyword("range", 0),
    "custom7": Keyword("range", 0),
    "custom8": Keyword("range", 0),
    "custom9": Keyword("range", 0),
    "custom10": Keyword("range", 0),
    "custom11": Keyword("range", 0),
    "custom12": Keyword("range", 0),
    "custom13": Keyword("range", 0),
    "custom14": Keyword("range", 0),
    "custom15": Keyword("range", 0),
    "country": Keyword("eq", 1, 255),
    "city": Keyword("eq", 1),
    "political": Keyword("eq", 0),
    "sex": Keyword("eq", 0),
    "operator": Keyword("eq", 0),
    "region": Keyword("eq", 0),
    "smoking": Keyword("eq", 0),
    "alcohol": Keyword("eq", 0),
    "personal_priority": Keyword("eq", 0),
    "important_in_others": Keyword("eq", 0),
    "status": Keyword("eq", 0),
    "has_photo": Keyword("eq", 0, 1),
    "uses_apps": Keyword("eq", 0, 1),
    "pays_money": Keyword("eq", 0, 1),
    "privacy": Keyword("eq", 0),
    "gcountry": Keyword("eq", 0),
    "birthday_soon": Keyword("eq", 0),
    "education.country": Keyword("eq", 1, 255),
    "education.city": Keyword("eq", 1),
    "education.university": Keyword("eq", 1),
    "education.faculty": Keyword("eq", 1),
    "education.chair": Keyword("eq", 1),
    "education.form": Keyword("eq", 0),
    "education.status": Keyword("eq", 0),
    "school.country": Keyword("eq", 1, 255),
    "school.city": Keyword("eq", 1),
    "school.id": Keyword("eq", 0),
    "school.class": Keyword("eq", 1, 102),
    "address.country": Keyword("eq", 1, 255),
    "address.city": Keyword("eq", 1),
    "address.district": Keyword("eq", 1),
    "address.station": Keyword("eq", 1),
    "address.street": Keyword("eq", 1),
    "address.type": Keyword("eq", 1),
    "group.type": Keyword("eq", 1, 127),
    "group.id": Keyword("eq"),
    "military.unit": Keyword("eq", 1),
    "lang.id": Keyword("eq"),
    "name": Keyword("words"),
    "name_interests": Keyword("words"),
    "interests": Keyword("words"),
    "religion": Keyword("words"),
    "hometown": Keyword("words"),
    "proposal": Keyword("words"),
    "school.spec": Keyword("words"),
    "address.house": Keyword("words"),
    "address.name": Keyword("words"),
    "company.name": Keyword("words"),
    "company.job": Keyword("words"),
    "true": Keyword("flag"),
    "false": Keyword("flag"),
    "birthday_today": Keyword("flag"),
    "birthday_tomorrow": Keyword("flag"),
    "in_list": Keyword("flag"),
    "education": Keyword("compound"),
    "school": Keyword("compound"),
    "address": Keyword("compound"),
    "group": Keyword("compound"),
    "company": Keyword("compound"),
    "military": Keyword("compound"),
    "lang": Keyword("compound"),
}

_TOKEN = re.compile(r"\s*(>=|<=|!=|==|=|<|>|&&|\|\||[!&|().?]|-?\d+(?:\.\d+)?|\"[^\"]*\"|'[^']*'|[A-Za-z_]\w*)")


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r}")
        out.append(m[1])
        at = m.end()
    return out


def words_of(c: Column) -> Column:
    """Distinct lower-case words of a text column."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


class _Parser:
    def __init__(self, text: str, keywords: dict[str, Keyword], flags: dict[str, Column], fields: dict[str, Column]):
        self.t, self.i, self.keywords, self.flags, self.fields = _tokens(text), 0, keywords, flags, fields

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want and got != want:
            raise ValueError(f"{want or 'more'} is needed before {got!r}")
        self.i += 1
        return got

    def either(self, prefix: str = "", element: Column | None = None) -> Column:
        left = self.both(prefix, element)
        while self.peek() in ("|", "||"):
            self.take()
            left = left | self.both(prefix, element)
        return left

    def both(self, prefix: str, element: Column | None) -> Column:
        left = self.term(prefix, element)
        while self.peek() in ("&", "&&"):
            self.take()
            left = left & self.term(prefix, element)
        return left

    def term(self, prefix: str, element: Column | None) -> Column:
        t = self.take()
        if t == "!":
            return ~F.coalesce(self.term(prefix, element), F.lit(False))
        if t == "(":
            x = self.either(prefix, element)
            self.take(")")
            return x
        name = prefix + t
        kw = self.keywords.get(name)
        if kw is None:
            raise ValueError(f"no keyword {name}")
        if kw.kind == "flag":
            return self.flags[t]
        if kw.kind == "compound":
            self.take(".")
            if self.peek() != "(":
                return F.exists(self.fields.get(name, F.col(name)), lambda e: F.coalesce(self.term(name + ".", e), F.lit(False)))
            at = self.i
            if name in INDEPENDENT:
                self.take("(")
                x = self.apart(name)
                self.take(")")
                return x
            out = []

            def inside(e: Column) -> Column:
                self.i = at
                self.take("(")
                out.append(self.either(name + ".", e))
                self.take(")")
                return F.coalesce(out[-1], F.lit(False))

            return F.exists(self.fields.get(name, F.col(name)), inside)
        op, raw = self.take(), self.take()
        field = element[t] if element is not None else self.fields.get(name, F.col(kw.column or name))
        return self.compare(name, kw, field, op, raw)

    def apart(self, name: str) -> Column:
        """Conditions of a group that each find an element of their own, with the levels of | and &, ! and parentheses."""
        left = self.apart_both(name)
        while self.peek() in ("|", "||"):
            self.take()
            left = left | self.apart_both(name)
        return left

    def apart_both(self, name: str) -> Column:
        left = self.apart_term(name)
        while self.peek() in ("&", "&&"):
            self.take()
            left = left & self.apart_term(name)
        return left

    def apart_term(self, name: str) -> Column:
        if self.peek() == "!":
            self.take()
            return ~F.coalesce(self.apart_term(name), F.lit(False))
        if self.peek() == "(":
            self.take()
            x = self.apart(name)
            self.take(")")
            return x
        at = self.i
        return F.exists(self.fields.get(name, F.col(name)), lambda e: self._again(at, name, e))

    def _again(self, at: int, name: str, e: Column) -> Column:
        self.i = at
        return F.coalesce(self.term(name + ".", e), F.lit(False))

    def compare(self, name: str, kw: Keyword, field: Column, op: str, raw: str) -> Column:
        if kw.kind == "words":
            if op not in ("=", "=="):
                raise ValueError(f"{name} takes =")
            wanted = [w for w in re.split(r"\W+", raw.strip("'\"").lower()) if w]
            if len(wanted) > 8:
                raise ValueError("more than 8 words")
            has = F.lit(True)
            for w in wanted:
                has = has & F.array_contains(field, w)
            return has
        v = float(raw) if "." in raw else int(raw)
        if op in (">=", "<=", "<", ">") and kw.kind != "range":
            raise ValueError(f"{name} takes = only")
        if kw.least is not None and v < kw.least or kw.most is not None and v > kw.most:
            raise ValueError(f"{name}: {v} is out of range")
        out = {"=": field == v, "==": field == v, "!=": field != v, ">=": field >= v, "<=": field <= v, ">": field > v, "<": field < v}[op]
        # Upper bounds leave out values under the keyword's least one, which are unset.
        return out & (field >= kw.least) if op in ("<=", "<") and kw.least is not None and kw.least > 0 else out


def birthday_in(days: Column | int, today: Column, day: str = "bday_day", month: str = "bday_month") -> Column:
    at = F.date_add(today, days)
    return (F.dayofmonth(at) == F.col(day)) & (F.month(at) == F.col(month))


def age_on(today: Column, year: str = "bday_year", month: str = "bday_month", day: str = "bday_day") -> Column:
    """Full years on a day; null where the birthday isn't a date."""
    born = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", F.col(year), F.col(month), F.col(day)), F.lit("yyyy-MM-dd"))
    return F.floor(F.months_between(today.cast("date"), born.cast("date")) / 12).cast("int")


def compiled(text: str, keywords: dict[str, Keyword] | None = None, today: Column | None = None, seed: int = 0, fields: dict[str, Column] | None = None, in_list: Column | None = None) -> Column:
    """The query as a Column; today drives birthdays and ages, seed the random predicate, in_list the flag of that name."""
    today = today if today is not None else F.current_date()
    flags = {"true": F.lit(True), "false": F.lit(False), "birthday_today": birthday_in(0, today), "birthday_tomorrow": birthday_in(1, today), "in_list": in_list if in_list is not None else F.lit(False)}
    own = {"age": age_on(today), "random": rand(0, 999, seed, F.col("id")), "birthday_soon": F.lit(None).cast("int")}
    p = _Parser(text, keywords or KEYWORDS, flags, own | dict(fields or {}))
    x = p.either()
    if p.peek():
        raise ValueError(f"unexpected {p.peek()!r}")
    return F.coalesce(x, F.lit(False))


def search(entities: DataFrame, text: str, order: str | Column = "id", descending: bool = False, limit: int | None = None, **how) -> DataFrame:
    """Entities that meet the query, by order and then id."""
    out = entities.where(compiled(text, **how))
    by = order if isinstance(order, Column) else F.col(order)
    out = out.orderBy(by.desc() if descending else by.asc(), F.col("id").asc())
    return out.limit(limit) if limit is not None else out


def condition(text: str) -> Column:
    """Album condition: ``field op value``, ``?field`` (present), ``&&``, ``||``, ``!`` and parentheses over any columns."""
    t, i = _tokens(text), 0

    def take() -> str:
        nonlocal i
        i += 1
        return t[i - 1]

    def either() -> Column:
        left = both()
        while i < len(t) and t[i] == "||":
            take()
            left = left | both()
        return left

    def both() -> Column:
        left = term()
        while i < len(t) and t[i] == "&&":
            take()
            left = left & term()
        return left

    def term() -> Column:
        x = take()
        if x == "!":
            return ~term()
        if x == "(":
            y = either()
            take()
            return y
        if x == "?":
            return F.col(take()).isNotNull()
        op, raw = take(), take()
        v = raw[1:-1] if raw[0] in "'\"" else float(raw) if "." in raw else int(raw)
        c = F.col(x)
        return {"=": c == v, "==": c == v, "!=": c != v, "<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[op]

    return F.coalesce(either(), F.lit(False))


def masked(flags: str, xor_mask: int, and_mask: int) -> Column:
    """((flags ^ xor_mask) & and_mask) == 0"""
    return F.col(flags).cast("int").bitwiseXOR(F.lit(xor_mask)).bitwiseAND(F.lit(and_mask)) == 0


def sublist(flags: str, k: int) -> Column:
    return F.col(flags).cast("int").bitwiseAND(F.lit(7)) == k


def of_types(mask: int, type_column: str) -> Column:
    """(mask >> type) & 1"""
    return F.expr(f"(shiftright({mask}L, {type_column}) & 1L) = 1L")


_RULE = re.compile(r"([+-])(?:(\d+)|\*(\d+)|([AG0]))|/(\d+)")


def privacy_rules(text: str) -> list[tuple[int, str, int | None]]:
    """(sign, kind, value) of each rule such as ``+12 -*3 +A``: kinds user, cat, all, friends, nobody."""
    out, at = [], 0
    text = text.replace(" ", "")
    while at < len(text):
        m = _RULE.match(text, at)
        if not m:
            raise ValueError(f"not a rule: {text[at:]!r}")
        sign = 1 if m[1] == "+" or m[5] else -1
        out.append((sign, "nobody", None) if m[2] == "0" else (sign, "user", int(m[2])) if m[2] else (sign, "cat", int(m[3] or m[5])) if m[3] or m[5] else (sign, {"A": "all", "G": "friends", "0": "nobody"}[m[4]], None))
        at = m.end()
    return out


def minimal_privacy(rules: list[tuple[int, str, int | None]]) -> list[tuple[int, str, int | None]]:
    """Rules without those that an earlier one makes idle; neighbours of one sign are sorted, and trailing denials dropped."""
    seen, kept = set(), []
    for r in rules:
        if r[1:] not in seen:
            seen.add(r[1:])
            kept.append(r)
        if r[1] in ("all", "nobody"):
            break
    while kept and kept[-1][0] < 0:
        kept.pop()
    out, i = [], 0
    while i < len(kept):
        j = i
        while j < len(kept) and kept[j][0] == kept[i][0]:
            j += 1
        out += sorted(kept[i:j], key=lambda r: (r[1], r[2] or 0))
        i = j
    return out


def check_privacy(checks: DataFrame, rules: DataFrame, friends: DataFrame) -> DataFrame:
    """owner, viewer, allowed for each check (owner, viewer): the first rule (owner, pos, sign, kind, value) that fits decides, else no; friends (owner, friend, cat) has category masks."""
    known = checks.join(friends.withColumnRenamed("friend", "viewer"), ["owner", "viewer"], "left")
    fits = (
        ((F.col("kind") == "user") & (F.col("value") == F.col("viewer"))) | ((F.col("kind") == "cat") & (F.expr("(shiftright(coalesce(cat, 0), cast(value AS int)) & 1) = 1")))
        | (F.col("kind") == "all") | ((F.col("kind") == "friends") & F.col("cat").isNotNull())
    )
    first = known.join(rules, "owner").where(fits).groupBy("owner", "viewer").agg(F.min_by("sign", "pos").alias("sign"))
    return checks.join(first, ["owner", "viewer"], "left").select("owner", "viewer", F.coalesce(F.col("sign") > 0, F.lit(False)).alias("allowed"))
