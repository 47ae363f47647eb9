"""String functions of the script runtime as Columns.

Strings are bytes there: lengths, offsets and cuts count bytes of UTF-8. Functions that cut go over a one-character-a-byte
form (``as_bytes``) and back (``as_text``); the mb_ functions count characters. A search that fails is null.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r\0\x0b"


def col(c: Column | str | int | float | bool) -> Column:
    """A Column as it is; anything else as a constant."""
    return c if isinstance(c, Column) else F.lit(c)


def as_bytes(c) -> Column:
    """One character for each byte of the UTF-8 form."""
    return F.decode(F.encode(col(c).cast("string"), "UTF-8"), "ISO-8859-1")


def as_text(c: Column) -> Column:
    return F.encode(c, "ISO-8859-1").cast("string")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _class(chars: str) -> str:
    """A regex class of characters; ``a..z`` is a range."""
    out, i = "", 0
    while i < len(chars):
        if chars[i + 1 : i + 3] == ".." and i + 3 < len(chars):
            out += re.escape(chars[i]) + "-" + re.escape(chars[i + 3])
            i += 4
        else:
            out += {"\0": r"\x00", "\x0b": r"\x0B"}.get(chars[i], "\\" + chars[i] if chars[i] in r"\[]^-&" else chars[i])
            i += 1
    return f"[{out}]"


def addcslashes(c, chars: str) -> Column:
    r"""A backslash before each of the characters; control characters become \n, \t and so on, or octal."""
    names = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r"}
    members = re.compile(_class(chars), re.S)
    out = F.regexp_replace(col(c), f"({_class(chars)})", r"\\$1") if chars else col(c)
    for k in [*range(32), *range(127, 256)]:
        if chars and members.match(chr(k)):
            out = F.replace(out, F.lit("\\" + chr(k)), F.lit("\\" + names.get(k, f"{k:03o}")))
    return out


def addslashes(c) -> Column:
    return F.replace(F.regexp_replace(col(c), r"""(['"\\])""", r"\\$1"), F.lit("\0"), F.lit("\\0"))


def stripslashes(c) -> Column:
    zeroed = F.regexp_replace(col(c), r"(?<!\\)((?:\\\\)*)\\0", "$1\0")
    return F.regexp_replace(zeroed, r"(?s)\\(.?)", "$1")


def mysql_escape_string(c) -> Column:
    out = F.regexp_replace(col(c), r"""(['"\\])""", r"\\$1")
    for raw, name in (("\0", "0"), ("\n", "n"), ("\r", "r"), ("\x1a", "Z")):
        out = F.replace(out, F.lit(raw), F.lit("\\" + name))
    return out


def bin2hex(c) -> Column:
    return F.lower(F.hex(F.encode(col(c), "UTF-8")))


def hex2bin(c) -> Column:
    return F.unhex(col(c))


def rtrim(c, chars: str = SPACE) -> Column:
    return F.regexp_replace(col(c), f"{_class(chars)}+\\z", "") if chars else col(c)


chop = rtrim


def ltrim(c, chars: str = SPACE) -> Column:
    return F.regexp_replace(col(c), f"\\A{_class(chars)}+", "") if chars else col(c)


def trim(c, chars: str = SPACE) -> Column:
    return ltrim(rtrim(c, chars), chars)


def chr_(c) -> Column:
    """The byte of that number modulo 256, as a binary value."""
    return F.unhex(F.lpad(F.hex(F.pmod(col(c).cast("bigint"), F.lit(256))), 2, "0"))


def ord_(c) -> Column:
    """The first byte; 0 for an empty string."""
    return F.coalesce(F.conv(F.substring(F.hex(F.encode(col(c), "UTF-8")), 1, 2), 16, 10).cast("int"), F.lit(0))


def count_chars(c, mode: int = 0) -> Column:
    """0: byte -> count of all 256 bytes, 1: of those there, 2: of the others, 3: the bytes there as a string, 4: the others."""
    b = as_bytes(c)
    chars = F.filter(F.split(b, ""), lambda x: x != "")
    seen = F.transform(F.array_sort(F.array_distinct(F.transform(chars, F.ascii))), lambda k: F.struct(k.alias("key"), F.size(F.filter(chars, lambda x: F.ascii(x) == k)).alias("value")))
    every = F.sequence(F.lit(0), F.lit(255))
    ones = F.transform(chars, F.ascii)
    if mode == 1:
        return F.map_from_entries(seen)
    if mode in (0, 2):
        rows = F.transform(every, lambda k: F.struct(k.alias("key"), F.size(F.filter(ones, lambda x: x == k)).alias("value")))
        return F.map_from_entries(rows if mode == 0 else F.filter(rows, lambda e: e.value == 0))
    if mode == 3:
        return as_text(F.array_join(F.array_sort(F.array_distinct(chars)), ""))
    if mode == 4:
        hexed = F.array_join(F.transform(F.filter(every, lambda k: ~F.array_contains(ones, k)), lambda k: F.lpad(F.hex(k), 2, "0")), "")
        return F.unhex(hexed)
    raise ValueError(mode)


_HTML = [("&", "&amp;"), ('"', "&quot;"), ("'", "&#039;"), ("<", "&lt;"), (">", "&gt;")]


def _quotes(flags: int) -> set[str]:
    """Quotes that flags (2: double, 3: both, 0: none) leave alone."""
    return {0: {'"', "'"}, 2: {"'"}, 3: set()}[flags & 3]


def htmlspecialchars(c, flags: int = 2) -> Column:
    out = col(c)
    for raw, name in _HTML:
        if raw not in _quotes(flags):
            out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def htmlspecialchars_decode(c, flags: int = 2) -> Column:
    out = col(c)
    for raw, name in reversed(_HTML):
        if raw not in _quotes(flags):
            out = F.replace(out, F.lit(name), F.lit(raw))
    return out


def _entities() -> dict[str, str]:
    """Character -> entity name of Latin-1 and beyond, those with one of the classic names."""
    return {chr(k): f"&{v};" for k, v in sorted(_html.entities.codepoint2name.items()) if chr(k) not in "&\"'<>"}


def htmlentities(c, flags: int = 2) -> Column:
    table = F.create_map(*(F.lit(x) for e in _entities().items() for x in e))
    return F.array_join(F.transform(F.split(htmlspecialchars(c, flags), ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def html_entity_decode(c, flags: int = 2) -> Column:
    table = F.create_map(*(F.lit(x) for e in _entities().items() for x in (e[1], e[0])))
    parts = F.regexp_extract_all(col(c), F.lit(r"(?s)&#?\w+;|[^&]+|&"), F.lit(0))
    return htmlspecialchars_decode(F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(table, x), x)), ""), flags)


def nl2br(c) -> Column:
    return F.regexp_replace(col(c), r"(\r\n|\n\r|\n|\r)", "<br />$1")


def _cap(c: Column, pattern: str, up: bool) -> Column:
    """Letters a-z (or A-Z) that the pattern's last character finds, in the other case."""
    out = c
    for a, b in zip("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", strict=True):
        out = F.regexp_replace(out, pattern.format(a if up else b), b if up else a)
    return out


def ucfirst(c) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.substring(col(c), 2, 1 << 30))


def lcfirst(c) -> Column:
    return F.concat(F.lower(F.substring(col(c), 1, 1)), F.substring(col(c), 2, 1 << 30))


def ucwords(c) -> Column:
    """The first letter (a-z) of each word between white space in upper case, the rest as it is."""
    return _cap(col(c), r"(?<![^\s\x0B]){}", True)


def lcwords(c) -> Column:
    return _cap(col(c), r"(?<![^\s\x0B]){}", False)


def levenshtein(a, b) -> Column:
    """Edit distance in bytes."""
    return F.levenshtein(as_bytes(a), as_bytes(b))


def number_format(c, decimals: int = 0, point: str = ".", comma: str = ",") -> Column:
    out = F.format_string(f"%,.{decimals}f", F.round(col(c).cast("double"), decimals))
    out = F.replace(F.replace(out, F.lit(","), F.lit("\x01")), F.lit("."), F.lit(point))
    return F.replace(out, F.lit("\x01"), F.lit(comma))


_DIRECTIVE = re.compile(r"%(?:(\d+)\$)?((?:[-+0 ]|'.)*)(\d*)(?:\.(\d+))?([a-zA-Z%])", re.S)


def sprintf(fmt: str, *args) -> Column:
    """The format b c d e f o s u x X %, with argument numbers, signs, padding, width and precision."""
    out, at, nth = [], 0, 0
    for m in _DIRECTIVE.finditer(fmt):
        out.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        number, flags, width, precision, kind = m.groups()
        if kind == "%":
            out.append(F.lit("%"))
            continue
        i, nth = (int(number) - 1, nth) if number else (nth, nth + 1)
        if i >= len(args):
            raise ValueError("too few arguments")
        pad, left, plus = " ", False, False
        for f in re.findall(r"'.|[-+0 ]", flags, re.S):
            left, plus, pad = left or f == "-", plus or f == "+", f[1] if f[0] == "'" else f if f in "0 " else pad
        x, whole = col(args[i]), col(args[i]).cast("bigint")
        if kind == "d":
            v = F.concat(F.when(whole >= 0, "+").otherwise("") if plus else F.lit(""), whole.cast("string"))
        elif kind in "fF":
            v = F.format_string(f"%{'+' if plus else ''}.{precision or 6}f", F.round(x.cast("double"), int(precision or 6)))
        elif kind in "eE":
            v = F.regexp_replace(F.format_string(f"%{'+' if plus else ''}.{precision or 6}{kind}", x.cast("double")), "([eE][+-])0(?=\\d)", "$1")
        elif kind == "u":
            v = F.when(whole >= 0, whole.cast("string")).otherwise((whole.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("string"))
        elif kind in "xX":
            v = F.hex(whole) if kind == "X" else F.lower(F.hex(whole))
        elif kind == "o":
            v = F.conv(F.hex(whole), 16, 8)
        elif kind == "b":
            v = F.bin(whole)
        elif kind == "c":
            v = chr_(whole).cast("string")
        elif kind == "s":
            v = x.cast("string") if precision is None else substr(x, 0, int(precision))
        else:
            raise ValueError(f"no conversion {kind!r}")
        out.append(v if not width else _padded(v, int(width), pad, left))
    out.append(F.lit(fmt[at:]))
    return F.concat(*out)


def _padded(v: Column, width: int, pad: str, left: bool) -> Column:
    n = F.greatest(F.lit(width), F.length(v))
    if left:
        return F.rpad(v, n, F.lit(" " if pad == "0" else pad))
    if pad == "0":
        signed = F.rlike(v, F.lit("^[+-]"))
        return F.when(signed, F.concat(F.substring(v, 1, 1), F.lpad(F.substring(v, 2, 1 << 30), n - 1, F.lit("0")))).otherwise(F.lpad(v, n, F.lit("0")))
    return F.lpad(v, n, F.lit(pad))


#: The text that printf writes; its result there is the length, strlen(printf(..)).
printf = sprintf
vsprintf = sprintf


def _sign(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def strcmp(a, b) -> Column:
    """-1, 0 or 1 by bytes."""
    return _sign(F.encode(col(a), "UTF-8"), F.encode(col(b), "UTF-8"))


def strcasecmp(a, b) -> Column:
    return strcmp(F.lower(col(a)), F.lower(col(b)))


def strncmp(a, b, n: int) -> Column:
    return _sign(*(F.substring(F.encode(col(x), "UTF-8"), 1, n) for x in (a, b)))


def strlen(c) -> Column:
    return F.octet_length(col(c))


def strpos(c, needle, offset: int = 0) -> Column:
    return F.nullif(F.position(as_bytes(needle), as_bytes(c), F.lit(offset + 1)), F.lit(0)) - 1


def stripos(c, needle, offset: int = 0) -> Column:
    return strpos(F.lower(col(c)), F.lower(col(needle)), offset)


def strrpos(c, needle, offset: int = 0) -> Column:
    """The last place of the needle, at or after the offset."""
    b, n = as_bytes(c), as_bytes(needle)
    back = F.nullif(F.position(F.reverse(n), F.reverse(b)), F.lit(0))
    at = F.length(b) - F.length(n) - back + 1
    return F.when(at >= offset, at)


def strripos(c, needle, offset: int = 0) -> Column:
    return strrpos(F.lower(col(c)), F.lower(col(needle)), offset)


def strstr(c, needle, before: bool = False) -> Column:
    at = F.nullif(F.position(col(needle), col(c)), F.lit(0))
    return F.substr(col(c), F.lit(1), at - 1) if before else F.substr(col(c), at)


def stristr(c, needle, before: bool = False) -> Column:
    at = F.nullif(F.position(F.lower(col(needle)), F.lower(col(c))), F.lit(0))
    return F.substr(col(c), F.lit(1), at - 1) if before else F.substr(col(c), at)


def strpbrk(c, chars: str) -> Column:
    """From the first of the characters on."""
    return F.nullif(F.regexp_extract(col(c), f"(?s){_class(chars)}.*\\z", 0), F.lit(""))


def strrev(c) -> Column:
    return as_text(F.reverse(as_bytes(c)))


def strtolower(c) -> Column:
    return F.lower(col(c))


def strtoupper(c) -> Column:
    return F.upper(col(c))


def strtr(c, table: dict[str, str] | str, to: str | None = None) -> Column:
    """Characters one for one, or a table's keys by their values, the longest first and nothing replaced twice."""
    if isinstance(table, str):
        n = min(len(table), len(to or ""))
        return F.translate(col(c), table[:n], (to or "")[:n])
    keys = sorted((k for k in table if k), key=lambda k: (-len(k), k))
    if not keys:
        return col(c)
    either = "|".join(f"\\Q{k}\\E" for k in keys)
    parts = F.regexp_extract_all(col(c), F.lit(f"(?s){either}|."), F.lit(0))
    m = F.create_map(*(F.lit(x) for k in keys for x in (k, table[k])))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(m, x), x)), "")


def str_pad(c, length: int, pad: str = " ", side: str = "right") -> Column:
    b = as_bytes(c)
    p = F.lit(pad.encode().decode("latin-1"))
    n = F.greatest(F.lit(length), F.length(b))
    if side == "left":
        return as_text(F.lpad(b, n, p))
    if side == "both":
        return as_text(F.rpad(F.lpad(b, F.length(b) + F.floor((n - F.length(b)) / 2).cast("int"), p), n, p))
    return as_text(F.rpad(b, n, p))


def str_repeat(c, n) -> Column:
    return F.repeat(col(c), col(n))


def str_replace(search: str | list[str], to: str | list[str], c) -> Column:
    """Each search string in turn by its replacement (a list's missing ones: nothing)."""
    olds = [search] if isinstance(search, str) else search
    news = [to] * len(olds) if isinstance(to, str) else to + [""] * len(olds)
    out = col(c)
    for a, b in zip(olds, news, strict=False):
        out = F.replace(out, F.lit(a), F.lit(b)) if a else out
    return out


def str_split(c, n: int = 1) -> Column:
    """Pieces of n bytes; one empty piece of an empty string."""
    b = as_bytes(c)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(b) / n).cast("int") - 1, F.lit(0))), lambda i: as_text(F.substr(b, i * n + 1, F.lit(n))))


def _cut(s: Column, start, length) -> Column:
    """Start and length in the runtime's way; null where the start is beyond the end."""
    n = F.length(s)
    a = col(start)
    first = F.when(a >= 0, a).otherwise(F.greatest(n + a, F.lit(0)))
    if length is None:
        last = n
    else:
        m = col(length)
        last = F.when(m >= 0, F.least(first + m, n)).otherwise(n + m)
    return F.when(first < n, F.substr(s, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")))


def substr(c, start, length=None) -> Column:
    return as_text(_cut(as_bytes(c), start, length))


def substr_count(c, needle: str) -> Column:
    return F.regexp_count(col(c), F.lit(f"\\Q{needle}\\E"))


def wordwrap(c, width: int = 75, brk: str = "\n", cut: bool = False) -> Column:
    """Lines of at most width characters, broken at spaces; longer words stay whole unless cut."""
    # A fold over the words keeps the text and the length of its last line.
    parts = F.split(col(c), " ")
    long = lambda w: F.regexp_replace(w, f"(.{{{width}}})(?=.)", "$1" + brk.replace("\\", "\\\\").replace("$", "\\$"))
    words = F.transform(parts, lambda w: F.when(F.length(w) > width, long(w)).otherwise(w)) if cut else parts
    last = lambda w: F.length(F.substring_index(w, brk, -1))
    first = lambda w: F.length(F.substring_index(w, brk, 1))

    def step(a: Column, w: Column) -> Column:
        fits = a.n + 1 + first(w) <= width
        line = F.when(F.contains(w, F.lit(brk)), last(w)).when(fits, a.n + 1 + F.length(w)).otherwise(F.length(w))
        return F.struct(F.concat(a.t, F.when(fits, F.lit(" ")).otherwise(F.lit(brk)), w).alias("t"), line.alias("n"))

    start = F.struct(F.get(words, F.lit(0)).alias("t"), last(F.get(words, F.lit(0))).alias("n"))
    return F.aggregate(F.slice(words, 2, 1 << 30), start, step, lambda a: a.t)


def mb_check_encoding(c) -> Column:
    return F.is_valid_utf8(col(c))


def mb_strlen(c) -> Column:
    return F.char_length(col(c))


mb_strtolower, mb_strtoupper = strtolower, strtoupper


def mb_strpos(c, needle, offset: int = 0) -> Column:
    return F.nullif(F.position(col(needle), col(c), F.lit(offset + 1)), F.lit(0)) - 1


def mb_stripos(c, needle, offset: int = 0) -> Column:
    return mb_strpos(F.lower(col(c)), F.lower(col(needle)), offset)


def mb_substr(c, start, length=None) -> Column:
    return F.coalesce(_cut(col(c), start, length), F.when(col(c).isNotNull(), ""))


def iconv(source: str, target: str, c) -> Column:
    """Bytes of one charset as bytes of another."""
    return F.encode(F.decode(col(c), source), target)


def setlocale(_category: int, name: str) -> Column:
    """Only the C locale is there; any other name gives null."""
    return F.lit(name if name in ("C", "", "0") else None)


NAMES = {
    **{n: globals()[n] for n in "addcslashes addslashes bin2hex chop count_chars hex2bin htmlentities html_entity_decode htmlspecialchars htmlspecialchars_decode lcfirst lcwords levenshtein ltrim mysql_escape_string nl2br number_format printf rtrim setlocale sprintf stripslashes strcasecmp strcmp stripos stristr strlen strncmp strpbrk strpos strrpos strripos strrev strstr strtolower strtoupper strtr str_pad str_repeat str_replace str_split substr substr_count trim ucfirst ucwords wordwrap mb_check_encoding mb_strlen mb_strtolower mb_strtoupper mb_strpos mb_stripos mb_substr iconv".split()},
    "chr": chr_, "ord": ord_,
}
