"""Patterns, URLs, JSON and other encodings, digests and addresses.

Everything that Spark has stays in Spark expressions; Arrow UDFs do what it hasn't: callbacks over matches, the
serialised form, pack and unpack, dumps, zlib and IPv6.
"""

from __future__ import annotations

import gzip
import hashlib
import ipaddress
import json
import re
import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from quillon.functions.strings import col, let

SLICE = 100


def long_values(f: Callable, kind: str) -> Callable:
    """A UDF of one string or binary column for long values: f of SLICE values at a time, so that a batch is never held as Python objects."""
    made = {"string": pa.string(), "binary": pa.binary()}[kind]

    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array([f(x.as_py()) for x in values.slice(i, SLICE)], made) for i in range(0, len(values), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], made)

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR)


# Patterns, written /pattern/flags as in the runtime or bare


def pattern_of(text: str) -> str:
    """A delimited pattern with flags i m s x u as a bare one."""
    pairs = {"(": ")", "{": "}", "[": "]", "<": ">"}
    if len(text) > 1 and not text[0].isalnum() and text[0] not in "\\^$.?*+| " and (end := text.rfind(pairs.get(text[0], text[0]))) > 0 and re.fullmatch("[imsxuADU]*", text[end + 1 :]):
        flags = "".join(f for f in text[end + 1 :] if f in "imsx")
        return (f"(?{flags})" if flags else "") + text[1:end]
    return text


def preg_match(pattern: str, c) -> Column:
    """1 or 0."""
    return F.rlike(col(c), F.lit(pattern_of(pattern))).cast("int")


def preg_match_groups(pattern: str, c) -> Column:
    """The first match and its groups; an empty array without a match."""
    p = pattern_of(pattern)
    n = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", p)).groups
    return F.when(F.rlike(col(c), F.lit(p)), F.array(*(F.regexp_extract(col(c), p, i) for i in range(n + 1)))).otherwise(F.array().cast("array<string>"))


def preg_match_all(pattern: str, c, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern_of(pattern)), F.lit(group))


def preg_replace(pattern: str | list[str], to: str | list[str], c) -> Column:
    r"""Matches replaced in turn; \1 and $1 are groups."""
    olds = [pattern] if isinstance(pattern, str) else pattern
    news = [to] * len(olds) if isinstance(to, str) else to + [""] * len(olds)
    out = col(c)
    for a, b in zip(olds, news, strict=False):
        out = F.regexp_replace(out, pattern_of(a), re.sub(r"\\(\d)", r"$\1", b))
    return out


def preg_replace_callback(pattern: str, f: Callable[[list[str]], str], c) -> Column:
    """f takes a match and its groups and returns what stands in its place (Python, by Arrow batches)."""
    p = re.compile(pattern_of(pattern))
    run = long_values(lambda t: None if t is None else p.sub(lambda m: f([m[0], *(g or "" for g in m.groups())]), t), "string")
    return run(col(c).cast("string"))


def preg_split(pattern: str, c, limit: int = -1, no_empty: bool = False) -> Column:
    out = F.split(col(c), pattern_of(pattern), limit if limit > 0 else -1)
    return F.filter(out, lambda x: x != "") if no_empty else out


def preg_quote(c, delimiter: str = "") -> Column:
    extra = re.escape(delimiter) if delimiter else ""
    return F.replace(F.regexp_replace(col(c), r"([.\\+*?\[^\]$(){}=!<>|:\-" + extra + "])", r"\\$1"), F.lit("\0"), F.lit("\\000"))


def preg_last_error() -> Column:
    """Always 0: a bad pattern fails the query instead."""
    return F.lit(0)


# URLs


def base64_encode(c) -> Column:
    return F.base64(F.encode(col(c), "UTF-8") if not isinstance(c, bytes) else col(c))


def base64_decode(c) -> Column:
    return F.unbase64(col(c))


def urlencode(c) -> Column:
    """As a form: a space is +, and * is written out."""
    return F.replace(F.url_encode(col(c)), F.lit("*"), F.lit("%2A"))


def rawurlencode(c) -> Column:
    return F.replace(F.replace(urlencode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


def urldecode(c) -> Column:
    """A percent sign that starts no code stays."""
    return F.url_decode(F.regexp_replace(col(c), "%(?![0-9A-Fa-f]{2})", "%25"))


def rawurldecode(c) -> Column:
    return urldecode(F.replace(col(c), F.lit("+"), F.lit("%2B")))


def http_build_query(m) -> Column:
    return F.array_join(F.transform(F.map_entries(col(m)), lambda e: F.concat(urlencode(e.key.cast("string")), F.lit("="), urlencode(e.value.cast("string")))), "&")


def parse_str(c) -> Column:
    """A query as a map; of equal names the last counts, and a name without = has an empty value."""
    parts = F.filter(F.split(col(c), "&"), lambda x: x != "")
    value = lambda x: F.when(F.contains(x, F.lit("=")), urldecode(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("")
    pairs = F.transform(parts, lambda x: F.struct(urldecode(F.substring_index(x, "=", 1)).alias("key"), value(x).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.lit(1 << 30)), lambda q: q.key == p.key)))


_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:([^:@/?#]*)(?::([^@/?#]*))?@)?([^:/?#]*)(?::(\d+))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def parse_url(c, part: str | None = None) -> Column:
    """scheme, user, pass, host, port, path, query, fragment: as a struct, or one of them; what is missing is null."""
    names = ("scheme", "user", "pass", "host", "port", "path", "query", "fragment")
    pick = lambda i: F.nullif(F.regexp_extract(col(c), _URL, i + 1), F.lit(""))
    if part is not None:
        out = pick(names.index(part))
        return out.cast("int") if part == "port" else out
    return F.struct(*((pick(i).cast("int") if n == "port" else pick(i)).alias(n) for i, n in enumerate(names)))


# JSON, the serialised form and dumps


def json_encode(c) -> Column:
    """Any column; nulls stay."""
    whole = F.to_json(F.struct(col(c).alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_replace(whole, r'(?s)^\{"v":(.*)\}$', "$1")


def json_decode(c, schema: str | None = None) -> Column:
    """By a schema, else as VARIANT; null for what isn't JSON."""
    return F.from_json(col(c), schema) if schema else F.try_parse_json(col(c))


def _plain(x):
    """Rows and arrays as dicts and lists."""
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list | tuple) else x


def serialized(x) -> str:
    """The serialised form: N; b: i: d: s: (length in bytes) a: (keys and values)."""
    if x is None:
        return "N;"
    if isinstance(x, bool):
        return f"b:{int(x)};"
    if isinstance(x, int):
        return f"i:{x};"
    if isinstance(x, float):
        return f"d:{int(x) if x == int(x) and abs(x) < 1e15 else repr(x)};"
    if isinstance(x, str):
        return f's:{len(x.encode())}:"{x}";'
    pairs = list(x.items()) if isinstance(x, dict) else list(enumerate(x))
    return f"a:{len(pairs)}:{{" + "".join(serialized(k) + serialized(v) for k, v in pairs) + "}"


def unserialized(text: str):
    """The value of a serialised form; ValueError if it isn't one. Arrays with keys 0 to n - 1 are lists."""
    raw = text.encode()

    def value(at: int):
        kind = raw[at : at + 2]
        if kind == b"N;":
            return None, at + 2
        end = raw.index(b":" if kind in (b"s:", b"a:") else b";", at + 2)
        head = raw[at + 2 : end]
        if kind == b"b:":
            return head == b"1", end + 1
        if kind == b"i:":
            return int(head), end + 1
        if kind == b"d:":
            return float(head), end + 1
        if kind == b"s:":
            stop = end + 2 + int(head)
            if raw[end + 1 : end + 2] != b'"' or raw[stop : stop + 2] != b'";':
                raise ValueError("a string's length is wrong")
            return raw[end + 2 : stop].decode(), stop + 2
        if kind != b"a:":
            raise ValueError(f"unknown kind at {at}")
        at, pairs = end + 2, []
        for _ in range(int(head)):
            k, at = value(at)
            v, at = value(at)
            pairs.append((k, v))
        if raw[at : at + 1] != b"}":
            raise ValueError("an array doesn't end")
        whole = [k for k, _ in pairs] == list(range(len(pairs)))
        return [v for _, v in pairs] if whole else dict(pairs), at + 1

    out, at = value(0)
    if at != len(raw):
        raise ValueError("more follows")
    return out


def printed(x, indent: int = 0) -> str:
    """A value in print_r's layout."""
    if isinstance(x, dict | list):
        pad = " " * indent
        pairs = x.items() if isinstance(x, dict) else enumerate(x)
        return f"Array\n{pad}(\n" + "".join(f"{pad}    [{k}] => {printed(v, indent + 8)}\n" for k, v in pairs) + f"{pad})\n"
    return "" if x is None or x is False else "1" if x is True else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)


def dumped(x, indent: int = 0) -> str:
    """A value in var_dump's layout."""
    pad = " " * indent
    if isinstance(x, dict | list):
        pairs = list(x.items()) if isinstance(x, dict) else list(enumerate(x))
        return f"{pad}array({len(pairs)}) {{\n" + "".join(f"{pad}  [{k if isinstance(k, int) else json.dumps(k)}]=>\n{dumped(v, indent + 2)}" for k, v in pairs) + f"{pad}}}\n"
    if x is None:
        return f"{pad}NULL\n"
    if isinstance(x, bool):
        return f"{pad}bool({'true' if x else 'false'})\n"
    if isinstance(x, int):
        return f"{pad}int({x})\n"
    if isinstance(x, float):
        return f"{pad}float({int(x) if x == int(x) else x!r})\n"
    return f'{pad}string({len(x.encode())}) "{x}"\n'


def _of(f: Callable, kind: str = "string"):
    return lambda c: F.udf(lambda x: f(_plain(x)), kind, useArrow=True)(col(c))


def _json_of_serialized(x):
    try:
        return None if x is None else json.dumps(unserialized(x), ensure_ascii=False)
    except (ValueError, IndexError):
        return None


serialize, print_r, var_dump = _of(serialized), _of(printed), _of(dumped)
#: The value as JSON text (for from_json or parse_json); null for what isn't in the serialised form.
unserialize = _of(_json_of_serialized)

# pack and unpack

_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "v": "<H", "n": ">H", "i": "i", "I": "I", "l": "i", "L": "I", "N": ">I", "V": "<I", "q": "q", "Q": "Q", "P": "<Q", "J": ">Q", "f": "f", "d": "d"}


def packed(fmt: str, *args) -> bytes:
    out, rest = b"", list(args)
    for code, count in re.findall(r"([A-Za-z@])(\d+|\*)?", fmt):
        if code in "aAZ":
            raw = rest.pop(0)
            raw = raw if isinstance(raw, bytes | bytearray) else str(raw).encode()
            n = len(raw) + (code == "Z") if count == "*" else int(count or 1)
            raw = raw[: n - 1] if code == "Z" else raw[:n]
            out += bytes(raw).ljust(n, b" " if code == "A" else b"\0")
        elif code in "hH":
            digits = rest.pop(0)
            digits = digits[: len(digits) if count == "*" else int(count or 1)]
            digits += "0" * (len(digits) % 2)
            pairs = [digits[i : i + 2] for i in range(0, len(digits), 2)]
            out += bytes(int(p if code == "H" else p[::-1], 16) for p in pairs)
        elif code == "x":
            out += b"\0" * int(count or 1)
        elif code in _CODES:
            c = _CODES[code] if _CODES[code][0] in "<>" else "<" + _CODES[code]
            for _ in range(len(rest) if count == "*" else int(count or 1)):
                v = rest.pop(0)
                if code not in "fd":
                    bits = 8 * struct.calcsize(c)
                    v = int(v) & ((1 << bits) - 1)
                    v = v - (1 << bits) if c[-1].islower() and v >> (bits - 1) else v
                out += struct.pack(c, v)
        else:
            raise ValueError(f"no code {code!r}")
    return out


def unpacked(fmt: str, raw: bytes) -> dict[str, object]:
    out, at = {}, 0
    for part in fmt.split("/"):
        code, count, name = re.fullmatch(r"([A-Za-z@])(\d+|\*)?(.*)", part).groups()
        if code in "aAZ":
            n = len(raw) - at if count == "*" else int(count or 1)
            piece = raw[at : at + n]
            piece = piece.rstrip(b" \t\r\n\0") if code == "A" else piece.split(b"\0")[0] if code == "Z" else piece
            out[name or "1"] = piece.decode("latin-1")
            at += n
        elif code in "hH":
            n = 2 * (len(raw) - at) if count == "*" else int(count or 1)
            digits = "".join(f"{b:02x}" if code == "H" else f"{b:02x}"[::-1] for b in raw[at : at + (n + 1) // 2])
            out[name or "1"] = digits[:n]
            at += (n + 1) // 2
        elif code == "x":
            at += int(count or 1)
        else:
            c = _CODES[code] if _CODES[code][0] in "<>" else "<" + _CODES[code]
            size = struct.calcsize(c)
            n = (len(raw) - at) // size if count == "*" else int(count or 1)
            for i in range(n):
                out[f"{name}{i + 1}" if n > 1 or count or not name else name] = struct.unpack_from(c, raw, at)[0]
                at += size
    return out


def pack(fmt: str, *args) -> Column:
    """Binary value; numbers without an order are little-endian."""
    return F.udf(lambda *x: None if any(v is None for v in x) else packed(fmt, *x), "binary", useArrow=True)(*map(col, args))


def unpack(fmt: str, c) -> Column:
    """A map of names to values, as JSON text of each."""
    run = F.udf(lambda x: None if x is None else {k: v if isinstance(v, str) else json.dumps(v) for k, v in unpacked(fmt, bytes(x)).items()}, "map<string,string>", useArrow=True)
    return run(col(c).cast("binary"))


# Compression


def _bytes(f: Callable[[bytes], bytes]):
    def run(x):
        try:
            return None if x is None else f(bytes(x))
        except (zlib.error, OSError, EOFError):
            return None

    return lambda c: long_values(run, "binary")(col(c).cast("binary"))


def gzcompress(c, level: int = -1) -> Column:
    return _bytes(lambda x: zlib.compress(x, level))(c)


def gzencode(c, level: int = 9) -> Column:
    return _bytes(lambda x: gzip.compress(x, level, mtime=0))(c)


gzuncompress, gzdecode = _bytes(zlib.decompress), _bytes(gzip.decompress)

# Digests

_SHA2 = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}


def hash_algos() -> list[str]:
    return ["md5", "sha1", *_SHA2, "crc32b"]


def hash_(algorithm: str, c) -> Column:
    b = col(c).cast("binary")
    if algorithm in _SHA2:
        return F.sha2(b, _SHA2[algorithm])
    return {"md5": lambda: F.md5(b), "sha1": lambda: F.sha1(b), "crc32b": lambda: F.lpad(F.lower(F.hex(F.crc32(b))), 8, "0")}[algorithm]()


def hash_hmac(algorithm: str, c, key: str | bytes) -> Column:
    """HMAC with a constant key, in Spark expressions."""
    raw = key.encode() if isinstance(key, str) else key
    block = 128 if algorithm in ("sha384", "sha512") else 64
    raw = (hashlib.new(algorithm, raw).digest() if len(raw) > block else raw).ljust(block, b"\0")
    inner, outer = (F.lit(bytearray(x ^ k for x in raw)) for k in (0x36, 0x5C))
    return hash_(algorithm, F.concat(outer, F.unhex(hash_(algorithm, F.concat(inner, col(c).cast("binary"))))))


def md5(c) -> Column:
    return F.md5(col(c).cast("binary"))


def sha1(c) -> Column:
    return F.sha1(col(c).cast("binary"))


def crc32(c) -> Column:
    return F.crc32(col(c).cast("binary"))


# Addresses


def ip2ulong(c) -> Column:
    """The address as a whole number; null for what isn't four numbers under 256."""
    n = F.transform(F.split(F.when(F.rlike(col(c), F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")), col(c)), r"\."), lambda x: x.cast("bigint"))
    return F.when(~F.exists(n, lambda x: x > 255), F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x))


def ip2long(c) -> Column:
    """The same as a signed 32-bit number."""
    return let(ip2ulong(c), lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x))


def long2ip(c) -> Column:
    x = col(c).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.concat_ws(".", *(F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def inet_pton(c) -> Column:
    """4 or 16 bytes of an address; null for what isn't one."""

    def run(x):
        try:
            return None if x is None else ipaddress.ip_address(x).packed
        except ValueError:
            return None

    return F.udf(run, "binary", useArrow=True)(col(c))


# Typed values of requests


def _store(code: str):
    return lambda c: pack(code, c)


store_int, store_long, store_double = _store("l"), _store("q"), _store("d")


def stored_string(x: bytes) -> bytes:
    """Length, bytes and zeros up to a multiple of four: one byte of length under 254, else 254 and three bytes."""
    head = bytes([len(x)]) if len(x) < 254 else b"\xfe" + len(x).to_bytes(3, "little")
    return (head + x).ljust(-(-(len(head) + len(x)) // 4) * 4, b"\0")


def store_string(c) -> Column:
    return _bytes(stored_string)(c)


def fetch_int(c, at: int = 0) -> Column:
    return _fetch(c, at, 4).cast("int")


def fetch_long(c, at: int = 0) -> Column:
    return _fetch(c, at, 8)


def _fetch(c, at: int, size: int) -> Column:
    """Little-endian bytes as a signed number."""
    h = F.hex(F.substring(col(c), at + 1, size))
    turned = F.concat(*(F.substring(h, 2 * (size - 1 - i) + 1, 2) for i in range(size)))
    n = F.conv(turned, 16, -10).cast("bigint") if size == 8 else F.conv(turned, 16, 10).cast("bigint")
    n = n if size == 8 else F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)
    return F.when(F.octet_length(col(c)) >= at + size, n)


def fetch_double(c, at: int = 0) -> Column:
    return F.udf(lambda x: None if x is None or len(x) < at + 8 else struct.unpack_from("<d", bytes(x), at)[0], "double", useArrow=True)(col(c))


def fetch_string(c, at: int = 0) -> Column:
    def run(x):
        if x is None or len(x) <= at:
            return None
        x = bytes(x)[at:]
        begin, n = (1, x[0]) if x[0] < 254 else (4, int.from_bytes(x[1:4], "little"))
        return x[begin : begin + n].decode("utf-8", "replace")

    return F.udf(run, "string", useArrow=True)(col(c))


NAMES = {
    **{n: globals()[n] for n in "preg_match preg_match_all preg_replace preg_replace_callback preg_split preg_quote preg_last_error base64_decode base64_encode http_build_query parse_str parse_url rawurldecode rawurlencode urldecode urlencode serialize unserialize json_encode json_decode print_r var_dump pack unpack gzcompress gzuncompress gzencode gzdecode hash_algos hash_hmac sha1 md5 crc32 ip2long ip2ulong long2ip inet_pton fetch_int fetch_long fetch_double fetch_string store_int store_long store_double store_string".split()},
    "hash": hash_,
}
