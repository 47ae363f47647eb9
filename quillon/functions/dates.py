"""Dates: seconds since 1970 in a time zone, taken apart and put together without the session's zone."""

from __future__ import annotations

import datetime
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillon.functions.strings import col

DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_zone = ["UTC"]


def date_default_timezone_set(zone: str) -> bool:
    ZoneInfo(zone)
    _zone[0] = zone
    return True


def date_default_timezone_get() -> str:
    return _zone[0]


def use_session_timezone(spark: SparkSession) -> None:
    date_default_timezone_set(spark.conf.get("spark.sql.session.timeZone"))


def _local(ts: Column, zone: str) -> Column:
    """Seconds of the zone's wall clock."""
    return ts if zone == "UTC" else F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))


def _seconds(local: Column, zone: str) -> Column:
    return local if zone == "UTC" else F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


def parts(ts, zone: str | None = None) -> dict[str, Column]:
    """year, mon, mday, hours, minutes, seconds, wday (0: Sunday), yday (from 0), offset (seconds east) and day (a date)."""
    zone = zone or _zone[0]
    t = col(ts).cast("bigint")
    local = _local(t, zone)
    day = F.date_from_unix_date(F.floor(local / 86400).cast("int"))
    rest = F.pmod(local, F.lit(86400))
    return {
        "year": F.year(day), "mon": F.month(day), "mday": F.dayofmonth(day), "hours": F.floor(rest / 3600).cast("int"), "minutes": (F.floor(rest / 60) % 60).cast("int"), "seconds": (rest % 60).cast("int"),
        "wday": F.dayofweek(day) - 1, "yday": F.dayofyear(day) - 1, "offset": (local - t).cast("int"), "day": day,
    }


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _named(names: tuple[str, ...], index: Column, cut: int | None = None) -> Column:
    return F.get(F.array(*(F.lit(n[:cut]) for n in names)), index)


def _offset(seconds: Column, colon: str) -> Column:
    a = F.abs(seconds)
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), _two(F.floor(a / 3600)), F.lit(colon), _two(F.floor(a / 60) % 60))


def _iso(p: dict[str, Column]) -> tuple[Column, Column]:
    """Week of ISO 8601 and its year."""
    return F.weekofyear(p["day"]), F.year(F.date_add(p["day"], 4 - F.when(p["wday"] == 0, 7).otherwise(p["wday"])))


def _letters(ts, zone: str) -> dict[str, Column]:
    p = parts(ts, zone)
    h12 = F.pmod(p["hours"] - 1, F.lit(12)) + 1
    leap = F.dayofyear(F.make_date(p["year"], F.lit(12), F.lit(31))) == 366
    week, week_year = _iso(p)
    clock = lambda a, b, c: F.concat(_two(a), F.lit(":"), _two(b), F.lit(":"), _two(c))
    beat = F.floor(F.pmod(col(ts).cast("bigint") + 3600, F.lit(86400)) / 86.4)
    swatch = F.lpad(beat.cast("string"), 3, "0")
    date = F.concat(F.lpad(p["year"].cast("string"), 4, "0"), F.lit("-"), _two(p["mon"]), F.lit("-"), _two(p["mday"]))
    time = clock(p["hours"], p["minutes"], p["seconds"])
    suffix = F.when(p["mday"].isin(11, 12, 13), "th").otherwise(F.get(F.array(*(F.lit(x) for x in ("th", "st", "nd", "rd", "th", "th", "th", "th", "th", "th"))), p["mday"] % 10))
    out = {
        "d": _two(p["mday"]), "D": _named(DAYS, p["wday"], 3), "j": p["mday"], "l": _named(DAYS, p["wday"]), "N": F.when(p["wday"] == 0, 7).otherwise(p["wday"]), "S": suffix, "w": p["wday"], "z": p["yday"],
        "W": _two(week), "o": week_year, "F": _named(MONTHS, p["mon"] - 1), "m": _two(p["mon"]), "M": _named(MONTHS, p["mon"] - 1, 3), "n": p["mon"], "t": F.dayofmonth(F.last_day(p["day"])), "L": leap.cast("int"),
        "Y": p["year"], "y": _two(F.pmod(p["year"], F.lit(100))), "a": F.when(p["hours"] < 12, "am").otherwise("pm"), "A": F.when(p["hours"] < 12, "AM").otherwise("PM"), "B": swatch, "g": h12, "G": p["hours"], "h": _two(h12),
        "H": _two(p["hours"]), "i": _two(p["minutes"]), "s": _two(p["seconds"]), "u": F.lit("000000"), "e": F.lit(zone), "T": F.lit(zone), "I": F.lit(0), "O": _offset(p["offset"], ""), "P": _offset(p["offset"], ":"), "Z": p["offset"], "U": col(ts).cast("bigint"),
        "c": F.concat(date, F.lit("T"), time, _offset(p["offset"], ":")),
        "r": F.concat(_named(DAYS, p["wday"], 3), F.lit(", "), _two(p["mday"]), F.lit(" "), _named(MONTHS, p["mon"] - 1, 3), F.lit(" "), p["year"].cast("string"), F.lit(" "), time, F.lit(" "), _offset(p["offset"], "")),
    }
    return out | {"_date": date, "_time": time, "_wday": p["wday"], "_yday": p["yday"], "_hour": p["hours"], "_mday": p["mday"]}


def date(fmt: str, ts, zone: str | None = None) -> Column:
    """The runtime's format letters; a backslash takes the next character as it is. I (summer time) is 0."""
    own, out, i = _letters(ts, zone or _zone[0]), [], 0
    while i < len(fmt):
        if fmt[i] == "\\" and i + 1 < len(fmt):
            i += 1
            out.append(F.lit(fmt[i]))
        else:
            out.append(own[fmt[i]].cast("string") if fmt[i] in own else F.lit(fmt[i]))
        i += 1
    return F.concat(*out) if out else F.lit("")


def gmdate(fmt: str, ts) -> Column:
    return date(fmt, ts, "UTC")


def strftime(fmt: str, ts, zone: str | None = None) -> Column:
    own = _letters(ts, zone or _zone[0])
    space = lambda c: F.lpad(c.cast("string"), 2, " ")
    slash = lambda *cs: F.concat(*(x for k, c in enumerate(cs) for x in ([F.lit("/")] if k else []) + [c]))
    monday = F.pmod(own["_wday"] + 6, F.lit(7))
    table = {
        "a": own["D"], "A": own["l"], "d": own["d"], "e": space(own["_mday"]), "j": F.lpad((own["_yday"] + 1).cast("string"), 3, "0"), "u": own["N"], "w": own["w"], "U": _two(F.floor((own["_yday"] + 7 - own["_wday"]) / 7)), "W": _two(F.floor((own["_yday"] + 7 - monday) / 7)),
        "V": own["W"], "G": own["o"], "g": _two(F.pmod(own["o"], F.lit(100))), "b": own["M"], "h": own["M"], "B": own["F"], "m": own["m"], "C": _two(F.floor(own["Y"] / 100)), "y": own["y"], "Y": own["Y"], "H": own["H"], "I": own["h"], "l": space(own["g"]), "k": space(own["_hour"]),
        "M": own["i"], "p": own["A"], "P": own["a"], "S": own["s"], "z": own["O"], "Z": own["T"], "s": own["U"], "n": F.lit("\n"), "t": F.lit("\t"), "%": F.lit("%"), "F": own["_date"], "T": own["_time"], "X": own["_time"], "R": F.concat(own["H"], F.lit(":"), own["i"]),
        "r": F.concat(own["h"], F.lit(":"), own["i"], F.lit(":"), own["s"], F.lit(" "), own["A"]), "D": slash(own["m"], own["d"], own["y"]), "x": slash(own["m"], own["d"], own["y"]),
        "c": F.concat(own["D"], F.lit(" "), own["M"], F.lit(" "), space(own["_mday"]), F.lit(" "), own["_time"], F.lit(" "), own["Y"].cast("string")),
    }
    out = [F.lit("")]
    for m in re.finditer(r"%(.)|([^%]+)|%$", fmt, re.S):
        out.append(F.lit(m[2]) if m[2] else table[m[1]].cast("string") if m[1] in table else F.lit(m[0]))
    return F.concat(*out)


def getdate(ts, zone: str | None = None) -> Column:
    p = parts(ts, zone)
    return F.struct(*(p[k].cast("int").alias(k) for k in ("seconds", "minutes", "hours", "mday", "wday", "mon", "year", "yday")), _named(DAYS, p["wday"]).alias("weekday"), _named(MONTHS, p["mon"] - 1).alias("month"), col(ts).cast("bigint").alias("ts"))


def localtime(ts, zone: str | None = None) -> Column:
    """tm_year counts from 1900, tm_mon from 0; tm_isdst is 0."""
    p = parts(ts, zone)
    names = {"tm_sec": p["seconds"], "tm_min": p["minutes"], "tm_hour": p["hours"], "tm_mday": p["mday"], "tm_mon": p["mon"] - 1, "tm_year": p["year"] - 1900, "tm_wday": p["wday"], "tm_yday": p["yday"], "tm_isdst": F.lit(0)}
    return F.struct(*(c.cast("int").alias(k) for k, c in names.items()))


def mktime(hour, minute, second, month, day, year, zone: str | None = None) -> Column:
    """Seconds since 1970; parts beyond their range carry over."""
    month = col(month).cast("int")
    y = (col(year).cast("int") + F.floor((month - 1) / 12)).cast("int")
    first = F.make_date(y, (F.pmod(month - 1, F.lit(12)) + 1).cast("int"), F.lit(1))
    days = F.unix_date(first).cast("bigint") + col(day).cast("bigint") - 1
    return _seconds(days * 86400 + col(hour).cast("bigint") * 3600 + col(minute).cast("bigint") * 60 + col(second).cast("bigint"), zone or _zone[0])


def gmmktime(hour, minute, second, month, day, year) -> Column:
    return mktime(hour, minute, second, month, day, year, "UTC")


def checkdate(month, day, year) -> Column:
    m, d, y = (col(x).cast("int") for x in (month, day, year))
    length = F.dayofmonth(F.last_day(F.make_date(F.when((y >= 1) & (y <= 32767), y).otherwise(1), F.when((m >= 1) & (m <= 12), m).otherwise(1), F.lit(1))))
    return (m >= 1) & (m <= 12) & (y >= 1) & (y <= 32767) & (d >= 1) & (d <= length)


def time() -> Column:
    return F.unix_timestamp()


def microtime(as_float: bool = True) -> Column:
    micros = F.unix_micros(F.current_timestamp())
    return micros / 1e6 if as_float else F.concat(F.format_string("%.8f", (micros % 1_000_000) / 1e6), F.lit(" "), F.floor(micros / 1_000_000).cast("string"))


_ABSOLUTE = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%m/%d/%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%a, %d %b %Y %H:%M:%S", "%Y%m%dT%H%M%S", "%Y%m%d")
_UNIT = {"sec": 1, "second": 1, "min": 60, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "fortnight": 1209600}


def parse_time(text: str | None, now: int, zone: str = "UTC") -> int | None:
    """Seconds of an absolute date, ``@n``, or words relative to now: now, today, midnight, noon, tomorrow, yesterday, +n unit, last/next unit or weekday, n unit ago."""
    if text is None:
        return None
    tz, t = ZoneInfo(zone), text.strip()
    if re.fullmatch(r"@-?\d+", t):
        return int(t[1:])
    offset = re.search(r"(?<=[0-9 ])(Z|UTC|GMT|[+-]\d\d:?\d\d)$", t)
    if offset and re.search(r"\d{4}.*\d:\d\d", t):
        t = t[: offset.start()].strip()
    for f in _ABSOLUTE if re.search(r"\d{4}", t) else ():
        try:
            at = datetime.datetime.strptime(t, f)
        except ValueError:
            continue
        if offset and "%H" in f:
            o = offset[1].replace(":", "")
            east = 0 if o in ("Z", "UTC", "GMT") else (int(o[1:3]) * 60 + int(o[3:])) * (60 if o[0] == "+" else -60)
            return int(at.replace(tzinfo=datetime.UTC).timestamp()) - east
        return int(at.replace(tzinfo=tz).timestamp())
    at = datetime.datetime.fromtimestamp(now, tz).replace(tzinfo=None)
    rest = t.lower()
    day = lambda d: d.replace(hour=0, minute=0, second=0)

    def months(d: datetime.datetime, n: int) -> datetime.datetime:
        m = d.year * 12 + d.month - 1 + n
        return d.replace(year=m // 12, month=m % 12 + 1, day=1) + datetime.timedelta(days=d.day - 1)

    while rest:
        m = re.match(r"\s*(now|today|midnight|noon|tomorrow|yesterday|(?P<n>[+-]?\s*\d+|last|next|this)\s*(?P<u>sec|second|min|minute|hour|day|week|fortnight|month|year)s?(?P<ago>\s+ago)?|(?P<w>last|next|this)?\s*(?P<d>sun|mon|tue|wed|thu|fri|sat)[a-z]*|(?P<h>\d\d?):(?P<m>\d\d)(?::(?P<s>\d\d))?)\s*,?", rest)
        if not m or not m[0].strip():
            return None
        word, rest = m[1], rest[m.end() :]
        if m["u"]:
            n = {"last": -1, "next": 1, "this": 0}.get(m["n"]) if m["n"].isalpha() else int(m["n"].replace(" ", ""))
            n = -n if m["ago"] else n
            at = months(at, n) if m["u"] == "month" else months(at, 12 * n) if m["u"] == "year" else at + datetime.timedelta(seconds=n * _UNIT[m["u"]])
        elif m["d"]:
            k = ("sun", "mon", "tue", "wed", "thu", "fri", "sat").index(m["d"])
            ahead = (k - (at.weekday() + 1)) % 7
            ahead = ahead - 7 if m["w"] == "last" else ahead or 7 if m["w"] == "next" else ahead
            at = day(at) + datetime.timedelta(days=ahead)
        elif m["h"]:
            at = at.replace(hour=int(m["h"]), minute=int(m["m"]), second=int(m["s"] or 0))
        elif word != "now":
            at = day(at) + {"noon": datetime.timedelta(hours=12), "tomorrow": datetime.timedelta(days=1), "yesterday": datetime.timedelta(days=-1)}.get(word, datetime.timedelta())
    return int(at.replace(tzinfo=tz).timestamp())


def strtotime(c, now: int | Column | None = None, zone: str | None = None) -> Column:
    """ISO dates and times stay in Spark expressions; every other form goes through ``parse_time``."""
    zone = zone or _zone[0]
    t = col(c).cast("string")
    at = F.unix_timestamp() if now is None else col(now)
    iso = F.regexp_extract_all(F.regexp_extract(t, r"^\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d(?::\d\d)?)?$", 0), F.lit(r"\d+"), F.lit(0))
    n = lambda i: F.coalesce(F.get(iso, F.lit(i)), F.lit("0"))
    good = (F.size(iso) >= 3) & checkdate(n(1), n(2), n(0)) & (n(3).cast("int") < 24) & (n(4).cast("int") < 60)
    other = F.udf(lambda x, y: parse_time(x, y, zone), "bigint", useArrow=True)
    return F.when(good, mktime(n(3), n(4), n(5), n(1), n(2), n(0), zone)).otherwise(other(F.when(~good, t), at.cast("bigint")))


NAMES = {n: globals()[n] for n in "checkdate date date_default_timezone_set date_default_timezone_get getdate gmdate gmmktime localtime microtime mktime strftime strtotime time".split()}
