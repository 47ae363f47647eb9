"""SELECT over typed event logs, planned as one DataFrame query.

``SELECT [DEFAULT] [LENGTH] [DISTINCT] fields FROM source [WHERE cond[, cond over aggregates]] [LIMIT [T time,] [offset,] rows]
[ORDER BY alias[, ASC|DESC]]``. fields: names, ``*``, ``[expression]``, SUM, COUNT, MIN, MAX, each with ``AS alias``; the grouping is by
the fields that aren't aggregates. source: ``*``, a type, ``field=value`` or ``type, field=value``. Rows come newest first; without LIMIT
all of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.expressions import Parser, Typed, fields_of, tokens, truth

_AGGREGATES = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}


def _clauses(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    t, key = tokens(text), None
    i = 0
    while i < len(t):
        w = t[i].upper()
        if w in ("SELECT", "FROM", "WHERE", "LIMIT", "ORDER"):
            if w in out:
                raise ValueError(f"{w} comes twice")
            key = w
            out[key] = []
            if w == "ORDER":
                i += 1
                if i >= len(t) or t[i].upper() != "BY":
                    raise ValueError("BY is needed after ORDER")
        elif key is None:
            raise ValueError("SELECT is needed")
        else:
            out[key].append(t[i])
        i += 1
    if "SELECT" not in out or "FROM" not in out:
        raise ValueError("SELECT and FROM are needed")
    if "ORDER" in out and "LIMIT" not in out:
        raise ValueError("ORDER BY is allowed only with LIMIT")
    return out


def _split(t: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for x in t:
        depth += (x in "([") - (x in ")]")
        if x == "," and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return [x for x in out if x]


def _source(df: DataFrame, t: list[str]) -> DataFrame:
    for part in _split(t):
        if part == ["*"]:
            continue
        if len(part) == 1:
            df = df.where(F.col("type") == part[0].strip("'\""))
        elif len(part) == 3 and part[1] in ("=", "=="):
            v = part[2]
            df = df.where(F.col(part[0]) == (v[1:-1] if v[0] in "'\"" else int(v)))
        else:
            raise ValueError(f"unexpected {' '.join(part)!r} after FROM")
    return df


def select(events: DataFrame, text: str, now: int | None = None) -> DataFrame:
    """Rows of the query over events, which have columns type (string), time (seconds) and id (the order of equal times)."""
    c = _clauses(text)
    words = list(c["SELECT"])
    flags = set()
    while words and words[0].upper() in ("DEFAULT", "LENGTH", "DISTINCT"):
        flags.add(words.pop(0).upper())
    df = _source(events, c["FROM"])
    fields = fields_of(df)
    if "DEFAULT" in flags:
        fields = {k: Typed(F.coalesce(v.column, F.lit("" if v.kind == "str" else 0)), v.kind) for k, v in fields.items()}
    where = _split(c.get("WHERE", []))
    if where:
        p = Parser(where[0], fields)
        df = df.where(truth(p.expression()))
    rows, offset = None, 0
    if "LIMIT" in c:
        parts = _split(c["LIMIT"])
        if parts and parts[0][0].upper() == "T":
            span = int("".join(parts.pop(0)[1:]))
            start = span if span >= 0 else (int(now) if now is not None else F.unix_timestamp()) + span
            df = df.where(F.col("time") >= start)
        values = [int(p[0]) for p in parts]
        rows = values[-1] if values else None
        offset = values[-2] if len(values) > 1 else 0
    plain: list[tuple[str, Column]] = []
    made: list[tuple[str, Column]] = []
    names: list[str] = []
    for n, item in enumerate(_split(words)):
        alias = None
        if len(item) > 2 and item[-2].upper() == "AS":
            alias, item = item[-1], item[:-2]
        if item == ["*"]:
            for k in events.columns:
                plain.append((k, fields[k].column if k in fields else F.col(k)))
                names.append(k)
            continue
        if item[0].upper() in _AGGREGATES and len(item) > 1 and item[1] == "(":
            inner = item[2:-1]
            if inner == ["*"]:
                value = F.lit(1)
            else:
                x = Parser([x for x in inner if x not in "[]"], fields).expression()
                value = x.column.cast("int") if x.kind == "bool" else x.column
            alias = alias or f"{item[0].lower()}_{n}"
            made.append((alias, _AGGREGATES[item[0].upper()](value)))
        else:
            x = Parser([x for x in item if x not in "[]"], fields).expression()
            alias = alias or (item[0] if len(item) == 1 else f"expr_{n}")
            plain.append((alias, x.column.cast("int") if x.kind == "bool" else x.column))
        names.append(alias)
    used = [k for item in _split(words) for k in item if k in fields]
    if "DEFAULT" not in flags and used:
        df = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in dict.fromkeys(used))))
    if made:
        out = df.groupBy(*(x.alias(k) for k, x in plain)).agg(*(x.alias(k) for k, x in made), F.max("time").alias("_time"), F.max("id").alias("_id")).select(*names, "_time", "_id")
        if len(where) > 1:
            out = out.where(truth(Parser(where[1], fields_of(out)).expression()))
    else:
        out = df.select(*(x.alias(k) for k, x in plain), F.col("time").alias("_time"), F.col("id").alias("_id"))
    if "DISTINCT" in flags:
        out = out.groupBy(*names).agg(F.max("_time").alias("_time"), F.max("_id").alias("_id"))
    if "LENGTH" in flags:
        return (out if rows is None else out.limit(rows)).agg(F.count("*").alias("length"))
    order = [F.desc("_time"), F.desc("_id")]
    if "ORDER" in c:
        parts = _split(c["ORDER"])
        down = len(parts) > 1 and parts[1][0].upper() == "DESC"
        order.insert(0, F.desc(parts[0][0]) if down else F.asc(parts[0][0]))
    out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return (out if rows is None else out.limit(rows)).select(*names)


def type_sizes(events: DataFrame) -> DataFrame:
    """type, n and the oldest time of each type."""
    return events.groupBy("type").agg(F.count("*").alias("n"), F.min("time").alias("oldest"))


def change_color(colors: DataFrame, low: int, high: int, and_mask: int, xor_mask: int) -> DataFrame:
    """colors (value, color) with (color & and_mask) ^ xor_mask on values low to high, at most 65536 of them."""
    if high - low >= 65536:
        raise ValueError("the range is too long")
    return colors.withColumn("color", F.when(F.col("value").between(low, high), F.col("color").bitwiseAND(F.lit(and_mask)).bitwiseXOR(F.lit(xor_mask))).otherwise(F.col("color")))


def with_color(events: DataFrame, field: str, colors: DataFrame) -> DataFrame:
    """events with color, that of the field's value, else 0."""
    return events.join(colors.select(F.col("value").alias(field), "color"), field, "left").withColumn("color", F.coalesce("color", F.lit(0)))


def fields_table(spec: str) -> list[tuple[str, str]]:
    """(field, kind) of a type definition such as ``uid:int,name:string``."""
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\w+)\s*:\s*(int|long|double|string)\s*", part)
        if not m:
            raise ValueError(f"not a field: {part!r}")
        out.append((m[1], m[2]))
    return out
