"""Mailboxes: message search with phrases and filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.predicate import words_of


def search(messages: DataFrame, query: str, where: Column | None = None, last: int | None = None, text: str = "text", order: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Messages with all the query's words and quoted phrases; the last ones by order if last is positive, the first if negative."""
    phrases = re.findall(r'"([^"]+)"', query)
    words = re.findall(r"\w+", query.lower())
    out = messages
    for w in dict.fromkeys(words):
        out = out.where(F.array_contains(words_of(F.col(text)), w))
    for p in phrases:
        out = out.where(F.contains(F.lower(text), F.lit(p.lower())))
    if where is not None:
        out = out.where(where)
    if last:
        out = out.orderBy(*(F.desc(c) if last > 0 else F.asc(c) for c in order)).limit(abs(last))
    return out


def history(changes: DataFrame, owner: int, after: int, limit: int, seq: str = "seq", key: str = "owner") -> DataFrame:
    """The owner's changes with a sequence number above after, oldest first."""
    return changes.where((F.col(key) == owner) & (F.col(seq) > after)).orderBy(seq).limit(limit)
