"""Ordered lists: modes, ranks, ranges, and updates as latest-wins tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.predicate import masked


def sorted_list(entries: DataFrame, value: str, tie: str, descending: bool = False, tie_descending: bool = False, flags: str | None = None, xor_mask: int = 0, and_mask: int = 0, limit: int | None = None) -> DataFrame:
    """Entries that pass the flag mask, by value and then by tie."""
    out = entries.where(masked(flags, xor_mask, and_mask)) if flags else entries
    out = out.orderBy(F.desc(value) if descending else F.asc(value), F.desc(tie) if tie_descending else F.asc(tie))
    return out.limit(limit) if limit is not None else out


def retrieve(entries: DataFrame, key: str, by_date: str | None = None, limit: int = 0, offset: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Entries by key, or by date and then key; a negative limit takes them in reverse."""
    order = ([by_date] if by_date else []) + [key]
    out = entries.orderBy(*(F.desc(c) if limit < 0 else F.asc(c) for c in order))
    out = out.offset(offset) if offset else out
    out = out.limit(abs(limit)) if limit else out
    return out.select(*columns) if columns else out


def with_rank(entries: DataFrame, lists: list[str], order: list[str | Column], name: str = "pos") -> DataFrame:
    """entries with their place in their list, from 1."""
    return entries.withColumn(name, F.row_number().over(Window.partitionBy(*lists).orderBy(*order)))


def rank_range(entries: DataFrame, lists: list[str], order: list[str], first: int, last: int) -> DataFrame:
    """Entries from place first to last of each list with pos and size; negative places count from the end; first > last turns the order round; 0 in either gives sizes only."""
    size = Window.partitionBy(*lists)
    if not first or not last:
        return entries.groupBy(*lists).agg(F.count("*").alias("size"))
    df = with_rank(entries, lists, order).withColumn("size", F.count("*").over(size))
    place = lambda x: F.lit(x) if x > 0 else F.col("size") + x + 1
    a, b = place(first), place(last)
    inside = F.col("pos").between(F.least(a, b), F.greatest(a, b))
    return df.where(inside).withColumn("shown", F.when(a <= b, F.col("pos") - a + 1).otherwise(a - F.col("pos") + 1).cast("int"))


def latest(log: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last row of each key, without keys whose last row is a deletion. Rows are reduced before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest))
    return out.where(~F.col(deleted)).drop(deleted) if deleted else out


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], mode: str = "set") -> DataFrame:
    """base with changes of the same columns, unique by keys: set overwrites, add keeps what is there, replace changes only what is there."""
    new, old = changes.select(*base.columns), base
    if mode == "add":
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
    if mode == "replace":
        new = new.join(old.select(*keys), keys, "left_semi")
    elif mode != "set":
        raise ValueError(mode)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def increment(base: DataFrame, deltas: DataFrame, keys: list[str], value: str, create: bool = True) -> DataFrame:
    """keys, value: the base plus all deltas; absent keys are made only with create."""
    d = deltas.groupBy(*keys).agg(F.sum(value).alias("_d"))
    out = base.select(*keys, value).join(d, keys, "full" if create else "left")
    return out.select(*keys, (F.coalesce(F.col(value), F.lit(0)) + F.coalesce(F.col("_d"), F.lit(0))).alias(value))


def change_flags(entries: DataFrame, where: Column, flags: str, and_mask: int, or_mask: int) -> DataFrame:
    """entries with (flags & and_mask) | or_mask where the condition holds."""
    return entries.withColumn(flags, F.when(where, F.col(flags).bitwiseAND(F.lit(and_mask)).bitwiseOR(F.lit(or_mask))).otherwise(F.col(flags)))


def reorder(entries: DataFrame, moved: int, before: int, key: str = "id", pos: str = "pos") -> DataFrame:
    """entries with one moved right before another: its position becomes the middle of the neighbours'. Without that other one nothing moves."""
    place = F.col(pos).cast("double")
    at = entries.where(F.col(key) == before).agg(F.max(place).alias("_at"))
    under = entries.where(F.col(key) != moved).join(F.broadcast(at), place < F.col("_at")).agg(F.max(place).alias("_under"))
    both = at.join(F.broadcast(under)).select(F.coalesce((F.col("_at") + F.col("_under")) / 2, F.col("_at") - 1).alias("_new"))  # one row each
    return entries.join(F.broadcast(both)).withColumn(pos, F.when((F.col(key) == moved) & F.col("_new").isNotNull(), F.col("_new")).otherwise(place)).drop("_new")
