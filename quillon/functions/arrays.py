"""Array functions: lists are Spark arrays, arrays with keys are maps (whose entries keep their order).

Functions that sort or filter keep entries' order and ties as they stood. Callbacks are Python functions from Columns to a
Column, applied inside Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.strings import col

_ALL = 1 << 30


def _entries(m: Column, keep: Callable[[Column], Column]) -> Column:
    return F.map_from_entries(F.filter(F.map_entries(m), keep))


def implode(glue: str, a) -> Column:
    return F.array_join(F.transform(col(a), lambda x: F.coalesce(x.cast("string"), F.lit(""))), glue)


def explode(glue: str, c, limit: int | None = None) -> Column:
    """Pieces between glue; a positive limit leaves the rest in the last piece, a negative one drops that many pieces."""
    pattern = f"\\Q{glue}\\E"
    if limit is None:
        return F.split(col(c), pattern, -1)
    if limit >= 0:
        return F.split(col(c), pattern, max(limit, 1))
    whole = F.split(col(c), pattern, -1)
    return F.slice(whole, F.lit(1), F.greatest(F.size(whole) + limit, F.lit(0)))


def array_chunk(a, n: int) -> Column:
    a = col(a)
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / n).cast("int") - 1, F.lit(0))), lambda _: F.size(a) > 0), lambda i: F.slice(a, i * n + 1, F.lit(n)))


def _bounds(a: Column, offset: int, length: int | None) -> tuple[Column, Column]:
    n = F.size(a)
    first = F.least(F.lit(offset), n) if offset >= 0 else F.greatest(n + offset, F.lit(0))
    last = n if length is None else F.least(first + length, n) if length >= 0 else n + length
    return first, F.greatest(last, first)


def array_slice(a, offset: int, length: int | None = None) -> Column:
    first, last = _bounds(col(a), offset, length)
    return F.slice(col(a), first + 1, last - first)


def array_splice(a, offset: int, length: int | None = None, put=None) -> Column:
    """The array with a part taken out and another put there."""
    a = col(a)
    first, last = _bounds(a, offset, length)
    return F.concat(F.slice(a, F.lit(1), first), *([col(put)] if put is not None else []), F.slice(a, last + 1, F.lit(_ALL)))


def array_filter(a, keep: Callable | None = None) -> Column:
    """Elements that the callback accepts; without one, those that aren't null, 0, false or empty."""
    return F.filter(col(a), keep or (lambda x: x.isNotNull() & ~x.cast("string").isin("", "0", "0.0", "false")))


def array_filter_values(m, keep: Callable) -> Column:
    """The same for a map's values."""
    return F.map_filter(col(m), lambda k, v: keep(v))


def array_map(f: Callable, a) -> Column:
    return F.transform(col(a), f)


def array_merge(*arrays) -> Column:
    return F.concat(*map(col, arrays))


def array_merge_keys(a, b) -> Column:
    """Maps: the second's values win, its new keys follow."""
    a, b = col(a), col(b)
    old = F.transform(F.map_entries(a), lambda e: F.struct(e.key.alias("key"), F.coalesce(F.try_element_at(b, e.key), e.value).alias("value")))
    return F.map_from_entries(F.concat(old, F.filter(F.map_entries(b), lambda e: ~F.map_contains_key(a, e.key))))


def array_intersect_key(a, b) -> Column:
    return F.map_filter(col(a), lambda k, v: F.map_contains_key(col(b), k))


def array_diff_key(a, b) -> Column:
    return F.map_filter(col(a), lambda k, v: ~F.map_contains_key(col(b), k))


def array_intersect(a, b) -> Column:
    """Elements (repeats too) that are in b."""
    return F.filter(col(a), lambda x: F.array_contains(col(b), x))


def array_diff(a, b) -> Column:
    return F.filter(col(a), lambda x: ~F.array_contains(col(b), x))


def array_reverse(a) -> Column:
    return F.reverse(col(a))


def array_shift(a) -> Column:
    """Struct of the first element and the rest."""
    return F.struct(F.get(col(a), F.lit(0)).alias("value"), F.slice(col(a), 2, _ALL).alias("rest"))


def array_pop(a) -> Column:
    a = col(a)
    return F.struct(F.get(a, F.size(a) - 1).alias("value"), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))).alias("rest"))


def array_unshift(a, *values) -> Column:
    return F.concat(F.array(*map(col, values)), col(a))


def array_push(a, *values) -> Column:
    return F.concat(col(a), F.array(*map(col, values)))


def array_key_exists(key, m) -> Column:
    return F.map_contains_key(col(m), col(key))


def array_search(value, a) -> Column:
    """Place of the first equal element, from 0; null if there is none."""
    return F.nullif(F.array_position(col(a), col(value)), F.lit(0)) - 1


def array_search_key(value, m) -> Column:
    return F.get(F.transform(F.filter(F.map_entries(col(m)), lambda e: e.value == col(value)), lambda e: e.key), F.lit(0))


def array_rand(a, seed: int | None = None) -> Column:
    """A place of the array at random; null if it is empty."""
    n = F.size(col(a))
    return F.when(n > 0, F.floor(F.rand(seed) * n).cast("int"))


def array_keys(x, is_map: bool = True) -> Column:
    return F.map_keys(col(x)) if is_map else F.filter(F.sequence(F.lit(0), F.greatest(F.size(col(x)) - 1, F.lit(0))), lambda i: F.size(col(x)) > 0)


def array_values(m) -> Column:
    return F.map_values(col(m))


def array_unique(a) -> Column:
    return F.array_distinct(col(a))


def array_count_values(a) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(col(a)), lambda x: F.struct(x.alias("key"), F.size(F.filter(col(a), lambda y: y == x)).alias("value"))))


def array_flip(m) -> Column:
    """Values to keys; of equal values the last key stays."""
    e = F.map_entries(col(m))
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.lit(_ALL)), lambda y: y.value == x.value))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x.value.alias("key"), x.key.alias("value"))))


def in_array(value, a) -> Column:
    return F.coalesce(F.array_contains(col(a), col(value)), F.lit(False))


def array_fill(start: int, n: int, value) -> Column:
    """A map from start, start + 1 ... to the value."""
    keys = F.sequence(F.lit(start), F.lit(start + n - 1)) if n > 0 else F.array().cast("array<int>")
    return F.map_from_arrays(keys, F.array_repeat(col(value), n))


def array_fill_keys(keys, value) -> Column:
    return F.map_from_arrays(F.array_distinct(col(keys)), F.array_repeat(col(value), F.size(F.array_distinct(col(keys)))))


def array_combine(keys, values) -> Column:
    return F.map_from_arrays(col(keys), col(values))


def range_(low, high, step: int = 1) -> Column:
    """low to high in steps of |step|, downwards where high is less."""
    low, high = col(low), col(high)
    return F.when(low <= high, F.sequence(low, F.greatest(low, high), F.lit(abs(step)))).otherwise(F.sequence(low, F.least(low, high), F.lit(-abs(step))))


def shuffle(a, seed: int | None = None) -> Column:
    return F.shuffle(col(a), seed)


def sort(a) -> Column:
    return F.sort_array(col(a))


def rsort(a) -> Column:
    return F.sort_array(col(a), asc=False)


def usort(a, compare: Callable) -> Column:
    """compare(x, y) gives a negative, zero or positive number."""
    return F.array_sort(col(a), lambda x, y: compare(x, y).cast("int"))


def _by(m: Column, what: str, down: bool) -> Column:
    """Entries by key or value; ties stay in order."""
    place = F.transform(F.map_entries(m), lambda e, i: F.struct(e[what].alias("by"), i.alias("i"), e.alias("e")))
    less = lambda x, y: F.when(x.by < y.by, -1).when(x.by > y.by, 1).otherwise(F.lit(0))
    order = F.array_sort(place, lambda x, y: F.when(less(x, y) != 0, -less(x, y) if down else less(x, y)).otherwise(x.i - y.i))
    return F.map_from_entries(F.transform(order, lambda x: x.e))


def asort(m) -> Column:
    return _by(col(m), "value", False)


def arsort(m) -> Column:
    return _by(col(m), "value", True)


def ksort(m) -> Column:
    return _by(col(m), "key", False)


def krsort(m) -> Column:
    return _by(col(m), "key", True)


def _user(m: Column, what: str, compare: Callable) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m), lambda x, y: compare(x[what], y[what]).cast("int")))


def uasort(m, compare: Callable) -> Column:
    return _user(col(m), "value", compare)


def uksort(m, compare: Callable) -> Column:
    return _user(col(m), "key", compare)


def array_sum(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def get_key_by_pos(m, i) -> Column:
    return F.get(F.map_keys(col(m)), col(i))


def get_value_by_pos(m, i) -> Column:
    return F.get(F.map_values(col(m)), col(i))


def create_vector(n, value) -> Column:
    return F.array_repeat(col(value), col(n))


NAMES = {
    **{n: globals()[n] for n in "implode explode array_chunk array_slice array_splice array_filter array_map array_merge array_intersect_key array_intersect array_diff_key array_diff array_reverse array_shift array_unshift array_key_exists array_search array_rand array_keys array_values array_unique array_count_values array_flip in_array array_fill array_fill_keys array_combine array_push array_pop shuffle sort rsort usort asort arsort uasort ksort krsort uksort array_sum create_vector".split()},
    "range": range_, "getKeyByPos": get_key_by_pos, "getValueByPos": get_value_by_pos,
}
