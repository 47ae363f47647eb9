"""Engines with typed operations over keyed tables.

An engine holds its state as DataFrames (``Table``: columns, keys, defaults). An operation takes a batch of requests, a
DataFrame with a column for each argument and ``rq``, the request's number (unique, and the order within the batch), and
gives a DataFrame of (rq, result columns). A single call is a batch of one row. Writes replace the engine's tables by new
ones, so whole batches are joins and aggregations on keys: nothing goes through the driver, and requests on one key
meet there in order. The kinds of writes below read the table once; after CUT of these (others count DEEP times) it is written out
in the shared folder, which cuts its lineage; ``save`` writes a snapshot of all tables.

Types of arguments: int, long, double, string, bool, ints, longs, strings (arrays). Other Spark types may be written out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.sources.scratch import written

CUT, DEEP = 8, 3
TYPES = {"bool": "boolean", "ints": "array<int>", "longs": "array<bigint>", "strings": "array<string>"}


def spark_type(name: str) -> str:
    return TYPES.get(name, name)


class Table(NamedTuple):
    """columns: ``name type, ...``; keys: names of the key columns."""

    columns: str
    keys: tuple[str, ...]
    defaults: dict[str, object] = {}


class Operation(NamedTuple):
    name: str
    arguments: dict[str, str]
    run: Callable[[Engine, DataFrame], DataFrame]
    doc: str


class Engine:
    """tables: name -> Table. Subclasses fill ``operations`` by ``op``."""

    tables: dict[str, Table] = {}
    operations: dict[str, Operation] = {}

    def __init__(self, spark: SparkSession, state: dict[str, DataFrame] | None = None, now: int = 0):
        self.spark, self.now, self.state, self.depth = spark, now, {}, {}
        for name, t in self.tables.items():
            schema = StructType.fromDDL(t.columns)
            given = (state or {}).get(name)
            if given is None:
                self.state[name] = spark.range(0).where(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
            else:
                have = set(given.columns)
                self.state[name] = given.select(*((F.col(f.name) if f.name in have else F.lit(t.defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema))

    def batch(self, name: str, requests: DataFrame) -> DataFrame:
        """Results of a batch of requests by rq; a write has taken effect when this returns."""
        o = self.operations[name]
        missing = {"rq", *o.arguments} - set(requests.columns)
        if missing:
            raise TypeError(f"{name}: no {', '.join(sorted(missing))}")
        typed = requests.select(F.col("rq").cast("bigint").alias("rq"), *(F.col(a).cast(spark_type(t)).alias(a) for a, t in o.arguments.items()))
        before = dict(self.state)
        out = o.run(self, typed)
        for table, now in self.state.items():
            if now is not before[table]:
                self.depth[table] = self.depth.get(table, 0) + (1 if getattr(o.run, "once", False) else DEEP)
                if self.depth[table] >= CUT:
                    self.state[table], self.depth[table] = written(now, table), 0
        return out

    def call(self, name: str, **arguments) -> DataFrame:
        """One request."""
        return self.batch(name, self.request(name, 0, **arguments))

    def request(self, name: str, rq: int, /, **arguments) -> DataFrame:
        """A request as a row, for a batch of several."""
        o = self.operations[name]
        if set(arguments) != set(o.arguments):
            raise TypeError(f"{name} takes {', '.join(o.arguments) or 'nothing'}")
        return self.spark.range(1).select(F.lit(rq).cast("bigint").alias("rq"), *(_literal(v, spark_type(o.arguments[a])).alias(a) for a, v in arguments.items()))

    def save(self, folder: str) -> None:
        """Write all tables under the folder and go on from these."""
        for name in self.tables:
            self.state[name].write.mode("overwrite").parquet(f"{folder}/{name}")
            self.state[name] = self.spark.read.schema(StructType.fromDDL(self.tables[name].columns)).parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, now: int = 0) -> Engine:
        return cls(spark, {name: spark.read.schema(StructType.fromDDL(t.columns)).parquet(f"{folder}/{name}") for name, t in cls.tables.items()}, now)


def _literal(v, kind: str) -> Column:
    if isinstance(v, list | tuple):
        return (F.array(*(F.lit(x) for x in v)) if v else F.array()).cast(kind)
    return F.lit(v).cast(kind)


def operations(cls: type[Engine]) -> Callable:
    """``op(name, signature)`` registers a function (engine, requests) -> results; the signature is ``name:type ...``."""
    cls.operations = dict(cls.operations)

    def op(name: str, signature: str, run: Callable | None = None, doc: str = ""):
        arguments = dict(x.split(":", 1) for x in signature.split())

        def keep(f: Callable) -> Callable:
            if name in cls.operations:
                raise ValueError(f"{name} is there already")
            cls.operations[name] = Operation(name, arguments, f, doc or (f.__doc__ or "").strip())
            return f

        return keep(run) if run is not None else keep

    return op


# Kinds of operations. Key arguments have the names of the table's key columns unless ``by`` renames them (argument -> column).


def _keyed(requests: DataFrame, by: dict[str, str] | None) -> DataFrame:
    return requests.withColumnsRenamed(by or {})


def last_of(requests: DataFrame, keys: list[str], pick: Callable = F.max_by) -> DataFrame:
    """The last request of each key (F.min_by: the first); column by column, so that numbers need no sort."""
    rest = [c for c in requests.columns if c not in keys]
    return requests.groupBy(*keys).agg(*(pick(c, "rq").alias(c) for c in rest))


def _once(run: Callable) -> Callable:
    """Marks a write whose new table reads the old one once."""
    run.once = True
    return run


def _asked(q: DataFrame, cols: list[str]) -> DataFrame:
    """The requests on the same columns as one row: _q, an array with the last first."""
    late = lambda a, b: F.when(a["rq"] > b["rq"], -1).when(a["rq"] < b["rq"], 1).otherwise(0)
    return q.groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct(*(c for c in q.columns if c not in cols))), late).alias("_q"))


def _of(name: str, sql: str) -> str:
    """An expression over q_<argument> as one over the fields of a struct."""
    return re.sub(r"\bq_(?=\w)", f"{name}.q_", sql)


def put(table: str, mode: str = "set", by: dict[str, str] | None = None, values: dict[str, Column | str] | None = None, merge: bool = True):
    """set: overwrite or make; add: only make; replace: only overwrite. values: column -> expression over the request (default: the arguments of the same names).

    Columns that the request doesn't have keep what they were (merge) or take their defaults. The result ok is whether the request's key allowed it.
    """

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        t, old = e.tables[table], e.state[table]
        keys = list(t.keys)
        r = _keyed(requests, by)
        r = r.withColumns({c: F.expr(v) if isinstance(v, str) else v for c, v in (values or {}).items()})
        own = [c for c in old.columns if c in r.columns and c not in keys]
        there = old.select(*keys).withColumn("_there", F.lit(True))
        seen = r.select("rq", *keys, *own).join(there, keys, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
        if mode == "add":
            first = seen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("rq")))
            ok = first.select("rq", ((F.col("_n") == 1) & ~F.col("_there")).alias("ok"))
        else:
            ok = seen.select("rq", (F.col("_there") if mode == "replace" else F.lit(True)).alias("ok"))
        new = last_of(r.select("rq", *keys, *own), keys, F.min_by if mode == "add" else F.max_by)
        new = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in own), F.lit(True).alias("_new"))
        rest = [c for c in old.columns if c not in keys]
        default = lambda c: F.lit(t.defaults.get(c)).cast(old.schema[c].dataType)
        held = old.withColumn("_old", F.lit(True)).join(new, keys, "left" if mode == "replace" else "full")
        held = held.withColumn("_new", F.when(F.col("_old").isNull(), True)) if mode == "add" else held
        pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if c in own else F.when(F.col("_old") if merge else F.col("_old") & F.col("_new").isNull(), F.col(c)).otherwise(default(c))
        e.state[table] = held.select(*keys, *(pick(c).cast(old.schema[c].dataType).alias(c) for c in rest)).select(*old.columns)
        return ok

    return _once(run)


def drop(table: str, by: dict[str, str] | None = None, on: list[str] | None = None, where: str | None = None):
    """Remove the rows whose columns ``on`` (default: the keys) are a request's, and for which the condition over row and request (as q) holds; n of each request, rows of several going to the first."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        old = e.state[table]
        cols, keys = on or list(e.tables[table].keys), list(e.tables[table].keys)
        r = _keyed(requests, by)
        q = r.select(*cols, "rq", *(F.col(c).alias(f"q_{c}") for c in r.columns if c not in cols and c != "rq"))
        hit = old.join(q, cols)
        hit = hit.where(F.expr(where)) if where else hit
        gone = hit.groupBy(*keys).agg(F.min("rq").alias("rq"))
        if where:
            fits = F.expr(f"exists(_q, _x -> coalesce({_of('_x', where)}, false))")
            e.state[table] = old.join(_asked(q, cols), cols, "left").where(~F.coalesce(fits, F.lit(False))).select(*old.columns)
        else:
            e.state[table] = old.join(r.select(*cols).distinct(), cols, "left_anti").select(*old.columns)
        return r.select("rq").join(gone.groupBy("rq").agg(F.count("*").alias("n")), "rq", "left").select("rq", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"))

    return _once(run)


def change(table: str, set_: dict[str, str], by: dict[str, str] | None = None, on: list[str] | None = None, where: str | None = None):
    """Rows whose columns ``on`` are a request's (and meet the condition) get new values: column -> expression over the row and q_<argument>; requests on one row apply the last. n rows and ok for each request."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        old = e.state[table]
        cols, keys = on or list(e.tables[table].keys), list(e.tables[table].keys)
        r = _keyed(requests, by)
        q = r.select(*cols, "rq", *(F.col(c).alias(f"q_{c}") for c in r.columns if c not in cols and c != "rq"))
        hit = old.join(q, cols)
        hit = hit.where(F.expr(where)) if where else hit
        count = hit.groupBy("rq").agg(F.count("*").alias("n"))
        if where and "q_" in where:  # the last request that fits the row
            held = old.join(_asked(q, cols), cols, "left").withColumn("_a", F.expr(f"get(filter(_q, _x -> {_of('_x', where)}), 0)")).withColumn("_hit", F.col("_a").isNotNull())
        else:
            held = old.join(last_of(q, cols).select(*cols, F.struct(*(c for c in q.columns if c not in cols)).alias("_a")), cols, "left")
            held = held.withColumn("_hit", F.col("_a").isNotNull() & (F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)))
        e.state[table] = held.select(*(F.when(F.col("_hit"), F.expr(_of("_a", set_[c])).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in old.columns))
        return r.select("rq").join(count, "rq", "left").select("rq", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"))

    return _once(run)


def add_to(table: str, column: str, by: dict[str, str] | None = None, amount: str = "value", create: bool = False, extra: dict[str, str] | None = None):
    """A number plus the amounts of all requests on its key; the value after each request in turn, null where the key isn't there (and isn't made)."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        t, old = e.tables[table], e.state[table]
        keys = list(t.keys)
        r = _keyed(requests, by).withColumn("_d", F.expr(amount))
        kind = old.schema[column].dataType
        base = old.select(*keys, F.coalesce(column, F.lit(0)).alias("_base"))
        so_far = F.sum("_d").over(Window.partitionBy(*keys).orderBy("rq").rowsBetween(Window.unboundedPreceding, 0))
        told = r.withColumn("_sum", so_far).join(base, keys, "left")
        start = F.coalesce("_base", F.lit(0)) if create else F.col("_base")
        out = told.select("rq", (start + F.col("_sum")).cast(kind).alias("value"))
        made = [F.first(F.expr(x)).alias(f"_{c}") for c, x in (extra or {}).items()]
        total = r.groupBy(*keys).agg(F.sum("_d").alias("_t"), *made).withColumn("_hit", F.lit(True))
        joined = old.withColumn("_old", F.lit(True)).join(total, keys, "full" if create else "left")
        default = lambda c: F.col(f"_{c}") if c in (extra or {}) else F.lit(t.defaults.get(c))
        value = lambda c: (F.coalesce(F.col(c), F.lit(0)) + F.coalesce("_t", F.lit(0))) if c == column else F.when(F.col("_old"), F.col(c)).otherwise(default(c))
        e.state[table] = joined.select(*((F.when(F.col("_hit") | F.col(c).isNotNull(), value(c)) if c == column else value(c)).cast(old.schema[c].dataType).alias(c) if c not in keys else F.col(c) for c in old.columns))
        return out

    return _once(run)


def get(table: str, result: dict[str, str] | str, by: dict[str, str] | None = None, where: str | None = None):
    """The row of the request's key: result columns (name -> expression over row and q_<argument>), null where there is none; found."""
    columns = {result: result} if isinstance(result, str) else result

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        keys = list(e.tables[table].keys)
        r = _keyed(requests, by)
        q = r.select(*keys, "rq", *(F.col(c).alias(f"q_{c}") for c in r.columns if c not in keys and c != "rq"))
        rows = e.state[table].withColumn("_found", F.lit(True))
        rows = rows.where(F.expr(where)) if where else rows
        return q.join(rows, keys, "left").select("rq", *(F.when(F.col("_found"), F.expr(x)).alias(n) for n, x in columns.items()), F.coalesce("_found", F.lit(False)).alias("found"))

    return run


def listed(table: str, on: list[str], result: list[str], order: list[Column | str], by: dict[str, str] | None = None, where: str | None = None, limit: str | None = None, offset: str | None = None, total: bool = False, descending: str | None = None):
    """Rows whose columns are a request's, in order (-name: descending) with place pos from 1; limit and offset are expressions over q_<argument> (a limit under 0: from the end; null: all). With total the number of rows before the limit.

    descending: a condition on the request under which the order is turned round.
    """

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        r = _keyed(requests, by)
        q = r.select(*on, "rq", *(F.col(c).alias(f"q_{c}") for c in r.columns if c not in on and c != "rq"))
        rows = e.state[table].join(q, on) if on else e.state[table].join(F.broadcast(q))
        rows = rows.where(F.expr(where)) if where else rows
        cs = [(F.desc(c[1:]) if c[0] == "-" else F.col(c)) if isinstance(c, str) else c for c in order]
        place = F.row_number().over(Window.partitionBy("rq").orderBy(*cs))
        rows = rows.withColumn("pos", place)
        turn = F.lit(False)
        if descending:
            turn = turn | F.coalesce(F.expr(descending), F.lit(False))
        if limit:
            turn = turn | F.coalesce(F.expr(limit) < 0, F.lit(False))
        if descending or limit or total:
            rows = rows.withColumn("total", F.count("*").over(Window.partitionBy("rq")))
            rows = rows.withColumn("pos", F.when(turn, F.col("total") - F.col("pos") + 1).otherwise(F.col("pos")).cast("int"))
        first = F.coalesce(F.expr(offset), F.lit(0)) if offset else F.lit(0)
        if offset:
            rows = rows.where(F.col("pos") > first)
        if limit:
            rows = rows.where(F.expr(limit).isNull() | (F.col("pos") <= first + F.abs(F.expr(limit))))
        return rows.select("rq", "pos", *result, *(["total"] if total else []))

    return run


def counted(table: str, on: list[str], by: dict[str, str] | None = None, where: str | None = None, result: dict[str, str] | None = None):
    """Aggregates (name -> expression; default: n, the number) of the rows whose columns are a request's."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        r = _keyed(requests, by)
        q = r.select(*on, "rq", *(F.col(c).alias(f"q_{c}") for c in r.columns if c not in on and c != "rq"))
        rows = q.join(e.state[table].withColumn("_row", F.lit(True)), on, "left") if on else q.join(e.state[table].withColumn("_row", F.lit(True)), F.lit(True), "left")
        rows = rows.withColumn("_row", F.coalesce(F.col("_row") & F.coalesce(F.expr(where) if where else F.lit(True), F.lit(False)), F.lit(False)))
        aggregates = [F.expr(x).alias(n) for n, x in (result or {}).items()] or [F.count_if("_row").alias("n")]
        return rows.groupBy("rq").agg(*aggregates)

    return run


def bits(table: str, column: str, clear: bool = False, by: dict[str, str] | None = None, amount: str = "flags"):
    """Bits of all requests on a key set (or cleared) in a column; the value afterwards, null where the key isn't there."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        old, keys = e.state[table], list(e.tables[table].keys)
        r = _keyed(requests.withColumn("_bits", F.expr(amount).cast("bigint")), by)
        mask = r.groupBy(*keys).agg(F.bit_or("_bits").alias("_mask"))
        value = F.col(column).cast("bigint")
        new = value.bitwiseAND(F.bitwise_not(F.coalesce("_mask", F.lit(0)))) if clear else F.coalesce(value, F.lit(0)).bitwiseOR(F.coalesce("_mask", F.lit(0)))
        out = old.join(mask, keys, "left").withColumn(column, F.when(F.col("_mask").isNotNull(), new).otherwise(value).cast(old.schema[column].dataType)).select(*old.columns)
        e.state[table] = out
        return r.select("rq", *keys).join(out.select(*keys, F.col(column).alias("value")), keys, "left").select("rq", "value")

    return _once(run)


def first_of(*runs):
    """Several writes for one request, in order; the result is the first's."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        return [f(e, requests) for f in runs][0]

    return run


def constant(**values):
    """The same answer to each request."""

    def run(e: Engine, requests: DataFrame) -> DataFrame:
        return requests.select("rq", *(F.lit(v).alias(k) for k, v in values.items()))

    return run
