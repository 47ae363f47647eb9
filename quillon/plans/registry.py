"""Name -> query and name -> SQL over the standard tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "l1_event_select"
MODULES = ("events", "predicates", "joins", "aggregates", "ranking", "text", "updates", "script", "requests", "feeds")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        key = name or f.__name__
        if key in _queries:
            raise ValueError(f"{key} is there already")
        _queries[key] = f
        if sql:
            _sql[key] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = 5000) -> DataFrame:
    """A table of narrow rows over tasks of about so many rows: a small file is one task otherwise, however much work a row is."""
    return df.repartition(max(1, -(-df.count() // rows)))


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quillon.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
