"""The script runtime's database, cache and request functions over a session and its engines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from quillon.engines.base import Engine


def db_query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def db_query_try(spark: SparkSession, sql: str) -> DataFrame | None:
    """None for a statement that can't be planned."""
    try:
        return spark.sql(sql)
    except PySparkException:
        return None


def db_fetch_row(df: DataFrame) -> Iterator[Row]:
    """Row by row, a partition at a time on the driver."""
    return df.toLocalIterator()


def db_num_rows(df: DataFrame) -> int:
    return df.count()


db_affected_rows = db_num_rows


def _quoted(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int | float) and not isinstance(v, bool) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def db_insert_string(table: str, values: dict) -> str:
    return f"INSERT INTO {table} ({', '.join(values)}) VALUES ({', '.join(map(_quoted, values.values()))})"


def db_update_string(table: str, values: dict, where: str) -> str:
    return f"UPDATE {table} SET {', '.join(f'{k} = {_quoted(v)}' for k, v in values.items())} WHERE {where}"


def memcached_get(cache: Engine, key: str):
    return cache.call("memcache.get", key=key).first()["value"]


rpc_mc_get = memcached_get


def rpc_mc_multiget(cache: Engine, keys: list[str]) -> dict[str, str]:
    """The keys that are there, in one join."""
    rows = cache.spark.createDataFrame(list(enumerate(keys)), "rq long, key string")
    got = cache.batch("memcache.get", rows).where("found").join(rows, "rq").collect()
    return {r["key"]: r["value"] for r in got}


def _ok(df: DataFrame) -> bool:
    return bool(df.first()["ok"])


def memcached_set(cache: Engine, key: str, value: str, flags: int = 0, delay: int = 0) -> bool:
    return _ok(cache.call("memcache.set", key=key, flags=flags, delay=delay, value=value))


def memcached_add(cache: Engine, key: str, value: str, flags: int = 0, delay: int = 0) -> bool:
    return _ok(cache.call("memcache.add", key=key, flags=flags, delay=delay, value=value))


def memcached_replace(cache: Engine, key: str, value: str, flags: int = 0, delay: int = 0) -> bool:
    return _ok(cache.call("memcache.replace", key=key, flags=flags, delay=delay, value=value))


def memcached_increment(cache: Engine, key: str, by: int = 1):
    return cache.call("memcache.incr", key=key, value=by).first()["value"]


def memcached_decrement(cache: Engine, key: str, by: int = 1):
    return cache.call("memcache.decr", key=key, value=by).first()["value"]


def memcached_delete(cache: Engine, key: str) -> bool:
    return _ok(cache.call("memcache.delete", key=key))


def mc_get_stats(cache: Engine) -> dict[str, int]:
    return {name: df.count() for name, df in cache.state.items()}


def rpc_tl_query_one(engine: Engine, operation: str, **arguments) -> DataFrame:
    return engine.call(operation, **arguments)


def rpc_tl_query(engine: Engine, requests: list[tuple[str, dict]]) -> list[DataFrame]:
    """Requests in order, each with its result."""
    return [engine.call(name, **arguments) for name, arguments in requests]


def rpc_tl_query_result_one(result: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in result.collect()]


def rpc_tl_query_result(results: list[DataFrame]) -> list[list[dict]]:
    return [rpc_tl_query_result_one(r) for r in results]
