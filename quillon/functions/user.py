"""User code in queries: formulas and callbacks as Columns, scalar, aggregate and table functions by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.expressions import compiled


def formula(df: DataFrame, text: str) -> Column:
    """An expression in the event language over df's columns, with no Python behind it."""
    return compiled(df, text).column


def rating(weights: list[tuple[str, float]]) -> Column:
    """A user's own rating: a weighted sum of columns."""
    out = F.lit(0.0)
    for c, w in weights:
        out = out + F.col(c) * w
    return out


def register_scalar(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """A Python function of values as an SQL function; values come in Arrow batches."""
    spark.udf.register(name, F.udf(f, returns, useArrow=True))


def register_sql(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A function whose body is SQL: planned into its callers."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def register_aggregate(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """f takes a group's values as a pandas Series; a group must fit a worker, so built-in aggregates come first."""
    import pandas as pd

    def run(v):
        return f(v)

    run.__annotations__ = {"v": pd.Series, "return": float}
    spark.udf.register(name, F.pandas_udf(run, returns))


def register_table(spark: SparkSession, name: str, f: Callable[..., Iterator[tuple]], returns: str) -> None:
    """f yields rows for its arguments; FROM name(..) or LATERAL name(..)."""

    class Rows:
        def eval(self, *args):
            yield from f(*args)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))
