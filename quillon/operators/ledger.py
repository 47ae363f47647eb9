"""Transactions between accounts: declared with their legs, checked, locked, committed or cancelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("declared", "locked", "committed", "cancelled")


def states(events: DataFrame) -> DataFrame:
    """t, state of each transaction after its events (t, seq, op, until): lock holds until a time (null: for good), commit takes a lock, cancel an open one; what isn't allowed changes nothing.

    The fold runs over a transaction's own few events, in order.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "op", "at", "until")))
    start = F.struct(F.lit("none").alias("state"), F.lit(None).cast("bigint").alias("until"))

    def step(a, e):
        held = (a.state == "locked") & (a.until.isNull() | (e.at <= a.until))
        open_ = (a.state == "declared") | (a.state == "locked")
        state = (
            F.when((e.op == "declare") & (a.state == "none"), "declared").when((e.op == "lock") & ((a.state == "declared") | ((a.state == "locked") & ~held)), "locked")
            .when((e.op == "commit") & held, "committed").when((e.op == "cancel") & open_, "cancelled").otherwise(a.state)
        )
        return F.struct(state.alias("state"), F.when((e.op == "lock") & (state == "locked") & ~held, e.until).otherwise(a.until).alias("until"))

    return events.groupBy("t").agg(F.aggregate(rows, start, step, lambda a: a.state).alias("state"))


def balanced(legs: DataFrame) -> DataFrame:
    """t of the transactions whose legs (t, account, currency, amount) add up to zero in every currency."""
    sums = legs.groupBy("t", "currency").agg(F.sum("amount").alias("s"))
    return sums.groupBy("t").agg(F.max((F.abs("s") > 1e-9).cast("int")).alias("off")).where("off = 0").select("t")


def balances(legs: DataFrame, told: DataFrame) -> DataFrame:
    """account, balance, locked: committed amounts, and what locked transactions take from it."""
    rows = legs.join(told, "t")
    return rows.groupBy("account").agg(F.sum(F.when(F.col("state") == "committed", F.col("amount")).otherwise(0)).alias("balance"), F.sum(F.when((F.col("state") == "locked") & (F.col("amount") < 0), -F.col("amount")).otherwise(0)).alias("locked"))


def payable(legs: DataFrame, told: DataFrame) -> DataFrame:
    """t, ok: whether each declared transaction is balanced and every account that pays has enough beyond what is locked."""
    own = told.where("state = 'declared'").select("t")
    money = balances(legs, told)
    poor = legs.join(own, "t").where("amount < 0").join(money, "account", "left").where(F.coalesce(F.col("balance") - F.col("locked"), F.lit(0)) + F.col("amount") < 0).select("t").distinct()
    good = balanced(legs)
    return own.join(good.withColumn("_b", F.lit(True)), "t", "left").join(poor.withColumn("_p", F.lit(True)), "t", "left").select("t", (F.col("_b").isNotNull() & F.col("_p").isNull()).alias("ok"))
