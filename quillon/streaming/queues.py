"""Event queues, standing queries, presence and counters over streams.

Every transformation takes a batch or a streaming DataFrame alike. ``drain`` runs a stream over all that is there now and
stops; its checkpoint makes a later call go on from that point. Sinks write one folder a micro-batch, so a batch that is
run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.predicate import compiled, words_of
from quillon.sources.scratch import new_path

MOST_WATCHED = 50_000


def follow(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A Parquet table as a stream of its files."""
    return spark.readStream.schema(like.schema).parquet(path + "*")


def drain(stream: DataFrame, folder: str | None = None, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """All that the stream has now, as a table (append), or through a sink of micro-batches (update, complete)."""
    spark = stream.sparkSession
    folder = folder or new_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(sink or keep).start().awaitTermination()
    if sink is not None:
        return None
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)


def published(events: DataFrame, x: str, flag: Column | int, y: str) -> DataFrame:
    """Events that a reader with that flag may see: (x & flag) = y."""
    return events.where(F.col(x).bitwiseAND(F.lit(flag) if isinstance(flag, int) else flag) == F.col(y))


def fanned_out(events: DataFrame, subscriptions: DataFrame, source: str = "source") -> DataFrame:
    """Events of a queue for each queue that follows it; subscriptions (source, target) are a table."""
    return events.join(subscriptions, source).drop(source).withColumnRenamed("target", "queue")


def after(events: DataFrame, positions: DataFrame, key: str, seq: str) -> DataFrame:
    """Events behind each reader's position; positions (key, position)."""
    return events.join(positions, key).where(F.col(seq) > F.col("position")).drop("position")


def expired(events: DataFrame, key: str, time: str, hold: str, late: str = "0 seconds") -> DataFrame:
    """key, began, ended, n of each stretch of events without a pause of ``hold``: when it ends the key is dropped. Streams give stretches that are over."""
    s = events.withWatermark(time, late).groupBy(key, F.session_window(time, hold)).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def watched(docs: DataFrame, watches: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, watch of each text with all words of a watch (watch, words); a watch meets texts over its longest word.

    Up to MOST_WATCHED such words are known to the plan, and a text goes on only for those of them that it has; with more, it does for each of its words.
    """
    rarest = F.get(F.transform(F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x.w), F.lit(0))
    own = watches.select("watch", "words", rarest.alias("_word"))
    known = [r[0] for r in own.select("_word").where("_word IS NOT NULL").distinct().limit(MOST_WATCHED + 1).collect()]
    some = F.filter("_own", lambda w: w.isin(known)) if len(known) <= MOST_WATCHED else F.col("_own")
    tokens = docs.select(key, words_of(F.col(text)).alias("_own")).withColumn("_word", F.explode(some))
    return tokens.join(own, "_word").where(F.forall("words", lambda w: F.array_contains("_own", w))).select(key, "watch")


def sliding_counts(events: DataFrame, keys: list[str], time: str, width: str, step: str, late: str = "0 seconds") -> DataFrame:
    """keys, ended, n: events in each window of that width, one every step."""
    w = events.withWatermark(time, late).groupBy(*keys, F.window(time, width, step)).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("window.end").alias("ended"), "n")


def versions(events: DataFrame, keys: list[str], time: str, shift: str = "0 hours", late: str = "0 seconds") -> DataFrame:
    """keys, version, views: counters by day from a midnight shifted by the time zone; a version doesn't change once it is over."""
    w = events.withWatermark(time, late).groupBy(*keys, F.window(time, "1 day", "1 day", shift)).agg(F.count("*").alias("views"))
    return w.select(*keys, F.col("window.start").alias("version"), "views")


def decayed_sums(events: DataFrame, keys: list[str], value: str, seconds: str, half_life: float, base: int) -> DataFrame:
    """keys, s: increments as of a fixed time base; the value now is s * 2 ** -((now - base) / half_life), whatever order they came in."""
    return events.groupBy(*keys).agg(F.sum(F.col(value) * F.pow(F.lit(2.0), (F.col(seconds) - base) / half_life)).alias("s"))


def latest_sink(spark: SparkSession, keys: list[str], folder: str) -> tuple[Callable[[DataFrame, int], None], Callable[[], DataFrame]]:
    """A sink that keeps the newest row of each key of an updating stream, and a reader of these."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    def read() -> DataFrame:
        rows = spark.read.parquet(f"{folder}/changes").drop("batch")
        rest = [c for c in rows.columns if c not in (*keys, "_batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest))

    return sink, read


def with_pending(base: DataFrame, pending: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """base with operations that came before their keys were there: pending (key, op: set, add or delete, value, order), applied on reading; after the last set or delete only adds count."""
    last = pending.where("op <> 'add'").groupBy(key).agg(F.max_by(F.struct("op", F.col(value).alias("_v")), order).alias("_last"), F.max(order).alias("_at"))
    adds = pending.where("op = 'add'").join(last.select(key, "_at"), key, "left").where(F.col("_at").isNull() | (F.col(order) > F.col("_at"))).groupBy(key).agg(F.sum(value).alias("_more"))
    rows = base.select(key, F.col(value).alias("_old")).join(last, key, "full").join(adds, key, "full")
    start = F.when(F.col("_last").isNull(), F.col("_old")).when(F.col("_last.op") == "set", F.col("_last._v"))
    out = rows.select(key, F.when(start.isNotNull() | F.col("_more").isNotNull(), F.coalesce(start, F.lit(0)) + F.coalesce("_more", F.lit(0))).alias(value))
    return out.where(F.col(value).isNotNull())


def retargeted(users: DataFrame, ads: dict[int, str], today: Column, before: DataFrame | None = None) -> DataFrame:
    """id, ad of the ads whose queries change by the day (ages, birthdays), as of today; with the earlier pairs, only what changed, as change (add or drop)."""
    hits = F.array_compact(F.array(*(F.when(compiled(t, today=today), F.lit(a)) for a, t in ads.items())))
    now = users.select("id", F.explode(hits).alias("ad"))
    if before is None:
        return now
    return now.join(before, ["id", "ad"], "left_anti").withColumn("change", F.lit("add")).unionByName(before.join(now, ["id", "ad"], "left_anti").withColumn("change", F.lit("drop")))
