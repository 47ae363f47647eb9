"""Append-only change logs, snapshots and point reads.

A log is a Parquet table of (seq, ts, key, op, payload, crc): seq rises within the log, op is set or delete or any other
word, payload is JSON, crc is crc32 of the row's text. State at a time is the last row of each key up to it; a snapshot is
that state with the position it was taken at, and a start is the snapshot and the tail behind it.
"""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.lists import latest
from quillon.sources.scratch import written

SCHEMA = "seq bigint, ts bigint, key bigint, op string, payload string, crc bigint"
START = "start"


def checksum() -> Column:
    return F.crc32(F.concat_ws("|", F.col("seq").cast("string"), F.col("ts").cast("string"), F.col("key").cast("string"), "op", F.coalesce("payload", F.lit(""))).cast("binary"))


def create(spark: SparkSession, path: str, schema_id: int, mod: int = 1, low: int = 0, high: int = 1) -> None:
    """A fresh log that holds its start record only: what it is a log of, and which share of the keys."""
    row = spark.range(1).select(F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("ts"), F.lit(0).cast("bigint").alias("key"), F.lit(START).alias("op"), F.to_json(F.struct(F.lit(schema_id).alias("schema"), F.lit(mod).alias("mod"), F.lit(low).alias("min"), F.lit(high).alias("max"))).alias("payload"))
    row.withColumn("crc", checksum()).write.mode("errorifexists").parquet(path)


def append(events: DataFrame, path: str) -> None:
    """Rows (seq, ts, key, op, payload) with their checksums; a batch is there as a whole or not at all."""
    rows = events.select("seq", "ts", "key", "op", "payload").withColumn("crc", checksum())
    rows.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def replay(log: DataFrame, cutoff: int | None = None, after: int = -1) -> DataFrame:
    """key, seq, payload of the keys alive after the events behind a position and up to a time."""
    rows = log.where((F.col("op") != START) & (F.col("seq") > after))
    rows = rows.where(F.col("ts") <= cutoff) if cutoff is not None else rows
    out = latest(rows.select("key", "seq", "op", "payload"), ["key"], ["seq"])
    return out.where("op <> 'delete'").select("key", "seq", "payload")


def save(state: DataFrame, path: str) -> None:
    """A snapshot of (key, seq, payload)."""
    state.write.mode("overwrite").parquet(path)


_writers = ThreadPoolExecutor(2)


def save_aside(state: DataFrame, path: str) -> Future:
    """The same while the caller goes on; the result is there when the future is done."""
    return _writers.submit(save, state, path)


def load(spark: SparkSession, path: str, log: DataFrame, position: int, cutoff: int | None = None) -> DataFrame:
    """The snapshot taken at a position, with the log's tail behind it."""
    snapshot = spark.read.parquet(path)
    tail = log.where((F.col("op") != START) & (F.col("seq") > position))
    tail = tail.where(F.col("ts") <= cutoff) if cutoff is not None else tail
    both = snapshot.select("key", "seq", F.lit("set").alias("op"), "payload").unionByName(tail.select("key", "seq", "op", "payload"))
    return latest(both, ["key"], ["seq"]).where("op <> 'delete'").select("key", "seq", "payload")


def owned(df: DataFrame, key: str, mod: int, rest: int) -> DataFrame:
    """Rows of one share of the keys: abs(key) % mod = rest."""
    return df.where(F.pmod(F.abs(F.col(key)), F.lit(mod)) == rest)


def split(log: DataFrame, mod: int, folder: str) -> None:
    """The log as mod logs, one for each share of the keys (folder/part=0 and on); start records go to all."""
    every = F.when(F.col("op") == START, F.sequence(F.lit(0), F.lit(mod - 1))).otherwise(F.array(F.pmod(F.abs("key"), F.lit(mod)).cast("int")))
    log.withColumn("part", F.explode(every)).write.mode("errorifexists").partitionBy("part").parquet(folder)


def merge(logs: list[DataFrame]) -> DataFrame:
    """The events of several logs as one, numbered by time and then by the order given; numbers rise with gaps. Start records stay behind."""
    rows = None
    for i, log in enumerate(logs):
        own = log.where(F.col("op") != START).withColumn("_log", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    ranged = rows.repartitionByRange(max(1, rows.sparkSession.sparkContext.defaultParallelism), "ts", "_log", "seq").sortWithinPartitions("ts", "_log", "seq").withColumn("_p", F.monotonically_increasing_id())
    out = ranged.select(F.col("_p").alias("seq"), "ts", "key", "op", "payload")
    return out.withColumn("crc", checksum())


def placed(merged: DataFrame, place: str = "place") -> DataFrame:
    """A merged log with each event's place from 1 by seq. It is written out once, as seq holds its task and its number there; tasks' sizes then give the places, and no task sorts the whole log."""
    rows = written(merged, "merged")
    task, own = F.expr("shiftright(seq, 33)"), F.expr(f"seq & {(1 << 33) - 1}L")
    sizes = rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))  # one row for each task of the merge
    before = sizes.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_task", task).join(F.broadcast(before), "_task").withColumn(place, F.col("_before") + own + 1).drop("_task", "_before")


def check(log: DataFrame) -> DataFrame:
    """seq, fault of every row that is damaged (crc) or whose number comes twice (seq)."""
    damaged = log.where(~checksum().eqNullSafe(F.col("crc"))).select("seq", F.lit("crc").alias("fault"))
    twice = log.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1").select("seq", F.lit("seq").alias("fault"))
    return damaged.unionByName(twice)


def repair(log: DataFrame) -> DataFrame:
    """The log up to before its first damaged row, as a replay would read it."""
    bad = log.where(~checksum().eqNullSafe(F.col("crc"))).agg(F.min("seq").alias("_bad"))
    return log.join(F.broadcast(bad), F.col("_bad").isNull() | (F.col("seq") < F.col("_bad")), "left_semi")


def pack(log: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """The log in few sorted files, zstd-compressed, so that reads by seq or ts skip most."""
    log.repartitionByRange("seq").sortWithinPartitions("seq").write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(path)


def tag(log: DataFrame) -> DataFrame:
    """One row that names the log: its rows, last number, and a sum over the checksums that doesn't depend on their order."""
    return log.agg(F.count("*").alias("n"), F.max("seq").alias("seq"), F.sum("crc").alias("sum"))


def merge_dumps(dumps: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Partial dumps of shards as one: the values of equal keys added."""
    out = dumps[0]
    for d in dumps[1:]:
        out = out.unionByName(d)
    return out.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def write_keyed(df: DataFrame, key: str, path: str, parts: int = 64) -> None:
    """A table for point reads: folders by a hash of the key, rows sorted by key inside, so that one key costs one small scan."""
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
    df.withColumn("bucket", bucket).repartition(parts, "bucket").sortWithinPartitions(key).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: list, parts: int = 64) -> DataFrame:
    """The rows of some keys: their folders only are read, and of these what the files' statistics let through."""
    buckets = sorted({r[0] for r in spark.createDataFrame([(v,) for v in values], "k bigint").select(F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")).collect()})
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col(key).isin(values)).drop("bucket")


def follow(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The log as a stream; with a checkpoint, a replica goes on from where it was."""
    stream = spark.readStream.schema(SCHEMA)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(path)


def replicate(spark: SparkSession, path: str, target: str, checkpoint: str) -> None:
    """Bring a replica up to what the log holds now; calling again takes only what is new."""
    follow(spark, path).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
