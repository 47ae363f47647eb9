"""Files of any store that Spark reads, by path; small ones, as a row or a few lines each."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.strings import col


def basename(c, suffix: str = "") -> Column:
    out = F.regexp_extract(col(c), r"([^/]*)/*$", 1)
    return F.when(F.endswith(out, F.lit(suffix)) & (out != suffix), F.substr(out, F.lit(1), F.length(out) - len(suffix))).otherwise(out) if suffix else out


def dirname(c) -> Column:
    """All before the last part; . without a slash, / under the root."""
    bare = F.regexp_replace(col(c), r"(?<=.)/+$", "")
    out = F.regexp_replace(bare, r"/+[^/]*$", "")
    return F.when(~F.contains(bare, F.lit("/")), ".").when(out == "", "/").otherwise(out)


def file(spark: SparkSession, path: str) -> DataFrame:
    """line: the lines of a file or folder, by no order but each file's own."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def file_get_contents(spark: SparkSession, path: str) -> DataFrame:
    """path, content (binary) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def filesize(spark: SparkSession, path: str) -> DataFrame:
    """path, size of each file; contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def md5_file(spark: SparkSession, path: str) -> DataFrame:
    return file_get_contents(spark, path).select("path", F.md5("content").alias("md5"))


def crc32_file(spark: SparkSession, path: str) -> DataFrame:
    return file_get_contents(spark, path).select("path", F.crc32("content").alias("crc32"))


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def file_exists(spark: SparkSession, path: str) -> bool:
    store, at = _store(spark, path)
    return store.exists(at)


def copy(spark: SparkSession, source: str, target: str) -> bool:
    """One file or folder; the bytes go through the driver, so for small files."""
    (a, x), (b, y) = _store(spark, source), _store(spark, target)
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def unlink(spark: SparkSession, path: str) -> bool:
    """Delete one file; never a folder with files in it."""
    store, at = _store(spark, path)
    return store.exists(at) and store.delete(at, False)


def sleep(seconds: float) -> None:
    """On the driver, between queries."""
    time.sleep(seconds)


def usleep(micros: int) -> None:
    time.sleep(micros / 1e6)


def posix_getpid() -> int:
    return os.getpid()


NAMES = {n: globals()[n] for n in "basename dirname file file_get_contents filesize md5_file crc32_file file_exists copy unlink sleep usleep posix_getpid".split()}
