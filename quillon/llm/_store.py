"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches that Python workers get while a table is written: so many bytes (one row at least).
BATCH_BYTES = 4 << 20

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``. Only a local master gets one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, scan_rows: int = 1024) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors.

    While it is written, scans decode scan_rows rows at a time and Arrow batches hold BATCH_BYTES.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(scan_rows)}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of tables written by this process, for ``forget``."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables and files written since a mark, but those under the paths to keep; nothing that reads them may run later."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for p in [p for p in _written[since:] if p not in keep]:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(p)
