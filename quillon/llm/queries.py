"""One query for each operator, over its whole table, in the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import labelled_samples, report, train

    return report(_table(spark, sf_dir, "documents"), train(labelled_samples(spark)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._labels import held_out
    from .toxicity import score, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 4, 2)), "toxic")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import report

    return report(_table(spark, sf_dir, "documents"))


def op6_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge, labelled_urls, train

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import normalise, read, write

    files = normalise(write(_table(spark, sf_dir, "pages")), spark)
    return read(files, spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._labels import held_out
    from .quality import score, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 3, 1)), "quality")
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_license_scan, op3_bpe, op4_toxicity, op5_decontamination, op6_fingerprint, op6_exact_groups, op7_url_filter, op8_near_dedup, op9_warc, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {}
