"""Stages that turn documents into clean training text.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns the columns of
documents that are there (COLUMNS; others end here); the last returns token ids. Between stages the rows are written as
Parquet in the shared folder and read again, and what a stage wrote for itself is deleted.

Decisions fall row by row: rows of one doc_id with different texts, or without a doc_id, are told apart by the text's
hash. All stages take empty tables, null and empty texts (no toxic word, no set, no window, no secret, no token), very
long texts (never cut) and other columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontam, near_dedup, secret_scan, toxicity
from quillon.llm._store import forget, mark, new_path, stored

#: Stages share the sf_dir's labels and benchmark; nothing is passed between them but rows.
TOXIC_AT = 0.3
NEAR_PERCENT = 80
#: Keys of rows to drop are broadcast up to this number (about 32 bytes each), else joined.
MOST_BROADCAST = 500_000
#: Words that a worker of the last stage remembers: fewer than the operator's own default, as the stages share its workers.
REMEMBERED = (250_000, 120_000)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c) for c in docs.columns if c in COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under TOXIC_AT; trained on all labels of sf_dir within toxicity.TRAIN_ROWS.

    Null and empty texts have the bias alone as their score; without labels of both classes the share of toxic ones decides for all rows.
    """
    corpus, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(corpus, labels, "toxic")
    return _columns(toxicity.score(docs, model, TOXIC_AT).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id (null only if all are), then of the least text hash.

    Of repeated rows (one doc_id or none, one text) one stays. Texts are shuffled once, after copies of a row are dropped.
    """
    keys = ["row_none", "row_id", "text_hash"]
    found = near_dedup.near_duplicates(docs, NEAR_PERCENT).where("stays")
    stays = found.select(F.col("doc_id").isNull().alias("row_none"), F.coalesce("doc_id", F.lit(0)).alias("row_id"), "text_hash").distinct()
    return _columns(near_dedup.row_keys(docs).dropDuplicates(keys).join(stays, keys, "left_semi"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of a benchmark item; each row by its own text."""
    keys = ["row_none", "row_id", "text_hash"]
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = stored(found.select(F.col("doc_id").isNull().alias("row_none"), F.coalesce("doc_id", F.lit(0)).alias("row_id"), "text_hash").distinct(), "contaminated")
    few = bad.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return _columns(near_dedup.row_keys(docs).join(F.broadcast(bad) if few else bad, keys, "left_anti"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by a mark; a null text stays null, and n_chars follows the text."""
    ratios = secret_scan.train(secret_scan.labelled_samples(spark))
    return _columns(secret_scan.redact(docs, ratios).withColumn("n_chars", F.length("text").cast("long")))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids of each row, and whether decoding the ids gives its text back; null and empty texts have no ids."""
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")
    out = bpe.encode(docs.select("doc_id", "text"), path, public.PATTERN, verify="round_trip", remembered=REMEMBERED)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe", to_tokens),
]
#: FTRL training, sketches and merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another; what they wrote on the way is deleted, but for the last one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = mark()
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        forget(spark, begin, (path,))
    return STAGES[-1][1](spark, docs, sf_dir)
