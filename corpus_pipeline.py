"""The corpus pipeline: documents to a deduplicated, mixed and encoded training set.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents; the last
one adds token ids. Stages are written as Parquet and read again between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitframe.llm import linededup, minhash, mixing, sentencepiece, toxicity
from bitframe.llm.scratch import forget, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = 80  # percent of five-word shingles that near duplicates share


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with lengths as they are now."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return _documents(toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(~F.col("toxic")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur in others; near copies, which the next stage drops, stay whole."""
    return _documents(linededup.dedup_lines(docs, copies=NEAR, most=50))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of five-word shingles and a similarity of 0.8 or more; documents without an id, too."""
    return minhash.one_each(docs.select(*COLUMNS), threshold=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; texts of several sources go through the flow."""
    return _documents(mixing.mixed(docs, copies=True))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and how many there are."""
    return sentencepiece.encode(docs.select(*COLUMNS), count_col="n_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: SQL can express neither the fitted chain nor the tokenizer; a test holds each stage's rows against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents in ``sf_dir``; what a stage read is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return docs
