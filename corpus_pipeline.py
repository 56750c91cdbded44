"""From raw documents to training sequences: five stages, each over all rows that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; the
last returns the packed sequences. Null texts and texts without a letter are rejected by the first stage. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm import decontaminate, language_id, line_dedup, packing, prob_minhash
from tarnmill.llm.common import numbered, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; lang becomes the predicted one."""
    named = language_id.predict(docs, language_id.train(docs), COLUMNS)
    return named.filter("not rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document that loses every line goes."""
    found = line_dedup.dedup(docs)
    return found.filter("n_dropped = 0 or text <> ''").select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    rows = numbered(docs, "__row")
    stays = prob_minhash.dedup(rows).filter("kept").select(F.col("row").alias("__row"))
    return rows.join(stays.hint("merge"), "__row", "left_semi").select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a test item, verbatim or edited."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.scan(docs, items).filter("not contaminated").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents into power-of-two sequences of token ids."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
