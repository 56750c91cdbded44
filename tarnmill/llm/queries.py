"""The registered queries of the training-data operators; each reads its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm import chat_format, collocations, decontaminate, exact_chunks, language_id, license_scan, line_dedup, packing, prefix_trie, prob_minhash, suffix_dedup, token_rollup, toxicity
from tarnmill.llm.common import shared_dir, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_chunks.dedup(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "n_items", "contaminated")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents as one batch, revises all of them to collapsed white space as a second, and sends that twice."""
    docs, state = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    tidy = docs.withColumn("text", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    token_rollup.commit_batch(state, "load", token_rollup.images(docs, 1))
    for _ in range(2):
        token_rollup.commit_batch(state, "revise", token_rollup.revisions(docs, tidy))
    return token_rollup.totals(spark, state)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.dedup(table(spark, sf_dir, "documents")).drop("row")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat_format.PROBE).alias("text"))
    return chat_format.read_back(chat_format.render(turns.unionByName(probe)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_exact_dedup, op3_suffix_dedup, op4_toxicity, op5_decontamination, op6_packing, op7_language_id, op8_license_scan, op9_token_counts, op10_minhash_dedup, op11_collocations, op12_prefix_trie, op13_chat_format)}
SQL: dict[str, str] = {"op2_exact_dedup": exact_chunks.SQL, "op11_collocations": collocations.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_chat_format": chat_format.SQL}
