"""Writers: immutable tables replaced as a whole, search databases, and their catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.operators import search_index


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces the table at path by df, which may read that very table: written beside it, then swapped in."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(path), hadoop.Path(f"{path}.new")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def build_search_db(entries: DataFrame, folder: str, name: str, source_type: str) -> DataFrame:
    """Writes entries, their full-text index as one segment, and the build's counts, which it returns."""
    spark, path = entries.sparkSession, f"{folder}/{name}"
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    stored = spark.read.parquet(f"{path}/entries")
    build = uuid.uuid4().hex  # a new build never meets an old one's index
    search_index.append(stored, f"{path}/index-{build}", "build", "entry_id", "search_text", "knowledge_type")
    counts = build_counts(stored)
    counts.withColumns({"database_name": F.lit(name), "source_type": F.lit(source_type), "index": F.lit(f"index-{build}")}).write.mode("overwrite").parquet(f"{path}/meta")
    return spark.read.parquet(f"{path}/meta")


def build_counts(entries: DataFrame) -> DataFrame:
    kind = F.col("knowledge_type")
    return entries.agg(F.count("*").alias("entries"), F.count_if(kind == "qa").alias("qa_entries"), F.count_if(kind == "plain").alias("plain_entries"))


def open_search_db(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """A database's entries and its index written out as postings and stats; open_search_index gives the index as it is stored."""
    index = open_search_index(spark, folder, name)
    return spark.read.parquet(f"{folder}/{name}/entries"), (index.postings().withColumnRenamed("key", "entry_id"), index.stats)


def open_search_index(spark: SparkSession, folder: str, name: str) -> search_index.Index:
    path = f"{folder}/{name}"
    return search_index.open_index(spark, f"{path}/{spark.read.parquet(f'{path}/meta').first()['index']}")


def databases(spark: SparkSession, folder: str, source_type: str | None = None) -> DataFrame:
    """The catalog of built search databases, by name."""
    found = spark.read.parquet(f"{folder}/*/meta")
    return (found.filter(F.col("source_type") == source_type) if source_type else found).orderBy("database_name")
