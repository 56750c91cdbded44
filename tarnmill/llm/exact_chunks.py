"""Exact dedup (2): content-defined chunk recipes, in built-in functions only.

Texts are compared without their ASCII white space. Each normalised text is cut into chunks where its content says so: a
chunk ends after a pair of letters from two fixed classes, once it is long enough, so an insertion moves no cut but its
neighbours'. Chunks are deduplicated first: a dictionary of distinct chunks proves the 64-bit identifiers, and gives
those that two different chunks share a second part. A document is then its ordered list of identifiers, and documents
are grouped by that list: long texts travel once, as chunks that map-side aggregation has already folded.

Null text counts as empty; all empty documents are equal. Of equal rows the one with the most code points in the original
text stays, then the smallest doc_id (null ids last). Rows repeated under one doc_id share that id as keep_id, and each
of them that has the most code points is marked as kept. Extra columns of the input are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import numbered, staged

WHITE = r"[\x20\x09-\x0D]+"


def cut_pattern(least: int = 256, most: int = 2048) -> str:
    """Chunks of `least` to `most` characters that end after a pair drawn from two classes, about one pair in 64.

    The classes take every eighth code point of Latin-1, at two offsets, and for other scripts some runs of letters, which
    the regex engine tests fastest; a chunk without such a pair ends at `most`, or with the text.
    """
    others = r"\x{3b1}-\x{3b4}\x{430}-\x{434}\x{627}-\x{62a}\x{905}-\x{90a}\x{3042}-\x{304a}\x{4e00}-\x{58ff}\x{ac00}-\x{b1ff}"

    def every_eighth(offset: int) -> str:
        return "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x100) if c % 8 == offset) + others

    return f"(?s).{{{least - 2},{most - 2}}}?(?:[{every_eighth(5)}][{every_eighth(4)}])|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def identifier(chunk: Column, bits: int = 64) -> Column:
    """A chunk's proposed identifier; fewer bits make shared ones likely, for tests."""
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_points, text_sha256 and recipe, the list of verified chunk identifiers, for each row of docs(doc_id, text)."""
    chunks = F.regexp_extract_all("norm", F.lit(cut_pattern()), F.lit(0))

    def prepared(rows: DataFrame, *more: str) -> DataFrame:
        text = F.col("text").cast("string")
        base = rows.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("n_points"), normalised(text).alias("norm"))
        return base.select(*more, "doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks, lambda c: identifier(c, bits)).alias("recipe"), "norm")

    distinct = prepared(docs).select(F.explode(chunks).alias("chunk")).select(identifier(F.col("chunk"), bits).alias("id"), "chunk").distinct()
    shared = distinct.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if shared.isEmpty():  # every identifier stands for one chunk
        return prepared(docs).drop("norm")
    # Chunks under a shared identifier are told apart by their own text; both lists together are verified.
    rank = distinct.join(shared, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("chunk")).alias("texts"))
    rows = prepared(numbered(docs, "__row"), "__row").withColumnRenamed("__row", "row")
    ranked = (
        rows.select("row", F.posexplode(chunks).alias("pos", "chunk"))
        .withColumn("id", identifier(F.col("chunk"), bits))
        .join(rank, "id")
        .select("row", F.struct("pos", F.array_position("texts", F.col("chunk")).alias("part")).alias("part"))
    )
    parts = ranked.groupBy("row").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    second = F.coalesce(F.flatten(F.transform("parts", lambda p: F.array(p["pos"].cast("long"), p["part"].cast("long")))), F.array().cast("array<long>"))
    return rows.join(parts, "row", "left").select("doc_id", "n_points", "text_sha256", F.concat("recipe", F.array(F.lit(-1).cast("long")), second).alias("recipe"))


def dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = staged(recipes(docs, bits), "recipes")
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    same = F.col("n_points") == -F.col("best.n")
    return rows.join(groups, "recipe").select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", (same & F.col("doc_id").eqNullSafe(F.col("best.id"))).alias("kept"), "text_sha256"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, min(struct_pack(a := -n_points, b := doc_id)) AS best FROM d GROUP BY norm
)
SELECT d.doc_id, g.best.b AS keep_id, g.group_size, d.doc_id = g.best.b AND d.n_points = -g.best.a AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
