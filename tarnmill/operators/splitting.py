"""Texts to records: numbered questions, question and answer blocks, paragraphs, and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.functions import text as T

RECORD = ["record_type", "index", "title", "text", "char_count", "line_count", "question_no", "question", "answer"]


def numbered_lines(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.posexplode(T.lines_of(F.col("text"))).alias("at", "line"))


def with_metrics(records: DataFrame, key: str, most: int) -> DataFrame:
    """Adds lengths and the fields a kind lacks, numbers the records of a document from 0 and keeps the first `most`."""
    order = Window.partitionBy(key).orderBy("block")
    found = records.withColumn("index", (F.row_number().over(order) - 1).cast("int")).filter(F.col("index") < most)
    found = found.withColumns({"char_count": F.length("text"), "line_count": T.line_count(F.col("text"))})
    for name in ("question_no", "question", "answer"):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(None).cast("string"))
    return found


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n")


def split_quiz(docs: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """docs(key, text) as one record for each numbered question; lines before the first make a record of their own."""
    number = F.regexp_extract("line", T.NUMBERED, 1)
    block = F.sum(F.when(number != "", 1).otherwise(0)).over(Window.partitionBy(key).orderBy("at"))
    lines = numbered_lines(docs, key).withColumns({"number": number, "block": block})
    blocks = lines.groupBy(key, "block").agg(joined(F.collect_list(F.struct("at", "line"))).alias("text"), F.max("number").alias("question_no"))
    found = with_metrics(blocks.withColumns({"record_type": F.lit("question_block"), "title": F.col("question_no")}), key, most)
    return found.select(key, *RECORD)


def split_qa(docs: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """docs(key, text) as question and answer records.

    A question marker opens a record if the open one has anything; unmarked lines go on the side that is open, and before
    any marker they are a question.
    """
    order = Window.partitionBy(key).orderBy("at")
    line = F.col("line")
    mark = F.when(line.rlike(T.QUESTION), "q").when(line.rlike(T.ANSWER), "a")
    lines = numbered_lines(docs, key).withColumn("mark", mark)
    lines = lines.withColumns({"block": F.sum(F.when(F.col("mark") == "q", 1).otherwise(0)).over(order), "line": F.when(F.col("mark") == "q", T.strip(F.regexp_replace(line, T.QUESTION, ""))).when(F.col("mark") == "a", T.strip(F.regexp_replace(line, T.ANSWER, ""))).otherwise(line)})
    # A side stays open until the next marker of its block; a block begins with its question marker, or with no marker.
    inside = Window.partitionBy(key, "block").orderBy("at")
    lines = lines.withColumn("side", F.coalesce(F.last("mark", ignorenulls=True).over(inside), F.lit("q")))
    side = lambda s: T.strip(F.coalesce(joined(F.collect_list(F.when(F.col("side") == s, F.struct("at", "line")))), F.lit("")))
    blocks = lines.groupBy(key, "block").agg(side("q").alias("question"), side("a").alias("answer"))
    parts = [F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in (("Q", "question"), ("A", "answer"))]
    found = with_metrics(blocks.withColumns({"text": F.concat_ws("\n", *parts), "record_type": F.lit("qa_block")}), key, most)
    return found.withColumn("title", F.concat(F.lit("qa_"), F.col("index") + 1)).select(key, *RECORD)


def split_paragraphs(docs: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """docs(key, text) as one record for each stretch between blank lines, titled by its first line."""
    parts = F.filter(F.transform(F.split("text", r"(?U)\n\s*\n"), T.strip), lambda x: x != "")
    blocks = docs.select(key, F.posexplode(parts).alias("block", "text"))
    title = F.substring(T.strip(F.substring_index("text", "\n", 1)), 1, 80)
    return with_metrics(blocks.withColumns({"title": title, "record_type": F.lit("paragraph")}), key, most).select(key, *RECORD)


def split_texts(docs: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """Cleans docs(key, text) and splits each text the way its markers ask for."""
    cleaned = docs.select(key, T.clean_text(F.col("text")).alias("text"))
    cleaned = cleaned.withColumn("kind", T.text_kind(F.col("text")))
    out = None
    for kind, split in (("quiz", split_quiz), ("qa", split_qa), ("paragraph", split_paragraphs)):
        part = split(cleaned.filter(F.col("kind") == kind).drop("kind"), key, most)
        out = part if out is None else out.unionByName(part)
    return out


def split_pages(pages: DataFrame, key: str) -> DataFrame:
    """Records (key, page, text, char_count) of extracted pages(key, page, text); a page that failed has empty text."""
    cleaned = T.clean_pdf(F.col("text"))
    return pages.select(key, "page", cleaned.alias("text")).withColumn("char_count", F.length("text"))
