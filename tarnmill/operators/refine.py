"""From generated items to search entries: cleansing, vectors, entries, and the order of the phases."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tarnmill.functions import text as T
from tarnmill.functions import vectors as V
from tarnmill.operators import retrieval

#: The phase that each step needs, and the one that it leaves (fixed values).
STEPS = {"cleanse": (("new", "ready", "done"), "cleansed"), "vectorize": (("cleansed",), "vectorized"), "deduplicate": (("vectorized",), "deduplicated"), "build": (("deduplicated",), "built")}


def next_phase(step: str, phase: str) -> str:
    needed, after = STEPS[step]
    if phase not in needed:
        raise ValueError(f"{step} needs one of {needed}, not {phase}")
    return after


def cleanse(items: DataFrame) -> DataFrame:
    """Adds question_normalize, answer_normalize and content_normalize: collapsed, null where empty."""
    return items.withColumns({f"{c}_normalize": F.nullif(T.collapse(F.col(c)), F.lit("")) for c in ("question", "answer", "content")})


def vectorize(items: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]]) -> DataFrame:
    """Adds question_vector, answer_vector and content_vector by an embedder that takes a list of texts; null stays null."""
    names = ("question", "answer", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, labels = list(batch.columns), list(batch.schema.names)
            for name in names:
                texts = batch.column(f"{name}_normalize").to_pylist()
                found = iter(embed([t for t in texts if t]))
                columns.append(pa.array([[float(x) for x in next(found)] if t else None for t in texts], pa.list_(pa.float64())))
                labels.append(f"{name}_vector")
            yield pa.RecordBatch.from_arrays(columns, labels)

    added = [S.StructField(f"{name}_vector", S.ArrayType(S.DoubleType())) for name in names]
    return items.mapInArrow(run, S.StructType([*items.schema.fields, *added]))


def item_vector(kind: Column, question: Column, answer: Column, content: Column) -> Column:
    """The mean of question and answer vectors for qa items, the content vector for plain ones."""
    return F.when(kind == "qa", V.mean(question, answer)).otherwise(content)


def build_entries(marked: DataFrame) -> DataFrame:
    """Entries of the items that are no duplicates, with their vectors (null where they have none)."""
    kept = marked.filter(F.coalesce("is_duplicate", F.lit(0)) == 0)
    title = T.title_of(*[F.col(c) for c in ("title", "question", "content", "source_item_id")])
    search = retrieval.search_text(*[F.col(c) for c in ("title", "question", "answer", "content")])
    return kept.select(
        F.concat(F.lit("e_"), "knowledge_id").alias("entry_id"), "knowledge_id", "knowledge_type", title.alias("title"), "question", "answer", "content", search.alias("search_text"),
        F.col("vector").alias("embedding"), "source_item_id", "sort_no",
    )


def fill_embeddings(entries: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]]) -> DataFrame:
    """entries(search_text, embedding, ...) with embeddings of the search text where they are null; blank texts keep null."""
    missing = F.col("embedding").isNull() & (T.strip(F.col("search_text")) != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            vectors = embed(batch.column("search_text").to_pylist()) if batch.num_rows else []
            yield batch.set_column(at, batch.schema.field(at), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64())))

    return entries.filter(~missing).unionByName(entries.filter(missing).mapInArrow(run, entries.schema))


def execute_chunks(chunks: DataFrame, generate: Callable[[str], str], tries: int = 3, pause: float = 2.0) -> DataFrame:
    """Adds response and error to chunks(chunk_id, prompt, ...) by a generator that is tried again on failure.

    After the n-th failure it waits n times `pause` seconds; after the last one the chunk keeps the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, errors = [], []
            for prompt in batch.column("prompt").to_pylist():
                reply = error = None
                for n in range(1, tries + 1):
                    try:
                        reply, error = generate(prompt or ""), None
                        break
                    except Exception as e:  # whatever the service raised is kept on the chunk
                        error = str(e)
                        if n < tries:
                            time.sleep(pause * n)
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, "response", "error"])

    return chunks.mapInArrow(run, S.StructType([*chunks.schema.fields, S.StructField("response", S.StringType()), S.StructField("error", S.StringType())]))


ITEM = "array<struct<question:string,answer:string,content:string>>"


def items_of(executed: DataFrame) -> DataFrame:
    """Items (chunk_id, sort_no, question, answer, content) of executed chunks; a reply that is no object gives none.

    The list is the first one with items among qa_list or plain_list, items, qas and data. Keys (chunk_id, sort_no) make a
    chunk that ran twice give the same items.
    """
    lists = ["qa_list", "plain_list", "items", "qas", "data"]
    schema = "struct<" + ",".join(f"{n}:{ITEM}" for n in lists) + ">"
    parsed = executed.select("chunk_id", F.from_json(T.repair_json(F.col("response")), schema).alias("r"))
    found = F.coalesce(*[F.when(F.size(f"r.{n}") > 0, F.col(f"r.{n}")) for n in lists])
    return parsed.select("chunk_id", F.posexplode(found).alias("at", "item")).select("chunk_id", (F.col("at") + 1).alias("sort_no"), "item.*")
