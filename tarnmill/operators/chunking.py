"""Greedy packing of a job's texts into prompt chunks under limits of characters and items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.functions import text as T
from tarnmill.functions.batches import slices
from tarnmill.operators import staging

#: Where a long text may be cut, best first (fixed values): after sentence marks, after clause marks.
CUTS = (re.compile(r"[。．！？!?]\s*"), re.compile(r"[、，,；;:]\s*"))


@dataclass(frozen=True)
class ChunkLimits:
    max_chars: int
    max_items: int
    overlap_items: int = 0

    def __post_init__(self):
        if self.max_chars <= 0 or self.max_items <= 0:
            raise ValueError("max_chars and max_items must be positive")


def prompt_limits(limits: ChunkLimits, template: str) -> ChunkLimits:
    """What is left for texts once the prompt's template and its separator are in."""
    left = limits.max_chars - len(template) - 2
    if left <= 0:
        raise ValueError(f"the template leaves {left} characters")
    return ChunkLimits(left, limits.max_items, limits.overlap_items)


def split_long(text: str, most: int) -> list[str]:
    """A collapsed text in parts of at most `most` characters, cut as late as its best kind of mark allows."""
    parts = []
    while len(text) > most:
        window = text[:most]
        at = next((ends[-1] for cut in CUTS if (ends := [m.end() for m in cut.finditer(window)])), 0) or window.rfind(" ")
        at = at if at > 0 else most
        if head := text[:at].strip():
            parts.append(head)
        text = text[at:].strip()
    return [*parts, text] if text else parts


class Packer:
    """One job's open chunk, for callers that pack as items come: (length, key) in order, full chunks go out, an open one's items are held."""

    def __init__(self, limits: ChunkLimits):
        self.limits, self.held, self.start, self.number = limits, [], 0, 0

    def fitting(self) -> int:
        n = chars = 0
        for length, _ in self.held:
            more = length + 2 * (n > 0)
            if n and (n >= self.limits.max_items or chars + more > self.limits.max_chars):
                break
            n, chars = n + 1, chars + more
        return n

    def out(self, n: int) -> tuple[int, int, list[int]]:
        self.number += 1
        return self.number, self.start, [k for _, k in self.held[:n]]

    def close(self, n: int) -> None:
        step = n - self.limits.overlap_items if n > self.limits.overlap_items > 0 else n
        self.held, self.start = self.held[step:], self.start + step

    def add(self, length: int, key: int) -> Iterator[tuple]:
        self.held.append((length, key))
        while (n := self.fitting()) < len(self.held):
            yield self.out(n)
            self.close(n)

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield self.out(len(self.held))


def cut_items(items: DataFrame, limits: ChunkLimits) -> DataFrame:
    """items(job, sort_no, item_id, text) with long texts cut in their own partitions; parts are in order of `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at, ids, parts, texts = [], [], [], []
            for i, (item_id, text) in enumerate(zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                found = split_long(text, limits.max_chars)
                at += [i] * len(found)
                ids += [item_id] if len(found) == 1 else [f"{item_id or ''}:part_{k}" for k in range(1, len(found) + 1)]
                parts += range(len(found))
                texts += found
            rows = batch.select(["job", "sort_no", "item_id"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.string()), pa.array(parts, pa.int32()), pa.array(texts, pa.string())], ["job", "sort_no", "item_id", "part_id", "part", "text"])

    kinds = [(c, items.schema[c].dataType.simpleString()) for c in ("job", "sort_no", "item_id")]
    return items.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds) + ", part_id string, part int, text string")


BLOCK = 1 << 16  # items whose chunks are found together


def following(jobs: np.ndarray, lengths: np.ndarray, own: int, whole: bool, limits: ChunkLimits) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first `own` items, how many items a chunk that begins there takes, and where the next chunk begins.

    jobs and lengths also hold items after those, up to what one chunk can take; whole says that no more items exist.
    """
    n = len(lengths)
    sums = np.concatenate(([0], np.cumsum(lengths + 2)))  # with the separator that follows each item
    last = np.append(np.flatnonzero(jobs[1:] != jobs[:-1]) + 1, n)
    job_end = last[np.searchsorted(last, np.arange(own), side="right")]
    i = np.arange(own)
    end = np.searchsorted(sums, sums[:own] + limits.max_chars + 2, side="right") - 1
    end = np.minimum(np.minimum(np.maximum(end, i + 1), i + limits.max_items), job_end)
    size = end - i
    closed = (end == job_end) & ((job_end < n) | whole)
    overlap = limits.overlap_items
    after = np.where(~closed & (size > overlap) & (overlap > 0), end - overlap, end)
    return size, after


def members(parts: DataFrame, limits: ChunkLimits, block_rows: int = BLOCK) -> DataFrame:
    """(chunk, start, place, key): which parts(job, sort_no, item_id, row, part, length, key) each chunk holds, in order.

    chunk and start count over all jobs, in the order of the jobs. Where the next chunk begins depends only on where this
    one does, by prefix sums and a binary search, so blocks of items are worked in parallel: a block first says, for each
    item where a chunk could enter it, where that chain of chunks leaves it, by doubling the steps. The blocks' answers are
    put together in order, a short row a block, and then each block lists its chunks from where it is entered.
    """
    most = max(1, min(limits.max_items, (limits.max_chars + 2) // 3))  # a part has a character at least, and a separator of two
    size = max(block_rows, 2 * most)
    order = [F.col(c) for c in ("job", "sort_no", "item_id", "row", "part")]
    placed = staging.numbered(parts.select("job", "sort_no", "item_id", "row", "part", "length", "key"), order, "at").select("job", "length", "key", (F.col("at") - 1).alias("at"))
    block = F.floor(F.col("at") / size)
    ahead = (F.col("at") % size < most) & (block > 0)  # the block before looks this far
    dealt = placed.select("*", F.explode(F.when(ahead, F.array(block, block - 1)).otherwise(F.array(block))).alias("block"))
    dealt = staging.stage(dealt, "dealt")

    def laid(rows: pa.Table) -> tuple[pa.Table, int, np.ndarray, np.ndarray]:
        rows = rows.sort_by("at")
        own = min(rows.num_rows, size)
        jobs = rows.column("job").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        return rows, own, *following(jobs, rows.column("length").to_numpy().astype(np.int64), own, rows.num_rows < size + most, limits)

    def chains(key: tuple, rows: pa.Table) -> pa.Table:
        _, own, _, after = laid(rows)
        end = own + most + 1
        to, steps = np.concatenate((after, np.arange(own, end))), np.concatenate((np.ones(own, np.int64), np.zeros(end - own, np.int64)))
        while (to[:own] < own).any():
            steps, to = steps + steps[to], to[to]
        entries = min(own, most)
        return pa.table({"block": [key[0].as_py()], "leaves": pa.array([to[:entries] - own], pa.list_(pa.int64())), "steps": pa.array([steps[:entries]], pa.list_(pa.int64()))})

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = chunk = 0
        for batch in batches:
            out = []
            for n, leaves, steps in zip(batch.column("block").to_pylist(), batch.column("leaves"), batch.column("steps"), strict=True):
                out.append((n, at, chunk))
                if at < len(leaves):
                    at, chunk = leaves[at].as_py(), chunk + steps[at].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["block", "entry", "first"])

    def listed(key: tuple, rows: pa.Table, entry: pa.Table) -> pa.Table:
        rows, own, sizes, after = laid(rows)
        starts, at = [], entry.column("entry")[0].as_py()
        while at < own:
            starts.append(at)
            at = after[at]
        starts = np.array(starts, np.int64)
        taken = sizes[starts]
        place = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
        return pa.table({
            "chunk": entry.column("first")[0].as_py() + np.repeat(np.arange(len(starts)), taken), "start": key[0].as_py() * size + np.repeat(starts, taken),
            "place": place, "key": rows.column("key").take(pa.array(np.repeat(starts, taken) + place)),
        })

    tables = dealt.groupBy("block").applyInArrow(chains, "block long, leaves array<long>, steps array<long>")
    entries = tables.repartition(1).sortWithinPartitions("block").mapInArrow(entered, "block long, entry long, first long")  # a row for BLOCK items
    return dealt.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(listed, "chunk long, start long, place long, key long")


def build_chunks(items: DataFrame, limits: ChunkLimits, job: str = "job_item_id") -> DataFrame:
    """Chunks (job, chunk_no, start_index, end_index, item_count, char_count, item_ids, chunk_text) of items(job, sort_no, item_id, text).

    Items are collapsed, blank ones dropped, long ones cut with `:part_n` ids. Chunk after chunk takes items while they
    fit; the next one begins `overlap_items` before the end, unless that is no progress. Rows that share a job, sort_no and
    item_id come one after the other. Texts are cut where they are read and joined by chunk, and chunks are found in blocks
    of items, so a job may hold any share of all items.
    """
    rows = items.select(F.col(job).alias("job"), "sort_no", F.col("item_id").cast("string").alias("item_id"), T.collapse(F.col("text")).alias("text")).filter("text <> ''")
    parts = staging.stage(cut_items(rows, limits).withColumn("key", F.monotonically_increasing_id()), "parts")
    placed = members(parts.withColumns({"row": F.col("key") - F.col("part"), "length": F.length("text")}), limits)
    each = F.struct("place", "part_id", "text")
    chunks = placed.join(parts.select("key", "job", "part_id", "text"), "key").groupBy("job", "chunk", "start").agg(F.array_sort(F.collect_list(each)).alias("held"))
    chunks = staging.stage(chunks, "chunks")
    firsts = chunks.groupBy(F.col("job").alias("__job")).agg(F.min("chunk").alias("first_chunk"), F.min("start").alias("first_start"))
    chunks = chunks.join(firsts, F.col("job").eqNullSafe(F.col("__job"))).withColumns({"chunk_no": (F.col("chunk") - F.col("first_chunk") + 1).cast("int"), "start_index": (F.col("start") - F.col("first_start")).cast("int")})
    size = F.size("held")
    chars = F.aggregate("held", F.lit(0), lambda n, x: n + F.length(x["text"]))
    return chunks.select(
        F.col("job").alias(job), "chunk_no", "start_index", (F.col("start_index") + size - 1).alias("end_index"), size.alias("item_count"), chars.alias("char_count"),
        F.col("held.part_id").alias("item_ids"), F.array_join("held.text", "\n\n").alias("chunk_text"),
    )


def chunk_inputs(records: DataFrame, key: str) -> DataFrame:
    """(key, sort_no, item_id, text) of records(key, kind, index, text), ready for build_chunks().

    Pages lose leading line numbers, and those that are front matter are left out; blank records are dropped. Ids are
    `key:page_n` for pages and `key:n` for the rest, and sort_no counts what is left of a key in order.
    """
    paged = F.col("kind") == "pdf"
    body = F.when(paged, T.chunk_input(F.col("text"))).otherwise(T.strip(F.col("text")))
    suffix = F.when(paged, F.concat(F.lit("page_"), "index")).otherwise(F.col("index").cast("string"))
    kept = records.withColumn("text", body).filter((F.col("text") != "") & ~(paged & T.is_front_matter(F.col("text"))))
    order = F.row_number().over(Window.partitionBy(key).orderBy("index"))
    return kept.select(key, order.alias("sort_no"), F.concat(F.col(key).cast("string"), F.lit(":"), suffix).alias("item_id"), "text")


def prompts(chunks: DataFrame, template: str, most: int) -> DataFrame:
    """chunks with prompt, the template and the chunk's text; one of more than `most` characters fails the job."""
    whole = F.concat(F.lit(f"{template}\n\n"), "chunk_text")
    return chunks.withColumn("prompt", F.when(F.length(whole) <= most, whole).otherwise(F.raise_error(F.lit(f"a prompt is longer than {most}"))))


def continue_numbers(qa: DataFrame, plain: DataFrame, job: str = "job_item_id") -> DataFrame:
    """qa and plain chunks of a job in one numbering: plain ones go on after the last qa one."""
    both = qa.withColumn("prompt_type", F.lit("qa")).unionByName(plain.withColumn("prompt_type", F.lit("plain")))
    order = Window.partitionBy(job).orderBy(F.when(F.col("prompt_type") == "qa", 0).otherwise(1), "chunk_no")
    return both.withColumn("chunk_no", F.row_number().over(order))


def interleave(qa: DataFrame, plain: DataFrame, job: str = "job_item_id") -> DataFrame:
    """qa and plain chunks of a job taken by turns."""
    both = qa.withColumn("prompt_type", F.lit("qa")).unionByName(plain.withColumn("prompt_type", F.lit("plain")))
    order = Window.partitionBy(job).orderBy("chunk_no", F.when(F.col("prompt_type") == "qa", 0).otherwise(1))
    return both.withColumn("chunk_no", F.row_number().over(order))
