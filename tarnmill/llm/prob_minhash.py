"""MinHash near-dedup (10): ProbMinHash signatures of weighted word shingles, banding, and exact verification.

A document's elements are its distinct five-word shingles (lower-cased words between white space; a shorter text is one
shingle), weighed by one plus the logarithm of their count. Each element sends a Poisson process of its weight, seeded by its hash, at
the document's registers: arrival times are sums of exponential steps, each arrival picks a register, and a register
keeps the element that arrives first. A process ends once its time passes the document's latest register, since it can
win none any more. Two registers agree with the probability Jaccard similarity. Bands of registers name buckets, and
pairs from buckets are links if the Jaccard similarity of their shingle sets is 0.8 or more.

Equal texts fold into one class before banding, and large buckets are compared as in components.py, so no group's pairs
are all written out. Null text counts as empty; empty texts are one class. Groups are connected; the row with the
smallest doc_id (null last, then the smallest row number) stays. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.llm.common import drop_staged, numbered, slices, staged
from tarnmill.llm.components import bucket_components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of several texts: (text's number, 64-bit hash, count), by text."""
    words = [(t or "").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, names = pd.factorize(np.array([x for w in words for x in w], dtype=object))
    raw = [x.encode("utf-8", "surrogatepass") for x in names]
    table = mix(np.array([zlib.crc32(x) | zlib.crc32(x, 0x5BD1E995) << 32 for x in raw], np.uint64))
    h = table[codes]
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(h))
    room = ends[owner] - at
    start = (room >= width) | ((at == ends[owner] - sizes[owner]) & (sizes[owner] < width))
    first = at[start]
    total = np.zeros(len(first), np.uint64)
    for j in range(width):
        inside = room[first] > j
        total[inside] = mix(total[inside] + h[first[inside] + j] + GOLDEN)
    owner = owner[first]
    # One sort tells equal shingles of one text: its number is stirred into the key.
    key = total ^ mix(owner.astype(np.uint64) * GOLDEN + np.uint64(1))
    _, index, count = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(owner[index], kind="stable")
    index = index[order]
    return owner[index], total[index], count[order]


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers) ProbMinHash signatures: in each register, the element that arrived first (0: no element at all)."""
    times = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    active = np.arange(len(elements))
    now = np.zeros(len(elements))
    drawn, block = 0, 1
    while len(active):
        number = np.arange(drawn, drawn + block, dtype=np.uint64)
        u = mix(elements[active][:, None] + (number[None, :] * np.uint64(2) + np.uint64(1)) * GOLDEN)
        step = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        arrival = now[active][:, None] + np.cumsum(step, 1) / weights[active][:, None]
        place = (mix(u + GOLDEN) % np.uint64(registers)).astype(np.int64) + owner[active][:, None] * registers
        np.minimum.at(times, place.ravel(), arrival.ravel())
        won = times[place] == arrival
        rows, cols = np.nonzero(won)
        winner[place[rows, cols]] = elements[active][rows]
        now[active] = arrival[:, -1]
        latest = times.reshape(n, registers).max(1)
        active = active[now[active] < latest[owner[active]]]
        drawn += block
        block = min(2 * block, 64)
    return winner.reshape(n, registers)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The probability Jaccard similarity that two signatures give."""
    return float((a == b).mean())


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), signature.shape[1] // rows), np.uint64)
    for j in range(rows):
        out = mix(out + signature[:, j::rows][:, : out.shape[1]] + GOLDEN)
    return out.astype(np.int64)


def sketch(rows: DataFrame, bands: int, band_rows: int) -> DataFrame:
    """Replaces `text` of rows(..., text) by `bands`, the hashes of its signature's bands (empty if it has no word)."""
    carried = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            texts = batch.column("text").to_pylist()
            owner, elements, counts = shingles(texts)
            found = band_hashes(signatures(owner, elements, 1 + np.log(counts), len(texts), bands * band_rows), band_rows)
            some = np.zeros(len(texts), bool)
            some[owner] = True
            offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [values], [*carried, "bands"])

    return rows.mapInArrow(run, rows.drop("text").schema.add("bands", T.ArrayType(T.LongType())))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(id, grams): the 64-bit hashes of the distinct shingles of rows(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            n = batch.num_rows
            owner, elements, _ = shingles(batch.column("text").to_pylist())
            offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements.view(np.int64)))], ["id", "grams"])

    return rows.mapInArrow(run, "id long, grams array<long>")


def compare_blocks(apart: DataFrame, sets: DataFrame, similarity: float, side: int = 256) -> DataFrame:
    """Links (a, b) between the components of each bucket of apart(bucket, id, comp, main, n, m), given sets(id, grams, bands).

    The members outside the main component, and all members, are dealt into blocks of about `side`; each pair of blocks is
    one group of at most that many rows on either side, and only links come out of it, one for an id and a component. Two
    ids that share several buckets are compared in their first one.
    """
    cells = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / side)).cast("int")
    cell = lambda n: F.pmod(F.xxhash64("id"), cells(n)).cast("int")
    full = apart.join(sets, "id")
    left = full.filter("comp <> main").withColumn("i", cell("m")).withColumn("j", F.explode(F.sequence(F.lit(0), cells("n") - 1)))
    right = full.select(*[F.col(c).alias(c) for c in full.columns]).withColumn("j", cell("n")).withColumn("i", F.explode(F.sequence(F.lit(0), cells("m") - 1)))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        found: dict[str, list[int]] = {"a": [], "b": []}
        if x.num_rows and y.num_rows:
            band = x.column("bucket")[0].as_py() & 31
            get = lambda t, c: t.column(c).to_numpy()
            xi, xc, yi, yc = get(x, "id"), get(x, "comp"), get(y, "id"), get(y, "comp")
            main = x.column("main")[0].as_py()
            xb, yb = (np.array(t.column("bands").to_pylist(), np.int64)[:, :band] for t in (x, y))
            lists = y.column("grams").combine_chunks()
            grams, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            sizes = np.diff(ends)
            for k, mine in enumerate(x.column("grams").to_pylist()):
                test = (yc != xc[k]) & ((yc == main) | (xi[k] < yi)) & ~(yb == xb[k]).any(1)
                if not test.any():
                    continue
                hit = np.concatenate([[0], np.cumsum(np.isin(grams, np.array(mine, np.int64)))])
                shared = hit[ends[1:]] - hit[ends[:-1]]
                near = np.flatnonzero(test & (shared >= similarity * (len(mine) + sizes - shared)))
                for at in near[np.unique(yc[near], return_index=True)[1]]:
                    found["a"].append(int(xi[k]))
                    found["b"].append(int(yi[at]))
        return pa.table({"a": pa.array(found["a"], pa.int64()), "b": pa.array(found["b"], pa.int64())})

    return left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j")).applyInArrow(compare, "a long, b long")


def dedup(docs: DataFrame, similarity: float = 0.8, bands: int = 24, band_rows: int = 5) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, group_id (the doc_id that stays), group_size, kept, row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = numbered(docs, "__row").select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hashed = base.select("row", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), "text")
    sketched = staged(sketch(hashed, bands, band_rows), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = staged(sketched.groupBy("h1", "h2").agg(F.min(order).alias("best"), F.count("*").alias("n")).select("h1", "h2", "best", F.col("best.row").alias("id"), "n"), "classes")
    heads = sketched.select(F.col("row").alias("id"), "bands").join(classes.select("id"), "id", "left_semi")
    items = heads.select("id", F.posexplode("bands").alias("band", "hash")).select(F.col("hash").bitwiseAND(F.lit(-32)).bitwiseOR(F.col("band")).alias("bucket"), "id")  # its last bits are the band
    texts = base.select(F.col("row").alias("id"), "text")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = staged(shingle_sets(texts.join(ids.hint("merge"), "id", "left_semi")), "shingles")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        links = staged(both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), "links")
        drop_staged(sets)
        return links

    def grid(apart: DataFrame) -> DataFrame:
        ids = apart.select("id").distinct()
        sets = shingle_sets(texts.join(ids.hint("merge"), "id", "left_semi")).join(heads, "id")
        sets = staged(sets, "shingles")
        links = staged(compare_blocks(apart, sets, similarity), "links")
        drop_staged(sets)
        return links

    comps = bucket_components(items, verify, grid)
    named = classes.join(comps, "id", "left").withColumn("group", F.coalesce("comp", "id"))
    groups = named.groupBy("group").agg(F.min("best").alias("stays"), F.sum("n").alias("group_size"))
    final = named.select("h1", "h2", "group").join(groups, "group").select("h1", "h2", F.col("stays.doc_id").alias("group_id"), F.col("stays.row").alias("kept_row"), "group_size")
    return sketched.select("row", "doc_id", "h1", "h2").join(final, ["h1", "h2"]).select("doc_id", "group_id", "group_size", (F.col("row") == F.col("kept_row")).alias("kept"), "row")
