"""Suffix dedup (3): removes every byte covered by a `length`-byte string that starts anywhere else too.

A full suffix array does not fit the job's limits (see the README), so suffixes are sampled and named in three rounds,
each on what the one before left open; Spark's own external sort takes the place of disk-backed queues.

1. Of every window of `length` bytes, the leftmost smallest hash of its 200-byte substrings is its anchor. Equal windows
   have equal anchors, so a window whose anchor value occurs once in the corpus is unique. What remains are segments.
2. Within segments the same is done with 360-byte substrings. The windows of one anchor form a run; a run whose whole text
   occurs twice is repeated in full, which settles the inside of every long repeat at one row a run.
3. Runs that share an anchor value but not their text lie at the edges of repeats: their windows, of one run for each
   text, are compared one by one.

The anchors only propose: runs and windows count as equal by a 128-bit BLAKE2b digest of their bytes, documents by SHA-256.
Keys that a thousandth of all rows share are few and are joined by broadcast, so no repeated passage fills one task.
Equal documents are folded before the first round. Anchors and runs depend on a window's bytes alone, so segments are
read independently, in pieces of bounded size. Null text counts as empty. Matches never cross documents; every repeated
row is a document. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import drop_staged, maybe_in, numbered, slices, staged, with_hot_keys
from tarnmill.llm.prob_minhash import mix

BASE = 0x9E3779B97F4A7C15
SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
PIECE = 1 << 20  # windows worked on at once
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        factors = np.ones(max(n, 1 << 16), np.uint64)
        factors[1:] = BASE
        _powers = np.cumprod(factors)
        factors[1:] = pow(BASE, -1, 1 << 64)
        _inverse = np.cumprod(factors)
    return _powers, _inverse


class Rolling:
    """Hashes of all substrings of some bytes, from prefix sums."""

    def __init__(self, data: bytes):
        self.n = len(data)
        power, self.inverse = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(SYMBOLS[np.frombuffer(data, np.uint8)] * power[: self.n], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        n = self.n - k + 1
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2) longs: the BLAKE2b digests, of 128 bits, of n stretches of some bytes."""
    view = memoryview(data)
    found = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    return h


def runs(rolling: Rolling, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor value: (value, first window, end, whether its value lies at two places or more)."""
    h = rolling.windows(k)
    low = sliding_min(h, length - k + 1)
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate([[0], change])
    end = np.concatenate([change, [len(low)]])
    # A window that starts at its own anchor and is followed by one of the same value: there is a second place.
    again = np.flatnonzero((h[: len(low) - 1] == low[:-1]) & (low[1:] == low[:-1]))
    twice = np.zeros(len(first), bool)
    twice[np.searchsorted(first, again, side="right") - 1] = True
    return low[first], first, end, twice


def pieces(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Parts of some bytes that share `length` - 1 bytes, so that each window lies in one part."""
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        part = data[at : at + PIECE + length - 1]
        if len(part) >= length:
            yield at, part


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Replaces text of docs(row, doc_id, digest, text) by n_bytes and anchors, its anchor values (twice if at two places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            sizes, counts, values = [], [], []
            for text in batch.column("text").to_pylist():
                data = text.encode()
                found = []
                for _, part in pieces(data, length):
                    value, _, _, twice = runs(Rolling(part), length, k)
                    found += [value, value[twice]]
                sizes.append(len(data))
                counts.append(sum(map(len, found)))
                values += found
            flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(signed(flat)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "digest")), pa.array(sizes, pa.int64()), lists], ["row", "doc_id", "digest", "n_bytes", "anchors"])

    return docs.select("row", "doc_id", "digest", "text").mapInArrow(run, "row long, doc_id long, digest binary, n_bytes long, anchors array<long>")


def segments(open_docs: DataFrame, length: int, k: int) -> DataFrame:
    """(row, start, bytes): the stretches of open_docs(row, text, repeated) whose windows have repeated anchor values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            out: list[tuple[int, int, bytes]] = []
            for row, text, repeated in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "repeated")), strict=True):
                data, wanted = text.encode(), np.unique(np.array(repeated, np.int64).view(np.uint64))
                for at, part in pieces(data, length):
                    value, first, end, _ = runs(Rolling(part), length, k)
                    near = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
                    hit = wanted[near] == value
                    start = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
                    stop = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]))
                    out += [(row, at + int(first[a]), part[first[a] : end[b] + length - 1]) for a, b in zip(start, stop, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["row", "start", "bytes"])

    return open_docs.select("row", "text", "repeated").mapInArrow(run, "row long, start long, bytes binary")


def segment_runs(parts: DataFrame, length: int, k: int) -> DataFrame:
    """(sid, first, end, value, a, b, twice) for the runs of parts(sid, bytes); a and b are the digest of a run's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["sid", "first", "end", "value", "a", "b", "twice"], [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.bool_()]
        for batch in slices(batches, "bytes", 4 << 20):
            out: list[list[np.ndarray]] = [[] for _ in names]
            for sid, data in zip(batch.column("sid").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                rolling = Rolling(data)
                value, first, end, twice = runs(rolling, length, k)
                a, b = digests(data, first, end + length - 1).T
                for column, x in zip(out, (np.full(len(value), sid), first, end, signed(value), a, b, twice), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), kind) if kind != pa.bool_() else pa.array(np.concatenate(c).astype(bool) if c else np.zeros(0, bool)) for c, kind in zip(out, kinds, strict=True)], names)

    return parts.select("sid", "bytes").mapInArrow(run, "sid long, first int, end int, value long, a long, b long, twice boolean")


def window_hashes(parts: DataFrame, length: int) -> DataFrame:
    """(sid, at, a, b): the digest of each window of the runs listed in parts(sid, bytes, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 20):
            sids, places, one, two = [], [], [], []
            for sid, data, spans in zip(*(batch.column(c).to_pylist() for c in ("sid", "bytes", "spans")), strict=True):
                at = np.unique(np.concatenate([np.arange(s["first"], s["end"]) for s in spans]))
                a, b = digests(data, at, at + length).T
                for column, x in zip((sids, places, one, two), (np.full(len(at), sid), at, a, b), strict=True):
                    column.append(x)
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (sids, places, one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["sid", "at", "a", "b"])

    return parts.select("sid", "bytes", "spans").mapInArrow(run, "sid long, at int, a long, b long")


def islands(windows: DataFrame) -> DataFrame:
    """(sid, first, end): neighbouring windows of windows(sid, at) as one span."""
    place = F.row_number().over(Window.partitionBy("sid").orderBy("at"))
    spans = windows.withColumn("island", F.col("at") - place).groupBy("sid", "island")
    return spans.agg(F.min("at").alias("first"), (F.max("at") + 1).alias("end")).drop("island")


def repeated_spans(docs: DataFrame, length: int, wide: int, narrow: int) -> tuple[DataFrame, DataFrame]:
    """Of docs(row, doc_id, digest, text): all rows (row, doc_id, digest, n_bytes, n, head), and (row, spans) of heads.

    n rows share a text, head is the first of them; spans are the places of repeated windows, as (first, end) of windows.
    """
    sketch = staged(anchors(docs, length, wide), "anchors")
    copies = sketch.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("head"))
    rows = staged(sketch.select("row", "doc_id", "digest", "n_bytes").join(copies, "digest"), "rows")
    heads = sketch.select("row", "anchors").join(rows.filter("row = head").select("row"), "row", "left_semi")
    values = staged(heads.select("row", F.explode("anchors").alias("value")), "values")
    many = staged(values.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1"), "many")
    repeated = staged(with_hot_keys(values, many, ["value"]).groupBy("row").agg(F.collect_set("value").alias("repeated")), "repeated")
    drop_staged(values, many)
    open_docs = maybe_in(docs.select("row", "text"), "row", repeated).join(repeated.hint("merge"), "row")
    parts = staged(segments(open_docs, length, wide).withColumn("sid", F.monotonically_increasing_id()), "segments")
    drop_staged(sketch, repeated)

    found = staged(segment_runs(parts, length, narrow), "runs")
    texts = found.groupBy("value", "a", "b").agg(F.count("*").alias("n"), F.min(F.struct("sid", "first", "end")).alias("one"), F.max("twice").alias("twice"))
    texts = staged(texts, "texts")
    kinds = staged(texts.groupBy("value").agg(F.count("*").alias("n"), F.max("twice").alias("again")).filter("n > 1 or again").select("value", "n"), "kinds")
    full = with_hot_keys(found, texts.filter("n > 1").select("value", "a", "b", "n"), ["value", "a", "b"]).select("sid", "first", "end")
    edges = with_hot_keys(texts.select("value", "one"), kinds, ["value"]).select("one.sid", F.struct("one.first", "one.end").alias("span"))
    edges = edges.groupBy("sid").agg(F.collect_list("span").alias("spans"))
    windows = staged(window_hashes(parts.join(edges.hint("merge"), "sid"), length), "windows")
    twin = staged(windows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1"), "twins")
    single = islands(with_hot_keys(windows, twin, ["a", "b"]).select("sid", "at"))
    places = parts.select("sid", "row", "start")
    spans = full.unionByName(single).join(places, "sid").select("row", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end")).alias("end")).alias("span"))
    spans = staged(spans.groupBy("row").agg(F.collect_list("span").alias("spans")), "spans")
    drop_staged(parts, found, texts, kinds, windows, twin)
    return rows, spans


def cut(data: bytes, spans: list[dict] | None, length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left) when the windows in spans are taken out."""
    left, removed, n, at = [], 0, 0, 0
    for first, end in sorted((s["first"], s["end"] + length - 1) for s in spans or ()):
        if first > at or not n:
            left.append(data[at:first])
            n += 1
            removed += end - first
        else:
            removed += max(0, end - at)
        at = max(at, end)
    return removed, n, b"".join([*left, data[at:]])


def dedup(docs: DataFrame, length: int = 400, wide: int = 200, narrow: int = 360, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text); with_text adds kept, the bytes left."""
    if not 0 < wide < narrow < length:
        raise ValueError("0 < wide < narrow < length")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = numbered(docs, "__row").select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows, spans = repeated_spans(base, length, wide, narrow)
    copies = rows.filter((F.col("n") > 1) & (F.col("n_bytes") >= length)).select("row")
    touched = staged(spans.select("row").unionByName(copies).distinct(), "touched")
    kept = ["kept"] if with_text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            sizes, removed, counts, shas, lefts = [], [], [], [], []
            for t, s, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "gone")), strict=True):
                data = t.encode()
                taken, n, left = (len(data), 1, b"") if gone else cut(data, s, length)
                for column, x in zip((sizes, removed, counts, shas, lefts), (len(data), taken, n, hashlib.sha256(left).hexdigest(), left), strict=True):
                    column.append(x)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(shas, pa.string())] + [pa.array(lefts, pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *kept])

    flagged = maybe_in(base.select("row", "doc_id", "text"), "row", touched, "hit")
    some = flagged.filter("hit").drop("hit").join(spans, "row", "left").join(copies.withColumn("gone", F.lit(True)), "row", "left")
    rest = flagged.filter("not hit").drop("hit").withColumns({"spans": F.lit(None).cast(spans.schema["spans"].dataType), "gone": F.lit(None).cast("boolean")})
    both = some.select("doc_id", "text", "spans", "gone").unionByName(rest.select("doc_id", "text", "spans", "gone"))
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
