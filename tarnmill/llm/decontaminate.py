"""Benchmark decontamination (5): rare n-gram seeds join texts to test items, Smith-Waterman alignment scores the copies.

Texts and test items are read as words. A text is aligned with an item by Smith-Waterman (match 2, mismatch and gap -1, by
words); the score divided by a perfect copy's score is the similarity, so edited and paraphrased copies keep most of it: a
copy with four words in ten replaced still has 0.4.

Seeds are pairs of words with at most one word between them. They lose no pair that reaches the threshold t: between two
matched words that follow each other, an alignment pays one for each word skipped, and of its links at most a score of
two each comes from those that skip one word or none. So an item of n words has at least t * n - 1 such links, each from
another place of the item. Places are therefore seeded from the rarest on, by the number of texts that hold their seeds, until so
few are left that HITS links at least must be seeds, and a text is joined with an item where it holds that many of them. So
the commonest word pairs are not joined, whatever the corpus repeats. Where an item may have no link (items of one word,
very low thresholds) single words are the seeds, and one is enough.

One pass counts how many texts hold the items' seeds, one finds the rare ones; both only test bits of a set of bounded size
and stay in the scan's partitions, whatever the size of the benchmark. What they find joins the items by seed, and texts
whose best stretch (2 for each word of the item, -1 for others) reaches the threshold are aligned.

Items of fewer than three words match as a whole only. Null or wordless items and texts match nothing; repeated items
count each; null doc_ids are carried through, a null item_id comes last among equals. Empty tables give empty or clean
results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import drop_staged, maybe_in, numbered, slices, staged
from tarnmill.llm.prob_minhash import GOLDEN, mix
from tarnmill.llm.suffix_dedup import powers, signed

WORD = re.compile(r"\w+")
HITS = 4  # places of an item that a text must hold, or all its links if it has fewer
SHORT = 3  # items of fewer words match as a whole only
MOST_BITS = 1 << 27  # of the set of seeds that goes to every task
FEW_SEEDS = 1 << 20  # so many rows are joined by broadcast, more by a shuffle
_word = np.zeros(0, bool)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def needed(n: int, threshold: float) -> float:
    """The least alignment score of an item of n words that counts."""
    return (2 * n if n < SHORT else threshold * 2 * n) - 1e-9


def links(n: int, threshold: float) -> int:
    """How many links with one word between or none an alignment has at least that counts for an item of n words."""
    return max(0, math.ceil((needed(n, threshold) - 2) / 2))


def _is_word(codes: np.ndarray) -> np.ndarray:
    global _word
    if not len(_word):
        _word = np.array([chr(c).isalnum() or c == 95 for c in range(1 << 16)])
    found = _word[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        found[at] = chr(codes[at]).isalnum()
    return found


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts, in order: (text's number, 64-bit hash)."""
    lower = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lower], dtype=np.int64)
    codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "replace"), "<u4")
    edge = np.diff(_is_word(codes).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + GOLDEN) * power[: len(codes)], out=sums[1:])
    return np.searchsorted(ends, start, side="right"), mix((sums[end] - sums[start]) * inverse[start])


def seeds(owner: np.ndarray, h: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, seed) for all pairs of words of one text with at most one word between; with single, of words too."""
    at = np.arange(len(h))
    places, keys = ([at], [mix(h ^ GOLDEN)]) if single else ([], [])
    for gap in (1, 2):
        near = owner[gap:] == owner[: len(h) - gap] if len(h) > gap else np.zeros(0, bool)
        first = at[: len(near)][near]
        places.append(first)
        keys.append(mix(h[first] * GOLDEN + mix(h[first + gap])))
    return np.concatenate(places), np.concatenate(keys)


class SeedSet:
    """A set of seeds as bits of bounded number: it may hold more than was put in, never less."""

    def __init__(self, table: DataFrame, single: bool):
        self.single = single
        n = table.count()
        self.bits = min(MOST_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
        place = F.col("seed").bitwiseAND(F.lit(self.bits - 1))
        slots = table.select(F.shiftright(place, 6).alias("slot"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit"))
        found = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.slots = np.zeros(self.bits >> 6, np.int64)
        self.slots[found.column("slot").to_numpy()] = found.column("bits").to_numpy()

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (text's number, seed) of some texts that may be in the set."""
        owner, h = word_hashes(texts)
        place, keys = seeds(owner, h, self.single)
        bit = keys & np.uint64(self.bits - 1)
        hit = self.slots.view(np.uint64)[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) == 1
        place, keys = place[hit], keys[hit]
        owner = owner[place]
        _, index = np.unique(keys ^ mix(owner.astype(np.uint64) * GOLDEN + np.uint64(1)), return_index=True)
        return owner[index], keys[index]


def item_seeds(items: DataFrame, threshold: float) -> DataFrame:
    """(item, n, place, seed) of items(item, text) that have a word: n words, seeds by the place of their first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            number = batch.column("item").to_numpy()
            owner, h = word_hashes(batch.column("text").to_pylist())
            size = np.bincount(owner, minlength=len(number))
            first = np.cumsum(size) - size
            single = np.array([n > 0 and links(n, threshold) == 0 for n in size.tolist()], bool)
            for alone in (False, True):  # items seeded by pairs, and by single words
                mine = single[owner] == alone
                o = owner[mine]
                place, keys = (np.arange(len(o)), mix(h[mine] ^ GOLDEN)) if alone else seeds(o, h[mine], False)
                o = o[place]
                at = np.flatnonzero(mine)[place] - first[o]
                columns = [pa.array(x, t) for x, t in zip((number[o], size[o], at, signed(keys)), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "n", "place", "seed"])

    return items.mapInArrow(run, "item long, n int, place int, seed long")


def seed_counts(docs: DataFrame, wanted: SeedSet, most: int = 200_000) -> DataFrame:
    """(seed, texts): how many of docs(text) hold each seed that may be in a set."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], ["seed", "texts"])
        for batch in slices(batches):
            _, found = held.value.found(batch.column("text").to_pylist())
            both, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(len(found), np.int64)]), len(both)).astype(np.int64)
            keys = both
            if len(keys) > most:
                yield out()
                keys, counts = keys[:0], counts[:0]
        yield out()

    return docs.select("text").mapInArrow(run, "seed long, texts long").groupBy("seed").agg(F.sum("texts").alias("texts"))


def seed_hits(docs: DataFrame, wanted: SeedSet) -> DataFrame:
    """(row, seed): the seeds of docs(row, text) that may be in a set."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, keys = held.value.found(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("row").to_numpy()[owner]), pa.array(signed(keys))], ["row", "seed"])

    return docs.select("row", "text").mapInArrow(run, "row long, seed long")


def candidates(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """All pairs (row, item) of docs(row, text) and items(item, text) that may reach the threshold, by their rare seeds."""
    every = staged(item_seeds(items, threshold), "seeds")
    least = F.greatest(F.lit(0), F.ceil(F.col("n") * threshold - 1 - 1e-9))
    for n in range(SHORT):
        least = F.when(F.col("n") == n, links(n, threshold)).otherwise(least)
    single = not every.filter(least == 0).isEmpty()
    counts = staged(seed_counts(docs, SeedSet(every.select("seed").distinct(), single)), "counts")
    places = every.join(counts, "seed", "left").groupBy("item", "n", "place").agg(F.sum(F.coalesce("texts", F.lit(0))).alias("texts"))
    order = F.row_number().over(Window.partitionBy("item").orderBy("texts", "place"))
    # n - 1 places have a seed; where `least` of them hold links and least - hits are not kept, `hits` are found.
    hits_of = F.least(least, F.lit(HITS))
    most = F.when(least > 0, F.col("n") - 1 - (least - hits_of)).otherwise(F.col("n"))
    rare = places.withColumn("rank", order).filter(F.col("rank") <= most).select("item", "place", F.greatest(hits_of, F.lit(1)).alias("hits"))
    kept = staged(every.join(rare, ["item", "place"]).select("item", "place", "hits", "seed").distinct(), "rare")
    hits = seed_hits(docs, SeedSet(kept.select("seed").distinct(), single))
    found = hits.join(F.broadcast(kept) if kept.count() <= FEW_SEEDS else kept, "seed").groupBy("row", "item", "hits").agg(F.count_distinct("place").alias("k"))
    found = staged(found.filter("k >= hits").select("row", "item"), "candidates")
    drop_staged(every, counts, kept)
    return found


def align(item: np.ndarray, window: np.ndarray) -> float:
    """The best local alignment's score over that of a perfect copy of the item.

    Row by row: a gap in the item is a running maximum along the row, since both gaps cost one a word.
    """
    n = len(window)
    slope = np.arange(n + 1)
    row, best = np.zeros(n + 1, np.int64), 0
    for w in item:
        step = np.zeros(n + 1, np.int64)
        np.maximum(row[:-1] + np.where(window == w, 2, -1), row[1:] - 1, out=step[1:])
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + slope) - slope
        best = max(best, int(row.max()))
    return best / (2 * len(item))


def similarity(item: list[str], text: list[str], threshold: float) -> float | None:
    """The alignment's similarity if it reaches the threshold; aligned only where the words' own bound reaches it."""
    number: dict[str, int] = {}
    wanted = np.array([number.setdefault(w, len(number)) for w in item])
    ids = np.array([number.get(w, -1) for w in text], np.int64)
    run = np.concatenate([[0], np.cumsum(np.where(ids >= 0, 2, -1))])
    least = needed(len(item), threshold)
    if (run - np.minimum.accumulate(run)).max() < least:
        return None
    top = align(wanted, ids)
    return top if top * 2 * len(item) >= least else None


def matches(pairs: DataFrame, threshold: float) -> DataFrame:
    """(row, item_id, similarity) of the pairs(row, text, item_id, item_text) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            last, cut, found = None, [], []
            for text, item in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist(), strict=True):
                if text != last:
                    last, cut = text, words(text)
                found.append(similarity(words(item), cut, threshold))
            kept = pa.array([f is not None for f in found])
            rows = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(found, pa.float64())], ["row", "item_id", "similarity"])
            yield rows.filter(kept)

    return pairs.mapInArrow(run, "row long, item_id long, similarity double")


def scan(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4) -> DataFrame:
    """docs(doc_id, text, ...) with item_id, similarity, n_items and contaminated added (null, 0, 0, false for clean rows).

    Columns of docs that have those names are replaced. item_id is the most similar item, the smallest id among equals.
    """
    names = ["item_id", "similarity", "n_items", "contaminated"]
    docs = docs.drop(*names)
    rows = numbered(docs, "__row")
    texts = rows.select(F.col("__row").alias("row"), F.col("text").cast("string").alias("text"))
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = staged(items.withColumn("item", F.monotonically_increasing_id()), "items")
    found = candidates(texts, items.select("item", "text"), threshold)
    pairs = maybe_in(texts, "row", found).join(found.hint("merge"), "row").join(items.withColumnRenamed("text", "item_text"), "item")
    best = matches(pairs, threshold).groupBy("row").agg(F.max(F.struct("similarity", -F.col("item_id"))).alias("top"), F.count("*").cast("int").alias("n_items"))
    best = staged(best.select(F.col("row").alias("__row"), (-F.col("top.col2")).alias("item_id"), "top.similarity", "n_items"), "matches")
    drop_staged(items, found)
    flagged = maybe_in(rows, "__row", best, "__hit")
    none = {"item_id": F.lit(None).cast("long"), "similarity": F.lit(0.0), "n_items": F.lit(0)}
    some = flagged.filter("__hit").join(best.hint("merge"), "__row", "left").fillna({"similarity": 0.0, "n_items": 0})
    out = [*docs.columns, "item_id", "similarity", "n_items"]
    both = some.select(*out).unionByName(flagged.filter("not __hit").withColumns(none).select(*out))
    return both.withColumn("contaminated", F.col("n_items") > 0)
