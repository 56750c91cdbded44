r"""Phrase collocation mining (11): vertical positional inverted lists, extended a word at a time.

Texts are cut into shards of one language and about SHARD bytes. A shard's words are numbered through, with a gap at every
piece's end, and each of its words has the list of its places: its postings. Lists of frequent words are kept (compressed);
a phrase's list is the list of the places where it begins. A list of k words is joined with the postings of the words that
stand k places on, which gives the lists of k + 1 words; a list's length is the phrase's exact frequency in the shard, and
the lengths are added up over the shards. Phrases below the least frequency are dropped before they are extended, as no
longer phrase can be more frequent. A phrase is known by the number of its first part and of its last word, and a number is
the shard and place in it where the phrase was first listed, so nothing is hashed and no dictionary is gathered anywhere.

A shard has one row for each of its phrases, whatever their frequency, so no phrase is a hot key; what one task holds is a
shard, or one piece where that is longer. Null texts count as empty and null languages as `und`; repeated rows count each.
Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import drop_staged, slices, staged

SHARD = 16 << 20
ENDS = b".,;:!?\n\x0b\x0c\r"  # of pieces
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(ENDS)] = 2
#: A phrase's number: its shard (a task and a count within it) and its place among the shard's phrases.
AT_BITS, MADE_BITS = 26, 16


def parts(text: bytes, most: int) -> Iterator[bytes]:
    """A text in runs of whole pieces, of about `most` bytes, or of one piece that is longer."""
    while len(text) > most:
        cut = max(text.rfind(bytes([c]), 0, most) for c in ENDS)
        if cut < 0:
            cut = min((x for x in (text.find(bytes([c]), most) for c in ENDS) if x >= 0), default=len(text) - 1)
        yield text[: cut + 1]
        text = text[cut + 1 :]
    if text:
        yield text


def word_lists(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A shard's distinct words, how often each occurs, and their lists of places one after the other."""
    raw = np.frombuffer(text.translate(LOWER), np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    code = words.indices.to_numpy()
    places = np.arange(len(starts)) + np.searchsorted(np.flatnonzero(kind == 2), starts)
    return words.dictionary, np.bincount(code, minlength=len(words.dictionary)), places[np.argsort(code, kind="stable")].astype(np.int32)


def packed(counts: np.ndarray, places: np.ndarray) -> bytes:
    """Lists of places as the steps within each, compressed."""
    steps = np.diff(places, prepend=np.int32(0))
    first = np.cumsum(counts) - counts
    steps[first] = places[first]
    return pa.Codec("zstd", compression_level=1).compress(steps.astype("<i4").tobytes(), asbytes=True)


def unpacked(counts: np.ndarray, data: bytes) -> np.ndarray:
    steps = np.frombuffer(pa.Codec("zstd").decompress(data, int(counts.sum()) * 4, asbytes=True), "<i4")
    sums, first = np.cumsum(steps, dtype=np.int64), np.cumsum(counts) - counts
    return sums - np.repeat(sums[first] - steps[first], counts)


def postings(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """shard, lang, n_words, words, counts and places (packed): the inverted lists of docs(lang, text), a row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def shards() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, texts in held.items():
                words, counts, places = word_lists(b"\n".join(texts))
                if not len(words):
                    continue
                if made >> MADE_BITS or len(places) >> AT_BITS or task >> (63 - AT_BITS - MADE_BITS):
                    raise ValueError("too many shards in a task, words in a shard or tasks to number phrases")
                row = {"shard": [task << MADE_BITS | made], "lang": [lang], "n_words": [len(places)], "words": pa.array([words], pa.list_(pa.string())), "counts": pa.array([counts], pa.list_(pa.int32())), "places": pa.array([packed(counts, places)], pa.binary())}
                made += 1
                yield pa.RecordBatch.from_pydict(row)

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in parts((text or "").encode(), shard_bytes):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= shard_bytes:
                        yield from shards()
                        held, size = {}, 0
        yield from shards()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "shard long, lang string, n_words long, words array<string>, counts array<int>, places binary")


def frequent(lists: DataFrame, key: list[str], least: int, label: str) -> DataFrame:
    """code and id of the lists(*key, n, code) whose phrases occur `least` times in all; a phrase's id is its least code.

    The one row of a phrase with code = id also has its key and its total.
    """
    same = Window.partitionBy(*key)
    found = lists.withColumns({"total": F.sum("n").over(same), "id": F.min("code").over(same)}).filter(F.col("total") >= least)
    first = F.col("code") == F.col("id")
    return staged(found.select("code", "id", *[F.when(first, F.col(c)).alias(c) for c in (*key, "total")]), label, clean=True)


def marks(found: DataFrame, level: int) -> DataFrame:
    """Which lists of a shard are frequent, and under which numbers."""
    return found.select(F.shiftright("code", AT_BITS).alias("shard"), F.lit(level).alias("level"), F.col("code").bitwiseAND(F.lit((1 << AT_BITS) - 1)).cast("int").alias("at"), "id")


def frequent_words(lists: DataFrame, found: DataFrame) -> DataFrame:
    """shard, ids, counts, places: the postings of the frequent words alone."""

    def keep(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"shard": [], "ids": [], "counts": [], "places": []}).cast(schema)
        counts = left.column("counts")[0].values.to_numpy()
        at, ids = right.column("at").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(at)
        kept = np.zeros(len(counts), bool)
        kept[at] = True
        places = unpacked(counts, left.column("places")[0].as_py())[np.repeat(kept, counts)].astype(np.int32)
        return pa.table({"shard": left.column("shard"), "ids": pa.array([ids[order]], pa.list_(pa.int64())), "counts": pa.array([counts[kept]], pa.list_(pa.int32())), "places": pa.array([packed(counts[kept], places)], pa.binary())})

    schema = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.binary())])
    pair = lists.select("shard", "counts", "places").groupBy("shard").cogroup(found.groupBy("shard"))
    return pair.applyInArrow(keep, "shard long, ids array<long>, counts array<int>, places binary")


def extended(words: DataFrame, found: DataFrame | None, level: int) -> DataFrame:
    """left, right, n, code: the lists of `level` words, each a frequent list of one word less and the frequent word after it.

    found(shard, level, at, id) marks the frequent lists of 2 to level - 1 words. Lists are made anew from the words'
    postings, always in the same order, as that costs less than to write and read them.
    """

    def grow(shard: int, row: pa.Table, known: pa.Table | None) -> pa.Table:
        counts, ids = row.column("counts")[0].values.to_numpy(), row.column("ids")[0].values.to_numpy()
        places = unpacked(counts, row.column("places")[0].as_py())
        word = np.repeat(np.arange(len(ids)), counts)
        standing = np.full(places.max() + level + 1, -1)  # the word whose postings hold a place
        standing[places] = word
        names, owner = ids, word
        for k in range(1, level):
            after = standing[places + k]
            met = np.flatnonzero(after >= 0)
            both = owner[met] * len(ids) + after[met]
            order = np.argsort(both, kind="stable")
            both, places = both[order], places[met][order]
            first = np.flatnonzero(np.diff(both, prepend=-1))
            sizes, left, right = np.diff(np.append(first, len(both))), names[both[first] // len(ids)], ids[both[first] % len(ids)]
            if k + 1 == level:
                return pa.table({"left": left, "right": right, "n": sizes, "code": (shard << AT_BITS) + np.arange(len(first))})
            mine = np.flatnonzero(known.column("level").to_numpy() == k + 1)
            mine = mine[np.argsort(known.column("at").to_numpy()[mine])]  # rows come in any order, which differs from job to job
            at, name = known.column("at").to_numpy()[mine], known.column("id").to_numpy()[mine]
            place_of = np.full(len(first), -1)
            place_of[at] = np.arange(len(at))
            owner, names = np.repeat(place_of, sizes), name
            places, owner = places[owner >= 0], owner[owner >= 0]

    schema = "left long, right long, n long, code long"
    none = pa.table({k: pa.array([], pa.int64()) for k in ("left", "right", "n", "code")})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from grow(batch.column("shard")[i].as_py(), pa.Table.from_batches([batch.slice(i, 1)]), None).to_batches()

    if found is None:  # every row is a shard, so none need move
        return words.mapInArrow(each, schema)
    return words.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(lambda key, row, known: grow(key[0].as_py(), row, known) if row.num_rows and known.num_rows else none, schema)


def phrases(docs: DataFrame, least: int = 30, most_words: int = 4, shard_bytes: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to most_words words that occur `least` times, and (lang, n) of all languages."""
    lists = staged(postings(docs, shard_bytes), "lists")
    each = lists.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").cast("long").alias("n"), (F.shiftleft("shard", AT_BITS) + F.col("at")).alias("code"))
    found = frequent(each, ["word", "lang"], least, "words")
    single = found.filter("code = id").select("id", "lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), F.col("total").alias("f"))
    n = staged(lists.groupBy("lang").agg(F.sum("n_words").alias("n")), "n")
    words = staged(frequent_words(lists, marks(found, 1)), "postings", clean=True)
    drop_staged(lists)
    out, shorter, known = single, single, None
    for level in range(2, most_words + 1):
        found = frequent(extended(words, known, level), ["left", "right"], least, "pairs")
        last = single.select(F.col("id").alias("right"), F.col("phrase").alias("word"))
        named = found.filter("code = id").select("id", "left", "right", F.col("total").alias("f")).join(shorter.select(F.col("id").alias("left"), "lang", "phrase"), "left").join(last, "right")
        shorter = named.select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.lit(level).alias("k"), "f")
        out = out.unionByName(shorter)
        known = marks(found, level) if known is None else known.unionByName(marks(found, level))
    return out.drop("id"), n


def exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, most_words: int = 4, keep: int = 2000, shard_bytes: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language of docs(lang, text).

    A phrase is scored at the cut where its parts explain it best; one that a longer phrase nearly always surrounds goes.
    """
    found, totals = phrases(docs, least, most_words, shard_bytes)
    known = staged(found, "phrases", clean=True).withColumn("words", F.split("phrase", " "))
    several = known.filter("k > 1")
    joined = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    cut = several.select("lang", "phrase", "k", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at", joined(F.lit(1), F.col("at")).alias("__first"), joined(F.col("at") + 1, F.col("k") - F.col("at")).alias("__rest"))
    first, rest = (known.select("lang", F.col("phrase").alias(name), F.col("f").alias(to)) for name, to in (("__first", "l"), ("__rest", "r")))
    parts_of = cut.join(first, ["lang", "__first"]).join(rest, ["lang", "__rest"])
    scored = parts_of.withColumns({"__a": exact("a"), "__lr": exact("l") + exact("r")}).withColumn("score", F.expr("__a * 2000000 div __lr"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("s"))
    inner = several.filter("k > 2").select("lang", "words", "k", F.col("f").alias("__longer"), F.explode(F.expr(f"filter(flatten(transform(sequence(1, {most_words}), s -> transform(sequence(2, {most_words}), w -> struct(s, w)))), x -> x.w < k and x.s + x.w - 1 <= k)")).alias("x"))
    inside = inner.select("lang", joined(F.col("x.s"), F.col("x.w")).alias("phrase"), "__longer").groupBy("lang", "phrase").agg(F.max("__longer").alias("__longer"))
    apart = lowest.join(inside, ["lang", "phrase"], "left").filter(F.col("__longer").isNull() | (exact("__longer") * 100 < exact("a") * 80))
    order = Window.partitionBy("lang").orderBy(F.col("s.score").desc(), F.col("a").desc(), "phrase")
    best = apart.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", "s.score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT lang, piece, unnest(ws) AS w1, generate_subscripts(ws, 1) AS s FROM w),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
f AS (SELECT lang, w1, lead(w1, 1) OVER q AS w2, lead(w1, 2) OVER q AS w3, lead(w1, 3) OVER q AS w4 FROM o WINDOW q AS (PARTITION BY piece ORDER BY s)),
g AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS a FROM f GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) AS a FROM f WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) AS a FROM f WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) AS a FROM f WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * c.a) // (l.a + r.a) AS BIGINT) AS score FROM c JOIN (SELECT unnest([1, 2, 3]) AS j) ON j < c.k
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:c.k], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(a) AS longer FROM c, (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([2, 3]) AS m) WHERE m < k AND s + m - 1 <= k GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low LEFT JOIN sub USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
