"""Language ID (7): averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Every run of letters is read with a boundary on both sides, and all its 2- to 4-grams are hashed into one embedding
table. A document is the mean of its embeddings, a softmax over the learned languages sits on top, and both are trained
by stochastic gradient descent in numpy on a bounded sample. A temperature fitted on rows kept out of that training
makes the probabilities honest; the rejection threshold loses at most `reject_loss` of those rows that were read right,
and is never above an even chance.

Since the mean is linear, scoring adds up one row of logits per n-gram: texts of any length run in bounded memory.
Null text, or text without a letter, gives `und` with score 0 and is rejected. With no labelled row to learn from, every
document gets that result. Null or repeated doc_ids are carried through; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import bounded_sample, held_out, slices

UNKNOWN = "und"
GRAMS = (2, 3, 4)
SEGMENT = 1 << 19
_letters = np.zeros(0, bool)


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # (buckets, languages): an n-gram's share of the logits
    bias: np.ndarray
    temperature: float
    reject_below: float


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.array([chr(c).isalpha() for c in range(1 << 16)])
    found = _letters[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        found[at] = chr(codes[at]).isalpha()
    return found


def grams(text: str, buckets: int) -> np.ndarray:
    """The hashed 2- to 4-grams of a text's words, each word with a boundary on both sides."""
    return np.concatenate(list(gram_parts(text, buckets)) or [np.zeros(0, np.int64)])


def gram_parts(text: str, buckets: int) -> Iterator[np.ndarray]:
    """grams() of a text of any length, some SEGMENT places of it at a time; each gram is in the part where it starts."""
    padded = f" {text} ".lower()
    for at in range(0, len(padded), SEGMENT):
        yield _grams(padded[at : at + SEGMENT + max(GRAMS) - 1], buckets)


def _grams(part: str, buckets: int) -> np.ndarray:
    """The grams that start within the first SEGMENT places of some lower-cased text."""
    codes = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    codes[~_is_letter(codes)] = 0
    out = []
    for n in GRAMS:
        if len(codes) < n:
            continue
        starts = min(len(codes) - n + 1, SEGMENT)
        parts = [codes[i : starts + i] for i in range(n)]
        keep = np.ones(len(parts[0]), bool)
        for p in parts[1:-1]:
            keep &= p != 0
        keep &= (parts[0] != 0) | (parts[-1] != 0)
        h = np.full(int(keep.sum()), n * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for p in parts:
            h = (h ^ p[keep]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        out.append((h % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def counted(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text's grams fall in, and how many in each; a text of any length has at most `buckets` of them."""
    total = np.zeros(buckets, np.int64)
    for part in gram_parts(text, buckets):
        total += np.bincount(part, minlength=buckets)
    found = np.flatnonzero(total)
    return found, total[found]


def fit(features: list[tuple[np.ndarray, np.ndarray]], langs: list[str], buckets: int = 1 << 16, size: int = 16, epochs: int = 4, rate: float = 0.5, reject_loss: float = 0.0005, seed: int = 7) -> LanguageModel:
    """Trains on counted() texts and their languages; every fifth is kept out of training and used for calibration."""
    names = sorted(set(langs))
    rows = [((idx, count), int(count.sum()), names.index(y)) for (idx, count), y in zip(features, langs, strict=True) if len(idx)]
    if not rows:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept = set(order[::5].tolist()) if len(rows) >= 50 else set()
    train = [i for i in order if i not in kept]
    emb = rng.normal(0, 0.1, (buckets, size))
    top = rng.normal(0, 0.1, (size, len(names)))
    bias = np.zeros(len(names))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            (idx, count), n, y = rows[i]
            weight = count / n
            mean = weight @ emb[idx]
            z = mean @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = top @ p
            top -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            emb[idx] -= (step * len(idx) ** 0.5) * np.outer(weight, back)
    table = emb @ top
    tested = sorted(kept) or train
    z = np.array([rows[i][0][1] / rows[i][1] @ table[rows[i][0][0]] + bias for i in tested])
    y = np.array([rows[i][2] for i in tested])

    def log_p(t: float) -> np.ndarray:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    temperature = min((2.0**k for k in np.arange(-6, 6.01, 0.25)), key=lambda t: -log_p(t)[np.arange(len(y)), y].mean())
    best = np.exp(log_p(temperature))
    right = np.sort(best.max(1)[best.argmax(1) == y])
    reject = min(0.5, float(right[int(len(right) * reject_loss)])) if len(right) else 0.0
    return LanguageModel(names, table.astype(np.float32), bias, float(temperature), reject)


def predict_one(model: LanguageModel, text: str | None) -> tuple[str, float, bool]:
    """(language, calibrated probability, rejected)."""
    total, n = np.zeros(len(model.languages)), 0
    for g in gram_parts(text or "", len(model.logits)):
        total += model.logits[g].sum(0, dtype=np.float64)
        n += len(g)
    if not n or not model.languages:
        return UNKNOWN, 0.0, True
    z = (total / n + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    k = int(p.argmax())
    return model.languages[k], float(p[k]), bool(p[k] < model.reject_below)


def train(docs: DataFrame, sample: int = 6000, buckets: int = 1 << 16) -> LanguageModel:
    """Fits on at most about `sample` rows of docs(doc_id, text, lang) outside the held-out fold, null languages left out.

    The texts are counted on the executors; only their bounded counts come to the driver.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("k"), "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [counted(t, buckets) for t in batch.column("text").to_pylist()]
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("at"), *(pa.array([f[i].astype(np.int32) for f in found], kinds) for i in (0, 1))], ["lang", "at", "idx", "n"])

    picked = bounded_sample(rows, F.col("k"), sample).select("lang", F.xxhash64("text").alias("at"), "text")
    found = picked.mapInArrow(run, "lang string, at long, idx array<int>, n array<int>").orderBy("lang", "at").toArrow()
    lists = [[np.asarray(x.values) for x in found.column(c)] for c in ("idx", "n")]
    return fit(list(zip(*lists, strict=True)), found.column("lang").to_pylist(), buckets)


def predict(docs: DataFrame, model: LanguageModel, columns: list[str] | None = None) -> DataFrame:
    """docs' doc_id (or the named columns) with held_out, lang_pred, score and rejected."""
    carried = columns or ["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*carried, F.col("text").alias("__text"), held_out().alias("held_out"))
    schema = source.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 8 << 20):
            got = [predict_one(held.value, t) for t in batch.column("__text").to_pylist()]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "__text"]
            more = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + more, [batch.schema.names[i] for i in keep] + ["lang_pred", "score", "rejected"])

    return source.mapInArrow(run, schema)
