"""Toxicity (4): Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon is learned: words far commoner in documents labelled toxic than in the others, and stems ("abc*") that do so
with many endings. The automaton that accepts everything within one edit of a term (two for terms of eight letters or
more; a swap of neighbours is one edit; a stem may go on in any way) walks the trie of terms, and its states are made
once and kept, so reading a word costs one step a letter. Words of clean labelled rows that it accepts by accident are
learned as exceptions, from one half of the sample for the features of the other half, so the weights are honest. Each hit is weighed by its edits and by the words
around it: inside quotation marks, or beside words of speech, it counts as a quotation. A logistic regression on sums of
these weights gives the score.

Null text counts as empty; empty texts get the score of a document without hits. Without labels of both kinds the lexicon
is empty and every score is the share of toxic rows (0 with no labels). Null or repeated doc_ids are carried through;
label rows of one doc_id that disagree are all used. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import bounded_sample, drop_staged, held_out, slices, staged

WORD = re.compile(r"\w+")
WINDOW = 6
QUOTES = "\"'“”„«»‘’‹›"
#: Words that report what somebody else said (fixed values).
SPEECH = frozenset("said says say saying quote quoted quotes called calls word words wrote writes term slur insult insults shouted reported".split())
FEATURES = 5
STATES = 100_000  # an automaton that has made this many is begun anew, so a task's memory is bounded


class FuzzyLexicon:
    """The deterministic automaton of all words near a term, built state by state as words ask for it."""

    DEAD = 0

    def __init__(self, terms: list[str], edits: dict[str, int] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str] = [""]
        self.allowed: list[int] = [0]  # the most edits of any term at or below a node
        self.limits = {t: (edits or {}).get(t, allowed_edits(t)) for t in terms}
        for t in sorted(terms):
            node, most = 0, self.limits[t]
            self.allowed[0] = max(self.allowed[0], most)
            for c in t.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append("")
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], most)
            self.term[node] = t
        self._forget()

    def _forget(self) -> None:
        """Starts the automaton anew, with no state made yet but the first."""
        self.ids: dict[frozenset, int] = {frozenset(): self.DEAD}
        self.sets: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[str, int] | None] = [None]
        self.stems: list[tuple[int, str] | None] = [None]
        self.start = self._state({(0, 0, "")} if self.limits else set())

    def _state(self, places: set[tuple[int, int, str]]) -> int:
        best: dict[tuple[int, str], int] = {}
        todo = list(places)
        while todo:  # a letter of the term left out
            node, e, wait = todo.pop()
            if e > self.allowed[node] or best.get((node, wait), 99) <= e:
                continue
            best[node, wait] = e
            if not wait:
                todo += [(child, e + 1, "") for child in self.children[node].values()]
        key = frozenset((n, e, w) for (n, w), e in best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e, w in key if not w and self.term[n] and e <= self.limits[self.term[n]]]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
            self.stems.append(min(((e, t) for e, t in ends if t[-1] == "*"), default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, wait in self.sets[state]:
            if wait:
                if c == wait:
                    out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))
            for x, child in self.children[node].items():
                out.add((child, e if x == c else e + 1, ""))
                if x != c and c in self.children[child]:  # x and c swapped
                    out.add((self.children[child][c], e + 1, x))
        return self._state(out)

    def find(self, word: str) -> tuple[str, int] | None:
        """(nearest term, edits), or None if no term is near enough."""
        if len(self.sets) > STATES:
            self._forget()
        state, stem = self.start, None
        for c in word:
            known = self.steps[state]
            to = known.get(c)
            if to is None:
                to = self._step(state, c)
                if len(known) < 4096:
                    known[c] = to
            if to == self.DEAD:
                return stem and (stem[1], stem[0])
            state = to
            if self.stems[state] and (stem is None or self.stems[state] < stem):
                stem = self.stems[state]
        whole = self.accepts[state]
        return whole if whole and (stem is None or whole[1] <= stem[0]) else stem and (stem[1], stem[0])


def allowed_edits(term: str) -> int:
    if term.endswith("*"):
        return 0 if len(term) < 8 else 1
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)  # term or stem*: log odds
    edits: dict[str, int] = field(default_factory=dict)  # how far a misspelling of a term may be
    exceptions: frozenset = frozenset()
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -math.inf


class Scorer:
    """A model with its automaton and the words seen so far, for one task."""

    def __init__(self, model: ToxicityModel):
        self.model, self.fuzzy = model, FuzzyLexicon(list(model.lexicon), model.edits)
        self.seen: dict[str, tuple[str, int] | None] = {}

    def hit(self, word: str) -> tuple[str, int] | None:
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) > 200_000:
            self.seen.clear()
        got = self.fuzzy.find(word)
        if got and got[1] and word in self.model.exceptions:
            got = None
        self.seen[word] = got
        return got

    def features(self, text: str | None) -> np.ndarray:
        """Weights of exact, misspelled and quoted hits, the densest window, and hits a hundred words."""
        text = (text or "").lower()
        n = hits = 0
        exact = fuzzy = quoted = 0.0
        recent: list[tuple[int, float]] = []
        dense = 0.0
        for n, m in enumerate(WORD.finditer(text), 1):
            got = self.hit(m[0])
            if not got:
                continue
            weight = min(self.model.lexicon[got[0]], 8.0) / 8 / (1 + got[1])
            hits += 1
            if is_quoted(text, m.start(), m.end()):
                quoted += weight
                continue
            exact, fuzzy = (exact + weight, fuzzy) if not got[1] else (exact, fuzzy + weight)
            recent = [(at, w) for at, w in recent if at > n - WINDOW] + [(n, weight)]
            dense = max(dense, sum(w for _, w in recent))
        return np.array([math.log1p(4 * exact), math.log1p(4 * fuzzy), math.log1p(quoted), dense, math.log1p(100 * hits / n) if n else 0.0])

    def score(self, text: str | None) -> float:
        m = self.model
        z = float((self.features(text) - m.mean) / m.scale @ m.weights + m.bias)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit is somebody else's word: marks on both sides within the window, or a word of speech before it."""
    before, after = text[max(0, start - 60) : start], text[end : end + 60]
    left = WORD.findall(before)[-WINDOW:]
    if any(w in SPEECH for w in left[-3:]):
        return True
    opens = max(before.rfind(q) for q in QUOTES)
    if opens < 0 or len(WORD.findall(before[opens:])) > WINDOW or (opens and before[opens] in "'’" and before[opens - 1].isalnum()):
        return False
    closes = [at for q in QUOTES if (at := after.find(q)) >= 0 and not (q in "'’" and after[at + 1 : at + 2].isalnum())]
    return bool(closes) and len(WORD.findall(after[: min(closes)])) <= WINDOW


def learn_lexicon(train: DataFrame, size: int = 400, odds: float = 3.0, share: float = 0.01, sure: float = 0.03, endings: int = 5) -> tuple[dict[str, float], dict[str, int]]:
    """Terms of train(text, toxic) with log odds of at least `odds` that `share` of the toxic rows have, the surest `size`.

    A stem (four letters or more, written with a star) needs `endings` different words. What a stem covers is left out.
    Terms that fewer than a share `sure` of the toxic rows have are taken as spelled; the second result has the edits. A
    whole term that more of them have stays beside a stem that covers it, since the stem may allow fewer edits.
    """
    total = train.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = int(total.t or 0), int((total.n or 0) - (total.t or 0))
    if not toxic or not clean:
        return {}, {}
    words = F.array_distinct(F.expr(r"regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{3,}', 0)"))
    stems = lambda w: [F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in range(4, 8)]
    # A row counts once for a stem, however many of its words have it: the row's own terms are made distinct first.
    terms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array_compact(F.array(w, *stems(w))))))
    counts = train.select("toxic", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    toxic_words = train.filter("toxic = 1").select(F.explode(words).alias("word"))
    forms = toxic_words.select("word", F.explode(F.array_compact(F.array("word", *stems(F.col("word"))))).alias("term"))
    score = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    found = counts.filter(F.col("t") >= max(3, share * toxic)).withColumn("s", score).filter(F.col("s") >= odds)
    top = found.orderBy((F.col("s") * F.sqrt(F.col("t"))).desc(), "term").limit(8 * size)
    variety = forms.join(F.broadcast(top), "term").groupBy("term", "s", "t").agg(F.approx_count_distinct("word").alias("endings"))
    rows = variety.filter(f"not endswith(term, '*') or endings >= {endings}").collect()
    chosen: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (not r.term.endswith("*"), len(r.term), r.term)):
        covered = any(r.term.rstrip("*").startswith(x[:-1]) for x in chosen if x[-1] == "*")
        if not covered or (r.term[-1] != "*" and r.t >= sure * toxic):
            chosen[r.term] = float(r.s) * r.t**0.5
    kept = sorted(chosen, key=lambda t: (-chosen[t], t))[:size]
    odds_of = {r.term: float(r.s) for r in rows}
    common = {r.term for r in rows if r.t >= sure * toxic}
    return {t: odds_of[t] for t in kept}, {t: allowed_edits(t) if t in common else 0 for t in kept}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, misspelled: float = 0.7) -> ToxicityModel:
    """Learns from at most about `sample` labelled rows outside the held-out fold, the only rows ever read with labels.

    Misspellings are too rare in such a sample to be weighed by it: they count at least `misspelled` times an exact hit.
    """
    spark = docs.sparkSession
    chosen = bounded_sample(labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")), F.col("doc_id"), sample)
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # `sample` bounds the broadcast side
    train = staged(train.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int")), "labelled")
    model = ToxicityModel(*learn_lexicon(train))
    lexicon, edits = list(model.lexicon), model.edits

    def accidents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuzzy, found = FuzzyLexicon(lexicon, edits), set()
        for batch in slices(batches):
            for text, half in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True):
                for w in set(WORD.findall((text or "").lower())):
                    if (got := fuzzy.find(w)) and got[1]:
                        found.add((w, half))
        pairs = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([h for _, h in pairs], pa.int32())], ["word", "half"])

    by_half: dict[int, set[str]] = {0: set(), 1: set()}
    if lexicon:
        for r in train.filter("toxic = 0").select("text", "half").mapInArrow(accidents, "word string, half int").distinct().collect():
            by_half[r.half].add(r.word)
    model.exceptions = frozenset(by_half[0] | by_half[1])
    halves = spark.sparkContext.broadcast({h: ToxicityModel(model.lexicon, model.edits, frozenset(by_half[1 - h])) for h in by_half})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {h: Scorer(m) for h, m in halves.value.items()}
        for batch in slices(batches):
            x = [scorers[h].features(t).tolist() for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    rows = train.mapInArrow(measure, "x array<double>, toxic int").toArrow()
    drop_staged(train)
    if not rows.num_rows:
        return model
    x, y = np.array(rows.column("x").to_pylist()).reshape(-1, FEATURES), np.array(rows.column("toxic").to_pylist(), float)
    model.mean, model.scale = np.zeros(FEATURES), np.maximum(x.std(0), 1e-3)
    model.weights, model.bias = logistic(x / model.scale, y)
    raw = model.weights / model.scale
    raw[1] = max(raw[1], misspelled * raw[0])
    model.weights = raw * model.scale
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(np.clip(w[-1], -30, 30))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in slices(batches):
            s = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
