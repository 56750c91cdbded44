from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tarnmill.llm import language_id, toxicity
from tests.llm.conftest import words

SETS = {"aa": "ka lo mi ru te sa no vi", "bb": "schu ber ung ach ei zt", "cc": "eau oi çre tion ê lle"}


def fold(i):
    return zlib.crc32(str(i if i is not None else "").encode()) % 4 == 2


@pytest.fixture(scope="module")
def multilingual(spark):
    rows = [(i, words(i, 5 + i % 60, SETS[k]), k) for i in range(600) for k in [sorted(SETS)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy(multilingual):
    found = language_id.predict(multilingual, language_id.train(multilingual)).toPandas().set_index("doc_id")
    lang = multilingual.toPandas().set_index("doc_id")["lang"]
    assert list(found.held_out) == [fold(i) for i in found.index]
    tested = found[found.held_out]
    assert (tested.lang_pred == lang[tested.index]).mean() > 0.97
    assert found.score.between(0, 1).all() and found.rejected.mean() < 0.02


def test_language_never_learns_from_the_held_out_fold(multilingual):
    from pyspark.sql import functions as F

    poisoned = multilingual.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    assert language_id.train(poisoned).languages == sorted(SETS)


def test_language_edges(make, edge_rows, multilingual):
    model = language_id.train(multilingual)
    got = language_id.predict(make([*edge_rows, (30, "123 !?")]), model).collect()
    assert len(got) == len(edge_rows) + 1
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, None, 30}
    assert all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    assert language_id.predict(make([]), model).count() == 0


def test_language_without_labels(make):
    docs = make([(1, "kalo")])
    model = language_id.train(docs.drop("lang").selectExpr("*", "cast(null as string) lang"))
    assert language_id.predict(docs, model).first().lang_pred == "und"


def test_long_texts_score_like_short_ones(multilingual):
    model = language_id.train(multilingual)
    text = words(5, 400, SETS["bb"])
    old, language_id.SEGMENT = language_id.SEGMENT, 100
    try:
        parts = language_id.predict_one(model, text)
    finally:
        language_id.SEGMENT = old
    assert parts == language_id.predict_one(model, text) and parts[0] == "bb"


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 50])
def test_cut_texts_have_the_grams_of_whole_ones(segment, monkeypatch):
    text = "Kalo miru, İSTANBUL ΣΑΣ 😀 ß42 " + words(4, 30)
    want = np.sort(language_id.grams(text, 1 << 16))
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    assert (np.sort(language_id.grams(text, 1 << 16)) == want).all()


# Toxicity


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_accepts_exactly_what_is_near():
    terms = ["idiot", "moron", "worthless", "pathetic", "scum", "abc"]
    fuzzy, rng = toxicity.FuzzyLexicon(terms), random.Random(1)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "x", "o", "t"])
        if len(w) > 2 and rng.random() < 0.3:
            at = rng.randrange(len(w) - 1)
            w[at], w[at + 1] = w[at + 1], w[at]
        word = "".join(w)
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= toxicity.allowed_edits(t)]
        assert fuzzy.find(word) == ((min(near)[1], min(near)[0]) if near else None), word


def test_stems_take_any_ending():
    fuzzy = toxicity.FuzzyLexicon(["lowe*", "idiot"])
    assert fuzzy.find("loweiung") == ("lowe*", 0) and fuzzy.find("lowa") is None and fuzzy.find("idoit") == ("idiot", 1)


def test_a_document_counts_once_for_a_stem(spark):
    rows = [(f"abcdone abcdtwo abcdthree abcdfour abcdfive {words(i, 5)}", 1) for i in range(3)] + [(words(i, 8), 0) for i in range(60)]
    terms, edits = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), share=0.0)
    assert terms["abcd*"] == pytest.approx(np.log(3.5 / 4) - np.log(0.5 / 61))
    assert edits["abcd*"] == 0 and edits["abcdthree"] == 2  # a common whole term stays beside its stem


def test_automaton_forgets_when_it_is_full(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 20)
    fuzzy = toxicity.FuzzyLexicon(["idiot", "worthless"])
    for i in range(300):
        fuzzy.find(words(i, 1))
        assert fuzzy.find("idoit") == ("idiot", 1) and len(fuzzy.sets) < 100


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = random.Random(2), [], []
    for i in range(1200):
        w = words(i, 60).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["idiot", "moron", "scum"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").toPandas()
    tested = got[got.held_out]
    assert (tested.predicted == tested.toxic).mean() > 0.98 and got.score.between(0, 1).all()


def test_misspelled_terms_are_caught_and_quotations_are_not(labelled):
    scorer = toxicity.Scorer(toxicity.fit(*labelled))
    plain, spelled = (scorer.score(words(9, 30) + t) for t in (" idiot moron idiot", " idoit mor0n idiiot"))
    quoted = scorer.score(words(9, 30) + ' they said "idiot" and called me "moron"')
    assert plain >= 0.3 and spelled >= 0.3 and quoted < 0.3


def test_toxicity_edges(make, edge_rows, labelled):
    model = toxicity.fit(*labelled)
    got = toxicity.score(make(edge_rows), model).collect()
    assert len(got) == len(edge_rows) and all(r.predicted == 0 for r in got)
    assert toxicity.score(make([]), model).count() == 0
    empty = toxicity.fit(labelled[0], labelled[1].filter("toxic > 9"))
    assert toxicity.score(make([(1, "x")]), empty).first().score == 0.0
