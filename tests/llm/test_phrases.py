"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.llm import collocations as C
from tests.llm.conftest import SCHEMA


def plain(rows, least, keep, most=4):
    """All phrases counted one by one."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, most + 1):
                for s in range(len(words) - k + 1):
                    f[lang, tuple(words[s : s + k])] += 1
    many = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    longer = {}
    for (lang, words), a in many.items():
        for m in range(2, len(words)):
            for s in range(len(words) - m + 1):
                key = (lang, words[s : s + m])
                longer[key] = max(longer.get(key, 0), a)
    out = []
    for (lang, words), a in many.items():
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        if 100 * longer.get((lang, words), 0) < 80 * a:
            out.append((lang, " ".join(words), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:keep]
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def phrase_rows():
    rng, pool = random.Random(5), "Of THE the rain É é ﬁn a b tab Straße in on 東京 x_y".split(" ")
    make = lambda n: "".join(rng.choice(pool) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "; ", "\r\n", "?"]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "en", "fr", None, "und"]), make(rng.randint(0, 60))) for _ in range(60)]
    return rows + [("en", None), (None, None), ("de", ""), ("de", " .. \n"), ("en", "the rain in " * 40), ("en", "the rain in " * 40), ("xx", "one more " * 3000 + ". " + make(2000))]


def docs(spark, rows, n=3):
    return spark.createDataFrame([(i, t, g, "s", 1, 7, 0.5, 1, "x", 2, "g", "b", "h") for i, (g, t) in enumerate(rows)], SCHEMA).repartition(n)


@pytest.mark.parametrize(("least", "keep", "shard"), [(3, 2000, 400), (2, 7, 1 << 20), (30, 2000, 3000)])
def test_collocations_are_those_of_a_plain_count(spark, phrase_rows, least, keep, shard):
    got = C.collocations(docs(spark, phrase_rows), least, keep=keep, shard_bytes=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {d for c, d in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == plain(phrase_rows, least, keep)


def test_collocations_do_not_depend_on_the_order_in_which_marks_arrive(spark, phrase_rows, monkeypatch):
    """Level three is listed once with the marks in one order, and once more, to be extended, with them the other way round."""
    plainly, way = C.extended, {3: F.col("at"), 4: F.col("at").desc()}
    turned = lambda words, found, level: plainly(words, found if found is None else found.coalesce(1).sortWithinPartitions(way[level]), level)
    monkeypatch.setattr(C, "extended", turned)
    assert sorted(map(tuple, C.collocations(docs(spark, phrase_rows), 3).collect())) == plain(phrase_rows, 3, 2000)


def test_collocations_of_nothing(spark):
    assert C.collocations(docs(spark, [])).count() == C.collocations(docs(spark, [("en", None)])).count() == 0


def test_parts_of_a_text_break_no_piece():
    text = b"aa bb. cc dd ee ff gg hh ii, jj kk; ll"
    for most in range(1, 45):
        found = list(C.parts(text, most))
        assert b"".join(found) == text and all(p[-1:] in (b".", b",", b";") for p in found[:-1])


def test_packed_lists_come_back():
    counts, places = np.array([3, 1, 2]), np.array([5, 9, 1_000_000, 4, 0, 2**31 - 1], np.int32)
    assert C.unpacked(counts, C.packed(counts, places)).tolist() == places.tolist()


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.sql("select cast(9000000000000 as decimal(20,0)) * 2000000 div cast(17999999999999 as decimal(20,0)) x").first()
    assert row.x == 9_000_000_000_000 * 2_000_000 // 17_999_999_999_999
