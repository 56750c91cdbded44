"""The stored full-text index: what it finds is what scoring every document finds."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from tarnmill.operators import retrieval, search_index
from tarnmill.sources import sinks

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def entries(spark):
    """Common and rare words, ties, equal and empty texts, nulls."""
    rng = random.Random(4)
    rows = [(f"d{i:04d}", " ".join(rng.choices(WORDS, [1 / (j + 1) ** 1.5 for j in range(60)], k=rng.randint(1, 40))), rng.choice(["qa", "plain"])) for i in range(700)]
    rows += [(f"t{i}", "w5 w50 w50", "plain") for i in range(40)] + [("n1", None, "plain"), ("n2", "", None), ("n3", " .,", "qa")]
    return spark.createDataFrame(rows, "id string, text string, kind string").repartition(3)


@pytest.fixture(scope="module")
def terms(spark):
    rng = random.Random(5)
    rows = [(q, t) for q in range(12) for t in rng.sample(WORDS, rng.randint(1, 6))] + [(20, "w50"), (20, "w50"), (20, "w5"), (21, "nowhere"), (22, "w0")]
    return spark.createDataFrame(rows, "query_id int, term string")


def best(scores, key, k):
    rounded = scores.withColumn("score", F.round("score", 6))
    top = retrieval.top(rounded, ["query_id"], [F.col("score"), F.col(key)], k)
    return sorted((r.query_id, r.rank, r[key], r.score) for r in top.collect())


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_stored_index_finds_what_full_scoring_finds(spark, entries, terms, tmp_path, k):
    path = str(tmp_path / "index")
    assert search_index.append(entries, path, "all", "id", "text", "kind", range_docs=16)
    index = search_index.open_index(spark, path)
    whole = retrieval.bm25(*retrieval.build_index(entries, "id", "text"), terms, "id")
    hits, report = search_index.search(index, terms, k)
    assert best(hits, "key", k) == best(whole, "id", k)
    counts = report.agg(F.sum("blocks"), F.sum("skipped")).first()
    assert (counts[1] > counts[0] // 4) if k == 1 else counts[1] == 0 if k == 1000 else counts[1] >= 0
    plain = whole.join(entries.filter("kind = 'plain'"), "id", "left_semi")
    assert best(search_index.search(index, terms, k, "plain")[0], "key", k) == best(plain, "id", k)


def test_a_span_of_ranges_gives_its_best_documents_alone(spark, entries, terms, tmp_path):
    """47 ranges are two spans; a query gets k documents of each, and the 40 that tie. Query 22 asks for a word of no weight, so all tie."""
    search_index.append(entries, str(tmp_path / "index"), "all", "id", "text", "kind", range_docs=16)
    hits = search_index.search(search_index.open_index(spark, str(tmp_path / "index")), terms, 3)[0]
    assert max(r["count"] for r in hits.filter("query_id <> 22").groupBy("query_id").count().collect()) <= 2 * 3 + 40


def test_deltas_make_the_same_index_and_count_once(spark, entries, terms, tmp_path):
    path = str(tmp_path / "index")
    parts = [entries.filter(F.pmod(F.hash("id"), F.lit(3)) == i) for i in range(3)]
    for i, part in enumerate(parts):
        assert search_index.append(part, path, f"delta{i}", "id", "text", "kind", range_docs=16)
        assert not search_index.append(part, path, f"delta{i}", "id", "text", "kind", range_docs=16)
    whole = retrieval.bm25(*retrieval.build_index(entries, "id", "text"), terms, "id")
    assert best(search_index.search(search_index.open_index(spark, path), terms, 10)[0], "key", 10) == best(whole, "id", 10)
    shutil.rmtree(f"{path}/segment=delta1/stats")  # as a delta that broke off
    assert search_index.segments(spark, path) == ["delta0", "delta2"]
    assert search_index.append(parts[1], path, "delta1", "id", "text", "kind", range_docs=16)
    assert best(search_index.search(search_index.open_index(spark, path), terms, 10)[0], "key", 10) == best(whole, "id", 10)


def test_index_of_nothing_and_of_no_index(spark, entries, terms, tmp_path):
    with pytest.raises(ValueError):
        search_index.open_index(spark, str(tmp_path / "none"))
    search_index.append(entries.limit(0), str(tmp_path / "empty"), "a", "id", "text")
    index = search_index.open_index(spark, str(tmp_path / "empty"))
    assert search_index.search(index, terms, 3)[0].count() == index.postings().count() == 0


def test_search_by_the_stored_index_of_a_database(spark, entries, tmp_path):
    held = entries.select(F.col("id").alias("entry_id"), F.col("kind").alias("knowledge_type"), F.col("text").alias("search_text"), F.lit(0).alias("sort_no"), F.lit("").alias("created_at"))
    sinks.build_search_db(held, str(tmp_path), "db", "upload")
    sinks.build_search_db(held, str(tmp_path), "db", "upload")  # a build replaces the one before
    loose = {"fts": {"strong_bm25_max": 0, "weak_bm25_max": 0, "top_k": 7}}
    find = lambda **more: sorted((r.entry_id, r.rank, round(r.score, 9)) for r in retrieval.search(spark, held, "w3 w40\nw50", "plain_fts", loose, **more).collect())
    stored = find(index=sinks.open_search_index(spark, str(tmp_path), "db"))
    assert stored == find() and len(stored) == 7
