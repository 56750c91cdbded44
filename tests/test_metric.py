"""Vector cells: exact searches and joins against every pair, and what the bounds leave out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.operators import metric, neardup

SCHEMA = "id long, vector array<double>"


@pytest.fixture(scope="module")
def vectors():
    """Clusters, copies, noise, another length, and what matches nothing."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 24))
    near = [m + rng.normal(size=24) * 0.15 for m in middle for _ in range(20)]
    rows = [(i, v.tolist()) for i, v in enumerate([*near, *rng.normal(size=(100, 24)), *[middle[0]] * 30])]
    short = [(2000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))]
    return rows + short + [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [1.0, None, 2.0]), (3004, [float("nan")] * 24), (3005, [1e200] * 24), (3006, [1e200] * 24)]


def every_pair(rows, queries, least):
    out = []
    for q, x in queries:
        for i, y in rows:
            if x and y and len(x) == len(y) and None not in [*x, *y] and not np.isnan(x + y).any() and any(x) and any(y):
                a, b = np.array(x) / max(map(abs, x)), np.array(y) / max(map(abs, y))
                s = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
                if s >= least:
                    out.append((q, i, round(s, 6)))
    return out


@pytest.mark.parametrize("threshold", [0.85, 0.97, 0.3])
def test_pairs_are_all_pairs(spark, vectors, threshold):
    cells = metric.partition(spark.createDataFrame(vectors, SCHEMA).repartition(4), "id", "vector")
    found, report = metric.pairs(cells, threshold)
    assert sorted((r.a, r.b, round(r.score, 6)) for r in found.collect()) == sorted(p for p in every_pair(vectors, vectors, threshold) if p[0] < p[1])
    n = len(vectors)
    compared = report.agg(F.sum("compared")).first()[0]
    assert compared <= n * (n - 1) // 2 and (threshold < 0.85 or compared < n * n / 20)


@pytest.mark.parametrize(("k", "least"), [(1, 0.0), (7, 0.0), (5, 0.9), (None, 0.8)])
def test_search_finds_the_nearest(spark, vectors, tmp_path, k, least):
    metric.write_index(metric.partition(spark.createDataFrame(vectors, SCHEMA), "id", "vector"), str(tmp_path / "v"))
    cells = metric.open_index(spark, str(tmp_path / "v"))
    asked = vectors[::17] + vectors[-8:] + [(9000, [1.0, 2.0])]
    hits, report = metric.search(cells, spark.createDataFrame(asked, SCHEMA).withColumnRenamed("id", "query_id"), k, least)

    def best(rows):
        out = {}
        for q, i, s in rows:
            out.setdefault(q, []).append((-s, i))
        return {q: sorted(x)[:k] for q, x in out.items()}

    assert best((r.query_id, r.id, round(r.score, 6)) for r in hits.collect()) == best(every_pair(vectors, asked, least))
    seen = report.agg(F.sum("cells").alias("cells"), F.sum("visited").alias("visited")).first()
    assert seen.visited < seen.cells if k == 1 else seen.visited <= seen.cells


def test_a_join_that_reaches_most_cells_takes_one(spark, vectors):
    held = spark.createDataFrame([r for r in vectors if r[1] and len(r[1]) == 24], SCHEMA)
    assert len(metric.partition(held, "id", "vector", threshold=0.0).shape) == 1 < len(metric.partition(held, "id", "vector", threshold=0.95).shape)


def test_every_vector_is_in_one_cell_within_its_shape(spark, vectors):
    cells = metric.partition(spark.createDataFrame(vectors, SCHEMA), "id", "vector", cells=5)
    rows = cells.rows.collect()
    assert sorted(r.id for r in rows) == sorted(i for i, v in vectors if v and None not in v and not np.isnan(v).any() and any(v))
    for r in rows:
        first, c = cells.centroids[r.dims]
        t = np.arccos(np.clip(c @ np.array(r.vector), -1, 1))
        assert first + t.argmin() == r.cell and cells.shape[r.cell][1] <= r.angle <= cells.shape[r.cell][2]


def test_a_hot_group_of_copies_is_one_vector_of_the_clusters(spark):
    rows = [(i, [1.0, 0.0, 0.1]) for i in range(400)] + [(500, [1.0, 0.02, 0.1]), (501, [0.0, 1.0, 0.0]), (502, None)]
    roots = {r.id: r.root for r in neardup.linked(spark.createDataFrame(rows, SCHEMA), 0.95).collect()}
    assert roots == {i: 0 for i in range(400)} | {500: 0, 501: 501}


def test_nothing_and_one_vector(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])]):
        held = spark.createDataFrame(rows, SCHEMA)
        cells = metric.partition(held, "id", "vector")
        assert metric.pairs(cells, 0.5)[0].count() == 0
        assert metric.search(cells, held.withColumnRenamed("id", "query_id"), 3)[0].count() == (1 if rows and rows[0][1] else 0)


def test_noise_is_searched_in_plain_blocks_and_sent_to_cells_in_slices(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 48)))], "id int, vector array<double>")
    assert len(metric.partition(rows, "id", "vector").shape) == 1
    batch = metric.valid(rows, "id", "vector").toArrow().combine_chunks().to_batches()[0]
    found = [r for _, r, x in metric.by_length(batch) if len(x) <= metric.SLICE]
    assert np.concatenate(found).tolist() == list(range(batch.num_rows))
