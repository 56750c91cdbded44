"""Row numbers hold whatever splits a read has: over a table of 12 files, under other core counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnmill.llm import common, line_dedup, prob_minhash, suffix_dedup

from .conftest import words

SPLITS = "spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"


@pytest.fixture(scope="module")
def folder(make, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "docs")
    shared = words(7, 120)
    rows = [(i, f"{words(i % 40, 30)}\n{shared if i % 3 else words(900 + i, 20)}") for i in range(120)]
    make(rows, 12).write.parquet(path)
    return path


def under(spark, many, run):
    """What run() gives when reads are split small and wide (many), or packed into few parts."""
    old = {k: spark.conf.get(k, None) for k in SPLITS}
    for k, v in zip(SPLITS, ("8192", "12", "1") if many else ("128m", "2", "4m"), strict=True):
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_numbers_do_not_depend_on_the_splits(spark, folder):
    def numbers():
        return sorted(map(tuple, common.numbered(spark.read.parquet(folder).filter("doc_id is not null"), "at").select("doc_id", "at").collect()))

    few, many = under(spark, False, numbers), under(spark, True, numbers)
    assert few == many and len({at for _, at in few}) == 120


def test_derived_tables_are_staged_before_numbering(spark, folder):
    docs = spark.read.parquet(folder)
    assert common.is_scan(docs.select("doc_id", "text").filter("doc_id > 3"))
    for other in (docs.repartition(3), docs.orderBy("doc_id"), docs.join(docs.select("doc_id"), "doc_id"), docs.select(F.explode(F.split("text", " "))), spark.range(4)):
        assert not common.is_scan(other)
    assert common.numbered(docs.unionByName(docs), "at").select("at").distinct().count() == 240


@pytest.mark.parametrize("op", [line_dedup.dedup, suffix_dedup.dedup, lambda d: prob_minhash.dedup(d).drop("row")], ids=["lines", "suffixes", "near"])
def test_results_hold_when_the_splits_change_between_stages(spark, folder, op, monkeypatch):
    want = sorted(map(str, op(spark.read.parquet(folder)).collect()))
    plain, turn = common.staged, [0]

    def flipping(df, label):
        turn[0] += 1
        return under(spark, bool(turn[0] % 2), lambda: plain(df, label))

    for module in (line_dedup, suffix_dedup, prob_minhash):
        monkeypatch.setattr(module, "staged", flipping)
    assert sorted(map(str, op(spark.read.parquet(folder)).collect())) == want
