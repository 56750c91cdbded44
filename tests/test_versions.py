"""Versions of tables: updates by bucket, writers that meet, crashes, and cleaning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnmill.operators import relational
from tarnmill.sources.versions import Conflict, Table


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def upsert(old, new):
    return relational.upsert(old, new, ["k"])


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def test_updates_and_old_versions(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", "k", 4)
    assert table.version() == 0
    with pytest.raises(ValueError):
        table.read()
    first = [(n, "a") for n in range(20)] + [(None, "none")]
    assert table.replace(frame(spark, first)) == 1
    before = table.read()
    assert table.update(spark.createDataFrame([("3", "b", 1), (None, "c", 1), ("99", "d", 1)], "k string, v string, more int"), upsert) == 2
    assert rows(table.read()) == sorted([(n, "b" if n == 3 else "a") for n in range(20)] + [(None, "c"), (99, "d")], key=repr)
    assert rows(table.read(1)) == rows(before) == sorted(first, key=repr)
    assert table.update(frame(spark, []), upsert) == 2 and table.version() == 2
    assert table.replace(table.read().filter("k = 3")) == 3 and rows(table.read()) == [(3, "b")]
    assert table.update(frame(spark, [(3, "x")]), lambda old, new: old.join(new, "k", "left_anti")) == 4 and rows(table.read()) == []
    assert table.update(frame(spark, [(5, "y")]), upsert) == 5 and rows(table.read()) == [(5, "y")]
    with pytest.raises(ValueError):
        table.read(9)


def test_untouched_buckets_stay_where_they_are(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", "k", 16)
    table.replace(frame(spark, [(n, "a") for n in range(200)]))
    table.update(frame(spark, [(7, "b")]), upsert)
    one, two = table._held(1)["folders"], table._held(2)["folders"]
    assert len(one) == 16 and sum(one[b] != two[b] for b in one) == 1
    with pytest.raises(Exception, match="a row for a key that no change has"):
        table.update(frame(spark, [(7, "b")]), lambda old, new: old.unionByName(frame(spark, [(n, "z") for n in range(50)])))
    assert table.version() == 2


@pytest.mark.parametrize("other", [7, 8])
def test_two_writers_lose_nothing(spark, tmp_path, other):
    """Another writer commits while the change is computed: in the same bucket it is computed again, elsewhere it is not."""
    table = Table(spark, f"{tmp_path}/t", "k", 1 if other == 7 else 1000)
    table.replace(frame(spark, [(n, "0") for n in range(10)]))
    calls = []

    def slow(old, new):
        calls.append(1)
        if len(calls) == 1:
            Table(spark, f"{tmp_path}/t", "k").update(frame(spark, [(other, "w")]), lambda o, c: o.join(c.select("k"), "k", "left").withColumn("v", F.when(F.col("k") == other, F.concat("v", F.lit("w"))).otherwise(F.col("v"))))
        return old.withColumn("v", F.when(F.col("k") == 7, F.concat("v", F.lit("+"))).otherwise(F.col("v")))

    assert table.update(frame(spark, [(7, "+")]), slow) == 3
    want = {n: "0" for n in range(10)}
    want[other] += "w"
    want[7] += "+"
    assert rows(table.read()) == sorted(want.items(), key=repr) and len(calls) == (2 if other == 7 else 1)


def test_a_writer_that_never_wins(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t", "k", 1)
    table.replace(frame(spark, [(1, "a")]))

    def beaten(old, new):
        table.replace(frame(spark, [(1, "b")]))
        return upsert(old, new)

    with pytest.raises(Conflict):
        table.update(frame(spark, [(1, "c")]), beaten, attempts=2)
    assert rows(table.read()) == [(1, "b")]


def test_a_crash_before_the_commit_and_cleaning(spark, tmp_path, monkeypatch):
    table = Table(spark, f"{tmp_path}/t", "k", 4)
    table.replace(frame(spark, [(n, "a") for n in range(10)]))
    with monkeypatch.context() as m:
        m.setattr(Table, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            table.update(frame(spark, [(1, "b")]), upsert)
    assert table.version() == 1 and rows(table.read()) == [(n, "a") for n in range(10)]
    table.update(frame(spark, [(2, "c")]), upsert)
    assert len(table._names("data")) == 3
    table.clean(keep=2)
    assert len(table._names("data")) == 2 and rows(table.read(1)) == [(n, "a") for n in range(10)]
    table.replace(frame(spark, [(1, "z")]))
    table.clean()
    assert len(table._names("data")) == 1 and table._names("versions") == ["000000000003"] and rows(table.read()) == [(1, "z")]


def test_status_maps_and_contents(spark, tmp_path):
    """Partial status documents and one content a page, as updates of versions."""
    jobs = Table(spark, f"{tmp_path}/jobs", "job_id", 4)
    jobs.replace(spark.sql("select * from values ('j', map('status', 'new', 'refine_x', '1')), ('k', map('status', 'new')) as t(job_id, state)"))
    merge = lambda old, new: old.join(new.select("job_id", F.col("state").alias("more")), "job_id", "left").withColumn("state", F.when(F.col("more").isNull(), F.col("state")).otherwise(relational.merge_status(F.col("state"), F.col("more"))))
    jobs.update(spark.sql("select 'j' as job_id, map('status', 'done') as state"), merge)
    assert {r.job_id: r.state for r in jobs.read().collect()} == {"j": {"status": "done"}, "k": {"status": "new"}}
    pages = Table(spark, f"{tmp_path}/pages", "k", 4)
    pages.replace(frame(spark, [(1, "old"), (1, "older"), (2, "kept")]))
    fresh = spark.createDataFrame([(1, "x", 1), (1, "new", 2)], "k long, v string, n int")
    pages.update(fresh, lambda old, new: relational.replace_content(old, new, "k", [-F.col("n")]))
    assert rows(pages.read()) == [(1, "new"), (2, "kept")]
