"""Cases of the record operators that the synthetic tables do not have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tarnmill.functions import text as T
from tarnmill.functions import vectors as V
from tarnmill.operators import refine, relational, retrieval
from tarnmill.sources import readers
from tarnmill.streaming import progress


def test_transitions_keep_the_first_start_and_leave_other_rows(spark):
    rows = spark.createDataFrame([(1, "new", None, "e"), (2, "running", "a", "e"), (None, "new", None, "e")], "job_id long, status string, started_at string, error_message string")
    got = relational.transition(rows, F.col("job_id") > 0, "done", F.lit("now")).collect()
    assert [tuple(r) for r in got] == [(1, "done", "now", None), (2, "done", "a", None), (None, "new", None, "e")]
    bare = relational.transition(rows.select("job_id", "status"), F.lit(True), "done", F.lit("now"))
    assert {r.status for r in bare.collect()} == {"done"} and bare.columns == ["job_id", "status"]


def test_group_means(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", None), ("a", [3.0, 6.0]), ("b", [1.0]), ("b", [1.0, 2.0]), ("c", None), ("c", []), (None, [4.0])], "k string, v array<double>")
    got = {r.k: r["mean"] for r in V.group_mean(rows.filter("k is not null"), "k", "v").collect()}
    assert got == {"a": [2.0, 4.0], "b": None, "c": None}


def test_upload_limits_fall_back_to_the_prompt_type():
    found = {"upload": {"csv": {"qa": {"max_chars": 1}}, "qa": {"max_chars": 2}, "txt": {"plain": {"max_chars": 3}}}}
    assert readers.upload_limits(found, " CSV", "qa") == {"max_chars": 1} and readers.upload_limits(found, "pdf", "qa") == {"max_chars": 2}
    assert readers.upload_limits(found, "text", "plain") == {"max_chars": 3} and readers.upload_limits(found, "text", "qa") == {"max_chars": 2}
    for bad in (None, {}, {"upload": {}}):
        with pytest.raises(ValueError):
            readers.upload_limits(bad, "csv", "qa")
    with pytest.raises(ValueError):
        readers.upload_limits(found, "csv", "plain")


def test_requests_are_checked():
    assert readers.checked_request("upload", " QA ", " a.sqlite ") == ("upload", "qa", "a.sqlite")
    for bad in (("mail",), ("upload", "x"), ("upload", "qa", "a/b.sqlite"), ("upload", "qa", "a"), ("upload", "qa", " ")):
        with pytest.raises(ValueError):
            readers.checked_request(*bad)


def test_back_off_grows_with_each_failure(spark, tmp_path):
    log = str(tmp_path / "log")

    def generate(prompt):
        import time

        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        raise OSError("down")

    row = refine.execute_chunks(spark.createDataFrame([(1, "p")], "chunk_id long, prompt string"), generate, tries=3, pause=0.2).first()
    at = [float(x) for x in open(log)]
    assert row.error == "down" and len(at) == 3 and at[1] - at[0] >= 0.2 and at[2] - at[1] >= 0.4


def test_details_are_those_listed(spark):
    listing = spark.createDataFrame([("1", "t"), ("1", "t"), ("", "x"), (None, "x")], "issue_id string, title string")
    details = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("", "d")], "issue_id string, speech string")
    assert sorted(r.speech for r in readers.read_details(listing, details, "issue_id").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_details(listing, details, "speech")


def test_sizes_of_stored_objects(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.txt").write_text("12345")
    objects = readers.stored_objects(spark, str(tmp_path))
    path = objects.first().path
    files = spark.createDataFrame([(1, "a.txt", path, 1), (2, "b.txt", "gone", 3)], "file_id long, file_name string, path string, created_at long")
    assert [(r.file_id, r.title, r.file_size) for r in readers.uploads(files, objects).collect()] == [(2, "b.txt", None), (1, "a.txt", 5)]


def test_query_and_index_terms_differ(spark):
    tokens = [("走っ", "走る", "動詞"), ("た", "た", "助動詞"), ("犬", "*", "名詞"), ("7", "7", "数"), ("ね", "ね", "副詞"), ("東京", None, "名詞"), ("東京", "東京", "名詞"), (" ", "", "x"), ("。。", "。。", "記号"), ("ab", "ab", None)]
    found = retrieval.analysed(spark.createDataFrame([("x",), (None,), (" ",)], "text string"), "text", lambda _: tokens)
    rows = found.select(retrieval.index_terms(F.col("tokens")).alias("i"), retrieval.asked_terms(F.col("tokens")).alias("a")).collect()
    assert rows[0].i == ["走っ", "走る", "東京", "。。", "ab"] and rows[0].a == ["走る", "犬", "7", "東京", "ab"]
    assert rows[1].i == rows[1].a == rows[2].i == []


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "id long, embedding array<double>")
    queries = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, retrieval.vector_hits(queries, rows, "id").collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    assert sorted(map(tuple, retrieval.vector_hits(queries, rows, "id").collect())) == want


def test_many_terms_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the w{i % 5} x{i % 3} the") for i in range(30)], "id long, text string")
    terms = spark.createDataFrame([(q, w) for q in range(3) for w in ("the", f"w{q}", "x1", "zz")], "query_id long, term string")
    score = lambda: sorted((r.query_id, r.id, round(r.score, 9)) for r in retrieval.bm25(*retrieval.build_index(docs, "id", "text", terms), terms, "id").collect())
    want = score()
    full = sorted((r.query_id, r.id, round(r.score, 9)) for r in retrieval.bm25(*retrieval.build_index(docs, "id", "text"), terms, "id").collect())
    monkeypatch.setattr(retrieval, "small", lambda *_: False)
    assert score() == want == full


def test_strip_takes_what_isspace_takes(spark):
    odd = [chr(c) for c in range(0x3002) if chr(c).isspace()] + ["​", "x"]
    rows = spark.createDataFrame([(f"{c}a{c}b{c}",) for c in odd] + [(None,), ("　\x1c \t",)], "s string")
    assert [r.o for r in rows.select(T.strip(F.col("s")).alias("o")).collect()] == [f"{c}a{c}b{c}".strip() for c in odd] + ["", ""]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string"
    at = lambda h, m, kind, user=1: spark.createDataFrame([(f"2024-01-01 {h:02}:{m:02}:00", user, kind)], "ts string, user_id long, event_type string").selectExpr("cast(ts as timestamp) ts", "user_id", "event_type")
    path, folder = str(tmp_path / "events"), str(tmp_path / "state")
    read = lambda: sorted((r.window_start.hour, r.job_id, r.events, r.done, r.errors) for r in progress.follow(spark, path, S.StructType.fromDDL(schema), folder).collect())
    at(1, 5, "purchase").unionByName(at(1, 50, "view")).write.mode("append").parquet(path)
    assert read() == [(1, 1, 2, 1, 0)]
    at(1, 59, "error").unionByName(at(2, 1, "view", 2)).write.mode("append").parquet(path)
    assert read() == [(1, 1, 3, 1, 1), (2, 2, 1, 0, 0)]
    assert read() == [(1, 1, 3, 1, 1), (2, 2, 1, 0, 0)]
