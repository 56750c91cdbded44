"""Cases that the synthetic tables do not reach, and comparisons with plain models."""

from __future__ import annotations

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnmill.functions import html, scoring, urls
from tarnmill.functions import text as T
from tarnmill.functions import vectors as V
from tarnmill.operators import chunking, jobs, neardup, refine, relational, retrieval, splitting
from tarnmill.plans import page_scoring
from tarnmill.sources import readers, sinks
from tarnmill.streaming import progress


def one(spark, value, form):
    return spark.createDataFrame([(value,)], "x string").select(form(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("form", "value", "want"),
    [
        (T.collapse, "　a  b\u001cc　", "a b c"), (T.collapse, None, ""), (T.strip, "  x ", "x"), (T.trim_lines, " a \r\n\r\n　\rb", "a\nb"),
        (T.clean_text, "﻿a\u0007  b\n\n\n\nc 123456789012345678901 d", "a b\n\nc d"), (T.clean_cell, "﻿ x\ty ", "x y"), (T.chunk_input, "[12] a   b", "a b"),
        (T.pdf_line, "[3] see https://x.y/z 2024/01/02 03:04:05 end  。", "see end。"), (T.clean_pdf, "12\nxiv\nbook.indd 3\n---\nreal\ntext", "real text"),
        (T.extension, "https://a.b/c/d.PDF?x=1.zip", "pdf"), (T.extension, "https://a.b", ""), (T.base_name, "https://a.b/c/%E3%81%82+1.csv", "あ+1.csv"), (T.base_name, "/x/bad%zz", "bad%zz"),
        (T.content_kind, "application/JSON", "json"), (T.content_kind, "image/png", ""), (T.repair_json, '```json\n{a: [1,2,],}\n```', '{"a": [1,2]}'),
        (urls.normalise, "HTTPS://M.Ex.com:80/A/b/?q=1#f", "https://m.ex.com:80/A/b?q=1"), (urls.normalise, "http://x.y", "http://x.y/"), (urls.prefix, "http://x/a/b/c", "/a/b"), (urls.prefix, "http://x/a/b", "/a/b"),
    ],
)
def test_text_forms(spark, form, value, want):
    assert one(spark, value, form) == want


@pytest.mark.parametrize(("value", "want"), [("", True), ("目 次", True), ("第3章 序", True), ("図表1-2 x", True), ("a......b", True), ("short", True), ("A sentence that is long enough to be kept, surely.", False)])
def test_front_matter(spark, value, want):
    assert one(spark, value, T.is_front_matter) == want


@pytest.mark.parametrize(("value", "want"), [("users/a", True), ("a/b/c.txt", True), ("a/b.txt", False), (None, False)])
def test_object_paths(spark, value, want):
    assert one(spark, value, T.is_object_path) == want


def test_numbers_and_aliases(spark):
    rows = spark.createDataFrame([("12",), ("1.5",), (None,), (" -3 ",)], "x string").select(T.as_int(F.col("x"), 7)).collect()
    assert [r[0] for r in rows] == [12, 7, 7, -3]
    row = spark.createDataFrame([({"issueID": "", "issueId": "b"},)], "r map<string,string>").select(readers.first_alias("r", ["issueID", "issueId"])).first()
    assert row[0] == "b"


def test_splitters(spark):
    docs = spark.createDataFrame([(1, "intro\n1. one\nmore\n2) two"), (2, "lead\nQ: a?\nstill a\nA: b\nmore b\nQ: c?\n質問：d"), (3, "T\nbody\n\n \nsecond"), (4, None), (5, "")], "k long, text string")
    got = splitting.split_texts(docs, "k").orderBy("k", "index").collect()
    by = lambda k: [r for r in got if r.k == k]
    assert [(r.question_no, r.text) for r in by(1)] == [("", "intro"), ("1", "1. one\nmore"), ("2", "2) two")]
    assert [(r.question, r.answer) for r in by(2)] == [("lead", ""), ("a?\nstill a", "b\nmore b"), ("c?", ""), ("d", "")]
    assert by(2)[1].text == "Q: a?\nstill a\nA: b\nmore b" and by(2)[1].title == "qa_2"
    assert [(r.title, r.text, r.char_count, r.line_count) for r in by(3)] == [("T", "T\nbody", 6, 2), ("second", "second", 6, 1)]
    assert not by(4) and not by(5)
    assert splitting.split_texts(docs, "k", most=1).count() == 3


def packing_model(lengths, limits):
    """Chunks as (first, last) item places."""
    out, start = [], 0
    while start < len(lengths):
        i, total = start, 0
        while i < len(lengths) and (i == start or (i - start < limits.max_items and total + 2 + lengths[i] <= limits.max_chars)):
            total += lengths[i] + (2 if i > start else 0)
            i += 1
        out.append((start, i - 1))
        if i >= len(lengths):
            break
        start = i - limits.overlap_items if i - limits.overlap_items > start else i
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=50), st.integers(12, 40), st.integers(1, 6), st.integers(0, 3))
def test_packer_against_a_model(lengths, chars, items, overlap):
    limits = chunking.ChunkLimits(chars, items, overlap)
    packer, out = chunking.Packer(limits), []
    for n, length in enumerate(lengths):
        out += packer.add(length, n)
    out += packer.end()
    assert [(keys[0], keys[-1]) for _, _, keys in out] == packing_model(lengths, limits)
    assert all(start == keys[0] and keys == list(range(keys[0], keys[-1] + 1)) for _, start, keys in out)
    assert [c[0] for c in out] == list(range(1, len(out) + 1))


@pytest.mark.parametrize("overlap", [0, 2])
def test_chunks_of_many_jobs_against_a_model(spark, overlap):
    """One job has two thirds of the items, ids repeat, some texts are blank or are cut."""
    import random

    rng, limits = random.Random(3), chunking.ChunkLimits(60, 4, overlap)
    rows = [("hot" if i % 3 else f"j{i % 9}", rng.randrange(40), f"i{rng.randrange(30)}", rng.choice(["", " "]) + " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 30])))) for i in range(300)]
    rows += rows[:20]
    items = spark.createDataFrame(rows, "job_item_id string, sort_no int, item_id string, text string").repartition(5)
    got = {}
    for r in chunking.build_chunks(items, limits).orderBy("job_item_id", "chunk_no").collect():
        got.setdefault(r.job_item_id, []).append(r)
    for job, chunks in got.items():
        held = {}  # places to parts, as the chunks have them
        for c in chunks:
            texts = c.chunk_text.split("\n\n")
            assert c.item_count == len(texts) == len(c.item_ids) == c.end_index - c.start_index + 1 and c.char_count == sum(map(len, texts))
            for at, part in enumerate(zip(c.item_ids, texts), c.start_index):
                assert held.setdefault(at, part) == part
        mine = sorted((n, i, " ".join(t.split())) for j, n, i, t in rows if j == job and t.strip())
        want = [p for _, i, t in mine for p in ([(i, t)] if len(chunking.split_long(t, 60)) == 1 else [(f"{i}:part_{k}", x) for k, x in enumerate(chunking.split_long(t, 60), 1)])]
        assert sorted(held) == list(range(len(want))) and sorted(held.values()) == sorted(want)
        assert [i.split(":")[0] for _, (i, _) in sorted(held.items())] == [i.split(":")[0] for i, _ in want]
        assert [(c.start_index, c.end_index) for c in chunks] == packing_model([len(held[k][1]) for k in range(len(held))], limits)
        assert [c.chunk_no for c in chunks] == list(range(1, len(chunks) + 1))
    assert set(got) == {j for j, _, _, t in rows if t.strip()}


@settings(max_examples=200, deadline=None)
@given(st.text("ab 。,!?", max_size=120), st.integers(5, 30))
def test_long_texts_are_cut_within_the_limit(raw, most):
    text = " ".join(raw.split())
    parts = chunking.split_long(text, most)
    assert all(0 < len(p) <= most and p == p.strip() for p in parts)
    assert "".join(parts).replace(" ", "") == text.replace(" ", "")


@pytest.mark.parametrize("limits", [(40, 5, 0), (40, 5, 2), (200, 3, 2), (60, 1000, 3), (10, 1, 0), (500, 7, 6)])
def test_chunks_found_in_blocks_are_those_of_the_packer(spark, limits):
    """Blocks of few items, jobs of one item and of many blocks, items over the limit."""
    limits, rng = chunking.ChunkLimits(*limits), random.Random(limits[0])
    rows = [(job, k, str(k), 0, 0, rng.choice([1, 3, 9, 30, 70]), 1000 * j + k) for j, job in enumerate(["a", "b", None, "c", "d"]) for k in range((1, 150, 40, 13, 1)[j])]
    parts = spark.createDataFrame(rows, "job string, sort_no int, item_id string, row int, part int, length int, key long").repartition(4)
    found = {}
    for r in chunking.members(parts, limits, block_rows=16).collect():
        found.setdefault(r.chunk, []).append((r.place, r.key))
    got = [[k for _, k in sorted(found[c])] for c in sorted(found)]
    want = []
    for job in (None, "a", "b", "c", "d"):
        packer = chunking.Packer(limits)
        for r in sorted((r for r in rows if r[0] == job), key=lambda r: r[1]):
            want += [keys for _, _, keys in packer.add(r[5], r[6])]
        want += [keys for _, _, keys in packer.end()]
    assert sorted(found) == list(range(len(want))) and got == want


def test_chunks_of_jobs(spark):
    items = spark.createDataFrame([("j1", 1, "a", "one two"), ("j1", 2, "b", " "), ("j1", 3, "c", "x" * 25), ("j1", 4, "d", None), ("j2", 1, "e", "solo")], "job_item_id string, sort_no int, item_id string, text string")
    got = chunking.build_chunks(items, chunking.ChunkLimits(20, 3, 1)).orderBy("job_item_id", "chunk_no").collect()
    assert [(r.job_item_id, r.item_ids, r.chunk_text) for r in got] == [("j1", ["a"], "one two"), ("j1", ["c:part_1"], "x" * 20), ("j1", ["c:part_2"], "x" * 5), ("j2", ["e"], "solo")]
    with pytest.raises(ValueError):
        chunking.prompt_limits(chunking.ChunkLimits(10, 1), "x" * 9)


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")), V.mean(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == pytest.approx([1 / math.sqrt(2), -1, -1, -1, -1])
    assert [r[1] for r in got] == [[1.0, 0.5], [1.0], [], None, [0.5, 0.5]]
    texts = [("[1, 2.5]", [1.0, 2.5]), ("1, 2 ,", [1.0, 2.0]), ("x,1", None), ("[1, null]", None), ("7", None), (None, None), ("", None)]
    got = spark.createDataFrame(texts, "x string, want array<double>").select(V.parse(F.col("x")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_clusters_chain_and_choose(spark):
    near = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows = [("a", "qa", "q", "", "", 3, near(0)), ("b", "qa", "q", "answer", "", 2, near(25)), ("c", "qa", "long question", "answer", "", 1, near(50)), ("d", "plain", "", "", "t", 4, near(0)), ("e", "plain", "", "", "t", 5, near(1)), ("f", "plain", "", "", "t", 6, None), ("g", "qa", "q", "x", "", None, near(200))]
    items = spark.createDataFrame(rows, "knowledge_id string, knowledge_type string, question string, answer string, content string, sort_no int, vector array<double>")
    got = {r.knowledge_id: r for r in neardup.clusters(items).collect()}
    assert [got[k].representative_id for k in "abcdefg"] == ["c", "c", "c", "d", "d", "f", "g"]
    assert [got[k].dedup_group_id for k in "acdfg"] == ["job_QG_0001", "job_QG_0001", "job_PG_0002", None, None]
    assert got["f"].dedup_score == 1.0 and got["a"].dedup_score == pytest.approx(math.cos(math.radians(50)))
    total = neardup.summary(neardup.clusters(items)).first()
    assert (total.items, total.groups, total.duplicates, total.qa_kept, total.plain_kept) == (7, 2, 3, 2, 2)


def test_similar_pairs_in_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(90, None), (91, []), (92, [0.0] * 4), (93, [1.0, 2.0])]
    items = spark.createDataFrame(rows, "id long, vector array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    want = {(a, b) for a, x in rows[:60] for b, y in rows[:60] if a < b and cos(x, y) >= 0.6}
    for block in (7, 1000):
        assert {(r.a, r.b) for r in neardup.similar_pairs(items, 0.6, block).collect()} == want


def test_statuses(spark):
    rows = [("a", 1, "done", None), ("a", 2, "error", "first"), ("a", 3, "error", "last"), ("b", 1, "queued", None), ("c", 1, "done", None), ("c", 2, "queued", None), ("d", 1, "done", None)]
    got = {r.job_id: r for r in jobs.progress(spark.createDataFrame(rows, "job_id string, chunk_no int, status string, error_message string")).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "partial_error", "b": "new", "c": "running", "d": "done"}
    assert got["a"].last_error == "last" and got["d"].last_error is None and got["b"].phase == "queued"


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "done"), (2, "b", "new"), (None, "n", "new")], "k int, v string, status string")
    new = spark.createDataFrame([(1, "x", "error"), (3, "y", "new"), (3, "z", "new"), (None, "m", "new")], "k int, v string, status string")
    got = {r.k: (r.v, r.status) for r in relational.upsert(old, new, ["k"], order=[F.col("v")]).collect()}
    assert got == {1: ("x", "error"), 2: ("b", "new"), 3: ("z", "new"), None: ("m", "new")}
    assert {r.k: r.status for r in relational.sticky_status(old, new.filter("v <> 'y'"), "k").collect()}[1] == "done"
    assert relational.insert_absent(old, new, "k").filter("k = 3").count() == 1
    rest, counts = relational.replace_children(old, new.withColumn("v", F.when(F.col("v") != "y", F.col("v"))), "k", ["v"])
    assert {r.k: (r.inserted, r.skipped) for r in counts.collect()}[3] == (1, 1) and rest.filter("k = 1").first().v == "x"
    for bad in ((0, 5), (1, 101)):
        with pytest.raises(ValueError):
            relational.page(old, [F.col("k")], *bad)


@pytest.mark.parametrize(("reply", "question", "answer"), [
    ('{"qa_list":[{"question":"Which, see: page 3?","answer":"A, b: c"}]}', "Which, see: page 3?", "A, b: c"),
    ('{"qa_list":[{"question":"x,}","answer":"[y,]"}]}', "x,}", "[y,]"),
    ('{qa_list:[{question:"{a: 1,}",answer:"\\\\",},],}', "{a: 1,}", "\\"),
    ('```json\n{"qa_list":[{"question":"say \\"hi, you: \\"","answer" : "q",\n}]}\n```', 'say "hi, you: "', "q"),
])
def test_replies_are_mended_outside_their_strings_only(spark, reply, question, answer):
    found = refine.items_of(spark.createDataFrame([("c", reply)], "chunk_id string, response string")).collect()
    assert [(r.question, r.answer) for r in found] == [(question, answer)]


def test_valid_json_is_left_alone_whatever_its_strings_hold(spark):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice('a_:,{}[]"\\\n é') for _ in range(rng.randint(0, 30)))
    values = [json.dumps({text(): [text(), {text(): None, "k": [1, True, text()]}]}, ensure_ascii=rng.random() < 0.5) for _ in range(300)] + [json.dumps({"a": '\\"' * 50_000 + "x" * 500_000})]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    assert frame.select("v", T.repair_json(F.col("v")).alias("r")).filter("v <> r or r is null").count() == 0


def test_search_modes(spark):
    rows = [("e1", "plain", "t", None, None, "apple pear apple", "apple pear apple", None, 1, "2024"), ("e2", "plain", "t", None, None, "plum", "plum", None, 2, "2024"), ("e3", "qa", "t", "what?", "this", None, "what this", [1.0, 0.0], 3, "2024"), ("e4", "qa", "t", "why?", "that", None, "apple", [0.6, 0.8], 4, "2024")]
    rows += [(f"x{i}", "plain", "t", None, None, f"filler{i} common", f"filler{i} common", None, 9, "2024") for i in range(20)]
    entries = spark.createDataFrame(rows, "entry_id string, knowledge_type string, title string, question string, answer string, content string, search_text string, embedding array<double>, sort_no int, created_at string").withColumns({"source_type": F.lit("s"), "source_label": F.lit("l")})
    loose = {"fts": {"strong_bm25_max": -1, "weak_bm25_max": -0.5}}
    embed = lambda q: [1.0, 0.0]
    assert [r.entry_id for r in retrieval.search(spark, entries, "Apple", "plain_fts", loose).collect()] == ["e1"]
    assert [r.entry_id for r in retrieval.search(spark, entries, "x", "qa", embed=embed).collect()] == ["e3"]
    assert [r.entry_id for r in retrieval.search(spark, entries, "apple", "hybrid", loose, embed).orderBy("position").collect()] == ["e3", "e1"]
    seen = []
    answered = retrieval.search(spark, entries, "apple", "hybrid_ai", loose, embed, lambda q, c: seen.append(c) or "ok").first()
    assert answered.answer == "ok" and seen[0].startswith("[候補1]\n種別: qa\n質問: what?\n本文: this")
    assert retrieval.search(spark, entries.limit(0), "apple", "hybrid_ai", embed=embed).first().answer == retrieval.NOTHING_FOUND
    with pytest.raises(ValueError):
        retrieval.query_terms(" \n ")
    assert retrieval.query_terms("Red fox\nfox ...\n!!") == ["red", "fox", "!!"]
    swapped = retrieval.search_config({"qa_similarity": {"strong_threshold": 0.2, "weak_threshold": "bad"}})["qa_similarity"]
    assert (swapped["weak_threshold"], swapped["strong_threshold"]) == (0.2, 0.4)


PAGE = """<html><head><title> Site </title></head><body><nav><a href="/n">Nav</a></nav><div class="sidebar"><p>noise</p></div>
<main><h1>Head</h1><p>A paragraph that is certainly longer than thirty characters.<p>inner <a href="/x/y.html">link</a></p>
<ul><li><a href="only">only</a></li></ul></main><form><a href="/search">s</a></form><a href="mailto:x@y">m</a><a href="Other/#frag">o</a></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://Ex.com/a/b", PAGE), (2, "http://e/", None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in html.features(html.blocks(pages, "page_id"), "page_id").collect()}
    assert rows[1].title == "Site" and rows[1].heading_count == 1 and rows[1].block_count == 4 and rows[1].link_only_block_ratio == 0.25
    assert "noise" not in rows[1].text and "only" not in rows[1].text.split("\n")
    assert rows[2].block_count == 0 and rows[2].text == "" and rows[2].short_line_ratio == 0
    assert [r.link for r in html.links(pages, "page_id").orderBy("at").collect()] == ["http://ex.com/n", "http://ex.com/x/y.html", "http://ex.com/a/only", "http://ex.com/a/Other"]


def test_rule_scores(spark):
    rules = {"base_score": 50, "keyword_cap": 15, "rules": {"title_keywords": {"News": 10}, "body_keywords": {"x": 10}}, "thresholds": {"min_text_length": {"lt": 3, "score": -60}}, "decisions": {"pass": {"gte": 60}, "review": {"gte": 20}, "reject": {}}}
    config = page_scoring.checked_scoring(rules)
    names = ("text_length", "link_count", "short_line_ratio", "heading_count", "paragraph_count", "link_only_block_ratio", "nav_like_block_ratio")
    df = spark.createDataFrame([("news news", "xyz"), ("", ""), (None, "abcd")], "title string, text string")
    features = {n: F.lit(0.0) for n in names} | {"text_length": F.length("text")}
    got = df.select(*[c.alias(k) for k, c in scoring.judge(config, url=F.lit("u"), title=F.col("title"), text=F.col("text"), features=features).items()]).collect()
    assert [tuple(r) for r in got] == [(65, "pass", 1), (0, "reject", 0), (50, "review", 1)]
    for bad in ({"keyword_cap": True}, {"decisions": {"maybe": {}}}, {"thresholds": {"x": [{"lt": "1"}]}}, {"filter_mode": "x"}):
        with pytest.raises(ValueError):
            page_scoring.checked_scoring(bad)
    assert page_scoring.checked_crawl({"max_depth": 1, "max_pages": 2, "priority_keywords": [" New "]})["priority_keywords"] == ["new"]


def test_child_priority(spark):
    p = lambda u: one(spark, u, lambda c: urls.child_priority(c, F.lit("http://x/a/b/c.html"), F.lit("http://x/a/"), ["new"], ["old"]))
    assert p("http://x/a/b/new.html") == 100 + 60 + 25 + 18 + 12 + 8 and p("http://x/old") == -120 + 4 and p("http://x/index.html") == 4 + 8 - 3


def test_refinement(spark):
    items = spark.createDataFrame([("k1", " q  x ", "", None)], "knowledge_id string, question string, answer string, content string")
    cleaned = refine.vectorize(refine.cleanse(items), lambda texts: [[float(len(t))] for t in texts]).first()
    assert cleaned.question_normalize == "q x" and cleaned.answer_normalize is None and cleaned.question_vector == [3.0] and cleaned.content_vector is None
    assert refine.next_phase("cleanse", "done") == "cleansed"
    with pytest.raises(ValueError):
        refine.next_phase("build", "cleansed")
    replies = {"p1": '```json\n{"qa_list": [{question: "a", "answer": "b",},]}\n```', "p2": "[1]", "p3": '{"items": [], "data": [{"content": "c"}]}'}

    def generate(prompt):
        if prompt == "p4":
            raise RuntimeError("down")
        return replies[prompt]

    chunks = spark.createDataFrame([(f"c{i}", f"p{i}") for i in (1, 2, 3, 4)], "chunk_id string, prompt string")
    done = refine.execute_chunks(chunks, generate, pause=0.0)
    assert {r.chunk_id: r.error for r in done.collect()} == {"c1": None, "c2": None, "c3": None, "c4": "down"}
    assert [(r.chunk_id, r.sort_no, r.question, r.answer, r.content) for r in refine.items_of(done).orderBy("chunk_id").collect()] == [("c1", 1, "a", "b", None), ("c3", 1, None, None, "c")]


def test_inputs_and_prompts(spark):
    rows = [("f", "pdf", 1, "目 次"), ("f", "pdf", 2, "[3] A page that is long enough to be kept, surely."), ("f", "pdf", 3, ""), ("g", "csv", 0, " k: v "), ("g", "csv", 1, None)]
    inputs = chunking.chunk_inputs(spark.createDataFrame(rows, "k string, kind string, index int, text string"), "k")
    assert sorted(map(tuple, inputs.collect())) == [("f", 1, "f:page_2", "A page that is long enough to be kept, surely."), ("g", 1, "g:0", "k: v")]
    chunks = chunking.build_chunks(inputs, chunking.prompt_limits(chunking.ChunkLimits(100, 5), "Template"), "k")
    assert {r.prompt for r in chunking.prompts(chunks, "Template", 100).collect()} == {"Template\n\nk: v", "Template\n\nA page that is long enough to be kept, surely."}
    with pytest.raises(Exception, match="longer than 9"):
        chunking.prompts(chunks, "Template", 9).collect()


def test_missing_embeddings_and_taken_names(spark):
    entries = spark.createDataFrame([("a", "text", None), ("b", " ", None), ("c", "x", [1.0])], "entry_id string, search_text string, embedding array<double>")
    got = {r.entry_id: r.embedding for r in refine.fill_embeddings(entries, lambda texts: [[len(t)] for t in texts]).collect()}
    assert got == {"a": [4.0], "b": None, "c": [1.0]}
    files = entries.select("entry_id")
    assert relational.append_new(files, spark.createDataFrame([("d",)], "entry_id string"), "entry_id").count() == 4
    with pytest.raises(ValueError):
        relational.append_new(files, files.limit(1), "entry_id")


def test_file_records(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.csv", "﻿k,v\r\nx, 1 \ny\n".encode()), (2, "b.txt", "表示\n\n次".encode("shift_jis")), (3, "c.json", b'{"a": [1]}'), (4, "d.json", b"{bad"), (5, "e.pdf", b"p1|p2"), (6, "f.pdf", b"")], "k long, path string, content binary")
    got = {}
    for r in readers.read_records(files, "k", lambda b: b.decode().split("|") if b else 1 / 0).orderBy("k", "index").collect():
        got.setdefault(r.k, []).append(r.text)
    assert got == {1: ["k: x | v: 1", "k: y | v: "], 2: ["表示", "次"], 3: got[3], 4: ["{bad"], 5: ["p1", "p2"]}
    assert json.loads(got[3][0]) == {"a": [1]}
    assert [r.record for r in readers.read_csv_records(files.filter("k = 1"), "k", most=1).collect()] == [{"k": "x", "v": "1"}]


def test_saved_replies(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text(json.dumps({"speechRecord": [{"id": "a"}, {"id": "b"}]}))
    (tmp_path / "p" / "2.json").write_text(json.dumps({"speechRecord": [{"id": "c"}]}))
    assert [r.id for r in readers.read_pages(spark, str(tmp_path / "p"), "speechRecord", "struct<id:string>", 2).collect()] == ["a", "b"]
    (tmp_path / "d.json").write_text(json.dumps({"success": True, "result": {"results": [{"id": "1", "resources": [{"format": "CSV", "url": ""}]}, {"id": "2", "resources": [{"format": "", "url": "http://x/y.exe"}]}]}}))
    kind = "struct<id:string,resources:array<struct<format:string,url:string>>>"
    assert [r.id for r in readers.read_datasets(spark, str(tmp_path / "d.json"), kind, ["csv"]).collect()] == ["1"]
    (tmp_path / "bad.json").write_text(json.dumps({"success": False}))
    with pytest.raises(Exception, match="no success"):
        readers.read_datasets(spark, str(tmp_path / "bad.json"), kind, ["csv"]).collect()
    (tmp_path / "s").mkdir()
    for i, at in enumerate(("2024-01-01", None, "2024-02-01")):
        (tmp_path / "s" / f"{i}.json").write_text(json.dumps({"job_id": str(i), "status": "done", "updated_at": at}))
    assert [r.job_id for r in readers.read_status(spark, str(tmp_path / "s")).collect()] == ["2", "0", "1"]


def test_search_databases(spark, tmp_path):
    entries = spark.createDataFrame([("e1", "plain", "a b"), ("e2", "qa", "b")], "entry_id string, knowledge_type string, search_text string")
    meta = sinks.build_search_db(entries, str(tmp_path), "db1", "upload").first()
    assert (meta.entries, meta.qa_entries, meta.plain_entries) == (2, 1, 1)
    stored, (postings, stats) = sinks.open_search_db(spark, str(tmp_path), "db1")
    assert stored.count() == 2 and postings.filter("term = 'b'").count() == 2 and stats.first().n == 2
    assert sinks.databases(spark, str(tmp_path), "upload").count() == 1 and sinks.databases(spark, str(tmp_path), "x").count() == 0
    sinks.replace_table(spark.read.parquet(f"{tmp_path}/db1/entries").filter("entry_id = 'e1'"), f"{tmp_path}/db1/entries")
    assert spark.read.parquet(f"{tmp_path}/db1/entries").count() == 1


def test_streamed_progress(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = progress.windowed_progress(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    running = stream.writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    running.processAllAvailable()
    running.stop()
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, progress.windowed_progress(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))


def test_progress_does_not_depend_on_how_files_fall_into_batches(spark, tmp_path):
    """Files of one row each, newest first, a batch a file: none is too late."""
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=5 * i), i % 2, ("purchase", "error", "view")[i % 3]) for i in range(6)]
    schema = "ts timestamp_ntz, user_id long, event_type string"
    for row in reversed(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    count = lambda **more: sorted(map(tuple, progress.follow(spark, str(tmp_path / "events"), spark.createDataFrame([], schema).schema, **more).collect()))
    one, each = count(folder=str(tmp_path / "a")), count(folder=str(tmp_path / "b"), files_a_batch=1)
    assert one == each and len(one) == 6 and sum(r[2] for r in one) == 6
