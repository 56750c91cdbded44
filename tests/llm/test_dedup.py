from __future__ import annotations

import hashlib
import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.llm import components, exact_chunks, line_dedup, prob_minhash, suffix_dedup
from tests.llm.conftest import words


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


# Components


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)]
    found = components.components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long"))
    got = {r.id: r.comp for r in found.collect()}
    groups = Groups({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    assert got == {x: groups.find(x) for x in groups.up if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [2, 16])
def test_bucket_components_lose_no_link(spark, small):
    rng = random.Random(5)
    value = {i: rng.randrange(60) for i in range(120)}
    items = [(b, i) for i in value for b in {rng.randrange(6), rng.randrange(6)}]

    def linked(pairs):
        v = spark.createDataFrame(list(value.items()), "id long, v long")
        both = pairs.join(v.toDF("a", "x"), "a").join(v.toDF("b", "y"), "b")
        return both.filter(F.abs(F.col("x") - F.col("y")) <= 1).select("a", "b")

    got = {r.id: r.comp for r in components.bucket_components(spark.createDataFrame(items, "bucket long, id long"), linked, None, small).collect()}
    groups, by = Groups(value), defaultdict(set)
    for b, i in items:
        by[b].add(i)
    for members in by.values():
        for a in members:
            for b in members:
                if a != b and abs(value[a] - value[b]) <= 1:
                    groups.join(a, b)
    want = {i: groups.find(i) for i in value}
    assert {i: got.get(i, i) for i in value} == want


# Exact dedup


def exact_brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((i, t or ""))
    best = {k: min(v, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for k, v in groups.items()}
    return sorted(
        ((i, best[norm(t)][0], len(groups[norm(t)]), i == best[norm(t)][0] and len(t or "") == len(best[norm(t)][1]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr
    )


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_dedup_against_brute_force(make, edge_rows, bits):
    rows = [*edge_rows, (20, "Kalo  miru tesa."), (21, words(9, 3000)), (22, words(9, 3000).replace(" ", "\n")), (23, words(9, 3000) + "x")]
    got = sorted((tuple(r) for r in exact_chunks.dedup(make(rows), bits).collect()), key=repr)
    assert got == exact_brute(rows)


def test_exact_dedup_of_an_empty_table(make):
    assert exact_chunks.dedup(make([])).count() == 0


def test_chunks_join_to_the_text_and_survive_an_insertion():
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), exact_chunks.cut_pattern()))
    text = words(4, 4000).replace(" ", "")
    chunks = pattern.findall(text)
    assert "".join(chunks) == text
    moved = pattern.findall(text[:500] + "zz" + text[500:])
    assert len(set(chunks) & set(moved)) > len(chunks) * 0.6


# Line dedup


def line_brute(rows, similarity=0.8, most_bits=12):
    """Keeps the first of each group of equal lines, in order of (null ids last, id, place)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            key = " ".join(x for x in re.split(r"[^\w]+|_", line.lower()) if x)
            if not key or key not in seen:
                kept.append(line)
            seen.add(key)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_of_exact_lines(make):
    rows = [(1, f"{words(1, 9)}\n{words(2, 9)}\n\n--"), (2, f"{words(2, 9).upper()}!\n{words(3, 9)}\n\n--"), (3, words(1, 9)), (4, None), (5, ""), (6, f"{words(5, 9)}\n{words(5, 9)}"), (None, words(3, 9))]
    got = {r.doc_id: r for r in line_dedup.dedup(make(rows)).collect()}
    assert {i: r.text for i, r in got.items()} == line_brute(rows)
    assert got[3].text == "" and got[3].n_dropped == 1 and got[3].n_chars == 0 and got[1].n_lines == 4 and got[4].n_lines == 0
    assert set(got[1].asDict()) >= {"row", "score", "id", "best", "h1"}


def test_line_dedup_joins_near_lines(make):
    base = words(7, 120).split()
    near = base[:]
    near[60] = "zzz"
    far = words(8, 120)
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, far)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(make(rows)).collect()}
    assert got == {1: " ".join(base), 2: "", 3: far}


def test_line_dedup_finds_what_brute_force_finds(make):
    rng, rows, pairs = random.Random(12), [], 0
    for i in range(200):
        base = words(9000 + i, 5 + i % 96).split()
        near = base[:]
        for at in rng.sample(range(len(near)), max(1, len(near) // 10)):
            near[at] = words(20000 + 100 * i + at, 1)
        x, y = " ".join(base), " ".join(near)
        pairs += x != y and one_minus_distance(x, y) >= 0.8 - 1e-9
        rows += [(2 * i, x), (2 * i + 1, y)]
    got = {r.doc_id: r for r in line_dedup.dedup(make(rows)).collect()}
    joined = 0
    for i in range(200):
        x, y = rows[2 * i][1], rows[2 * i + 1][1]
        if x != y and one_minus_distance(x, y) >= 0.8 - 1e-9:
            joined += got[2 * i + 1].n_dropped
        elif x != y and not any(one_minus_distance(y, z) >= 0.8 - 1e-9 for n, (_, z) in enumerate(rows) if n != 2 * i + 1):
            assert got[2 * i + 1].n_dropped == 0
    assert pairs > 100 and joined >= 0.95 * pairs


def one_minus_distance(x, y):
    if abs(len(x) - len(y)) > 0.25 * max(len(x), len(y)):
        return 0.0
    row = np.arange(len(y) + 1)
    letters, slope = np.array(list(y)), np.arange(len(y) + 1)
    for i, c in enumerate(x):
        step = np.minimum(np.append(i + 1, row[:-1] + (letters != c)), row + 1)
        row = np.minimum.accumulate(step - slope) + slope
    return 1 - int(row[-1]) / max(len(x), len(y))


def test_line_dedup_edges(make, edge_rows):
    got = line_dedup.dedup(make(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert sum(r.text == "Kalo miru tesa." for r in got) == 1
    assert line_dedup.dedup(make([])).count() == 0


def test_lines_within_two_bits_meet(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    keys = df.select(F.arrays_overlap(line_dedup.block_keys(F.col("a")), line_dedup.block_keys(F.col("b"))).alias("meet"))
    assert keys.filter("not meet").count() == 0


def test_bucket_keys_are_made_in_methods_that_the_jvm_compiles(spark, capsys):
    """HotSpot interprets methods of more than 8,000 bytes; all keys as one array made one of 26,433."""
    codes = [F.xxhash64(F.lit(k), "id").alias(c) for k, c in enumerate(["sim", *line_dedup.MINS])]
    classes = spark.range(400).select("id", (F.col("id") * F.col("id") % 997 + 1).cast("int").alias("size"), *codes)
    items = line_dedup.bucket_items(classes, 0.8)
    want = classes.select(F.explode(F.concat(line_dedup.block_keys(F.col("sim")), line_dedup.band_keys(0.8))).alias("bucket"), "id")
    assert sorted(map(tuple, items.collect())) == sorted(map(tuple, want.collect()))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        items.groupBy("bucket").agg(F.count("*")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) == 2 and max(sizes) < 8000, sizes


def test_edit_similarity_is_exact(spark):
    rng = random.Random(6)
    pairs = [("abcdefghij", "abcdefghxx"), ("abcdefghij", "abcdefgxxx"), ("a" * 100, "a" * 80), ("a" * 100, "a" * 79), ("same", "same")]
    for i in range(60):
        a = words(i, 25).split()
        b = [w if rng.random() > i / 200 else words(999 + i, 1) for w in a]
        pairs.append((" ".join(a), " ".join(b)))
    for n in range(3, 40):  # one long word, and n others of which some change
        a = words(500 + n, n).split() + ["q" * 60]
        pairs.append((" ".join(a), " ".join(w if rng.random() > n / 90 else words(700 + n, 1) for w in a)))
    df = spark.createDataFrame(pairs, "x string, y string")
    got = df.select(line_dedup.edit_similar(line_dedup.compared(F.col("x"), 0.8), line_dedup.compared(F.col("y"), 0.8), 0.8).alias("got"), (1 - F.levenshtein("x", "y") / F.greatest(F.length("x"), F.length("y"))).alias("exact")).collect()
    assert [r.got for r in got] == [r.exact >= 0.8 - 1e-9 for r in got] and {r.got for r in got} == {True, False}


def test_blocks_are_compared_in_as_many_tasks_as_there_are_partitions(spark):
    """Blocks are small to read and slow to compare; their tasks were joined by what they read."""
    ids = spark.range(600)
    apart = ids.select(F.lit(1).cast("long").alias("bucket"), "id", F.col("id").alias("comp"), F.lit(0).cast("long").alias("main"), F.lit(600).cast("long").alias("n"), F.lit(599).cast("long").alias("m"))
    line = F.concat_ws(" ", *[F.sha2((F.col("id").cast("string")), 256).substr(k, 6) for k in range(1, 50, 6)])
    texts = ids.select("id", line_dedup.compared(line, 0.8).alias("t"), F.array(F.lit(1).cast("long")).alias("keys"))
    before, tracker = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.sparkContext.setJobGroup("blocks", "blocks")
    try:
        assert line_dedup.compare_blocks(apart, texts, 0.8, 20).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(i) for job in tracker.getJobIdsForGroup("blocks") for i in tracker.getJobInfo(job).stageIds]
    assert 7 in {x.numTasks for x in stages if x}


def test_line_dedup_leaves_no_shuffle_files(make, spark, tmp_path, monkeypatch):
    """Files of a query that has ended go with it, not when the driver happens to collect its garbage."""
    monkeypatch.setattr(line_dedup, "release_shuffles", lambda spark: None)
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x.name() for x in map(folder_id, range(folder.getAllBlocks().size())) if x.name().startswith("shuffle_")}
    folder_id = lambda i: folder.getAllBlocks().apply(i)
    docs = make([(i, f"{words(i // 2, 12)}\n{words(500 + i, 9)}") for i in range(60)])
    before = shuffles()
    result = line_dedup.dedup(docs)
    left = shuffles() - before
    assert not left, sorted(left)[:5]
    assert sum(r.n_dropped for r in result.collect()) == 30


def test_codes_of_all_lines_are_not_kept(make, monkeypatch):
    """While buckets are compared, an occurrence takes four numbers of disk; its class has the other eight."""
    kept, dropped, plain, seen = {}, [], line_dedup.staged, []
    monkeypatch.setattr(line_dedup, "staged", lambda df, label: kept.setdefault(label, plain(df, label)))
    monkeypatch.setattr(line_dedup, "drop_staged", lambda *tables: dropped.extend(map(id, tables)))
    monkeypatch.setattr(line_dedup, "bucket_components", lambda items, *a: seen.append([k for k, df in kept.items() if id(df) not in dropped and "sim" in df.columns]) or items.select(F.col("id"), F.col("id").alias("comp")).distinct())
    got = line_dedup.dedup(make([(1, words(3, 9)), (2, words(3, 9)), (3, words(4, 9))])).collect()
    assert seen == [["classes"]] and {r.doc_id: r.n_dropped for r in got} == {1: 0, 2: 1, 3: 0}


def test_a_long_word_does_not_make_a_long_line_slow(spark):
    """A line of 0.15 MB with a word of 2,000 letters and 3% of its words changed is compared by its 30,000 words, not by letters."""
    rng = random.Random(4)
    a = words(31, 30_000).split()
    b = [w if rng.random() > 0.03 else words(i, 1, "xo xu xy") for i, w in enumerate(a)]
    df = spark.createDataFrame([(" ".join([*a, "q" * 2000]), " ".join([*b, "q" * 2000]))], "x string, y string")
    side = df.select(line_dedup.compared(F.col("x"), 0.8).alias("x"), line_dedup.compared(F.col("y"), 0.8).alias("y"))
    start = time.time()
    assert side.select(line_dedup.edit_similar(F.col("x"), F.col("y"), 0.8).alias("got")).first().got
    assert time.time() - start < 60


def test_large_line_buckets_give_what_all_pairs_give(make, monkeypatch):
    """Lines that share their long words meet in large buckets; few are similar, and links cross buckets."""
    rng, heads = random.Random(21), ["internationalization constitutionality", "counterrevolutionary misunderstanding"]
    rows = []
    for i in range(160):
        tail = words(3000 + i // 2, 6 + i % 7).split()
        if i % 2:
            tail[rng.randrange(len(tail))] = words(9000 + i, 1)
        rows.append((i, f"{heads[i % 3 == 0]} {' '.join(tail)}"))
    blocks, seen = line_dedup.compare_blocks, []

    def small_blocks(apart, texts, similarity):
        seen.append(apart.count())
        return blocks(apart, texts, similarity, 7)

    monkeypatch.setattr(line_dedup, "compare_blocks", small_blocks)
    kept = lambda few: {r.doc_id for r in line_dedup.dedup(make(rows), few=few).collect() if r.text}
    plain = kept(10**9)
    assert not seen and kept(2) == plain and seen[0] > 100 and 80 <= len(plain) < 160


def test_simhash_is_the_majority_of_its_words(spark):
    lines = [(i, i, 0, words(i, 1 + i * 3)) for i in range(30)] + [(40, 40, 0, " ".join(f"w{i}" for i in range(700)))]
    got = line_dedup.simhashes(spark.createDataFrame(lines, "row long, doc_id long, pos int, line string")).collect()
    hashed = spark.createDataFrame([(i, w) for i, _, _, t in lines for w in set(t.split())], "row long, w string").select("row", F.xxhash64("w").alias("h")).collect()
    for r in got:
        hs = [x.h for x in hashed if x.row == r.row]
        for bit in range(64):
            c = sum(h >> bit & 1 for h in hs)
            want = c * 2 > len(hs) or (c * 2 == len(hs) and bool(r.h1 >> bit & 1))
            assert bool(r.sim >> bit & 1) == want


def test_long_lines_have_the_simhash_of_short_ones(spark, monkeypatch):
    lines = spark.createDataFrame([(i, i, 0, words(i, 1 + i * 3)) for i in range(30)], "row long, doc_id long, pos int, line string")
    want = line_dedup.simhashes(lines).collect()
    monkeypatch.setattr(line_dedup, "LONG", 40)
    got = line_dedup.simhashes(lines).unionByName(line_dedup.long_simhashes(lines)).collect()
    assert sorted(got) == sorted(want) and len(line_dedup.simhashes(lines).collect()) < 30


def test_native_operators_run_no_python(make, edge_rows):
    docs = make(edge_rows)
    for df in (line_dedup.simhashes(line_dedup.lines_of(docs.select("row", "doc_id", "text"))), exact_chunks.recipes(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_very_wide_lines_do_not_overflow(make):
    wide = " ".join(f"w{i}" for i in range(40_000))
    got = {r.doc_id: r.text for r in line_dedup.dedup(make([(1, wide), (2, wide), (3, "short line")])).collect()}
    assert got == {1: wide, 2: "", 3: "short line"}


# Near dedup


def near_brute(rows, similarity=0.8):
    sets = {}
    for n, (_, t) in enumerate(rows):
        w = (t or "").lower().split()
        sets[n] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    groups = Groups(sets)
    for a in sets:
        for b in range(a):
            x, y = sets[a], sets[b]
            if (rows[a][1] or "") == (rows[b][1] or "") or (x and y and len(x & y) >= similarity * len(x | y)):
                groups.join(a, b)
    return groups


def test_near_dedup_against_brute_force(make, edge_rows):
    rng = random.Random(4)
    rows = list(edge_rows)
    for g in range(12):
        base = words(50 + g, 200).split()
        for c in range(8):
            copy = base[:]
            for _ in range(rng.randrange(1, 6)):
                copy[rng.randrange(200)] = f"edit{rng.randrange(9999)}"
            rows.append((100 + g * 10 + c, " ".join(copy)))
    rows += [(900 + i, f"{words(5, 60)} {words(300 + i, 60)}") for i in range(30)]  # share a passage, are not similar
    groups = near_brute(rows)
    members = defaultdict(list)
    for n in range(len(rows)):
        members[groups.find(n)].append(rows[n][0])
    first = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    want = Counter((rows[n][0], first(members[groups.find(n)]), len(members[groups.find(n)])) for n in range(len(rows)))
    got = prob_minhash.dedup(make(rows)).collect()
    assert Counter((r.doc_id, r.group_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(members)


def test_large_near_groups_go_through_the_grid(make):
    base = words(1, 150).split()
    rng = random.Random(1)
    rows = []
    for i in range(150):
        copy = base[:]
        for _ in range(rng.randrange(2, 9)):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    groups = near_brute(rows)
    want = len({groups.find(n) for n in range(len(rows))})
    assert prob_minhash.dedup(make(rows)).filter("kept").count() == want


def test_near_dedup_of_an_empty_table(make):
    assert prob_minhash.dedup(make([])).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    ids = prob_minhash.mix(np.arange(1, 301, dtype=np.uint64))
    w1, w2 = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    w2[:50] = 0
    some = w2 > 0
    owner = np.repeat([0, 1], [300, int(some.sum())])
    sig = prob_minhash.signatures(owner, np.concatenate([ids, ids[some]]), np.concatenate([w1, w2[some]]), 2, 4096)
    exact = sum(1 / np.maximum(w1 / w1[d], w2 / w2[d]).sum() for d in np.flatnonzero(some))
    assert abs(prob_minhash.estimate(sig[0], sig[1]) - exact) < 0.03


# Suffix dedup


def suffix_brute(rows, length):
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        left = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((i, len(b), sum(mask), sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask)), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "wide", "narrow"), [(40, 20, 36), (12, 4, 9)])
def test_suffix_dedup_against_brute_force(make, length, wide, narrow):
    p, q = words(1, 60), words(2, 12)
    rows = [(0, p), (1, words(3, 9) + p[:70] + words(4, 5)), (2, p[20:200] + "x" + p[200:250]), (3, None), (4, ""), (5, "ab" * 100), (6, "z" * 77), (7, q + q), (8, q + "!" + q), (9, p), (10, "a" * 39), (11, "a" * 41), (None, "é" * 60), (12, "é" * 60)]
    rows += [(100 + i, p[: i * 5] + words(50 + i, 1) + p[i * 5 :]) for i in range(20)] + [(7, q + q)]
    got = sorted((tuple(r) for r in suffix_dedup.dedup(make(rows), length, wide, narrow).collect()), key=repr)
    assert got == suffix_brute(rows, length)


def test_planted_passages_by_length(make):
    """Passages of 45 to 105 words in two texts each, at the production lengths: all of 400 bytes and more go, no shorter one does."""
    rows, sizes = [], {}
    for i, n in enumerate(range(45, 106, 5)):
        passage = words(3000 + i, n)
        sizes[2 * i] = sizes[2 * i + 1] = len(passage)
        rows += [(2 * i + k, f"{words(4000 + 2 * i + k, 80)} | {passage} | {words(5000 + 2 * i + k, 60)}") for k in (0, 1)]
    rows += [(100 + i, words(6000 + i, 150)) for i in range(10)]
    got = sorted((tuple(r) for r in suffix_dedup.dedup(make(rows)).collect()), key=repr)
    assert got == suffix_brute(rows, 400)
    removed = {r[0]: r[2] for r in got}
    assert all((removed[i] >= n) if n >= 400 else removed[i] == 0 for i, n in sizes.items() if n + 6 < 400 or n >= 400)
    assert any(n >= 400 for n in sizes.values()) and any(n + 6 < 400 for n in sizes.values())
    assert not any(removed[100 + i] for i in range(10))


def test_suffix_dedup_in_small_pieces(make, monkeypatch):
    rows = [(1, words(1, 200)), (2, words(2, 30) + words(1, 200) + words(3, 30)), (3, words(1, 200)[300:900])]
    want = suffix_brute(rows, 60)
    data = rows[0][1].encode()
    monkeypatch.setattr(suffix_dedup, "PIECE", 50)
    parts = list(suffix_dedup.pieces(data, 60))
    assert {data[k : k + 60] for k in range(len(data) - 59)} == {part[k : k + 60] for _, part in parts for k in range(len(part) - 59)}
    got = sorted((tuple(r) for r in suffix_dedup.dedup(make(rows), 60, 30, 50).collect()), key=repr)
    assert got == want


def test_suffix_dedup_of_an_empty_table(make):
    assert suffix_dedup.dedup(make([])).count() == 0
