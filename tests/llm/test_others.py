from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tarnmill.llm import decontaminate, license_scan, packing, token_rollup
from tests.llm.conftest import words


# Packing


def test_packing_round_trip(make, edge_rows):
    whole = Tokenizer.from_file(packing.default_vocabulary())
    rows = [(n, t) for n, (_, t) in enumerate([*edge_rows, (0, "a <|endoftext|> b"), (0, "naïve 日本語 \r\n x  y")])]
    got = packing.pack(make(rows), with_ids=True).collect()
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for i, ids in want.items():
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for p in pieces for x in p.token_ids] == ids and all(p.doc_tokens == len(ids) for p in pieces)
        assert [p.length for p in pieces] == packing.piece_lengths(len(ids), 2048)
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and 1 << r.bucket == r.length and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
    assert len({r.sequence_id for r in got}) == len(got)
    assert packing.pack(make([])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 10_000])
def test_piece_lengths(n):
    found = packing.piece_lengths(n, 2048)
    assert sum(found) == n and sorted(found, reverse=True) == found and len(set(x for x in found if x < 2048)) == sum(x < 2048 for x in found)


def test_repeated_rows_are_packed_each(make):
    assert packing.pack(make([(1, "x"), (1, "x"), (None, None)])).count() == 2 * len(packing.piece_lengths(2, 2048)) + 1


def test_buckets_hold_equal_lengths(spark, make, tmp_path):
    packing.write_buckets(packing.pack(make([(1, words(1, 50)), (2, words(2, 9))]), with_ids=True), str(tmp_path / "b"))
    assert all(1 << r.bucket == r.length for r in spark.read.parquet(str(tmp_path / "b")).collect())


# Decontamination


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, words(700 + i, 20 + i % 20)) for i in range(40)] + [(90, None), (91, ""), (92, "qq zz"), (93, words(700, 20))], "item_id long, text string")


def align_brute(item, window):
    best, rows = 0, [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(window) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if item[i - 1] == window[j - 1] else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best / (2 * len(item))


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(-1, 4, rng.integers(1, 30))
        assert decontaminate.align(a, b) == pytest.approx(align_brute(a.tolist(), b.tolist()))


def test_copies_and_edited_copies_are_found(make, items):
    rng, rows, want = random.Random(1), [], {}
    for i in range(40):
        w = words(700 + i, 20 + i % 20).split()
        if i % 2:
            for at in rng.sample(range(len(w)), len(w) // 4):
                w[at] = "edited"
        rows.append((i, f"{words(i, 40)} {' '.join(w)} {words(i + 50, 40)}"))
        want[i] = i
    rows += [(100 + i, words(2000 + i, 200)) for i in range(30)] + [(200, None), (None, ""), (201, "qq zz")]
    got = decontaminate.scan(make(rows), items).collect()
    assert {r.doc_id: r.item_id for r in got if r.contaminated} == want | {201: 92}
    assert len(got) == len(rows) and {"row", "score", "best"} <= set(got[0].asDict())


def test_an_item_in_a_third_of_all_documents_is_still_found(make, items):
    leak = words(705, 25)
    rows = [(i, f"{words(i, 20)} {leak if i % 3 == 0 else words(i + 999, 20)}") for i in range(90)]
    assert {r.doc_id for r in decontaminate.scan(make(rows), items).filter("contaminated").collect()} == set(range(0, 90, 3))


def test_decontamination_equals_alignment_of_all_pairs(spark, make):
    rng, texts = random.Random(8), [words(700 + i, 20) for i in range(6)]
    skewed = [(i, f"{words(i, 9)} {' '.join(texts[0].split()[:12])} {words(i + 300, 9)}") for i in range(60)]
    rows = skewed + [(100, texts[0]), (101, " ".join("x" if k % 3 == 2 else w for k, w in enumerate(texts[1].split())))]
    for i in range(60):
        rows.append((200 + i, " ".join(rng.choice(["x", w, w, f"{w} y"]) for w in texts[i % 6].split())))
    got = {r.doc_id: r for r in decontaminate.scan(make(rows), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")).collect()}
    for i, t in rows:
        scores = [align_brute(x.split(), t.split()) for x in texts]
        assert got[i].n_items == sum(s >= 0.4 - 1e-9 for s in scores)
        assert not got[i].contaminated or got[i].similarity == pytest.approx(max(scores))
    assert all(got[i].contaminated for i in [*range(60), 101])


def test_many_seeds_are_joined_by_a_shuffle(make, items, monkeypatch):
    rows = [(i, f"{words(i, 9)} {words(700 + i, 20 + i % 20)}") for i in range(40)]
    key = lambda r: (r.doc_id, r.item_id, round(r.similarity, 9))
    want = sorted(map(key, decontaminate.scan(make(rows), items).collect()))
    monkeypatch.setattr(decontaminate, "FEW_SEEDS", 0)
    assert sorted(map(key, decontaminate.scan(make(rows), items).collect())) == want


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.75])
def test_rare_seeds_lose_no_pair(spark, threshold):
    rng, few = random.Random(5), "aa bb cc dd ee ff gg hh ii jj kk ll".split()
    items = [(i, " ".join(rng.choice(few) for _ in range(1 + i % 9))) for i in range(27)]
    texts = [(i, " ".join(rng.choice(few) for _ in range(i % 30))) for i in range(60)]
    rows, tests = spark.createDataFrame(texts, "row long, text string"), spark.createDataFrame(items, "item long, text string")
    found = {tuple(r) for r in decontaminate.candidates(rows, tests, threshold).collect()}
    for i, t in texts:
        for k, x in items:
            score = align_brute(x.split(), t.split()) * 2 * len(x.split())
            assert score < decontaminate.needed(len(x.split()), threshold) or (i, k) in found, (t, x)


def test_words_are_those_of_the_pattern():
    texts = ["Kalo_miru, ab12\ncd 😀é ΣΑΣ", None, "", "İx ½ ²y", "a"]
    owner, h = decontaminate.word_hashes(texts)
    want = [(i, w) for i, t in enumerate(texts) for w in decontaminate.words(t)]
    assert owner.tolist() == [i for i, _ in want]
    assert len(dict(zip([w for _, w in want], h.tolist()))) == len(set(h.tolist())) == len({w for _, w in want})


def test_no_items_and_no_documents(make, items):
    assert decontaminate.scan(make([(1, "x")]), items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.scan(make([]), items).count() == 0


# Licenses


def test_patience_never_beats_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))] for _ in range(2))
        found, best = license_scan.patience(a, b), license_scan.common_subsequence(a, b)
        assert all(a[i] == b[j] for i, j in found) and len(found) <= len(best)
        assert found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)


def test_notices_are_found_where_they_lie(make):
    apache = license_scan.NOTICES["Apache-2.0"][1]
    edited = apache.replace("applicable law", "any law").replace("You may", "one\nmay")
    rows = [(1, f"{words(1, 30)} {edited} {words(2, 30)}"), (2, f"{words(3, 400)}\nReleased under the MIT License.\n{words(4, 50)}"), (3, words(5, 90) + " license the under"), (4, None), (None, ""), (5, "Licensed under CC BY-NC 4.0. " * 3), (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in license_scan.scan(make(rows)).collect()}
    assert {i: r.license for i, r in got.items()} == {1: "Apache-2.0", 2: "MIT", 3: None, 4: None, None: None, 5: "CC-BY-NC-4.0", 6: "GPL-3.0"}
    assert got[2].first_word == 400 and got[2].coverage == 1 and 0.8 <= got[1].coverage < 1 and got[3].coverage == 0
    assert license_scan.scan(make([])).count() == 0


def test_notices_side_by_side_are_each_found(make):
    mit, bsd = license_scan.NOTICES["MIT"][2], license_scan.NOTICES["BSD-3-Clause"][0]
    changed = mit.replace("charge", "fee")
    rows = [(1, f"{mit} qq zz {changed} qq zz {changed}"), (2, f"{bsd} {words(1, 40)} {mit}"), (3, " ".join([changed] * 9))]
    got = {r.doc_id: r for r in license_scan.scan(make(rows)).collect()}
    n = len(license_scan.words(mit))
    assert [(x.license, x.first_word, x.last_word) for x in sorted(got[1].notices, key=lambda x: x.first_word)] == [("MIT", k * (n + 2), k * (n + 2) + n - 1) for k in range(3)]
    assert got[1].license == "MIT" and got[1].coverage == 1 and got[1].n_notices == 3
    assert {x.license for x in got[2].notices} == {"MIT", "BSD-3-Clause"}
    assert sorted(x.first_word for x in got[3].notices) == [k * n for k in range(9)]


@pytest.mark.parametrize("copies", [1, 2, 3, 5])
@pytest.mark.parametrize("gap", [0, 2, 10, 60])
@pytest.mark.parametrize("name", ["MPL-2.0", "BSD-3-Clause", "Apache-2.0"])
def test_every_intact_copy_is_found_among_edited_ones(name, copies, gap):
    """One intact notice first, then copies with one word in twelve changed, with words of another kind between."""
    rng, notice = random.Random(copies * 100 + gap), license_scan.words(max(license_scan.NOTICES[name], key=len))
    text, want = [], []
    for k in range(copies):
        text += [f"z{rng.randrange(10**6)}" for _ in range(gap)]
        want.append(len(text))
        text += [w if k == 0 or rng.random() > 1 / 12 else "edited" for w in notice]
    found = license_scan.Notices(license_scan.NOTICES).find(" ".join(text), 0.8)
    mine = [f for f in found if f[0] == name]
    assert any(f[1] == 1.0 and f[2] == want[0] for f in mine)
    for start in want:  # each copy overlaps a notice found, and none is found twice
        assert any(f[2] < start + len(notice) and f[3] >= start for f in mine), start
    assert len(mine) <= copies


@pytest.mark.parametrize("text", [
    "Released under the BSD License", "Licensed under the GPL License", "Licensed under the Zlib License", "Licensed under the Apache License, Version 1.1", "released under the new license", "Released under the MIT-0 License",
    "This work is licensed under the GNU General Public License, version 2", "This work is licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3",
    "Licensed under CC BY-ND 4.0", "Licensed under CC BY 3.0", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-NC-ND 4.0", "Distributed under the Boost Software License, Version 2.0.",
])
def test_a_variant_that_no_notice_has_is_no_license(text):
    ready = license_scan.Notices(license_scan.NOTICES)
    assert ready.find(text, 0.8) == ready.find(f"{words(1, 40)} {text}. {words(2, 40)}", 0.8) == []


def test_longer_names_are_not_shorter_ones():
    ready = license_scan.Notices(license_scan.NOTICES)
    for name in ("LGPL-3.0", "AGPL-3.0", "GPL-3.0", "GPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"):
        for text in license_scan.NOTICES[name]:
            assert {f[0] for f in ready.find(f"{words(3, 30)} {text} {words(4, 30)}", 0.8)} == {name}


def test_a_notice_with_one_naming_word_changed_is_not_that_license():
    ready, other = license_scan.Notices(license_scan.NOTICES), {"mit": "bsd", "gnu": "mit", "nc": "nd", "sa": "nd", "lesser": "affero", "affero": "lesser"}
    n = 0
    for name, texts in license_scan.NOTICES.items():
        for notice in map(license_scan.words, texts):
            for i, word in enumerate(notice):
                if i == notice.index(word) and (license_scan.naming(word) and word != "version" or license_scan.numeral(word)):
                    changed = [*notice[:i], "7" if license_scan.numeral(word) else other.get(word, "proprietary"), *notice[i + 1 :]]
                    assert name not in {f[0] for f in ready.find(" ".join(changed), 0.8)}, (name, word)
                    n += 1
    assert n > 30


def test_a_long_notice_with_other_words_changed_is_still_found():
    ready, rng = license_scan.Notices(license_scan.NOTICES), random.Random(8)
    for name, texts in license_scan.NOTICES.items():
        notice = license_scan.words(max(texts, key=len))
        free = [i for i, w in enumerate(notice) if not (license_scan.naming(w) or license_scan.numeral(w))]
        if len(notice) >= 20:
            for i in rng.sample(free, len(notice) // 10):
                notice[i] = "qq"
            assert ready.find(" ".join(["Copyright 2019 x", *notice]), 0.8)[0][0] == name


def test_each_notice_is_its_own_license():
    ready = license_scan.Notices(license_scan.NOTICES)
    for name, texts in license_scan.NOTICES.items():
        for text in texts:
            best = ready.find(f"some words before {text} and after it", 0.8)[0]
            assert best[1] == 1.0 and (best[0] == name or len(license_scan.words(text)) < len(license_scan.words(max(license_scan.NOTICES[best[0]], key=len)))), (name, best)


# Token counts


def brute_totals(rows):
    encode = packing.encoder(packing.default_vocabulary())
    out: dict = {}
    for source, lang, text in rows:
        n, k = out.get((source, lang), (0, 0))
        out[source, lang] = (n + 1, k + len(encode([text or ""])[0]))
    return out


def test_rollups_follow_every_change_once(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "source string, lang string, text string")
    state = str(tmp_path / "state")
    first = [("a", "en", words(i, 9)) for i in range(30)] + [("b", None, "x"), (None, "fr", None), ("a", "en", words(1, 9))]
    assert token_rollup.totals(spark, state).count() == 0
    assert token_rollup.commit_batch(state, "1", token_rollup.images(make(first), 1))
    assert not token_rollup.commit_batch(state, "1", token_rollup.images(make(first), 1))
    gone, before, after = first[:5], first[5:8], [("c", "en", "new text here")] * 3
    token_rollup.commit_batch(state, "2", token_rollup.images(make(gone), -1))
    token_rollup.commit_batch(state, "3", token_rollup.revisions(make(before), make(after)))
    token_rollup.commit_batch(state, "4", token_rollup.images(make([]), 1))
    want = brute_totals(first[8:] + after)
    read = lambda: {(r.source, r.lang): (r.documents, r.tokens) for r in token_rollup.totals(spark, state).collect()}
    assert read() == want
    for name in ("2", ".2.crc"):
        os.remove(f"{state}/commits/{name}")  # as if the batch had failed before its commit: not counted, then written anew
    assert read() != want
    assert token_rollup.commit_batch(state, "2", token_rollup.images(make(gone), -1))
    assert read() == want
    assert token_rollup.compact(spark, state) and not token_rollup.compact(spark, state)
    assert read() == want
    for _ in range(2):  # batches that come again after compaction, and after the old files went
        for name in "123":
            assert not token_rollup.commit_batch(state, name, token_rollup.images(make(first), 1))
        assert read() == want
        token_rollup.clean(spark, state)
    assert token_rollup.commit_batch(state, "a/b c", token_rollup.images(make(gone), 1)) and read() != want
    assert token_rollup.compact(spark, state)
    assert token_rollup.commit_batch(state, "5", token_rollup.images(make(gone), -1)) and read() == want


def test_rollup_writers_and_crashes(spark, tmp_path, monkeypatch):
    docs, state = spark.createDataFrame([("a", "en", words(1, 9))], "source string, lang string, text string"), str(tmp_path / "state")
    changes, plain = token_rollup.images(docs, 1), token_rollup.delta

    def overtaken(rows, tokenizers=None):  # another writer commits the same batch while this one is at work
        monkeypatch.setattr(token_rollup, "delta", plain)
        assert token_rollup.commit_batch(state, "1", changes)
        return plain(rows, tokenizers)

    monkeypatch.setattr(token_rollup, "delta", overtaken)
    assert not token_rollup.commit_batch(state, "1", changes)
    count = lambda: token_rollup.totals(spark, state).first().documents
    assert count() == 1 and len(os.listdir(f"{state}/deltas/1")) == 1

    publish = token_rollup.Store.publish
    for module_call in (lambda: token_rollup.compact(spark, state), lambda: token_rollup.commit_batch(state, "2", changes)):
        monkeypatch.setattr(token_rollup.Store, "publish", lambda *_: 1 / 0)  # dies when all but the last step is done
        with pytest.raises(ZeroDivisionError):
            module_call()
        monkeypatch.setattr(token_rollup.Store, "publish", publish)
        assert count() == 1
    token_rollup.clean(spark, state)
    assert count() == 1 and token_rollup.commit_batch(state, "2", changes) and count() == 2
    assert token_rollup.compact(spark, state) and count() == 2
    assert not token_rollup.Store(spark, state).publish("manifests/000000000001", "{}") and count() == 2


# Pipeline


def test_stages_keep_clean_documents_and_take_out_the_rest(spark, tmp_path):
    leak = words(900, 30)
    clean = [(i, words(i, 120, "ka lo mi ru te sa" if i % 2 else "schu ber ung ach ei zt"), "aa" if i % 2 else "bb") for i in range(80)]
    near = clean[3][1].split()
    near[60] = "zz"
    rows = [*clean, (100, clean[3][1], "aa"), (101, " ".join(near), "aa"), (102, f"{words(500, 60)} {leak}", "aa"), (103, None, "aa"), (104, "12345 !!", "bb"), (105, clean[8][1] + "\n" + words(600, 50), "bb")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (2, words(901, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, frame = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        assert frame.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in frame.collect()}
    everyone = {i for i, _, _ in rows}
    assert everyone - set(kept["language_id"]) == {103, 104}
    assert set(kept["language_id"]) - set(kept["line_dedup"]) == {100, 101} and kept["line_dedup"][105] == words(600, 50)
    assert set(kept["minhash_dedup"]) == set(kept["line_dedup"])
    assert set(kept["minhash_dedup"]) - set(kept["decontamination"]) == {102}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])


def test_a_long_notice_may_lose_a_name_to_an_ordinary_word_only():
    ready, notice = license_scan.Notices(license_scan.NOTICES), license_scan.words(max(license_scan.NOTICES["Apache-2.0"], key=len))
    at = notice.index("apache")
    found = lambda *instead: {f[0] for f in ready.find(" ".join([*notice[:at], *instead, *notice[at + 1 :]]), 0.8)}
    assert found("edited") == {"Apache-2.0"}
    assert found("mozilla") == found() == set()
    assert "Apache-2.0" not in found("edited", "mit")
