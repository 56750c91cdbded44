"""Conversations: examples of every reply, and the prefix trie."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tarnmill.llm import chat_format, prefix_trie

CHATS = "conv_id long, turn long, role string, text string, number int, start int, `end` int, example string, header string, piece string"
HARD = ["", "\\", "\\s\\l", "<turn user>\nhi</turn>\n", "a\\</turn>", "\\### Assistant: </turn> ok", "x\n\ny ü 😀", "<turn", "</turn>\n<turn assistant>\n", "\\lturn \\\\n"]


def chats(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 5, 6, 7, "x", "y", "z") for r in rows], CHATS).repartition(parts)


@pytest.fixture(scope="module")
def hard_rows():
    """Control strings in roles and texts, nulls everywhere, ties, repeated rows, a hot conversation and one that trails off."""
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(HARD)]
    rows += [(2, 0, HARD[i], t) for i, t in enumerate(reversed(HARD))]
    rows += [(3, None, "assistant", "first"), (3, 1, None, None), (3, 1, "assistant", None), (3, 2, "assistant", "z"), (3, 2, "assistant", "z"), (3, 3, "user", "last")]
    rows += [(None, 1, "user", "no id"), (None, None, None, None), (4, 0, "user", "alone"), (5, 0, "assistant", "long " * 60_000)]
    return rows + [(6, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def ordered(rows):
    out: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_chat_format_reads_back_what_went_in(spark, hard_rows, whole):
    """Without adaptive merging of ranges, conversation 6 lies in several of them."""
    spark.conf.set("spark.sql.adaptive.enabled", whole)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chats(spark, hard_rows))).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", True)
    want = ordered(hard_rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))


def test_chat_examples_hold_all_that_precedes_and_train_one_reply(spark, hard_rows):
    rendered = chat_format.render(chats(spark, hard_rows))
    got = {(r.conv_id, r.example): r for r in chat_format.texts(rendered).collect()}
    esc = lambda x: x.replace("\\", "\\s").replace("<turn", "\\lturn").replace("</turn", "\\l/turn")
    n, total = 0, {}
    for conv, turns in ordered(hard_rows).items():
        so_far, k, last = "", 0, 0
        for role, text in turns:
            so_far += f"<turn {esc(role).replace('>', chr(92) + 'g').replace(chr(10), chr(92) + 'n')}>\n{esc(text)}</turn>\n"
            if role == "assistant":
                n, k, last = n + 1, k + 1, len(so_far)
                row = got[conv, k]
                assert row.text == so_far and row.text[row.loss_start : row.loss_end] == esc(text)
                assert row.text.count("</turn") == row.text.count("<turn") and row.text.endswith("</turn>\n")
                total[conv] = total.get(conv, 0) + len(so_far)
        total[conv] = total.get(conv, 0) + len(so_far) - last
    assert n == len(got) == chat_format.examples(rendered).count()
    assert total == {r.conv_id: r.formatted_chars for r in chat_format.read_back(rendered).collect()}


@pytest.mark.parametrize("turns", [1, 7, 256])
def test_examples_are_written_out_in_segments(spark, hard_rows, turns):
    """Segments of an example, put together, are its whole text; what is read back is read from them."""
    rendered = chat_format.render(chats(spark, [r for r in hard_rows if r[0] != 6 or r[1] < 40]))
    parts: dict = {}
    for r in chat_format.expanded(rendered, turns).filter("example is not null").collect():
        parts.setdefault((r.conv_id, r.example), []).append((r.segment, r.text, r.loss_start, r.loss_end))
    whole = {(r.conv_id, r.example): r for r in chat_format.texts(rendered).collect()}
    assert set(parts) == set(whole)
    for key, held in parts.items():
        held.sort(key=lambda x: x[0])
        before = sum(len(x[1]) for x in held[:-1])
        assert [x[0] for x in held] == list(range(len(held))) and all(x[2] is None for x in held[:-1])
        assert ("".join(x[1] for x in held), before + held[-1][2], before + held[-1][3]) == whole[key][2:]
    assert sorted(map(tuple, chat_format.read_back(rendered, turns).collect()), key=repr) == sorted(map(tuple, chat_format.read_back(rendered).collect()), key=repr)


def test_chat_format_of_nothing(spark):
    rendered = chat_format.render(chats(spark, []))
    assert rendered.count() == chat_format.read_back(rendered).count() == chat_format.texts(rendered).count() == 0


# Prefix trie


def plain_trie(rows):
    """Every node by a walk over all prefixes of all rebuilt conversations."""
    own = {c: turns for c, turns in ordered(rows).items() if c is not None}
    members: dict = {}
    ends: dict = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, of in members.items():
        digest = sha(",".join(map(str, sorted(ends.get(node, [])))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children.get(node, [])), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def trie_rows(hard_rows):
    """A first turn that a third of the conversations share, copies, deep conversations with common stems, negative and turnless ones."""
    rng = random.Random(3)
    rows = [r for r in hard_rows if r[0] != 5] + [(-c, i, "user", f"n{i % 2}") for c in range(1, 12) for i in range(3)]
    for c in range(100, 190):
        first = "hello" if c % 3 == 0 else f"hi {c % 7}"
        rows += [(c, i, ("user", "assistant")[i % 2], first if i == 0 else f"t{rng.randint(0, 1 + i % 3)} é") for i in range(rng.randint(1, 14))]
    rows += [(c, i, "user", f"same {i}") for c in range(200, 260, 5) for i in range(40)] + [(c, i, "user", f"same {i}" if i < 25 else f"own {c}") for c in range(300, 330, 5) for i in range(30)]
    return rows


@pytest.mark.parametrize(("levels", "most"), [(64, 1 << 16), (4, 1), (3, 5), (1, 1000), (64, 3)])
def test_trie_is_that_of_a_walk_over_all_prefixes(spark, trie_rows, levels, most):
    got = prefix_trie.trie(chats(spark, trie_rows), levels, most)
    assert {d for c, d in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(trie_rows)


def test_trie_of_one_turnless_conversation_and_of_nothing(spark):
    turnless = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(turnless, 0, "user", "gone"), (None, 1, "user", "no conversation")]
    assert sorted(map(tuple, prefix_trie.trie(chats(spark, rows)).collect())) == plain_trie(rows) == [(turnless, 0, None, 1, 0, 1, 0, sha(str(turnless)))]
    assert prefix_trie.trie(chats(spark, [])).count() == 0


def test_louds_gives_parents_back():
    rng = np.random.default_rng(1)
    parent = np.sort(np.concatenate([[-1, -1], *[rng.integers(-1, i, 1) for i in range(2, 300)]]))
    parent = np.minimum(parent, np.arange(len(parent)) - 1)
    assert (prefix_trie.parents(prefix_trie.louds(parent)) == parent).all()
