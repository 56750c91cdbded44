"""License scans (8): patience alignment of documents with license notices.

A notice is aligned with a text by words: those that occur once in both are anchors, the longest increasing subsequence
of their places is kept, and the gaps between kept anchors are aligned the same way; a gap without such words falls back
to a longest common subsequence. The share of the notice's words that were matched is its coverage, so notices with
changed names, years or line breaks are found, and where they lie.

Only the parts of a text that hold word pairs of a notice are aligned, each with a notice's length of words around it; a
notice that lacks a word pair of the text, or too many of its words, cannot reach the least coverage there. Copies that lie close together are aligned each on its own:
word pairs vote for the places where a copy would start, and each such place is a window too.

Most words of a notice may change, but not those that tell licenses and their versions apart (NAMING, and numbers): each of
a notice's must be matched where it first stands, and none may be put in within the matched span, numbers only where they stand beside a naming
word. A variant that no notice has is thus no license rather than a wrong one. Null or empty texts have no license. Null or repeated doc_ids are carried through; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import slices

WORD = re.compile(r"\w+")

#: Notices by SPDX identifier (fixed values: the public texts of the licenses' own notices).
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
}


#: Words that name a license, a variant or a version (fixed values); `by` names one only after `cc`.
NAMING = frozenset(
    "0bsd affero afl agpl apache artistic attribution boost bsd bsl cc cc0 cddl commons creative ecl eclipse epl eupl gfdl gnu gpl isc lesser lgpl mit mozilla mpl "
    "nc nd noncommercial noderivatives noderivs openssl osl php postgresql proprietary python sa sharealike unlicense version wtfpl zlib".split()
)


LONG = 20  # words of a notice that its other words identify


def naming(word: str) -> bool:
    return word in NAMING


def numeral(word: str) -> bool:
    return word[:1].isdigit() or (word[:1] == "v" and word[1:2].isdigit())


def same_name(notice: list[str], window: list[str], matched: list[tuple[int, int]], after: str = "") -> bool:
    """Whether an alignment keeps every naming word and number of the notice, and puts in none; `after` is the text's next word.

    In a notice of LONG words a name or number may give way to some other word, if that is no name or number either: the
    rest of the notice tells which one it is. One that is left out, or stands for another, makes another license.
    """
    kept = dict(matched)
    for i in {notice.index(x) for x in set(notice) if naming(x) or numeral(x)} - kept.keys():
        before, behind = max((k for k in kept if k < i), default=None), min((k for k in kept if k > i), default=None)
        if len(notice) < LONG or before is None or behind is None:
            return False
        instead = window[kept[before] + 1 : kept[behind]]
        if len(instead) < behind - before - 1 or any(naming(x) or numeral(x) for x in instead):
            return False
    there = {j for _, j in matched}
    first, last = matched[0][1], matched[-1][1]
    if naming(window[last]) and numeral(window[last + 1] if last + 1 < len(window) else after):
        return False
    for j in range(first, last + 1):
        if j not in there:
            x, beside = window[j], [window[k] for k in (j - 1, j + 1) if first <= k <= last]
            if naming(x) or (numeral(x) and any(naming(b) or numeral(b) or b == "by" for b in beside)):
                return False
    return True


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def longest_increasing(values: list[int]) -> list[int]:
    """The places of a longest increasing subsequence of distinct values."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        back[i] = at[k - 1] if k else -1
        tails[k:k + 1], at[k:k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as places in a and b."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        last, row = table[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        table.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1] and table[i][j] == table[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def patience(a: list[str], b: list[str], at: int = 0, bt: int = 0) -> list[tuple[int, int]]:
    """Matched places of two word lists, both increasing."""
    if not a or not b:
        return []
    in_a, in_b = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if in_b[w] == 1}
    anchors = [(i, place[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in place]
    if not anchors:
        return [(i + at, j + bt) for i, j in common_subsequence(a, b)]
    out: list[tuple[int, int]] = []
    i0 = j0 = 0
    for k in [*longest_increasing([j for _, j in anchors]), None]:
        i, j = anchors[k] if k is not None else (len(a), len(b))
        out += patience(a[i0:i], b[j0:j], at + i0, bt + j0)
        if k is not None:
            out.append((i + at, j + bt))
        i0, j0 = i + 1, j + 1
    return out


def copy_starts(votes: list[int], n: int) -> list[int]:
    """Where copies of a notice of n words would start by the votes of its word pairs: the most voted for, a quarter notice apart."""
    taken: dict[int, int] = {}  # by slot, of which each holds one at most
    step = max(1, n // 4)
    for start, _ in sorted(Counter(votes).items(), key=lambda v: (-v[1], v[0])):
        slot = start // step
        if all(abs(start - taken[s]) >= step for s in (slot - 1, slot, slot + 1) if s in taken):
            taken[slot] = start
    return sorted(taken.values())


class Notices:
    def __init__(self, notices: dict[str, list[str]]):
        self.texts = [(name, words(t)) for name, texts in notices.items() for t in texts]
        self.pairs: dict[tuple[str, str], list[int]] = {}
        for k, (_, w) in enumerate(self.texts):
            for pair in set(zip(w, w[1:], strict=False)):
                self.pairs.setdefault(pair, []).append(k)
        self.places: list[dict[tuple[str, str], list[int]]] = [{} for _ in self.texts]
        for places, (_, w) in zip(self.places, self.texts, strict=True):
            for i, pair in enumerate(zip(w, w[1:], strict=False)):
                places.setdefault(pair, []).append(i)
        self.starts = frozenset(a for a, _ in self.pairs)

    def find(self, text: str | None, least: float) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of each notice and place with enough coverage, best ones first."""
        w = words(text)
        seen: dict[int, list[int]] = {}
        for i, x in enumerate(w[:-1]):
            if x in self.starts:
                for k in self.pairs.get((x, w[i + 1]), ()):
                    seen.setdefault(k, []).append(i)
        found = []
        for k, places in seen.items():
            name, notice = self.texts[k]
            n, i = len(notice), 0
            while i < len(places):
                j = i
                while j + 1 < len(places) and places[j + 1] - places[j] <= n:
                    j += 1
                lo, hi = max(0, places[i] - n), min(len(w), places[j] + n + 1)
                votes = [at - o for at in places[i : j + 1] for o in self.places[k][w[at], w[at + 1]]]
                i = j + 1
                part = w[lo:hi]
                if sum((Counter(notice) & Counter(part)).values()) < least * n:
                    continue
                windows = []
                for s in range(0, len(part), 4 * n):  # long parts in windows that overlap by two notices
                    windows.append((lo + s, min(hi, lo + s + 6 * n)))
                    if s + 6 * n >= len(part):
                        break
                for start in copy_starts(votes, n):  # tight windows for copies side by side, wide ones for words put in
                    windows += [(max(0, start - slack), min(len(w), start + n + slack)) for slack in (0, n // 8, n // 4, n // 2)]
                for a, b in sorted(set(windows)):
                    if match := self.align(notice, w, a, b, least):
                        found.append((name, match[2] / n, *match))
        # A notice stands for those that overlap it by its matched words, less half of the other words in its span.
        found.sort(key=lambda f: (-(3 * f[4] - (f[3] - f[2] + 1)), -f[1], f[3] - f[2], f[2], f[0]))
        out: list[tuple[str, float, int, int]] = []
        for f in (f[:4] for f in found):
            if not any(f[2] <= o[3] and o[2] <= f[3] for o in out):
                out.append(f)
        return sorted(out, key=lambda f: (-f[1], f[2], f[0]))


    @staticmethod
    def align(notice: list[str], w: list[str], lo: int, hi: int, least: float) -> tuple[int, int, int] | None:
        """(first word, last word, words matched) of the notice within w[lo:hi], if enough of it is there within three lengths."""
        window, n = w[lo:hi], len(notice)
        if sum((Counter(notice) & Counter(window)).values()) < least * n:
            return None
        matched = patience(notice, window)
        if matched and len(matched) >= least * n and matched[-1][1] - matched[0][1] < 3 * n and same_name(notice, window, matched, w[hi] if hi < len(w) else ""):
            return lo + matched[0][1], lo + matched[-1][1], len(matched)
        return None


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word (of the best notice), n_notices and notices for every row of docs(doc_id, text).

    notices are all of them, best first, as structs (license, coverage, first_word, last_word).
    """
    wanted = notices or NOTICES

    fields = [("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Notices(wanted)
        for batch in slices(batches):
            found = [ready.find(t, least) for t in batch.column("text").to_pylist()]
            best = [f[0] if f else (None, 0.0, None, None) for f in found]
            columns = [pa.array([b[i] for b in best], kind) for i, (_, kind) in enumerate(fields)]
            every = pa.array([[dict(zip((k for k, _ in fields), f, strict=True)) for f in fs] for fs in found], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array([len(f) for f in found], pa.int32()), every], ["doc_id", "license", "coverage", "first_word", "last_word", "n_notices", "notices"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long, n_notices int, notices array<struct<license: string, coverage: double, first_word: long, last_word: long>>")
