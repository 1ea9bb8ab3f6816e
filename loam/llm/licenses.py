"""License scans by patience alignment.

Words that occur once in a template and once in the stretch of text beside it are
anchors; the longest increasing subsequence of them is taken, and the gaps between
are aligned in the same way. Coverage is the share of a template's words that the
alignment matches.

Any word may anchor: a notice is found wherever a stretch matches enough of its
words, also where its name is misspelt. Lines of under 16 words hold little else than
a name, so there the words that name the license have to match and to stand together
("CC BY 4.0" is four fifths of "CC BY-NC 4.0"), and a line after "not" is none. Of
licenses that claim the same words, the one that matches more of them stays, then the
one that is covered better, then the one more of whose telling phrases stand whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least coverage of a template that counts as found.
COVERAGE = 0.8

#: Templates of fewer words are lines.
LINE = 16

#: Words of telling phrases that don't tell one license from another. Fixed values.
GENERIC = {"and", "general", "in", "license", "public", "the", "use", "v", "version"}

#: Words before a line that turn it round. Fixed values.
NEGATIONS = {"aren't", "isn't", "never", "not", "wasn't"}

#: Public identifiers of the covered licenses, and names in prose. Fixed values.
IDENTIFIERS = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
NAMES = (
    ("Apache-2.0", "Apache Software License, Version 2.0"),
    ("CC-BY-4.0", "CC-BY 4.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "CC-BY-NC 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "CC-BY-SA 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("MIT", "MIT licensed"),
    ("MIT", "MIT-licensed"),
)


def _identifier_lines():
    for name in IDENTIFIERS:
        for tail in ("", "-only", "-or-later") if "GPL" in name else ("",):
            line = f"SPDX-License-Identifier: {name}{tail}"
            yield name, line, (line,)


#: (license, template, telling phrases): public license lines and notices. Fixed values.
TEMPLATES = (
    *_identifier_lines(),
    *((name, line, (line,)) for name, line in NAMES),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("GNU Affero General Public License", "version 3"),
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("Apache License", "Version 2.0")),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("Apache License", "Version 2.0"),
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        ("Redistribution and use in source and binary forms",),
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("Redistribution and use in source and binary forms", "endorse or promote products"),
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ("CC BY 4.0",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("CC BY-NC 4.0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("CC BY-SA 4.0",)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("GNU General Public License", "version 2")),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ("GNU General Public License", "version 2"),
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("GNU General Public License", "version 3")),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("GNU General Public License", "version 3"),
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        ("with or without fee", "provided that"),
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("GNU Lesser General Public License", "version 3")),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("GNU Lesser General Public License", "version 3"),
    ),
    ("MIT", "Released under the MIT License.", ("MIT License",)),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        ("hereby granted, free of charge",),
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("Mozilla Public License", "v. 2.0"),
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software", "public domain")),
)

_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    """Lower-cased words; inner points, hyphens and apostrophes belong to them."""
    return _WORD.findall(text.lower())


def longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of a and b, as matched positions."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        here, below, w = best[i], best[i + 1], a[i]
        for j in range(len(b) - 1, -1, -1):
            here[j] = below[j + 1] + 1 if w == b[j] else max(below[j], here[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str], repeats: bool = False) -> list[tuple[int, int]]:
    """Matched positions of a and b, increasing in both, by patience alignment.
    With repeats, gaps without a word that occurs once are aligned as well."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in place]
        chain = _increasing(anchors)
        if not chain:
            if repeats:
                out += [(a0 + i, b0 + j) for i, j in longest(a[a0:a1], b[b0:b1])]
            continue
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(x[0] + 1, y[0], x[1] + 1, y[1]) for x, y in zip(edges, edges[1:])]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, in order of the first, with rising second."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        back.append(at[k - 1] if k else -1)
        tails[k : k + 1] = [y]
        at[k : k + 1] = [i]
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(pairs[i])
        i = back[i]
    return chain[::-1]


def spread(words: int) -> int:
    """Words of text in which a template of so many words is sought."""
    return words + (words // 2 if words >= LINE else words // 4)


class Template:
    """A template's words, how many must match, and what tells it apart."""

    def __init__(self, name: str, text: str, telling: tuple[str, ...], coverage: float):
        self.name, self.words = name, words_of(text)
        self.counts, self.width = Counter(self.words), spread(len(self.words))
        self.need = -int(-(coverage * len(self.words) - 1e-9) // 1)
        self.line = len(self.words) < LINE
        self.phrases, at = [], 0
        for phrase in map(words_of, telling):
            at = next(i for i in range(at, len(self.words)) if self.words[i : i + len(phrase)] == phrase)
            self.phrases.append((at, phrase))
            at += len(phrase)
        self.naming = {at + i for at, p in self.phrases for i, w in enumerate(p) if w not in GENERIC} if self.line else set()
        self.must = {self.words[i] for i in self.naming}

    def in_words(self, places: dict[str, list[int]]) -> bool:
        """Whether a text with such words can hold the template at all."""
        if not all(w in places for w in self.must):
            return False
        return sum(min(n, len(places.get(w, ()))) for w, n in self.counts.items()) >= self.need

    def starts(self, places: dict[str, list[int]]) -> list[tuple[int, int]]:
        """(place, words in common) of each word of the template in the text from which
        the next width words have enough words in common with it."""
        events = sorted((p, w) for w in self.counts for p in places.get(w, ()))
        seen: Counter = Counter()
        out, common, end = [], 0, 0
        for p, w in events:
            while end < len(events) and events[end][0] < p + self.width:
                v = events[end][1]
                seen[v] += 1
                common += seen[v] <= self.counts[v]
                end += 1
            if common >= self.need:
                out.append((p, common))
            common -= seen[w] <= self.counts[w]
            seen[w] -= 1
        return out

    def told(self, words: list[str], first: int, last: int) -> int:
        """How many telling phrases stand whole in the stretch."""
        inside = words[first : last + 1]
        return sum(any(inside[i : i + len(p)] == p for i in range(len(inside) - len(p) + 1)) for _, p in self.phrases)

    def accepts(self, chain: list[tuple[int, int]], words: list[str]) -> bool:
        """Whether enough words match; of a line, the naming words too, side by side
        and not after a negation."""
        if len(chain) < self.need:
            return False
        if not self.line:
            return True
        at = dict(chain)
        if not self.naming <= at.keys():
            return False
        for t, p in self.phrases:
            if len({at[i] - i for i in range(t, t + len(p)) if i in at}) > 1:
                return False
        first = chain[0][1]
        return NEGATIONS.isdisjoint(words[max(0, first - 2) : chain[-1][1] + 1])

    def stretches(self, words: list[str], places: dict[str, list[int]]):
        """(matched words, first word, last word) of stretches that hold the template,
        from left to right and apart from each other: of the starts in as many words
        as a stretch has at least, the one that matches most, ties to the shorter
        stretch, then the first."""
        starts, k = self.starts(places), 0
        while k < len(starts):
            stop, best = bisect_left(starts, (starts[k][0] + self.need,)), None
            for p, common in sorted(starts[k:stop], key=lambda s: (-s[1], s[0])):
                if best is not None and common <= best[0]:
                    break
                chain = self.aligned(words, p, best[0] + 1 if best else self.need)
                # one that begins beyond these starts has its own, and must not hide one before it
                if chain and chain[0][1] < starts[k][0] + self.need and (best is None or len(chain) > best[0]):
                    best = (len(chain), chain[0][1], chain[-1][1])
            if best is None:
                k = stop
            else:
                yield best
                k = max(k + 1, bisect_left(starts, (best[2] + 1,)))

    def aligned(self, words: list[str], start: int, least: int) -> list[tuple[int, int]]:
        """The alignment from a start, empty if it isn't accepted or matches less than least."""
        beside = words[start : start + self.width]
        if least > self.need and common_words(self.words, beside) < least:
            return []
        chain = align(self.words, beside, repeats=True)
        if len(chain) < self.need <= common_words(self.words, beside):
            chain = longest(self.words, beside)  # anchors can lead astray
        chain = [(i, start + j) for i, j in chain]
        if len(chain) < least:
            return []
        first, last = chain[0][1], chain[-1][1]
        if last - first >= len(chain):  # the same from the other end, which leaves out a word that comes too early
            n, m = len(self.words) - 1, last
            back = [(n - i, m - j) for i, j in reversed(align(self.words[::-1], words[first : last + 1][::-1], repeats=True))]
            if len(back) >= len(chain) and self.accepts(back, words):
                return back
        return chain if self.accepts(chain, words) else []


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    for w in b:
        hit = left & places.get(w, 0)
        left = (left + hit | left - hit) & full
    return len(a) - left.bit_count()


class Scanner:
    def __init__(self, templates=TEMPLATES, coverage: float = COVERAGE):
        self.templates = [Template(*t, coverage) for t in templates]
        self.vocabulary = frozenset(w for t in self.templates for w in t.counts)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of each license found, its best
        covered stretch only (ties to the longer, then the first), in the order of the
        templates. Licenses that nothing tells apart are all listed."""
        words = words_of(text or "")
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        claims = [
            (first, last, (n, n / len(t.words), t.told(words, first, last)), t.name)
            for t in self.templates
            if t.in_words(places)
            for n, first, last in t.stretches(words, places)
        ]
        best: dict[str, tuple] = {}
        for first, last, (_, share, _), name in _undisputed(claims):
            if name not in best or (share, last - first, -first) > (best[name][0], best[name][2] - best[name][1], -best[name][1]):
                best[name] = (share, first, last)
        return [(name, *best[name]) for name in dict.fromkeys(t.name for t in self.templates) if name in best]


def _undisputed(claims):
    """Claims without a better one of another license on half of their words or more."""
    claims = sorted(claims, key=lambda c: c[:2])
    longest_one, lost = max((last - first for first, last, *_ in claims), default=0), set()
    firsts = [c[0] for c in claims]
    for i, (first, last, worth, name) in enumerate(claims):
        for j in range(bisect_left(firsts, first - longest_one), bisect_right(firsts, last)):
            f, l, w, other = claims[j]
            shared = min(last, l) - max(first, f) + 1
            if other != name and w > worth and 2 * shared >= last - first + 1:
                lost.add(i)
                break
    return [c for i, c in enumerate(claims) if i not in lost]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, licenses, license, coverage, first_word,
    last_word.

    licenses lists the licenses found, in order of name; license is the one with
    the highest coverage, ties to the longer stretch and then the name, with its
    coverage and its place in the text's words. Without one, licenses is empty
    and the rest null; so it is for null and empty texts. Repeated rows each get
    a row; empty input gives none; further columns are ignored.
    """
    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = scanner.scan(text.as_py())
                if not found:
                    rows.append(([], None, None, None, None))
                    continue
                best = max(found, key=lambda f: (f[1], f[3] - f[2], f[0]))
                rows.append((sorted({f[0] for f in found}), *best))
            types = (pa.list_(pa.string()), pa.string(), pa.float64(), pa.int32(), pa.int32())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "licenses", "license", "coverage", "first_word", "last_word"])

    one = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return one.mapInArrow(run, "doc_id long, licenses array<string>, license string, coverage double, first_word int, last_word int")
