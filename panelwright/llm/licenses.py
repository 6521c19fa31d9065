r"""License scan: exact set-similarity join of text blocks with notice templates.

Words are runs of digits, lower-cased letters and non-ASCII characters. A
block is a line. A line b meets a template T when it contains at least the
share CONTAIN of T's distinct words.

Filters, all exact. The words of the templates are ordered by how often they
occur in the whole corpus, rarest first (ties by the word). With n words and
``need`` = ceil(CONTAIN n), a line that meets T must hold one of T's first
n - need + 1 words (prefix), must have ``need`` words (length), and when the
rarest word it shares has place i in T's order it can share at most n - i
(position). Only lines that pass are counted word by word. Templates are a
parameter with a checked bound, so they and their index go to every task; the
documents are read in place and never shuffled.

Notices (the templates again, and NOTICES: declarations, headers, paragraphs) meet runs of as many words
as they have, wherever lines break; short ones must be there whole.

Base phrases are exact runs of words anywhere in the text.

Edge cases: a null text is empty: no words, no labels, score 0; templates
without words are refused; rows repeating a doc_id are scanned one by one; a
null doc_id is returned as it is; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import NON_WORD, Words, arrow_map, read, small_batches, steps, texts_of
from panelwright.llm.registry import query

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening words of well-known public notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-attribution": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This is free and unencumbered software released into the public domain",
}
# What the query looks for besides: declaration lines, header notices and the
# paragraphs of the licences themselves, each under its label.
# Met only whole: in a short sentence one word tells licences apart.
DECLARATIONS = {
    "apache-2.0": [
        "Released under the Apache License, Version 2.0",
        "Licensed under the Apache License 2.0",
        "This project is licensed under the Apache License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License",
        "This project is licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-attribution": [
        "Licensed under a Creative Commons Attribution License",
        "Released under the Creative Commons Attribution License",
    ],
    "gpl-notice": [
        "Released under the GNU General Public License",
        "Licensed under the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the MIT License",
        "Distributed under the terms of the MIT License",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "Released under the Mozilla Public License",
        "Licensed under the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "public-domain": [
        "Released into the public domain",
        "SPDX-License-Identifier: Unlicense",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
# Met from a share of CONTAIN of their words on.
PARAGRAPHS = {
    "apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "bsd": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "cc-attribution": [
        "You are free to share, copy and redistribute the material in any medium or format for any purpose, even commercially",
        "You must give appropriate credit, provide a link to the license, and indicate if changes were made. You may do so in any reasonable manner, but not in any way that suggests the licensor endorses you or your use.",
    ],
    "gpl-notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl-2.0": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "public-domain": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
CONTAIN = 0.8
MOST_TEMPLATE_WORDS = 1_000_000  # beyond it the templates are no parameter any more


def notices() -> list[tuple[str, str, float]]:
    """(label, text, share) of what is looked for in runs of words; every notice states its share."""
    openings = [(k, t, CONTAIN) for k, t in TEMPLATES.items()]
    return openings + [(k, t, 1.0) for k, ts in DECLARATIONS.items() for t in ts] + [(k, t, CONTAIN) for k, ts in PARAGRAPHS.items() for t in ts]


def words_of(text: str) -> list[str]:
    w = Words([text], NON_WORD, True)
    return [w.data[a:b].decode() for a, b in zip(w.starts.tolist(), w.ends.tolist())]


def hashes_of(words: list[str]) -> np.ndarray:
    return Words([" ".join(words)], NON_WORD, True).hashes if words else np.empty(0, np.uint64)


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of ``words`` occurs in all texts; one row per word and task moves."""
    known = hashes_of(words)
    order = np.argsort(known)
    ordered = known[order]

    def run(batches):
        total = np.zeros(len(words) + 1, np.int64)
        for b in batches:
            texts = texts_of(b.column(0))
            for x, y in steps(texts):
                total += np.bincount(_places(ordered, Words(texts[x:y], NON_WORD, True).hashes), minlength=len(words) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(total[:-1])], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(words, 0) | {words[r.word]: r.n for r in rows}


def _places(ordered: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted table; the table's length where it is missing."""
    at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    return np.where(ordered[at] == hashes, at, len(ordered))


class Index:
    """Templates in global frequency order with their prefix index."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], contain: float):
        self.names = sorted(templates)
        sets = {k: set(words_of(templates[k])) for k in self.names}
        self.words = sorted(set().union(*sets.values()))
        known = hashes_of(self.words)
        by = np.argsort(known)
        self.ordered = known[by]
        place = {self.words[i]: k for k, i in enumerate(by.tolist())}
        self.members, self.need, self.size = [], [], []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, name in enumerate(self.names):
            ranked = sorted(sets[name], key=lambda w: (counts.get(w, 0), w))
            n, need = len(ranked), math.ceil(contain * len(ranked) - 1e-9)
            self.members.append({place[w] for w in ranked})
            self.need.append(need)
            self.size.append(n)
            for i, w in enumerate(ranked[: n - need + 1]):
                self.prefix.setdefault(place[w], []).append((t, i))
        self.in_prefix = np.zeros(len(self.words) + 1, bool)
        self.in_prefix[list(self.prefix)] = True

    def matches(self, places: np.ndarray, line: np.ndarray):
        """(line, template, shared) of every line that meets a template.

        ``places`` and ``line``: per word its place in the table and its line, ascending.
        """
        first: dict[tuple[int, int], int] = {}
        for w in np.flatnonzero(self.in_prefix[places]).tolist():
            for t, i in self.prefix[int(places[w])]:
                key = int(line[w]), t
                first[key] = min(i, first.get(key, i))
        for (b, t), i in first.items():
            x, y = np.searchsorted(line, [b, b + 1])
            if y - x < self.need[t] or self.size[t] - i < self.need[t]:
                continue
            shared = len(self.members[t].intersection(places[x:y].tolist()))
            if shared >= self.need[t]:
                yield b, t, shared


class Runs:
    """Notices met by runs of words as long as they are, across line breaks.

    As for lines, words are in global frequency order: a run that holds enough
    words of a notice holds one of its rarest (prefix filter), and all it holds
    lies within its length of that one (position filter).
    """

    def __init__(self, notices: list[tuple[str, str, float]], counts: dict[str, int]):
        self.notices, self.rarest = [], {}
        for label, text, share in notices:
            words = words_of(text)
            if not words:
                raise ValueError("notices need words")
            ranked = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
            need = math.ceil(share * len(ranked) - 1e-9)
            rare = np.sort(hashes_of(ranked[: len(ranked) - need + 1]))
            for h in rare.tolist():
                self.rarest.setdefault(h, []).append(len(self.notices))
            self.notices.append((label, np.sort(hashes_of(ranked)), rare, len(words), need))
        self.known = np.unique(np.concatenate([n[1] for n in self.notices])) if self.notices else np.empty(0, np.uint64)
        self.prefix = np.array(sorted(self.rarest), np.uint64)

    def matches(self, hashes: np.ndarray, owner: np.ndarray, bounds: np.ndarray):
        """(text, label, share) of every text with a run that holds enough words of a notice.

        A word counts in the runs that start after its last occurrence, so
        running sums give the distinct words of all runs at once.
        """
        if not self.notices or not len(hashes):
            return
        met = np.unique(_places(self.prefix, hashes))
        tried = {k for i in met[met < len(self.prefix)].tolist() for k in self.rarest[int(self.prefix[i])]}
        if not tried:
            return
        at = np.flatnonzero(_places(self.known, hashes) < len(self.known))
        kept = hashes[at]
        for label, known, rare, length, need in (self.notices[k] for k in sorted(tried)):
            which = _places(known, kept)
            mine = which < len(known)
            place, word = at[mine], which[mine]
            anchor = place[_places(rare, known)[word] < len(rare)]
            behind = np.minimum(np.searchsorted(anchor, place - length + 1), len(anchor) - 1)
            near = np.abs(anchor[behind] - place) < length
            place, word = place[near], word[near]
            if len(np.unique(word)) < need:
                continue
            by = np.lexsort((place, word))
            last = np.full(len(place), -1)
            last[by[1:]] = np.where(word[by[1:]] == word[by[:-1]], place[by[:-1]], -1)
            first = np.maximum(np.maximum(last + 1, place - length + 1), bounds[owner[place]])
            change = np.bincount(first, minlength=len(hashes) + 1) - np.bincount(place + 1, minlength=len(hashes) + 1)
            held = np.cumsum(change)[:-1]
            hits = np.flatnonzero(held >= need)
            for d in np.unique(owner[hits]).tolist():
                yield d, label, float(held[hits][owner[hits] == d].max()) / len(known)


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, contain: float = CONTAIN,
    notices: list[tuple[str, str, float]] = (),
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``notices``: (label, text, share) looked for in runs of words beside the templates.
    """
    words = sorted({w for t in [*templates.values(), *(n[1] for n in notices)] for w in words_of(t)})
    if not all(map(words_of, templates.values())) or len(words) > MOST_TEMPLATE_WORDS:
        raise ValueError("templates need words, and not more than a task can hold")
    counts = frequencies(docs, words)
    index, spread = Index(templates, counts, contain), Runs(notices, counts)
    runs = [(hashes_of(words_of(p)), label) for p, label in phrases.items()]

    def run(batch):
        ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        rows = []
        for x, y in steps(texts):
            w = Words(texts[x:y], NON_WORD, True)
            feeds = np.flatnonzero(np.frombuffer(w.data, np.uint8) == 0x0A)
            line = np.searchsorted(feeds, w.starts)  # a line feed ends every text
            owner = np.searchsorted(w.bounds, np.arange(len(w)), "right") - 1
            labels = [set() for _ in range(y - x)]
            base = [set() for _ in range(y - x)]
            places = [[] for _ in range(y - x)]
            score = [0.0] * (y - x)
            for hashes, label in runs:
                n = len(hashes)
                hit = np.ones(max(0, len(w) - n + 1), bool)
                for k, h in enumerate(hashes):
                    hit &= w.hashes[k : len(w) - n + 1 + k] == h
                for at in np.flatnonzero(hit).tolist():
                    d = int(owner[at])
                    if owner[at + n - 1] == d:
                        places[d].append(at - int(w.bounds[d]))
                        base[d].add(label)
                        score[d] = 1.0
            for b, t, shared in index.matches(_places(index.ordered, w.hashes), line):
                d = int(owner[np.searchsorted(line, b)])
                labels[d].add(index.names[t])
                score[d] = max(score[d], shared / index.size[t])
            for d, label, share in spread.matches(w.hashes, owner, w.bounds):
                labels[d].add(label)
                score[d] = max(score[d], share)
            for d in range(y - x):
                p = places[d]
                rows.append((
                    ids[x + d], int(w.bounds[d + 1] - w.bounds[d]), len(p), min(p, default=None), max(p, default=None),
                    ",".join(sorted(base[d])), ",".join(sorted(base[d] | labels[d])), score[d],
                ))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, _SCHEMA)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
])


def _sql() -> str:
    """The same by brute force: every line against every template, every run against every notice."""
    word = r"'[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    temp = ", ".join(f"('{k}', {sorted(set(words_of(v)))})" for k, v in TEMPLATES.items())
    phrase = ", ".join(f"('{v}', {words_of(k)})" for k, v in PHRASES.items())
    spread = ", ".join(f"({i}, '{k}', {sorted(set(words_of(t)))}, {len(words_of(t))}, {math.ceil(share * len(set(words_of(t))) - 1e-9)})" for i, (k, t, share) in enumerate(notices()))
    return f"""
WITH t(label, ws) AS (VALUES {temp}), p(label, ws) AS (VALUES {phrase}), z(k, label, ws, length, need) AS (VALUES {spread}),
d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, {word}) AS ws FROM d),
hit AS (SELECT r, label, unnest(list_filter(range(len(w.ws)), lambda i: w.ws[i + 1:i + len(p.ws)] = p.ws)) AS pos FROM w, p),
b AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS ls FROM hit GROUP BY r),
l AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(x, chr(10))), {word})) AS ws FROM d),
m AS (SELECT r, label, len(list_intersect(l.ws, t.ws)) / len(t.ws) AS s FROM l, t WHERE len(list_intersect(l.ws, t.ws)) >= ceil({CONTAIN} * len(t.ws) - 1e-9)),
zw AS (SELECT k, label, len(ws) AS n, length, need, unnest(ws) AS v FROM z),
o AS (SELECT r, unnest(ws) AS v, generate_subscripts(ws, 1) AS i FROM w),
x AS (SELECT r, k, any_value(label) AS label, any_value(n) AS n, any_value(length) AS length, any_value(need) AS need, list(v ORDER BY i) AS vs, list(i ORDER BY i) AS js
      FROM o JOIN zw USING (v) GROUP BY r, k HAVING count(DISTINCT v) >= any_value(need)),
y AS (SELECT r, label, n, need, list_unique(vs[a:a + len(list_filter(js, lambda j: j >= js[a] AND j < js[a] + length)) - 1]) AS c FROM (SELECT *, unnest(range(1, len(js) + 1)) AS a FROM x)),
u AS (SELECT r, label, s FROM m UNION ALL SELECT r, label, max(c) / any_value(n) FROM y WHERE c >= need GROUP BY r, label, n, need),
f AS (SELECT r, list(DISTINCT label) AS ls, max(s) AS s FROM u GROUP BY r)
SELECT doc_id, len(w.ws)::BIGINT AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
       coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.ls, f.ls))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.s, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""


@query("op7_license_scan", _sql())
def op7_license_scan(spark, sf_dir):
    return scan(read(spark, sf_dir, "documents"), notices=notices())
