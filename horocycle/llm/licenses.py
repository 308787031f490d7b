"""License scans by patience alignment of texts with templates.

Words of text and template (letters and digits, lower-cased) that occur once in either are anchors; the longest increasing
subsequence of their places keeps those in order, and the gaps between anchors are aligned the same way, after equal words
at their ends.  Coverage is the share of a template's words that are aligned.

A text is aligned around places that share three successive words with a template.  Where that leaves a template short of
whole coverage, it is aligned also in the stretches of ``STRETCH`` times its words that hold enough of them, each word
counted as often as the template has it: less cannot reach the coverage, so no covered stretch of that length is passed over.
Everything happens within a row, with the templates on every worker; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horocycle.llm import subwords, textkit

# The wording of public licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}
RUN = 3
#: Words of a text over which a template may be spread, in times its own.
STRETCH = 4


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal items, increasing in both, by recursive patience alignment."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i == j or k == m:
            continue
        times_a, times_b = Counter(a[i:j]), Counter(b[k:m])
        place = {x: y for y, x in enumerate(b[k:m], k) if times_b[x] == 1}
        once = [(y, place[x]) for y, x in enumerate(a[i:j], i) if times_a[x] == 1 and x in place]
        if not once:
            continue
        last_a, last_b = i, k
        for n in increasing([y for _, y in once]):
            x, y = once[n]
            pairs.append((x, y))
            todo.append((last_a, x, last_b, y))
            last_a, last_b = x + 1, y + 1
        todo.append((last_a, j, last_b, m))
    return sorted(pairs)


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, raw, offs in textkit.blocks(column):
        hashed, counts = textkit.words(subwords._WORD[raw], offs, lower=False)
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            yield hashed[a:b]


def _runs(words: np.ndarray) -> np.ndarray:
    return textkit.ngrams(words, np.array([len(words)]), RUN)[0]


class Scanner:
    """Finds templates in texts of word hashes."""

    def __init__(self, templates: dict[str, str], percent: int) -> None:
        self.names, self.percent = list(templates), percent
        self.words = list(_words(pa.array(list(templates.values()), pa.string())))
        runs = [np.unique(_runs(w)) for w in self.words]
        flat = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.times = np.zeros((len(self.words), len(self.vocabulary)), np.int64)
        for times, w in zip(self.times, self.words, strict=True):
            np.add.at(times, np.searchsorted(self.vocabulary, w), 1)
        self.least = np.array([max(1, -(-percent * len(w) // 100)) for w in self.words], np.int64)

    def windows(self, hits: np.ndarray, width: int, n: int) -> list[tuple[int, int]]:
        """Stretches of the text around hits; hits further apart than a template is long are looked at apart."""
        cut = np.flatnonzero(np.diff(hits) > width) + 1
        return [(max(0, int(x[0]) - width), min(n, int(x[-1]) + RUN + width)) for x in np.split(hits, cut)]

    def by_runs(self, words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The best alignment of each template that shares a run of words."""
        runs = _runs(words)
        if not len(runs) or not len(self.flat):
            return {}
        a, b = np.searchsorted(self.flat, runs, "left"), np.searchsorted(self.flat, runs, "right")
        hits: dict[int, list[int]] = {}
        for x in np.flatnonzero(b > a):
            for t in self.owner[a[x] : b[x]]:
                hits.setdefault(int(t), []).append(int(x))
        out = {}
        for t in hits:
            template = self.words[t].tolist()
            best: list[tuple[int, int]] = []
            for lo, hi in self.windows(np.array(hits[t]), len(template), len(words)):
                # A long stretch repeats the template: it is aligned in overlapping parts, each of which can hold it whole.
                for start in range(lo, max(lo + 1, hi - 2 * len(template)), len(template)):
                    stop = hi if hi - lo <= 4 * len(template) else min(hi, start + 3 * len(template))
                    pairs = align(template, words[start:stop].tolist())
                    if len(pairs) > len(best):
                        best = [(x, y + start) for x, y in pairs]
                    if stop == hi or 100 * len(best) == 100 * len(template):
                        break
            out[t] = best
        return out

    def by_words(self, t: int, words: np.ndarray, at: np.ndarray, kinds: np.ndarray, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``best``, or a better alignment of template ``t`` in a stretch with enough of its words, which are of ``kinds`` at ``at``."""
        template, least, most = self.words[t].tolist(), int(self.least[t]), self.times[t]
        own = most[kinds] > 0
        places, kinds = at[own].tolist(), kinds[own].tolist()
        size = STRETCH * len(template)

        def taken(x: int, seen: dict[int, int], step: int) -> int:
            """The change of the words counted when one of kind ``x`` comes (1) or goes (-1)."""
            n = seen[x] = seen.get(x, 0) + step
            return step if (n <= most[x] if step > 0 else n < most[x]) else 0

        # The stretch that ends at j and is as long as may be, and the shortest that still has enough.
        wide, tight, seen_w, seen_t, in_w, in_t = 0, 0, {}, {}, 0, 0
        for j, x in enumerate(kinds):
            in_w += taken(x, seen_w, 1)
            in_t += taken(x, seen_t, 1)
            while places[j] - places[wide] >= size:
                in_w += taken(kinds[wide], seen_w, -1)
                wide += 1
            while tight < wide or in_t - (seen_t[kinds[tight]] <= most[kinds[tight]]) >= least:
                in_t += taken(kinds[tight], seen_t, -1)
                tight += 1
            if in_w < max(least, len(best) + 1):
                continue
            end = places[j] + 1
            for start in {places[tight], max(places[wide], end - len(template)), max(places[wide], end - 2 * len(template)), places[wide]}:
                pairs = align(template, words[start:end].tolist())
                if len(pairs) > len(best):
                    best = [(a, b + start) for a, b in pairs]
            if len(best) == len(template):
                break
        return best

    def scan(self, words: np.ndarray) -> list[tuple[str, int, int, int, int]]:
        """(template, aligned words, template's words, first and last place) of the best-covering window of each template found."""
        if not len(words) or not len(self.vocabulary):
            return []
        kinds = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[kinds] == words)
        kinds = kinds[at]
        held = np.minimum(self.times, np.bincount(kinds, minlength=len(self.vocabulary))).sum(axis=1)
        enough = np.flatnonzero(held >= self.least)
        if not len(enough):
            return []
        found, out = self.by_runs(words), []
        for t in enough.tolist():
            best, n = found.get(t, []), len(self.words[t])
            if len(best) < n:
                best = self.by_words(t, words, at, kinds, best)
            if best and 100 * len(best) >= self.percent * n:
                out.append((self.names[t], len(best), n, best[0][1], best[-1][1]))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = 80) -> DataFrame:
    """``doc_id, license, n_matched, n_words, coverage, first_word, last_word`` for each template that a text covers to ``percent``.

    The places are those of the best-covering stretch, in words of the text from 0.  Null, empty and other texts without a
    template have no rows; repeated rows come out repeatedly; a null doc_id stays null; other columns are ignored.
    """
    scanner = Scanner(templates, percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, words in enumerate(_words(batch.column(1))):
                for x in scanner.scan(words):
                    rows.append(i)
                    found.append((x[0], x[1], x[2], x[1] / x[2], x[3], x[4]))
            columns = list(zip(*found, strict=True)) if found else [[] for _ in range(6)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "license", "n_matched", "n_words", "coverage", "first_word", "last_word"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, license string, n_matched long, n_words long, coverage double, first_word long, last_word long")
