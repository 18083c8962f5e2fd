"""License scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of the templates below.  A text is streamed through it: after each word
the state gives the longest run that ends here and occurs in some template (the matching statistics).  Runs of at
least ``MIN_RUN`` words that cannot be extended are anchors; per template, anchors in the template's own order and
at most ``MAX_GAP`` words apart are chained, and a chain that covers ``COVER`` of its template is a finding.
Words outside the templates' vocabulary end every run, so only stretches of known words are streamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.hashing import WORD_TABLE, corpus_words, encode
from lexiloom.llm.tables import slices, source

MIN_RUN, MAX_GAP, COVER = 3, 12, 0.6

#: Base phrases and their labels.
BASE: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public licence notices.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    ("reserved", "All rights reserved"),
]


def split_words(text: str) -> list[bytes]:
    return encode(text).translate(WORD_TABLE).split()


class SuffixAutomaton:
    """Online automaton of several sequences of small integers; a state keeps all ends of its runs, by template."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for k, seq in enumerate(sequences):
            last = 0
            for at, word in enumerate(seq):
                last = self._extend(last, word)
                self.ends[last].setdefault(k, []).append(at)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[s]:
                up = self.ends[self.link[s]]
                for k, at in self.ends[s].items():
                    up[k] = up.get(k, []) + at

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(edges)
        self.ends.append({})
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of exactly one word more than ``p`` along ``word``, made from ``q`` where needed."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: (state, length of the longest run that ends here)."""
        state, held = 0, 0
        nxt, link, size = self.next, self.link, self.size
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                held = size[state]
            if w in nxt[state]:
                state, held = nxt[state][w], held + 1
            yield state, held


class Scanner:
    """Templates, vocabulary, automaton and base phrases, made once per worker."""

    def __init__(self, templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None) -> None:
        self.templates = TEMPLATES if templates is None else templates
        base = BASE if base is None else base
        worded = [split_words(t) for _, t in self.templates]
        phrases = [(split_words(p), label) for p, label in base.items()]
        vocabulary = sorted({w for seq in [*worded, *(p for p, _ in phrases)] for w in seq})
        hashes, _ = corpus_words(vocabulary, WORD_TABLE)
        order = np.argsort(hashes)
        self.table = hashes[order]
        ids = {vocabulary[j]: i for i, j in enumerate(order)}
        self.sequences = [[ids[w] for w in seq] for seq in worded]
        self.phrases = [([ids[w] for w in p], label) for p, label in phrases]
        self.automaton = SuffixAutomaton(self.sequences)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.table, hashes)
        at[at == len(self.table)] = 0
        return np.where(self.table[at] == hashes, at, -1)

    def anchors(self, words: list[int], offset: int) -> Iterator[tuple[int, int, int, int]]:
        """Maximal runs as (template, start in text, start in template, words), once for each place in the template."""
        previous, held, at = 0, 0, offset - 1
        for state, n in [*self.automaton.statistics(words), (0, 0)]:
            if held >= MIN_RUN and n <= held:
                for k, ends in self.automaton.ends[previous].items():
                    for end in ends:
                        yield k, at - held + 1, end - held + 1, held
            previous, held, at = state, n, at + 1

    def _chained(self, found: list[tuple[int, int, int]], size: int) -> Iterator[tuple[float, int, int]]:
        """(cover, start, end) of the chains of one template: each anchor goes on with the chain that covers most, of those that end at most
        ``MAX_GAP`` words before it and, in the template, not beyond it; of chains that share an anchor the best one counts."""
        best: list[tuple[int, int, int, int, int]] = []  # covered, root, start in text, end in text, end in template
        first = 0
        for text_at, own_at, n in found:
            chain = (n, len(best), text_at, text_at + n, own_at + n)
            while first < len(best) and best[first][3] < text_at - MAX_GAP - size:
                first += 1  # too far back for any anchor from here on
            for covered, root, start, text_end, own_end in best[first:]:
                fresh = min(n, own_at + n - own_end, text_at + n - text_end)
                if text_at - text_end <= MAX_GAP and fresh > 0 and covered + fresh > chain[0]:
                    chain = (covered + fresh, root, start, text_at + n, own_at + n)
            best.append(chain)
        ends: dict[int, tuple[int, int, int, int, int]] = {}
        for chain in best:
            if chain[1] not in ends or chain[0] > ends[chain[1]][0]:
                ends[chain[1]] = chain
        for covered, _, start, end, _ in ends.values():
            if covered >= COVER * size:
                yield min(1.0, covered / size), start, end

    def chains(self, ids: np.ndarray) -> list[tuple[float, str, int, int]]:
        """Findings in one text: (cover, label, start word, end word)."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        per: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= MIN_RUN:
                for k, text_at, own_at, n in self.anchors(ids[a:b].tolist(), int(a)):
                    per.setdefault(k, []).append((text_at, own_at, n))
        found = {(self.templates[k][0], start, end): (cover, self.templates[k][0], start, end) for k, x in per.items() for cover, start, end in sorted(self._chained(sorted(x), len(self.sequences[k])))}
        return list(found.values())

    def scan(self, ids: np.ndarray) -> tuple:
        places, labels = [], set()
        for phrase, label in self.phrases:
            if len(ids) >= len(phrase):
                hit = np.logical_and.reduce([ids[j : len(ids) - len(phrase) + 1 + j] == w for j, w in enumerate(phrase)])
                at = np.flatnonzero(hit)
                if len(at):
                    places.append(at)
                    labels.add(label)
        starts = np.concatenate(places) if places else np.empty(0, np.int64)
        chains = self.chains(ids)
        score = max([1.0 * bool(labels), *(c for c, _, _, _ in chains)])
        spans = ",".join(f"{label}:{a}:{b}" for _, label, a, b in sorted(chains, key=lambda c: (c[2], c[3], c[1])))
        return (len(starts), int(starts.min()) if len(starts) else None, int(starts.max()) if len(starts) else None, ",".join(sorted(labels)), ",".join(sorted(labels | {c[1] for c in chains})), score, spans)


_scanner: Scanner | None = None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    global _scanner
    _scanner = _scanner or Scanner()
    for batch in slices(batches):
        hashes, bounds = corpus_words([encode(t) for t in batch.column(1).to_pylist()], WORD_TABLE)
        ids = _scanner.known(hashes)
        rows = [_scanner.scan(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        yield pa.record_batch(
            [batch.column(0), pa.array(np.diff(bounds).astype(np.int64)), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``score`` is the largest share of a template that a chain covers, 1 where a base phrase stands, else 0.  ``spans`` lists the
    chains as label:start:end in words.  Null and empty texts have no words and no labels; null and repeated ids keep their
    rows; other columns are ignored; an empty table gives an empty result.
    """
    src = source(docs)
    return src.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
