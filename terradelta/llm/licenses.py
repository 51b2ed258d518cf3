"""License scans: matching statistics over a generalised suffix automaton of template tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from terradelta.llm.tables import slices, utf8
from terradelta.llm.words import terms

# Phrases that give a label wherever they stand.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Parts that several standard texts share.
_AS_IS = (
    " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this"
    " list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_AS_IS = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES,"
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF"
    " THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str) -> str:
    """The notice of a license of the GNU family."""
    return (
        f"This work is licensed under the {name}, version {version}. This program is free software: you can redistribute it"
        f" and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version}"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,"
        " but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
        f" See the {name} for more details."
    )


def _commons(kind: str, mark: str) -> str:
    """The notice of a Creative Commons license."""
    return f"This work is licensed under a Creative Commons {kind} 4.0 International License. Licensed under CC {mark} 4.0"


#: Standard texts and notices by label. Long parts of them, in order, give the label too.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the Software), to deal in the Software without restriction, including without limitation the"
    " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and"
    " this permission notice shall be included in all copies or substantial portions of the Software." + _AS_IS,
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
    " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
    " applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT"
    " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
    " permissions and limitations under the License.",
    "bsd-2": _BSD + _BSD_AS_IS,
    "bsd-3": _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
    " promote products derived from this software without specific prior written permission." + _BSD_AS_IS,
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS"
    " PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held"
    " liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for"
    " any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
    " restrictions",
    "gpl-2": _gnu("GNU General Public License", "2"),
    "gpl-3": _gnu("GNU General Public License", "3"),
    "lgpl-2.1": _gnu("GNU Lesser General Public License", "2.1"),
    "lgpl-3": _gnu("GNU Lesser General Public License", "3"),
    "agpl-3": _gnu("GNU Affero General Public License", "3"),
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
    " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
    " which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,"
    " publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
    " purpose, commercial or non-commercial, and by any means.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by": _commons("Attribution", "BY"),
    "cc-by-sa": _commons("Attribution-ShareAlike", "BY-SA"),
    "cc-by-nd": _commons("Attribution-NoDerivatives", "BY-ND"),
    "cc-by-nc": _commons("Attribution-NonCommercial", "BY-NC"),
    "cc-by-nc-sa": _commons("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "cc-by-nc-nd": _commons("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in"
    " any form or by any means without the prior written permission of the publisher",
}
MIN_MATCH = 6  # words of a match that may be chained
MAX_GAP = 8  # words between two chained matches, in the text and in the template
COVER = 8  # template words that a chain covers to give its label


class SuffixAutomaton:
    """Every run of words of the templates and phrases, with one place of each in each template.

    Built once per task from templates of a few thousand words: at most two states for each word.
    """

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, ends = [-1], [0], [set()]
        self.labels = sorted(set(templates))
        texts = [terms(templates[label].encode()) for label in self.labels]
        self.size = {label: len(words) for label, words in zip(self.labels, texts)}
        phrase_words = [(terms(p.encode()), label) for p, label in phrases.items()]
        phrase_at: dict[int, list[tuple[int, str]]] = {}
        for k, words in enumerate([*texts, *(w for w, _ in phrase_words)]):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary) + 1), ends)
                if k < len(texts):
                    ends[last].add((k, i))
        for words, label in phrase_words:
            state = 0
            for word in words:
                state = self.next[state][self.vocabulary[word]]
            phrase_at.setdefault(state, []).append((len(words), label))
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in order:  # from short to long: a state ends with what its link ends with
            self.phrases[v] = self.phrases[self.link[v]] + tuple(phrase_at.get(v, ()))
        for v in reversed(order):
            ends[self.link[v]] |= ends[v]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _extend(self, last: int, c: int, ends: list[set]) -> int:
        """The state of the word run that ends here, after ``last``; states that it splits keep their meaning."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q, ends)
        new = self._state(self.length[last] + 1, {}, 0, set(), ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, ends)
        return new

    def _split(self, p: int, c: int, q: int, ends: list[set]) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], set(), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _state(self, length: int, following: dict[int, int], link: int, places: set, ends: list[set]) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        ends.append(places)
        return len(self.length) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
        """Places of phrases ``(first, last, label)``, and maximal matches ``(last, length, state)`` of MIN_MATCH words."""
        found, matches = [], []
        state = size = 0
        nexts, link, length, phrases, known = self.next, self.link, self.length, self.phrases, self.vocabulary.get
        for i, word in enumerate(words):
            c = known(word)
            if c is None:
                if size >= MIN_MATCH:
                    matches.append((i - 1, size, state))
                state = size = 0
                continue
            if c not in nexts[state]:
                if size >= MIN_MATCH:
                    matches.append((i - 1, size, state))
                while state and c not in nexts[state]:
                    state = link[state]
                    size = length[state]
            if c in nexts[state]:
                state, size = nexts[state][c], size + 1
                if phrases[state]:
                    found += [(i - n + 1, i, label) for n, label in phrases[state] if n <= size]
        if size >= MIN_MATCH:
            matches.append((len(words) - 1, size, state))
        return found, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
        """Covered spans ``(first, last, label, words covered)``: matches of a template in order, gaps up to MAX_GAP."""
        out = []
        open_: dict[int, list[int]] = {}  # template: first and last word in the text, last in the template, covered
        for last, size, state in matches:
            best: dict[int, int] = {}
            for k, end in self.ends[state]:
                chain = open_.get(k)
                fits = chain and chain[1] < last and 0 < end - chain[2] <= size + MAX_GAP and last - size - chain[1] <= MAX_GAP
                if k not in best or fits:
                    best[k] = end
            for k, end in best.items():
                chain = open_.get(k)
                if chain and 0 < end - chain[2] <= size + MAX_GAP and last - size - chain[1] <= MAX_GAP:
                    chain[3] += min(end - chain[2], size, last - chain[1])
                    chain[1], chain[2] = last, end
                    continue
                if chain:
                    out.append((chain[0], chain[1], self.labels[k], chain[3]))
                open_[k] = [last - size + 1, last, end, size]
        out += [(c[0], c[1], self.labels[k], c[3]) for k, c in open_.items()]
        return sorted(x for x in out if x[3] >= COVER)

    def decided(self, chains: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
        """Of chains over the same words those whose template explains them best: more words, or a larger share of it.

        Standard texts share long parts; a chain goes if a better one covers half of its words or more.
        """
        merit = [(words, words / self.size[label]) for _, _, label, words in chains]

        def beaten(i: int) -> bool:
            a, b = chains[i][:2]
            return any(merit[j] > merit[i] and 2 * (min(b, y) - max(a, x) + 1) >= b - a + 1 for j, (x, y, *_) in enumerate(chains))

        return [c for i, c in enumerate(chains) if not beaten(i)]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("words", pa.int64())]))


def find_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, phrases and spans (first and last word from 0, label, words).

    ``phrases`` lists every place of a phrase; ``spans`` the parts of templates that the text holds, with the
    number of template words covered; where texts share words, the one that explains them best. Each text is streamed through the automaton once, in time linear in
    its words; nothing is shuffled. A null text has no words; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(phrases, templates)
        for part in slices(batches):
            counts, places, spans = [], [], []
            for text in utf8(part.column(1)):
                words = terms(text)
                found, matches = automaton.scan(words)
                counts.append(len(words))
                places.append([{"first": a, "last": b, "label": x, "words": b - a + 1} for a, b, x in sorted(found)])
                spans.append([{"first": a, "last": b, "label": x, "words": n} for a, b, x, n in automaton.decided(automaton.chains(matches))])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(places, _SPANS), pa.array(spans, _SPANS)],
                ["doc_id", "n_words", "phrases", "spans"],
            )

    span = "array<struct<first:long,last:long,label:string,words:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, phrases {span}, spans {span}")
