"""Licence scans by template-markup matching.

A template is licence wording with regions marked up as in the SPDX matching guidelines: `[[...]]` is optional and may
be nested, `|` parts alternatives in it, `<<n>>` stands for up to n words of any kind, and case and marks don't count. A template is compiled into a token automaton: a set of states
over its words, with free moves around optional regions and a counted loop for replaceable ones. A text is accepted
where the automaton reads consecutive words of it and every mandatory word is there exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from specloom.llm.common import doc_text, task

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, n_templates long, template_spans array<struct<label:string,first:long,last:long>>"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence wording with optional [[...]], alternative | and replaceable <<n>> regions: notices first, then whole texts.
TEMPLATES = {
    "mit": [
        "[[[[released | licensed | available | distributed]] under]] the MIT license",
        """[[[[The]] MIT License [[(MIT)]]]] [[Copyright <<12>> [[All rights reserved.]]]]
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice [[(including the
        next paragraph)]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL [[THE]] <<8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ],
    "isc": [
        "[[[[released | licensed | available | distributed]] under]] the ISC license",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<8>>
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL <<8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "bsd": [
        "BSD [[2 clause | 3 clause]] license",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. [[[[3.]] Neither the name of
        <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission.]] THIS SOFTWARE IS PROVIDED BY <<10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<10>>
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
        THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "apache-2.0": [
        "Apache license [[version]] 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at [[http | https]] www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    ],
    "gpl": [
        "GNU [[lesser | affero]] general public license [[as published by the free software foundation]] [[[[either]] version <<1>>]]",
        """[[This program | This library]] is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU
        [[Lesser | Affero]] General Public License as published by the Free Software Foundation[[,]] either version <<2>> of the License, or
        (at your option) any later version. [[This program | This library | <<4>>]] is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU [[Lesser |
        Affero]] General Public License for more details.""",
    ],
    "mpl-2.0": [
        "Mozilla public license [[version | v]] 2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at [[http | https]] mozilla.org/MPL/2.0/.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1.]] The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. [[2.]] Altered source versions must be
        plainly marked as such, and must not be misrepresented as being the original software. [[3.]] This notice may not be removed or
        altered from any source distribution.""",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
        any means.""",
    ],
    "cc-by": [
        "[[licensed under]] CC BY <<1>> 0",
        "creative commons attribution <<4>> [[international]] license",
        "This work is licensed under [[a | the]] Creative Commons Attribution <<3>> [[International]] License",
    ],
    "cc-by-nc": ["[[licensed under]] CC BY NC [[SA | ND]] <<1>> 0"],
    "cc-by-sa": ["[[licensed under]] CC BY SA <<1>> 0"],
    "cc0": ["CC0 1 0 [[universal]]", "To the extent possible under law, <<12>> has waived all copyright and related or neighboring rights to <<12>>"],
    "copyright-notice": ["copyright [[(c)]] <<1>> [[<<6>>]] all rights reserved"],
    "as-is": ["the software is provided as is without warranty of any kind"],
}
#: Bytes of words once A-Z are lower-cased: digits, letters and all of a code point from 128 on.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
MARKS = re.compile(r"\[\[|\]\]|\||<<\d+>>|[0-9a-z\x80-\U0010ffff]+")
#: Words of licence wording at which the score is one half.
HALF_SCORE = 10


class Automaton:
    """The token automaton of one template."""

    def __init__(self, template: str):
        self.reads: dict[int, list[tuple[str | None, int]]] = {}  # state: (word, or None for any word), next state
        self.free: dict[int, list[int]] = {}
        self.count = 1
        tokens = MARKS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in template))
        self.final, _ = self._sequence(tokens, 0, 0)
        self.closures = {s: self._closure(s) for s in range(self.count)}
        self.first_words = {w for s in self.closures[0] for w, _ in self.reads.get(s, [])}
        if None in self.first_words or self.final in self.closures[0]:
            raise ValueError(f"a template must begin with a fixed word: {template}")

    def _new(self) -> int:
        self.count += 1
        return self.count - 1

    def _sequence(self, tokens: list[str], at: int, state: int) -> tuple[int, int]:
        """Compile up to the end of a region: its last state, and where its tokens end. `|` parts alternatives."""
        begin, ends = state, []
        while at < len(tokens) and tokens[at] != "]]":
            token = tokens[at]
            at += 1
            if token == "[[":
                end, at = self._sequence(tokens, at, state)
                at += 1
                after = self._new()
                self.free.setdefault(end, []).append(after)
                self.free.setdefault(state, []).append(after)
                state = after
            elif token == "|":
                ends.append(state)
                state = self._new()
                self.free.setdefault(begin, []).append(state)
            elif token.startswith("<<"):
                after = self._new()
                self.free.setdefault(state, []).append(after)
                for _ in range(int(token[2:-2])):
                    following = self._new()
                    self.reads.setdefault(state, []).append((None, following))
                    self.free.setdefault(following, []).append(after)
                    state = following
                state = after
            else:
                following = self._new()
                self.reads.setdefault(state, []).append((token, following))
                state = following
        if ends:
            after = self._new()
            for end in [*ends, state]:
                self.free.setdefault(end, []).append(after)
            state = after
        return state, at

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free.get(todo.pop(), []):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[str], at: int) -> int | None:
        """Words from place `at` on that the automaton reads at most; None if it accepts none."""
        states, longest, begin = self.closures[0], None, at
        while states and at < len(words):
            word = words[at]
            states = frozenset().union(*(self.closures[t] for s in states for w, t in self.reads.get(s, []) if w is None or w == word))
            at += 1
            if self.final in states:
                longest = at - begin
        return longest


def compiled(templates: dict[str, list[str]]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, texts in templates.items() for t in texts]


class Scanner:
    """Scans texts; made once for each task."""

    def __init__(self, templates: dict[str, list[str]]):
        self.automata = compiled(templates)
        self.by_first: dict[str, list[tuple[str, Automaton]]] = {}
        for label, automaton in self.automata:
            for word in automaton.first_words:
                self.by_first.setdefault(word, []).append((label, automaton))
        not_word = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
        self.base = [(label, re.compile(not_word.join(p.encode().split())), p.count(" ") + 1) for p, label in BASE.items()]
        self.rare = [p.encode().split()[-1] for p in BASE]
        firsts = sorted(self.by_first, key=len, reverse=True)
        self.seeds = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:%b)(?![0-9a-z\x80-\xff])" % b"|".join(re.escape(w.encode()) for w in firsts))
        #: Of each automaton, a mandatory word that is long, so that most texts need no search; empty if it has none.
        self.needs = [max(self._mandatory(a), key=len, default="").encode() for _, a in self.automata]

    @staticmethod
    def _mandatory(a: Automaton) -> list[str]:
        """Words without which the final state isn't reached."""
        words = {w for r in a.reads.values() for w, _ in r if w}

        def reached(without: str) -> bool:
            seen, todo = {0}, [0]
            while todo:
                s = todo.pop()
                for t in [*a.free.get(s, []), *(t for w, t in a.reads.get(s, []) if w != without)]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return a.final in seen

        return [w for w in words if not reached(w)]

    def scan(self, text: str) -> tuple:
        data = text.encode().lower()
        inside = WORD_BYTE[np.frombuffer(data, np.uint8)]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        starts = inside & ~before
        n_words = int(np.count_nonzero(starts))
        places: list[tuple[int, str]] = []
        spans: list[tuple[str, int, int]] = []
        word_at = None
        if any(w in data for w in self.rare):
            word_at = np.flatnonzero(starts)
            for label, pattern, n in self.base:
                for m in pattern.finditer(data):
                    whole = not inside[m.start() - 1 : m.start()].any() and not inside[m.end() : m.end() + 1].any()
                    if whole:
                        places.append((int(np.searchsorted(word_at, m.start())), label))
        live = [(label, a) for (label, a), need in zip(self.automata, self.needs, strict=True) if need in data]
        if live:
            word_at = np.flatnonzero(starts) if word_at is None else word_at
            ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
            live_ids, longest = {id(a) for _, a in live}, max(a.count for _, a in live)
            for m in self.seeds.finditer(data):
                wanted = [(label, a) for label, a in self.by_first[m.group().decode()] if id(a) in live_ids]
                if wanted:
                    at = int(np.searchsorted(word_at, m.start()))
                    # a path reads fewer words than the automaton has states
                    words = [data[s:e].decode() for s, e in zip(word_at[at : at + longest], ends[at : at + longest], strict=True)]
                    spans += [(label, at, at + n) for label, a in wanted if (n := a.match(words, 0))]
        return n_words, sorted(places), outermost(spans)


def outermost(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans, sorted, that lie in no other of their label: wording is accepted from several of its words on."""
    kept, last = [], None
    for label, first, end in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        if last is None or last[0] != label or end > last[2]:
            last = (label, first, end)
            kept.append(last)
    return kept


def share(places: list[tuple[int, str]], spans: list[tuple[str, int, int]]) -> float:
    """The score: n / (n + HALF_SCORE) for n words of licence wording, each counted once."""
    length = {label: p.count(" ") + 1 for p, label in BASE.items()}
    runs = sorted([(a, b) for _, a, b in spans] + [(at, at + length[label]) for at, label in places])
    n = reached = 0
    for a, b in runs:
        n += max(0, b - max(a, reached))
        reached = max(reached, b)
    return n / (n + HALF_SCORE)


def licence_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Scan every whole text of `docs` (doc_id, text) for licence wording.

    A-Z are lower-cased; words are runs of digits, a-z and code points from 128 on. Returns a row for each row: doc_id,
    n_words, n_base (places where a base phrase stands), first_word and last_word (the smallest and largest start of
    one, else null), base_labels, labels (base and templates; distinct, sorted, comma-joined; empty if none), score (n / (n + HALF_SCORE) for n
    words in accepted wording or base phrases, 0 without), n_templates (accepted spans that lie in no other of their label) and template_spans (label,
    first word, word after the last). Null and empty texts have no words; repeated rows stay repeated; a null doc_id
    stays null; an empty table gives none; other columns don't matter. Memory: a batch of rows.
    """
    templates = TEMPLATES if templates is None else templates
    compiled(templates)  # a wrong template fails here, not in a task

    @task("licences")
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            found = [scanner.scan(text) for text in batch.column("text").to_pylist()]
            base = [Counter(label for _, label in places) for _, places, _ in found]
            labels = [sorted({*b, *(s[0] for s in spans)}) for b, (*_, spans) in zip(base, found, strict=True)]
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([n for n, *_ in found], pa.int64()),
                pa.array([len(p) for _, p, _ in found], pa.int64()),
                pa.array([p[0][0] if p else None for _, p, _ in found], pa.int64()),
                pa.array([p[-1][0] if p else None for _, p, _ in found], pa.int64()),
                pa.array([",".join(sorted(b)) for b in base], pa.string()),
                pa.array([",".join(x) for x in labels], pa.string()),
                pa.array([share(p, s) for _, p, s in found], pa.float64()),
                pa.array([len(s) for *_, s in found], pa.int64()),
                pa.array([[{"label": x, "first": a, "last": b} for x, a, b in s] for *_, s in found], span),
            ]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    return doc_text(docs).mapInArrow(scan, SCHEMA)
