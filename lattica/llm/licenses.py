"""Licence scans by a generalised suffix automaton over licence tokens.

The automaton holds every run of words of all templates. A file's words are streamed
through it: at each word it tells the longest suffix that occurs in some template (the
matching statistics). Long matches of one template that keep their order and lie close
together are chained into spans; the share of the template's words that a chain covers
is its coverage, and templates covered well enough give labels.

Plain phrases are counted besides, as the base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import bound_batches, in_batches, utf8

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices and bodies of well-known public licences, label -> text.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is released under CC0 1.0 Universal.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}

_SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of everything beyond ASCII."""
    return text.translate(_SEPARATED).split()  # every separator has become a space


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    #: template -> a position where this state's longest string ends
    ends: dict[int, int] = field(default_factory=dict)


class Automaton:
    """A generalised suffix automaton over lists of token ids."""

    def __init__(self, templates: list[list[int]]):
        self.states = [State(0, -1)]
        for name, tokens in enumerate(templates):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.states[last].ends.setdefault(name, at)
        for state in sorted(self.states[1:], key=lambda s: -s.length):
            for name, at in state.ends.items():
                self.states[state.link].ends.setdefault(name, at)

    def _extend(self, last: int, token: int) -> int:
        states = self.states
        old = states[last].next.get(token)
        if old is not None:  # the string is in the automaton by an earlier template
            return old if states[old].length == states[last].length + 1 else self._clone(last, token, old)
        made = len(states)
        states.append(State(states[last].length + 1, 0))
        at = last
        while at >= 0 and token not in states[at].next:
            states[at].next[token] = made
            at = states[at].link
        if at >= 0:
            old = states[at].next[token]
            states[made].link = old if states[old].length == states[at].length + 1 else self._clone(at, token, old)
        return made

    def _clone(self, at: int, token: int, old: int) -> int:
        states = self.states
        made = len(states)
        states.append(State(states[at].length + 1, states[old].link, dict(states[old].next), dict(states[old].ends)))
        states[old].link = made
        while at >= 0 and states[at].next.get(token) == old:
            states[at].next[token] = made
            at = states[at].link
        return made

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, dict[int, int]]]:
        """(end position, length, template ends) of each match that the next token cannot extend."""
        states = self.states
        at = length = 0
        for i, token in enumerate(tokens):
            if token in states[at].next:
                at, length = states[at].next[token], length + 1
                continue
            if length:
                yield i - 1, length, states[at].ends
            while at > 0 and token not in states[at].next:
                at = states[at].link
                length = states[at].length
            if token in states[at].next:
                at, length = states[at].next[token], length + 1
        if length:
            yield len(tokens) - 1, length, states[at].ends


class Scanner:
    """Templates compiled for scanning; ``min_match`` words make a match long, ``gap`` words may part two of a chain."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int, gap: int, coverage: float):
        self.names = sorted(templates)
        token: dict[bytes, int] = {}
        tokens = [[token.setdefault(w, len(token)) for w in words_of(templates[n].encode())] for n in self.names]
        self.token, self.sizes = token, [len(t) for t in tokens]
        self.automaton = Automaton(tokens)
        self.min_match, self.gap, self.coverage = min_match, gap, coverage
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in sorted(phrases.items())]

    def base(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """(starts of all phrase places, labels)."""
        line = b" " + b" ".join(words) + b" "
        starts: list[int] = []
        labels: set[str] = set()
        for phrase, label in self.phrases:
            at, seen, word = line.find(phrase), 0, 0
            while at >= 0:
                word, seen = word + line.count(b" ", seen, at), at
                starts.append(word)
                labels.add(label)
                at = line.find(phrase, at + 1)
        return starts, labels

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, coverage) of every chain that covers enough of its template."""
        get = self.token.get
        ids = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        hits: list[tuple[int, int, int, int]] = []  # template, first word, first template word, length
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        for low, high in edges.reshape(-1, 2).tolist():
            if high - low < self.min_match:
                continue
            for end, length, ends in self.automaton.matches(ids[low:high].tolist()):
                if length >= self.min_match:
                    hits += [(name, low + end - length + 1, at - length + 1, length) for name, at in ends.items()]
        found = []
        hits.sort()
        chain: list[tuple[int, int, int, int]] = []
        for hit in [*hits, None]:
            if chain and hit:
                name, first, at, length = chain[-1]
                beyond = hit[0] == name and hit[1] <= first + length + self.gap and hit[2] > at and hit[1] > first
                if beyond and hit[2] <= at + length + self.gap:
                    chain.append(hit)
                    continue
            if chain:
                name = chain[0][0]
                covered: set[int] = set()
                for _, _, at, length in chain:
                    covered.update(range(at, at + length))
                share = len(covered) / self.sizes[name]
                if share >= self.coverage:
                    found.append((self.names[name], chain[0][1], chain[-1][1] + chain[-1][3] - 1, share))
            chain = [hit] if hit else []
        return found


def _scan(scanner_args: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*scanner_args)
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())])
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                starts, base = scanner.base(words)
                spans = scanner.spans(words)
                labels = base | {s[0] for s in spans}
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((s[3] for s in spans), default=0.0), [dict(zip(("label", "first_word", "last_word", "coverage"), s, strict=True)) for s in spans]))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, min_match: int = 4, gap: int = 8, coverage: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists (label, first_word, last_word, coverage) of each covered template;
    ``score`` is the best coverage. Null, empty and word-less texts have no words and
    labels '', score 0, first and last word null. Ties sort by label. Repeated ids are
    scanned row by row, an empty table gives no rows, and other columns are ignored.
    """
    bound_batches(docs)
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    made = in_batches(inputs, _scan((templates or TEMPLATES, phrases or PHRASES, min_match, gap, coverage)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,coverage:double>>")
    return made
