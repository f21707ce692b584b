"""Licence notices in texts, found with a generalised suffix automaton of template words.

The automaton holds every run of words of every template. A text streams through it once: at each word
it gives the longest run that ends there (matching statistics). Maximal runs of MIN_MATCH words or more
are placed on the templates they come from, and runs in template order with small gaps are chained into
spans, any number of them a template. A span's coverage is the share of the template's words in its chain; from COVERAGE on it is
reported, with its label. Base phrases are found as they stand, whatever the chains say.

The automaton's size depends on the templates alone; each row is handled by itself in Arrow batches,
nothing is shuffled, and only runs of template words leave array code. Very long texts are scanned whole. A null text counts as empty,
repeated rows give repeated rows, an empty table gives none, and further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import by_text, typed

MIN_MATCH, MAX_GAP, COVERAGE = 5, 12, 0.6

# Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# The words of well-known licence notices (public texts).
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl", """This work is licensed under the GNU General Public License"""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"""),
    ("cc-by-sa", """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."""),
    ("cc0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."""),
    ("mit", """Released under the MIT License"""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0"""),
    ("cc-by", """Licensed under CC BY 4.0"""),
    ("cc-by-sa", """Licensed under CC BY-SA 4.0"""),
    ("cc-by-nc", """Licensed under CC BY-NC 4.0"""),
    ("unlicense", """This is free and unencumbered software released into the public domain."""),
]

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over template words; ends: for each state, (template, place of its last word)."""

    def __init__(self, templates: list[list[bytes]]) -> None:
        self.words: dict[bytes, int] = {}
        self.sizes = [len(t) for t in templates]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[tuple[int, int]]] = [set()]
        for k, t in enumerate(templates):
            last = 0
            for place, w in enumerate(t):
                last = self._extend(last, self.words.setdefault(w, len(self.words)), own)
                own[last].add((k, place))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            own[self.link[s]] |= own[s]
        self.ends = [sorted(x) for x in own]

    def _state(self, length: int, link: int, to: dict[int, int], own: list[set[tuple[int, int]]]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(to)
        own.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int, own: list[set[tuple[int, int]]]) -> int:
        """The state for the part of q that p reaches by w."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), own)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, own: list[set[tuple[int, int]]]) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w, own)
        new = self._state(self.length[last] + 1, 0, {}, own)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w, own)
        return new

    def statistics(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """For each word of a run: the length of the longest template run that ends there, and its state."""
        state = size = 0
        for w in run:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            yield size, state

    def matches(self, run: list[int]) -> list[tuple[int, int, int]]:
        """(first word, size, state) of the maximal runs of MIN_MATCH words or more."""
        found = list(self.statistics(run))
        return [(i - size + 1, size, state) for i, (size, state) in enumerate(found) if size >= MIN_MATCH and (i + 1 == len(found) or found[i + 1][0] <= size)]


def chains(spans: list[tuple[int, int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each template its chains that share no word of the text, the best first: (words covered, first word, last word of the text).

    spans: (template, first word in text, first word in template, size). In a chain both places grow,
    with at most MAX_GAP words between one span and the next in text and template; where spans overlap,
    a word counts once. Of equal chains the later one is taken.
    """
    best: dict[int, list[tuple[int, int, int]]] = {}
    by: dict[int, list[tuple[int, int, int]]] = {}
    for k, at, place, size in sorted(set(spans)):
        by.setdefault(k, []).append((at, place, size))
    for k, own in by.items():
        done: list[tuple[int, int, int]] = []
        near: list[tuple[int, int, int, int]] = []  # end in text, end in template, covered, first; spans come in text order, so one that ends too early for this span does for all later ones
        for at, place, size in own:
            near = [x for x in near if at - x[0] <= MAX_GAP]
            covered, first = size, at
            for text_end, template_end, had, start in near:
                over = max(0, text_end - at, template_end - place)
                if over < size and place - template_end <= MAX_GAP and at + size > text_end and place + size > template_end and had + size - over > covered:
                    covered, first = had + size - over, start
            near.append((at + size, place + size, covered, first))
            done.append((covered, first, at + size - 1))
        kept: list[tuple[int, int, int]] = []
        for c, a, b in sorted(done, reverse=True):
            at = bisect.bisect_left(kept, (a, b, 0))
            if (at == 0 or kept[at - 1][1] < a) and (at == len(kept) or kept[at][0] > b):
                kept.insert(at, (a, b, c))
        best[k] = sorted(((c, a, b) for a, b, c in kept), reverse=True)
    return best


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.labels = [label for label, _ in templates]
        self.automaton = Automaton([words_of(text) for _, text in templates])
        self.ids = dict(self.automaton.words)
        self.base = [([self.ids.setdefault(w, len(self.ids)) for w in words_of(p)], label) for p, label in BASE]

    def scan(self, texts: list[str | None]) -> list[tuple]:
        """n_words, n_base, first_word, last_word, base labels, labels, score, spans (label, first word, last word, coverage) of each text."""
        get = self.ids.get
        cut = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        starts = np.cumsum(sizes + 1) - sizes  # one unknown word stands before each text
        flat = np.full(int((sizes + 1).sum()) + 3, -1, np.int32)
        for at, words in zip(starts.tolist(), cut, strict=True):
            flat[at : at + len(words)] = [get(w, -1) for w in words]
        out: list[list] = [[n, 0, None, None, set(), {}, []] for n in sizes.tolist()]

        def place(i: int) -> tuple[list, int]:
            k = int(np.searchsorted(starts, i, "right")) - 1
            return out[k], i - int(starts[k])

        for phrase, label in self.base:
            hit = np.ones(len(flat) - 3, bool)
            for k, w in enumerate(phrase):
                hit &= flat[k : len(flat) - 3 + k] == w
            for i in np.flatnonzero(hit).tolist():
                row, at = place(i)
                row[1] += 1
                row[2] = at if row[2] is None else min(row[2], at)
                row[3] = at if row[3] is None else max(row[3], at)
                row[4].add(label)
        known = np.r_[False, (flat >= 0) & (flat < len(self.automaton.words)), False]
        edges = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= MIN_MATCH:
                found = self.automaton.matches(flat[a:b].tolist())
                if found:
                    row, at = place(a)
                    row[6] += [(k, at + first, end - size + 1, size) for first, size, state in found for k, end in self.automaton.ends[state]]
        rows = []
        for n, n_base, first, last, base, _, spans in out:
            kept = []
            for k, found in sorted(chains(spans).items()) if spans else ():
                for covered, a, b in found:
                    share = covered / self.automaton.sizes[k]
                    if share >= COVERAGE:
                        kept.append((self.labels[k], a, b, min(1.0, share)))
            labels = base | {x[0] for x in kept}
            rows.append((n, n_base, first, last, sorted(base), sorted(labels), max([1.0] * bool(base) + [x[3] for x in kept], default=0.0), kept))
        return rows


@lru_cache(4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(list(templates))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, step: int = 512) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, spans of each document.

    score: 1 where a base phrase stands, else the largest coverage of a labelled template, else 0.
    """
    fixed = tuple(templates)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scanner(fixed)
        for frame in frames:
            for at in range(0, len(frame), step):
                part = frame.iloc[at : at + step]
                rows = own.scan(part["text"].tolist())
                made = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"], dtype=object)
                made.insert(0, "doc_id", part["doc_id"].to_numpy())
                made["spans"] = [[{"label": a, "first_word": b, "last_word": c, "coverage": d} for a, b, c, d in x] for x in made["spans"]]
                yield made

    spans = "array<struct<label: string, first_word: long, last_word: long, coverage: double>>"
    return typed(by_text(docs, "text").mapInPandas(run, f"doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans {spans}"), docs)
