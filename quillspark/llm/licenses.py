"""Licence scans: texts stream through a generalised suffix automaton of licence tokens.

The automaton holds every token substring of every template. Fed a text token by
token it gives the matching statistics: at each position the longest suffix that
occurs in some template. Where a match of ``MIN_MATCH`` tokens or more ends, its
template places are noted; matches that advance together in text and template
are chained into a covered span, whose share of the template is the score. A chain
covers as much as any chain of the same matches can.
Phrases are templates of their own and are found through the automaton's suffix
links, which name every phrase that ends at a position; phrases of one word by lookup.

A match needs consecutive token pairs that occur in templates, so a lookup of all
pairs of a text at once leaves the automaton only the stretches that can match.

Null texts count as empty: no words, no labels, score 0. Repeated rows stay rows, and
equal texts get equal values. An empty table gives an empty result. Texts are read whole,
in time linear in their length; memory per text is four bytes a word. Of chains that
cover as much, the one that began last counts, up to the first place where it covers most.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import utf8

MIN_MATCH = 4
MAX_GAP = 8
MIN_COVER = 0.6

# Phrases that count as licence mentions, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licence statements, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def licence_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of any bytes above 127."""
    return text.translate(_TO_WORDS).split()


class Match(NamedTuple):
    end: int  # token after the match
    length: int
    state: int


class Span(NamedTuple):
    label: str
    start: int
    end: int
    score: float


class SuffixAutomaton:
    """Generalised suffix automaton over token sequences; states know where their strings end in the sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].append((k, at + 1))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(e)) for e in self.ends]
        self.ends[0] = []

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """A copy of q for the strings that reach it through p; q keeps the longer ones."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # an earlier sequence already has this string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return state

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """After each token: the state and length of the longest suffix that occurs in a sequence."""
        state = size = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            yield state, size


class LicenceIndex:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        sequences = [licence_words(t.encode()) for t in [*phrases, *[t for _, t in templates]]]
        if not all(sequences):
            raise ValueError("a phrase or template without words")
        self.labels = [*phrases.values(), *[label for label, _ in templates]]
        self.phrases = len(phrases)
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.ids = _Ids()
        for words in sequences:
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.sequences = [[self.ids[w] for w in words] for words in sequences]
        self.automaton = SuffixAutomaton(self.sequences)
        n = len(self.ids) + 1
        self.pair = np.zeros((n, n), dtype=bool)
        self.tail = np.zeros((n, n), dtype=bool)  # last pairs of phrases
        for k, seq in enumerate(self.sequences):
            for a, b in zip(seq, seq[1:]):
                self.pair[a, b] = True
            if 1 < len(seq) and k < self.phrases:
                self.tail[seq[-2], seq[-1]] = True
        self.single = [(k, seq[0]) for k, seq in enumerate(self.sequences[: self.phrases]) if len(seq) == 1]
        self.ending = self._endings()

    def _endings(self) -> list[list[tuple[int, int]]]:
        """For each state the phrases, with lengths, that are suffixes of its strings: found along the suffix links."""
        auto, out = self.automaton, []
        home = {}
        for k in range(self.phrases):
            if len(self.sequences[k]) < 2:
                continue
            state = 0
            for t in self.sequences[k]:
                state = auto.next[state][t]
            home.setdefault(state, []).append((k, len(self.sequences[k])))
        for state in range(len(auto.length)):
            found, s = [], state
            while s > 0:
                found += home.get(s, [])
                s = auto.link[s]
            out.append(found)
        return out

    def tokens(self, text: bytes) -> np.ndarray:
        words = licence_words(text)
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[Span]]:
        """Phrase places ``(phrase, start)`` and template spans of one text."""
        places: list[tuple[int, int]] = [(k, s) for k, word in self.single for s in np.flatnonzero(ids == word).tolist()]
        at = np.flatnonzero(self.pair[ids[:-1], ids[1:]])
        if not len(at):
            return places, []
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + 1
        tails = np.concatenate([[0], np.cumsum(self.tail[ids[:-1], ids[1:]])])
        able = (last - first + 1 >= self.min_match) | (tails[last] > tails[first])
        matches: list[Match] = []
        for a, b in zip(first[able].tolist(), last[able].tolist()):
            before = (0, 0)
            for end, (state, size) in enumerate(self.automaton.stream(ids[a : b + 1].tolist()), a + 1):
                places += [(k, end - n) for k, n in self.ending[state] if n <= size]
                if before[1] >= self.min_match and size <= before[1]:
                    matches.append(Match(end - 1, before[1], before[0]))
                before = (state, size)
            if before[1] >= self.min_match:
                matches.append(Match(b + 1, before[1], before[0]))
        return places, self._chain(matches)

    def _chain(self, matches: list[Match]) -> list[Span]:
        """The best chains of matches that move on in text and template with small gaps, where they cover enough.

        Each place of a match in a template goes on the chain that covers most with it
        (of equal ones, that which began last). A chain counts once, as far as it covers
        most. Starts of matches never fall, so a place that ended more than a gap before
        the present start is done with; those still open lie within one template's length.
        """
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # template -> (text end, template end, covered, text start of the chain)
        chains: dict[tuple[int, int], tuple[int, int]] = {}  # (template, text start) -> (covered, -text end)
        for end, size, state in matches:
            start = end - size
            for k, stop in self.automaton.ends[state]:
                if k < self.phrases:
                    continue
                begin, covered, first = stop - size, size, start
                own = open_[k] = [x for x in open_.get(k, ()) if start - x[0] <= self.max_gap]
                for text_end, template_end, held, head in own:
                    if text_end <= end and template_end <= stop and begin - template_end <= self.max_gap:
                        overlap = max(0, text_end - start, template_end - begin)
                        if overlap < size and (held + size - overlap, head) > (covered, first):
                            covered, first = held + size - overlap, head
                own.append((end, stop, covered, first))
                chains[k, first] = max(chains.get((k, first), (0, 0)), (covered, -end))
        return sorted(
            Span(self.labels[k], a, -b, min(1.0, covered / len(self.sequences[k])))
            for (k, a), (covered, b) in chains.items() if covered >= self.min_cover * len(self.sequences[k])
        )


class _Ids(dict):
    """Token numbers from 1; any other token is 0, which no template has."""

    def __missing__(self, key) -> int:
        return 0


SCHEMA = "n_words long, places array<struct<label:string,start:long>>, spans array<struct<label:string,start:long,end:long,score:double>>"


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row: words, phrase places and covered template spans (token positions from 0, end exclusive)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenceIndex(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            counts, places, spans = [], [], []
            for value in batch.column(1):
                ids = index.tokens(value.as_py())
                found, covered = index.scan(ids)
                counts.append(len(ids))
                places.append([{"label": index.labels[k], "start": s} for k, s in found])
                spans.append([s._asdict() for s in covered])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)], names=[id_col, "n_words", "places", "spans"])

    return docs.select(id_col, utf8(text_col).alias("bytes")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def op2_licenses(docs: DataFrame) -> DataFrame:
    base = F.array_sort(F.array_distinct("places.label"))
    return licence_scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("places.label", "spans.label")), ",").alias("labels"),
        F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("score"),
        F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))).alias("template_spans"),
    )
