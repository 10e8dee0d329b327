"""Licence scans: one generalised suffix automaton of all templates, matching statistics, chained matches.

The automaton accepts every run of words of every template.  A document is streamed through it once; after each
word the state and the length of the longest run of template words that ends there are known.  Maximal runs of
some length are mapped to their places in the templates and chained, in order and with bounded gaps, into
spans; the share of the template that a span covers decides whether it is reported.  Phrases that count on
their own are templates too, found wherever the statistics reach their length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusflow.llm.common import WORD_BYTES, map_slices

#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence wordings, and their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
]

RESULT = "n_words long, phrases array<struct<label:string,word:long>>, spans array<struct<label:string,first:long,last:long,share:double>>"


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, ASCII digits and non-ASCII characters."""
    return text.encode().translate(WORD_BYTES).split()


class SuffixAutomaton:
    """States for all runs of words of several sequences: longest run, suffix link, transitions, places."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                ends[last].append((number, at))
        #: (sequence, place of the last word) of each state's runs, handed up the suffix links, longest runs first.
        self.places: list[list[tuple[int, int]]] = [ends.get(s, []) for s in range(len(self.length))]
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if up > 0:
                self.places[up] = self.places[up] + self.places[state]

    def _new(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _clone(self, source: int, target: int, word: int) -> int:
        """Split off the runs of ``target`` that are no longer than one word after ``source``."""
        copy = self._new(self.length[source] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = copy
            source = self.link[source]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # another sequence has been here
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, word)
        state = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._clone(at, target, word)
        return state

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """After each word: the state, and the length of the longest run that ends there."""
        state, length, found = 0, 0, []
        follow, link, longest = self.next, self.link, self.length
        for word in words:
            while state and word not in follow[state]:
                state = link[state]
                length = longest[state]
            step = follow[state].get(word)
            state, length = (0, 0) if step is None else (step, length + 1)
            found.append((state, length))
        return found


class Scanner:
    """The automaton of all templates and phrases, and what is looked up in it."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_match: int, max_gap: int, share: float):
        sequences = [words_of(t) for t in [*phrases, *[text for _, text in templates]]]
        self.labels = [*phrases.values(), *[label for label, _ in templates]]
        self.n_phrases, self.sizes = len(phrases), [len(s) for s in sequences]
        if min(self.sizes, default=2) < 2:
            raise ValueError("templates and phrases need two words at least")
        self.min_match, self.max_gap, self.share = min_match, max_gap, share
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        coded = [[self.ids[w] for w in s] for s in sequences]
        self.automaton = SuffixAutomaton(coded)
        self.width = len(self.ids) + 1
        self.pairs = np.unique([a * self.width + b for s in coded for a, b in zip(s, s[1:])])
        #: Phrases that end wherever a state's runs end: a phrase is a suffix of them if its state is up the links.
        home: dict[int, list[int]] = defaultdict(list)
        for number in range(self.n_phrases):
            state = 0
            for word in coded[number]:
                state = self.automaton.next[state][word]
            home[state].append(number)
        self.ending: dict[int, list[int]] = {}
        for state in range(len(self.automaton.length)):
            at, found = state, []
            while at > 0:
                found += home.get(at, [])
                at = self.automaton.link[at]
            if found:
                self.ending[state] = found

    def runs(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The word ids (0: in no template), and the stretches in which every two neighbours stand together somewhere."""
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int64, count=len(words))
        pair = ids[:-1] * self.width + ids[1:]
        at = np.searchsorted(self.pairs, pair)
        good = (at < len(self.pairs)) & (ids[:-1] > 0) & (ids[1:] > 0)
        good[good] = self.pairs[at[good]] == pair[good]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        return ids, [(a, b + 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]

    def scan(self, words: list[bytes]) -> tuple[list[dict], list[dict]]:
        """Places of phrases, and template spans."""
        if len(words) < 2:
            return [], []
        ids, stretches = self.runs(words)
        phrases, matches = [], defaultdict(list)
        for begin, end in stretches:
            statistics = self.automaton.statistics(ids[begin:end].tolist())
            for i, (state, length) in enumerate(statistics):
                for number in self.ending.get(state, ()):
                    if self.sizes[number] <= length:
                        phrases.append({"label": self.labels[number], "word": begin + i + 1 - self.sizes[number]})
                maximal = i + 1 == len(statistics) or statistics[i + 1][1] <= length
                if maximal and length >= self.min_match:
                    for number, place in self.automaton.places[state]:
                        if number >= self.n_phrases and place + 1 >= length:
                            matches[number].append((begin + i + 1 - length, place + 1 - length, length))
        return phrases, [s for number, found in sorted(matches.items()) for s in self.chain(number, found)]

    def chain(self, number: int, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Best chains of matches that move forward in document and template with gaps of ``max_gap`` words at most."""
        matches.sort()
        best: list[tuple[int, int]] = []  # (covered words, chain's first word)
        low, chains = 0, {}
        for i, (begin, place, length) in enumerate(matches):
            covered, first = length, begin
            while matches[low][0] + self.sizes[number] + self.max_gap < begin:
                low += 1
            for j in range(low, i):
                before, spot, size = matches[j]
                if 0 <= begin - before - size <= self.max_gap and 0 <= place - spot - size <= self.max_gap and best[j][0] + length > covered:
                    covered, first = best[j][0] + length, best[j][1]
            best.append((covered, first))
            chains[first] = max(chains.get(first, (0, 0)), (covered, begin + length))
        spans, end = [], -1
        for first, (covered, last) in sorted(chains.items(), key=lambda c: (c[0], -c[1][0])):
            share = min(1.0, covered / self.sizes[number])
            if share >= self.share and first >= end:
                spans.append({"label": self.labels[number], "first": first, "last": last - 1, "share": share})
                end = last
        return spans


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    min_match: int = 4,
    max_gap: int = 8,
    share: float = 0.5,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Licence phrases and template spans of every whole text.

    ``key``, ``n_words``, ``phrases`` (label, first word), ``spans`` (label, first and last word, covered share of
    the template, ``share`` at least); words count from 0.  Null and empty texts have no words and empty lists.
    Every row is scanned, repeated rows and null keys too; other columns are ignored.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    kind = dict(docs.dtypes)[key]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scanner = Scanner(templates, phrases, min_match, max_gap, share)
        phrase_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            counts, places, spans = [], [], []
            for value in part.column("text").to_pylist():
                words = words_of(value or "")
                found = scanner.scan(words)
                counts.append(len(words))
                places.append(found[0])
                spans.append(found[1])
            columns = [part.column("key"), pa.array(counts, pa.int64()), pa.array(places, phrase_type), pa.array(spans, span_type)]
            return pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "phrases", "spans"])

        return one

    return map_slices(docs.selectExpr(f"`{key}` as key", f"`{text}` as text"), make, f"`{key}` {kind}, {RESULT}")
