"""License scans by template-markup matching: templates compile to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from fleetspan.llm.common import map_rows, table
from fleetspan.llm.words import alnum_words

# Phrases whose words, standing consecutively, give a base label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public licence notices as templates. [[...]] is optional, {{a-b}} replaceable by a to b words. All other words are mandatory.
TEMPLATES = [
    ("mit", "[[the]] mit license [[mit]] [[copyright [[c]] {{0-12}} [[all rights reserved]]]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "[[this {{1-3}} is]] [[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license"),
    ("apache-2", "[[this {{1-3}} is]] [[released]] [[licensed]] [[distributed]] under the [[terms of the]] apache license version 2 [[0]]"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-3", "[[this {{1-3}} is]] [[released]] [[licensed]] [[distributed]] under the [[terms of the]] gnu general public license version 3"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "spdx license identifier gpl 3 0 [[only]] [[or later]]"),
    ("gpl-2", "[[this {{1-3}} is]] [[released]] [[licensed]] [[distributed]] under the [[terms of the]] gnu general public license version 2"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-3", "under the [[terms of the]] gnu lesser general public license version 3"),
    ("agpl-3", "under the [[terms of the]] gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "[[this {{1-3}} is]] [[released]] licensed under [[a]] [[the]] cc by nc [[4]] [[3]] [[0]]"),
    ("cc-by-nc", "licensed under [[a]] [[the]] creative commons attribution noncommercial [[4]] [[3]] [[0]] [[international]] license"),
    ("cc-by-sa", "licensed under [[a]] [[the]] creative commons attribution sharealike [[4]] [[3]] [[0]] [[international]] license"),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[4]] [[3]] [[0]] [[international]] license"),
    ("cc0-1", "to the extent possible under law {{1-12}} has waived all copyright and related or neighboring rights to"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,end:long,mandatory:int>>"


class Automaton:
    """A template as a token automaton without empty moves: state -> moves (word or None for any word, next state)."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.moves: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        tokens = re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", markup)
        self.at, self.mandatory = 0, 0
        self._sequence(iter(tokens), True)
        self.last = self.at
        self.closure = [self._closure(s) for s in range(len(self.moves))]
        self.starts = {w for s in self.closure[0] for w, _ in self.moves[s]}

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _sequence(self, tokens: Iterator[str], must: bool) -> None:
        for t in tokens:
            if t == "]]":
                return
            if t == "[[":
                begin = self.at
                self._sequence(tokens, False)
                self.skips[begin].append(self.at)
            elif t.startswith("{{"):
                least, most = map(int, t[2:-2].split("-"))
                ways = []
                for i in range(most):
                    if i >= least:
                        ways.append(self.at)
                    self._step(None)
                for s in ways:
                    self.skips[s].append(self.at)
            else:
                self.mandatory += must
                self._step(t.encode())

    def _step(self, word: bytes | None) -> None:
        to = self._state()
        self.moves[self.at].append((word, to))
        self.at = to

    def _closure(self, state: int) -> frozenset[int]:
        found, todo = {state}, [state]
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def longest(self, words: list[bytes], first: int) -> int:
        """End of the longest run from `first` on that the automaton accepts, or 0."""
        states, end = self.closure[0], 0
        for i in range(first, len(words)):
            after: set[int] = set()
            for s in states:
                for w, to in self.moves[s]:
                    if w is None or w == words[i]:
                        after |= self.closure[to]
            if not after:
                break
            if self.last in after:
                end = i + 1
            states = after
        return end


AUTOMATA = [Automaton(label, markup) for label, markup in TEMPLATES]
_BY_START: dict[bytes, list[Automaton]] = {}
for _a in AUTOMATA:
    for _w in _a.starts:
        _BY_START.setdefault(_w, []).append(_a)
#: A template's rarest way in: texts without any of these words match nothing.
_ANCHORS = (b" license", b" licensed", b" permission", b" redistribution", b" unencumbered", b" copyright", b" gnu ", b" cc ")


def places(norm: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand; norm is the words with a space around each."""
    found, at, word, before = [], norm.find(phrase), 0, 0
    while at >= 0:
        word += norm.count(b" ", before, at)
        found.append(word)
        before = at
        at = norm.find(phrase, at + 1)
    return found


_PHRASES = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]


def scan(text: bytes | None) -> tuple:
    words = alnum_words(text)
    norm = b" " + b" ".join(words) + b" "
    base = sorted((i, label) for p, label in _PHRASES for i in places(norm, p))
    matches = []
    if any(a in norm for a in _ANCHORS):
        for i, w in enumerate(words):
            for a in _BY_START.get(w, ()):
                if end := a.longest(words, i):
                    matches.append((a.label, i, end, a.mandatory))
    base_labels = {label for _, label in base}
    labels = base_labels | {m[0] for m in matches}
    score = max((m[3] / (m[3] + 1) for m in matches), default=0.5 if base else 0.0)
    ends = (base[0][0], base[-1][0]) if base else (None, None)
    found = [dict(zip(("label", "first", "end", "mandatory"), m, strict=True)) for m in matches]
    return len(words), len(base), *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, found


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, the base phrases' places and labels, labels, score, and the template matches by word.

    A null or empty text has no words, empty labels and score 0. score is m / (m + 1) for the match with the most mandatory words m; 0.5 with base phrases
    only. Nested and overlapping matches are all listed, from each start the longest. Null and repeated doc_ids are rows like others; other
    columns are not read; an empty table gives no rows.
    """

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for doc, text in it:
            yield doc, *scan(text)

    return map_rows(docs.select("doc_id", "text"), SCANNED, rows)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")
