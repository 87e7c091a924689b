"""License detection by matching templates with optional and replaceable regions.

A template is wording with mark-up: ``[[...]]`` may be left out, ``<<n>>`` stands for up to n
words of any kind (a name, a year). It is compiled into an automaton over words: a chain of
mandatory words, with jumps over optional regions and counted loops for replaceable ones. A
text matches where the automaton gets from its start to its end, so every mandatory word is
there, in order, and nothing else but what the regions allow. Where several templates begin
at a word each is followed on its own; a place is reported with the longest match.

Whole slices of texts are searched at once for the pairs of words a template can begin with;
only there the automaton runs, over at most as many words as its longest path has.

Defined results: null and empty texts have no words, no label and score 0; repeated rows and
doc_ids are rows of their own. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kithwatch.llm.arrays import NOT_WORD, Words, chained, slices, utf8, word_hash, words

# Phrases that count as a license wherever they stand.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public license notices as templates, by label.
TEMPLATES = [
    ("mit", "[[released]] under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license [[version]] 2 [[0]]"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by-nc", "[[this work is]] licensed under [[a]] [[the]] cc by nc [[<<2>>]]"),
    ("cc-by-nc", "[[this work is]] licensed under a creative commons attribution noncommercial <<3>> license"),
    ("cc-by", "[[this work is]] licensed under a creative commons attribution [[<<2>>]] international license"),
    ("gpl-3", "[[this work is]] licensed under the gnu general public license [[as published by the free software foundation either]] version 3 [[of the license]] [[or at your option any later version]]"),
    ("gpl-2", "[[this work is]] licensed under the gnu general public license [[as published by the free software foundation either]] version 2 [[of the license]] [[or at your option any later version]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


class Automaton:
    """States 0 .. end; ``step[state]`` maps a word's hash to the next state, ``jump`` needs no word."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.step: list[tuple[int, int] | None] = []  # (word or any, next state)
        self.jump: list[list[int]] = []
        opened: list[int] = []
        self.words = 0
        for part in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", template):
            if part == "[[":
                opened.append(self._state(None))
            elif part == "]]":
                self.jump[opened.pop()].append(len(self.step))
            elif part.startswith("<<"):
                marks = [self._state(-1) for _ in range(int(part[2:-2]))]
                for mark in marks:
                    self.jump[mark].append(len(self.step))
            else:
                self._state(int(word_hash(part)))
                self.words += 1
        self.end = len(self.step)

    def _state(self, word: int | None) -> int:
        """A state that moves on with this word, with any word (-1), or without one (None)."""
        here = len(self.step)
        self.step.append(None if word is None else (word, here + 1))
        self.jump.append([here + 1] if word is None else [])
        return here

    def closed(self, states: set[int]) -> set[int]:
        """All states that can be reached without a word."""
        found, todo = set(states), list(states)
        while todo:
            state = todo.pop()
            for after in self.jump[state] if state < self.end else ():
                if after not in found:
                    found.add(after)
                    todo.append(after)
        return found

    def moved(self, states: set[int], word: int) -> set[int]:
        steps = (self.step[state] for state in states if state < self.end)
        return self.closed({step[1] for step in steps if step and step[0] in (word, -1)})

    def starts(self) -> set[int]:
        """Hashes of the pairs of words a match can begin with."""
        pairs = set()
        for first in self._given(self.closed({0})):
            for second in self._given(self.moved(self.closed({0}), first)):
                pairs.add(int(chained(np.array([first, second], np.uint64), 2)[0]))
        return pairs

    def _given(self, states: set[int]) -> set[int]:
        given = {self.step[state][0] for state in states if state < self.end and self.step[state]}
        if -1 in given:
            raise ValueError("a template cannot begin with a replaceable region")
        return given

    def longest(self, hashes: list[int]) -> int:
        """Words of the longest match from the first of these words on, 0 for none."""
        states, best = self.closed({0}), 0
        for count, word in enumerate(hashes, 1):
            states = self.moved(states, word)
            if not states:
                break
            if self.end in states:
                best = count
        return best

    @property
    def reach(self) -> int:
        return sum(step is not None for step in self.step)


def _templates_found(found: Words, automata: list[Automaton], lookup: dict[int, list[int]], keys: np.ndarray) -> list[dict[str, float]]:
    """For each text its labels, each with its best score."""
    rows = len(found.first) - 1
    labels: list[dict[str, float]] = [{} for _ in range(rows)]
    pairs = chained(found.hash, 2)
    text = found.text
    places = np.flatnonzero(np.isin(pairs, keys) & (text[1:] == text[:-1])) if len(pairs) else []
    for place in places:
        row = text[place]
        for number in lookup[int(pairs[place])]:
            automaton = automata[number]
            ahead = found.hash[place : min(found.first[row + 1], place + automaton.reach)].tolist()
            got = automaton.longest(ahead)
            if got:
                score = 0.5 + 0.5 * min(1.0, got / automaton.words)
                labels[row][automaton.label] = max(score, labels[row].get(automaton.label, 0.0))
    return labels


def scan_licenses(documents: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``n_base`` counts the places of the phrases, which are found wherever their words stand
    next to each other. ``score`` is 1 with a phrase or the full wording of a template, 0
    without any match, and else 0.5 plus half the share of a template's words (its optional
    ones too) that the best match has.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(*template) for template in templates]
        lookup: dict[int, list[int]] = {}
        for number, automaton in enumerate(automata):
            for pair in automaton.starts():
                lookup.setdefault(pair, []).append(number)
        keys = np.array(sorted(lookup), np.uint64)
        wanted = [([word_hash(word) for word in phrase.split()], label) for phrase, label in phrases.items()]
        for part in slices(batches):
            data, offsets = utf8(part["text"])
            found = words(data, offsets, NOT_WORD)
            text, rows = found.text, part.num_rows
            places, rows_of, marks = [], [], []
            for hashes, label in wanted:
                here = np.flatnonzero(found.hash == hashes[0])
                here = here[here + len(hashes) <= len(found.hash)]
                for step, value in enumerate(hashes[1:], 1):
                    here = here[found.hash[here + step] == value]
                here = here[text[here] == text[here + len(hashes) - 1]]
                places.append(here)
                rows_of.append(text[here])
                marks.extend((row, label) for row in np.unique(text[here]).tolist())
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            owner = np.concatenate(rows_of) if rows_of else np.zeros(0, np.int64)
            count = np.bincount(owner, minlength=rows)
            low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            np.minimum.at(low, owner, place - found.first[owner])
            np.maximum.at(high, owner, place - found.first[owner])
            base: list[set[str]] = [set() for _ in range(rows)]
            for row, label in marks:
                base[row].add(label)
            more = _templates_found(found, automata, lookup, keys)
            none = count == 0
            score = [1.0 if base[k] else max(more[k].values(), default=0.0) for k in range(rows)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part["doc_id"],
                    "n_words": pa.array(np.diff(found.first), pa.int64()),
                    "n_base": pa.array(count, pa.int64()),
                    "first_word": pa.array(low, pa.int64(), mask=none),
                    "last_word": pa.array(high, pa.int64(), mask=none),
                    "base_labels": [",".join(sorted(labels)) for labels in base],
                    "labels": [",".join(sorted({*base[k], *more[k]})) for k in range(rows)],
                    "score": score,
                }
            )

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return documents.select("doc_id", "text").mapInArrow(scan, schema)
