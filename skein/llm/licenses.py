"""License scans by template-markup matching (operator 6).

A template is the wording of a notice with markup: ``{{...}}`` is optional, ``<<n>>`` stands for up to n words of any
kind. It is compiled to an automaton over words; a text is accepted where mandatory wording matches word for word, and
nothing else lies between. Texts are cut to words once; only those with a template's or phrase's anchor word go on to
the automata, which start where the first word of the wording stands.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

Score: 1 if a template accepts; else half the share of its states that the furthest automaton has passed, if that is
``LEAST`` words or more, and at least 0.5 where a base phrase stands; 0 without either.

Defined results: null, empty and word-less texts have no places, no labels ('') and score 0. Repeated rows are scanned
one by one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import slices, words_of

#: Words that an automaton must pass to count for the score.
LEAST = 3

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices in markup and their labels.
TEMPLATES = {
    "apache-2.0": "licensed under {{the terms of}} the apache license {{,}} version 2.0",
    "apache-2.0-terms": "you may not use {{this file}} {{the software}} except in compliance with the license",
    "mit-notice": "{{this <<2>> is}} released under {{the terms of}} the mit license",
    "mit-terms": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{the software}} to deal in the software without restriction",
    "gpl-notice": "{{this}} {{<<3>>}} is licensed under {{the terms of}} the gnu general public license {{as published by the free software foundation}} {{either}} version 3 {{of the license}} {{or any later version}}",
    "gpl-2.0": "licensed under {{the terms of}} the gnu general public license {{as published by the free software foundation}} {{either}} version 2",
    "lgpl": "licensed under {{the terms of}} the gnu lesser general public license {{,}} version <<2>>",
    "cc-by-4.0": "licensed under {{a}} {{the}} {{creative commons}} cc by 4.0",
    "cc-by-nc-4.0": "licensed under {{a}} {{the}} {{creative commons}} cc by-nc 4.0",
    "cc-by-sa-4.0": "licensed under {{a}} {{the}} {{creative commons}} cc by-sa 4.0",
    "cc-by-nd-4.0": "licensed under {{a}} {{the}} {{creative commons}} cc by-nd 4.0",
    "cc-text": "licensed under {{a}} {{the}} creative commons attribution <<3>> 4.0 {{international}} license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license {{,}} v 2.0",
    "all-rights-reserved": "copyright {{c}} <<8>> all rights reserved",
    "gpl-terms": "free software {{:}} you can redistribute it and or modify it under the terms of the gnu {{lesser}} {{affero}} general public license as published by the free software foundation {{either}} version <<1>> {{of the license}} {{or}} {{at your option}} {{any later version}}",
    "agpl-3.0": "licensed under {{the terms of}} the gnu affero general public license {{as published by the free software foundation}} {{either}} version 3",
    "mit-warranty": "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-3-clause": "neither the name of <<8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "zlib": "software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "unlicense": "free and unencumbered software released into the public domain",
    "epl-2.0": "eclipse public license {{,}} {{v}} {{version}} 2.0",
    "cc0-1.0": "cc0 1.0 {{universal}}",
}


@dataclass
class Automaton:
    """States 0..n, each with the word that leaves it (None: any word) and the states that are reached without a word."""

    label: str
    words: list[bytes | None] = field(default_factory=list)
    skips: list[set[int]] = field(default_factory=list)
    mandatory: int = 0

    @property
    def first(self) -> set[bytes]:
        return {self.words[s] for s in self.closed({0}) if s < len(self.words) and self.words[s] is not None}

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def run(self, words: list[bytes], at: int) -> tuple[bool, int]:
        """Whether the wording stands at ``at``, and the furthest state."""
        live, end, far = self.closed({0}), len(self.words), 0
        while True:
            if end in live:
                return True, end
            if at >= len(words) or not live:
                return False, far
            word = words[at]
            live = self.closed({s + 1 for s in live if s < end and self.words[s] in (None, word)})
            far, at = max([far, *live]), at + 1


def compiled(label: str, markup: str) -> Automaton:
    """The automaton of one template; optional regions may hold replaceable ones, but not each other."""
    out = Automaton(label, [], [set()])

    def add(word: bytes | None) -> None:
        out.words.append(word)
        out.skips.append(set())

    for part in re.split(r"(\{\{.*?\}\})", markup):
        optional, start = part.startswith("{{"), len(out.words)
        for piece in re.split(r"(<<\d+>>)", part.strip("{}") if optional else part):
            if m := re.fullmatch(r"<<(\d+)>>", piece):
                for _ in range(int(m[1])):
                    out.skips[len(out.words)].add(len(out.words) + 1)
                    add(None)
            else:
                for word in words_of(piece):
                    add(word)
                    out.mandatory += not optional
        if optional and len(out.words) > start:
            out.skips[start].add(len(out.words))
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        automata = [compiled(*t) for t in templates.items()]
        self.starts: dict[bytes, list[Automaton]] = {}
        for a in automata:
            for w in a.first:
                self.starts.setdefault(w, []).append(a)
        self.heads: dict[bytes, list] = {}
        for words, label in self.phrases:
            self.heads.setdefault(words[0], []).append((words, label))
        self.anchors = set(self.starts) | set(self.heads)

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        places, base, labels, score = [], set(), set(), 0.0
        if not self.anchors.isdisjoint(words):
            for at, word in enumerate(words):
                if word not in self.anchors:
                    continue
                for phrase, label in self.heads.get(word, ()):
                    if words[at : at + len(phrase)] == phrase:
                        places.append(at)
                        base.add(label)
                for a in self.starts.get(word, ()):
                    done, far = a.run(words, at)
                    if done:
                        labels.add(a.label)
                    score = max(score, 1.0 if done else far / len(a.words) / 2 if far >= LEAST else 0.0)
        if base:
            score = max(score, 0.5)
        both = lambda x: ",".join(sorted(x))
        return len(words), len(places), min(places, default=None), max(places, default=None), both(base), both(base | labels), score


_OUT = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def scanned(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in slices(batches, "text"):
            rows = zip(*[scanner.scan(t) for t in batch.column("text").to_pylist()])
            columns = [pa.array(c, kind) for c, (_, kind) in zip(rows, _OUT)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(n for n, _ in _OUT)])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
