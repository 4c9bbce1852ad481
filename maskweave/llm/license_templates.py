"""License scans by template-markup matching.

A template is the wording of a notice with two kinds of markup: ``[[ ... ]]`` is
optional, ``<<n>>`` is replaceable by up to ``n`` words.  Templates are compiled into
one token automaton; its subset construction is done lazily, per state that a text
reaches.  A text is accepted at a word if the automaton gets from there to an end, so
that all mandatory words of a template stand in order with nothing but optional and
replaceable words between them.  Steps from a start are bounded by the longest
template, so the work is linear in the text.

Base phrases are plain word sequences; each place counts.

Defined results: null and empty texts have no words and no labels; repeated rows give
repeated results; an empty table gives an empty one; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from maskweave.llm.common import frugal, steps

#: Fixed values of the contract: phrase, label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Label and marked-up wording of notices.
TEMPLATES = (
    ("mit", "[[this <<4>> is]] released under the mit license"),
    ("mit", "[[spdx]] license identifier mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files [[the software]] to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    ("apache-2", "[[spdx]] license identifier apache 2 0"),
    ("cc-by-nc", "licensed under [[the]] [[a]] [[creative commons]] cc by nc [[sa]] [[nd]] [[4 0]]"),
    ("cc-by-nc", "licensed under [[the]] [[a]] creative commons attribution noncommercial [[<<2>>]] [[4 0]] [[international]] license"),
    ("gpl-3", "licensed under the [[terms of the]] gnu general public license [[as published by <<6>>]] [[either]] version 3"),
    ("gpl-2", "licensed under the [[terms of the]] gnu general public license [[as published by <<6>>]] [[either]] version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license [[v]] [[version]] 2 0"),
)
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MARK = re.compile(r"\[\[|\]\]|<<(\d+)>>|[^\s\[\]<>]+")


class Automaton:
    """All templates as one nondeterministic automaton over words, made deterministic as texts need it."""

    def __init__(self, templates) -> None:
        self.step: list[dict[bytes, int]] = []  # by state: word → state
        self.other: list[int] = []  # by state: the state after any word, or -1
        self.skip: list[list[int]] = []  # by state: states reached without a word
        self.ends: dict[int, str] = {}
        starts = []
        for label, text in templates:
            at = self._state()
            starts.append(at)
            open_at = []
            for m in MARK.finditer(text):
                if m[0] == "[[":
                    open_at.append(at)
                elif m[0] == "]]":
                    begin, end = open_at.pop(), self._state()
                    self.skip[at].append(end)
                    self.skip[begin].append(end)
                    at = end
                elif m[1]:
                    run = [at, *(self._state() for _ in range(int(m[1])))]
                    for a, b in zip(run, run[1:]):
                        self.other[a] = b
                    at = self._state()
                    for s in run:
                        self.skip[s].append(at)
                else:
                    new = self._state()
                    self.step[at][m[0].encode()] = new
                    at = new
            self.ends[at] = label
        self.start = self._closed(starts)
        self.known: dict[tuple[frozenset, bytes], frozenset] = {}
        self.words = {w for s in self.step for w in s}
        self.first = {w for s in self.start for w in self.step[s]}

    def _state(self) -> int:
        self.step.append({})
        self.other.append(-1)
        self.skip.append([])
        return len(self.step) - 1

    def _closed(self, states) -> frozenset:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.skip[s]
        return frozenset(seen)

    def after(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if word in self.words else b"")
        if key not in self.known:
            got = [self.step[s][word] for s in states if word in self.step[s]] + [self.other[s] for s in states if self.other[s] >= 0]
            self.known[key] = self._closed(got)
        return self.known[key]

    def labels_at(self, words: list[bytes], at: int) -> set[str]:
        states, found = self.start, set()
        while at < len(words) and (states := self.after(states, words[at])):
            found |= {self.ends[s] for s in states if s in self.ends}
            at += 1
        return found


def scan_text(text: str, phrases: dict[bytes, list], automaton: Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text.

    The score is 1 for an accepted template, else 0.5 for a base phrase, else 0.
    """
    words = TOKEN.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    places, base, more = [], set(), set()
    for i, w in enumerate(words):
        for parts, label in phrases.get(w, ()):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                base.add(label)
        if w in automaton.first:
            more |= automaton.labels_at(words, i)
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, by_first = Automaton(templates), {}
        for phrase, label in phrases:
            parts = phrase.encode().split()
            by_first.setdefault(parts[0], []).append((parts, label))
        for b in steps(batches):
            rows = [scan_text(t or "", by_first, automaton) for t in b.column("text").to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *fields])

    schema = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(frugal(scan), schema)
