"""License scans: templates with optional and replaceable regions, matched by token automata.

A template is wording with markup: ``[...]`` may be left out, ``{a|b}`` is one
of several wordings (each may hold markup again) and ``{*1-9}`` stands for one
to nine words of any kind. All other words are mandatory. Templates are
compiled into one automaton over words; its deterministic states are made as
texts need them. It is started at every word that can begin a template and
accepts where all mandatory words stood in their order with nothing between;
of several ends for one label the farthest counts. Plain phrases are templates
without markup.

Texts are scanned whole, in one pass without a shuffle. Each template has an
anchor, its longest mandatory word; texts that hold no anchor are only counted.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import lean

# Phrases and labels of the base rule.
PHRASES = [("mit license", "mit"), ("apache license", "apache"),
           ("general public license", "gpl")]

# Public license notices and texts, with the regions that vary marked.
TEMPLATES = [
    ("mit-notice", "{released|licensed|distributed|available} under [the terms of] the mit license"),
    ("apache-2.0-notice",
     "licensed under the apache license [version] 2 0 [the license you may not use this file "
     "except in compliance with the license]"),
    ("gpl-notice",
     "[this {work|program|software|file|project|code} is] {licensed|released|distributed} under "
     "[the terms of] the gnu [{lesser|affero}] general public license [version {2|3}] [0] "
     "[{only|or [any] later [version]}]"),
    ("gpl-notice",
     "it under the terms of the gnu [{lesser|affero}] general public license as published by the "
     "free software foundation {either version {2|3}|version {2|3}}"),
    ("cc-notice", "licensed under [a] [the] {cc|creative commons} {by|attribution} "
                  "[{nc|noncommercial}] [{sa|sharealike|nd|noderivatives}] [{2 0|2 5|3 0|4 0}]"),
    ("mit-text",
     "permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute "
     "sublicense and or sell copies of the software and to permit persons to whom the software is "
     "furnished to do so subject to the following conditions the above copyright notice and this "
     "permission notice [including the next paragraph] shall be included in all copies or "
     "substantial portions of the software [the software is provided as is without warranty of any "
     "kind express or implied including but not limited to the warranties of merchantability "
     "fitness for a particular purpose and noninfringement in no event shall {*1-8} be liable for "
     "any claim damages or other liability whether in an action of contract tort or otherwise "
     "arising from out of or in connection with the software or the use or other dealings in the "
     "software]"),
    ("isc-text",
     "permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted provided that the above copyright notice and this permission "
     "notice appear in all copies"),
    ("bsd-text",
     "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met [1] redistributions of source code must "
     "retain the above copyright notice this list of conditions and the following disclaimer [2] "
     "redistributions in binary form must reproduce the above copyright notice this list of "
     "conditions and the following disclaimer in the documentation and or other materials provided "
     "with the distribution [[3] neither the name of {*1-12} nor the names of {its|{*1-3}} "
     "contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission]"),
    ("spdx-tag", "spdx license identifier {mit|apache 2 0|gpl {2|3} 0 [{only|or later}]|bsd {2|3} "
                 "clause|isc|mpl 2 0|cc0 1 0}"),
]

_MARKUP = re.compile(r"[\[\]{}|]|\*\d+-\d+|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Bytes of words: 0-9, a-z and everything beyond ASCII; the rest parts words.
_LETTER = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
                for c in range(256))
_INSIDE = bytes(int(c != 0x20) for c in _LETTER)


def count_words(lowered: bytes) -> int:
    """Words of A-Z lower-cased bytes, without making them."""
    return (b"\0" + lowered.translate(_INSIDE)).count(b"\0\1")


def words_of(lowered: bytes) -> list[bytes]:
    return lowered.translate(_LETTER).split()


class Automaton:
    """Labelled templates as one automaton over words."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.steps: list[dict[bytes | None, set[int]]] = []  # None: any word
        self.free: list[set[int]] = []  # moves that take no word
        self.ends: dict[int, str] = {}
        self.anchors: list[bytes] = []
        begin = self._state()
        for label, text in templates:
            tokens = _MARKUP.findall(text.lower())
            last, mandatory, rest = self._sequence(begin, tokens)
            if rest or not mandatory:
                raise ValueError(f"template {label!r}: unbalanced markup or no mandatory word")
            self.ends[last] = label
            self.anchors.append(max(mandatory, key=len))
        self.anchors = sorted(set(self.anchors))
        self.known: dict[frozenset, dict] = {}
        self.start = self._closed({begin})
        if self._row(self.start)[None]:
            raise ValueError("a template begins with any word")

    def _state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def _sequence(self, at: int, tokens: list[str]) -> tuple[int, list[bytes], list[str]]:
        """(last state, mandatory words, unread tokens) of the wording from state ``at`` on."""
        mandatory: list[bytes] = []
        while tokens and tokens[0] not in "]}|":
            token, tokens = tokens[0], tokens[1:]
            after = self._state()
            if token == "[":
                last, _, tokens = self._sequence(at, tokens)
                tokens = self._closing(tokens, "]")
                self.free[at].add(after)
                self.free[last].add(after)
            elif token == "{":
                while True:
                    begin = self._state()
                    self.free[at].add(begin)
                    last, _, tokens = self._sequence(begin, tokens)
                    self.free[last].add(after)
                    if not tokens or tokens[0] != "|":
                        break
                    tokens = tokens[1:]
                tokens = self._closing(tokens, "}")
            elif token.startswith("*"):
                least, most = map(int, token[1:].split("-"))
                for n in range(1, most + 1):
                    step = self._state()
                    self.steps[at].setdefault(None, set()).add(step)
                    if n >= least:
                        self.free[step].add(after)
                    at = step
            else:
                word = token.encode()
                self.steps[at].setdefault(word, set()).add(after)
                mandatory.append(word)
            at = after
        return at, mandatory, tokens

    @staticmethod
    def _closing(tokens: list[str], mark: str) -> list[str]:
        if not tokens or tokens[0] != mark:
            raise ValueError(f"a region is not closed by {mark}")
        return tokens[1:]

    def _closed(self, states: set[int]) -> frozenset:
        found, stack = set(states), list(states)
        while stack:
            new = self.free[stack.pop()] - found
            found |= new
            stack += new
        return frozenset(found)

    def _row(self, states: frozenset) -> dict:
        """Word -> next states (None: of any other word) and, at 0, the labels accepted here."""
        row = self.known.get(states)
        if row is None:
            always = set().union(*(self.steps[s].get(None, ()) for s in states))
            row = {None: self._closed(always),
                   0: sorted({self.ends[s] for s in states if s in self.ends})}
            for word in set().union(*(self.steps[s] for s in states)) - {None}:
                row[word] = self._closed(
                    always.union(*(self.steps[s].get(word, ()) for s in states)))
            self.known[states] = row
        return row

    def places(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, word after the last, label), the farthest end of each label and start."""
        first = self._row(self.start)
        found = []
        for at in [i for i, word in enumerate(words) if word in first]:
            ends: dict[str, int] = {}
            row = first
            for here in range(at, len(words)):
                states = row.get(words[here]) or row[None]
                if not states:
                    break
                row = self._row(states)
                for label in row[0]:
                    ends[label] = here + 1
            found += [(at, end, label) for label, end in sorted(ends.items())]
        return found


def _covered(places: list[tuple[int, int, str]]) -> int:
    total, reached = 0, 0
    for start, stop, _ in sorted(places):
        total += max(0, stop - max(start, reached))
        reached = max(reached, stop)
    return total


def scan_licenses(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES,
                  phrases: list[tuple[str, str]] = PHRASES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, covered, base, found): every place of a phrase or a template.

    ``phrases`` are (wording, label), ``templates`` (label, marked-up wording).
    ``base`` and ``found`` are arrays of (label, start, stop) in words from 0,
    ``covered`` the number of words inside at least one place. Null and empty
    texts have no words; every row gives one, rows with equal or null ids too.
    Other columns are ignored; an empty table gives no rows.
    """
    plain = Automaton([(label, text) for text, label in phrases])
    marked = Automaton(templates)
    anchors = sorted({*plain.anchors, *marked.anchors})
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()),
                                ("stop", pa.int64())]))

    def rows(found):
        return [{"label": label, "start": a, "stop": b} for a, b, label in found]

    def kernel(batches):
        for batch in batches:
            counts, covered, base, method = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                lowered = (raw or b"").lower()
                counts.append(count_words(lowered))
                here = there = []
                if any(anchor in lowered for anchor in anchors):
                    words = words_of(lowered)
                    here, there = plain.places(words), marked.places(words)
                covered.append(_covered(here + there))
                base.append(rows(here))
                method.append(rows(there))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(covered, pa.int64()),
                 pa.array(base, place), pa.array(method, place)],
                names=["doc_id", "n_words", "covered", "base", "found"])

    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    name = light.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<label: string, start: long, stop: long>>"
    return light.mapInArrow(
        lean(kernel),
        f"doc_id {name}, n_words long, covered long, base {spans}, found {spans}")


def license_labels(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``score`` is the share of a text's words inside any place: near 1 for a
    license text, small for a text that mentions one, 0 without a place. See
    ``scan_licenses`` for odd rows; without places, labels are empty strings
    and first and last word null.
    """

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    starts = F.col("base.start")
    return scan_licenses(docs, **options).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "found.label")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(0.0)
        .alias("score"))
