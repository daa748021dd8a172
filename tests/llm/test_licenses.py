import re

import pytest
import tests_llm_odd as odd

from shelfmark.llm.license_templates import (
    PHRASES, TEMPLATES, Automaton, license_labels, scan_licenses,
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    own, found = words(text), []
    for phrase, label in PHRASES:
        want = phrase.split()
        found += [(i, label) for i in range(len(own)) if own[i:i + len(want)] == want]
    return found


def rewritten(template):
    """A template as a regular expression over words that each end in a space."""
    out = ""
    for token in re.findall(r"[\[\]{}|]|\*\d+-\d+|[^\s\[\]{}|*]+", template):
        if token.startswith("*"):
            out += r"(?:\S+ ){%s}" % token[1:].replace("-", ",")
        else:
            out += {"[": "(?:", "]": ")?", "{": "(?:", "}": ")", "|": "|"}.get(
                token, re.escape(token) + " ")
    return re.compile(out)


def brute(text, templates):
    """Every start at which some wording of a template fits, with its farthest end."""
    own, found = words(text), {}
    for label, template in templates:
        wanted = rewritten(template)
        for i in range(len(own)):
            for j in range(len(own), i, -1):
                if wanted.fullmatch(" ".join(own[i:j]) + " "):
                    found[i, label] = max(j, found.get((i, label), 0))
                    break
    return sorted((i, j, label) for (i, label), j in found.items())


CASES = [
    "Released under the MIT License.", "released under the terms of the MIT license",
    "Licensed under the Apache License, Version 2.0.", "licensed under the apache license 2.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "This program is released under the GNU Lesser General Public License version 2 or any later",
    "Licensed under CC BY-NC 4.0. licensed under Creative Commons Attribution",
    "licensed under the Eclipse license", "SPDX-License-Identifier: GPL-3.0-or-later x",
    "released under the mit release under the mit license mit license MIT-LICENSE",
]


def test_automata_equal_regular_expressions():
    short = [t for t in TEMPLATES if len(t[1]) < 400]
    automaton = Automaton(short)
    for text in [*CASES, " ".join(CASES), "", "under " * 50]:
        assert automaton.places([w.encode() for w in words(text)]) == brute(text, short), text


@pytest.mark.parametrize("template,text,ends", [
    ("a [b [c]] d", "a b c d", [4]), ("a [b [c]] d", "a c d", []), ("a [b [c]] d", "a b d", [3]),
    ("a {*1-3} d", "a d", []), ("a {*1-3} d", "a d d", [3]), ("a {*1-3} d", "a x y z d", [5]),
    ("a {*1-3} d", "a w x y z d", []), ("a {b|c {d|e}} f", "a c e f", [4]),
    ("a {b|c {d|e}} f", "a c f", []), ("a [z]", "a z", [2]), ("[a] b", "a b", [2, 2]),
])
def test_regions(template, text, ends):
    found = Automaton([("t", template)]).places([w.encode() for w in text.split()])
    assert [stop for _, stop, _ in found] == ends


@pytest.mark.parametrize("template", ["a [b", "a b]", "{a|b}", "[a]", "{*1-2} a", "a {b|c", ""])
def test_broken_templates_are_refused(template):
    with pytest.raises(ValueError):
        Automaton([("t", template)])


def test_rows_equal_brute_force(spark):
    rows = odd.rows(n=12)
    rows += [(100 + i, t, "s") for i, t in enumerate(CASES)]
    rows += [(200, odd.prose(__import__("random").Random(4), 900) + " mit license", None),
             (201, "ÀMIT license", "s"), (202, "mit\x00license apache\tLICENSE", "s")]
    got = license_labels(odd.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    short = [t for t in TEMPLATES if len(t[1]) < 400]
    want = []
    for doc_id, text, _ in rows:
        own, places = words(text), base(text)
        method = brute(text, short) if doc_id is not None and 100 <= doc_id < 200 else []
        starts = [i for i, _ in places]
        want.append((doc_id, len(own), len(places), min(starts, default=None),
                     max(starts, default=None), ",".join(sorted({n for _, n in places})),
                     ",".join(sorted({n for _, n in places} | {n for *_, n in method}))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:7]) for r in got)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)
    assert license_labels(odd.frame(spark, [])).count() == 0


def test_license_texts_and_spans(spark):
    text = ("Copyright (c) Someone. Permission to use, copy, modify, and/or distribute this "
            "software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.")
    changed = text.replace("purpose", "reason")
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(
        [(1, text), (2, changed)], "doc_id long, text string")).collect()}
    assert [tuple(p) for p in got[1].found] == [("isc-text", 3, 37)]
    assert got[1].covered == 34 and not got[2].found and not got[2].covered
