"""Mentions by automaton against a regular expression, and languages of paths."""

import random
import re

import pytest

from tessera.operators import languages, search


def by_pattern(texts, terms, definitions):
    out = {}
    for i, text in texts:
        for n, line in enumerate((text or "").split("\n"), 1):
            for term in {t for t, _ in terms}:
                if any(d[0] == i and d[1] == term and d[2] <= n <= d[3] for d in definitions):
                    continue
                names = sorted({name for t, name in terms if t == term and name}, key=lambda x: (-len(x), x))
                if names and (many := len(re.findall(r"(?<![^\W_]|[_$])(?:" + "|".join(map(re.escape, names)) + r")(?![^\W_]|[_$])", line, re.I))):
                    out[i, n, term] = many
    return out


@pytest.mark.parametrize("names", [search.NAMES, 3])
def test_mentions_by_pattern(spark, names):
    rng = random.Random(7)
    pieces = ["Data", "data lake", "lake", "a+b", "$x", "é", "LAKE", "ab", "a", "b", " ", " ", "_", "-", "1", "\n", "lake house", "house"]
    texts = [(i, rng.choice([None, *["".join(rng.choices(pieces, k=30)) for _ in range(9)]])) for i in range(80)]
    terms = [("L", "lake"), ("L", "data lake"), ("L", "lake house"), ("D", "data"), ("H", "House"), ("P", "a+b"), ("P", "b"), ("E", "É"), ("X", ""), ("X", None), ("A", "a"), ("A", "a a")]
    definitions = [(i, "L", 1, 2) for i in range(0, 80, 2)]
    got = search.term_mentions(
        spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term string, name string"), spark.createDataFrame(definitions, "id long, term string, line_start int, line_end int"), names
    )
    expected = by_pattern(texts, terms, definitions)
    assert {(r["id"], r["line"], r["term"]): r["n"] for r in got.collect()} == expected and len(expected) > 100
    assert search.term_mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "term string, name string")).count() == 0


def test_languages(spark):
    index = [
        ("name", "Makefile", "Makefile"), ("extension", ".in", "Template"), ("extension", ".h.in", "C Template"), ("extension", ".h", "C"), ("extension", ".h", "C++"), ("extension", ".h", "Objective-C"), ("extension", ".ts", "TypeScript"),
        ("extension", ".ts", "XML"), ("extension", ".json", "JSON"), ("extension", ".json", "OASv3-json"), ("extension", ".q", "Q"), ("extension", ".q", "K"), ("extension", ".m", "MATLAB"), ("extension", ".m", "Mercury"),
        ("interpreter", "python", "Python"), ("interpreter", "perl5", "Perl"),
    ]
    paths = {
        ("src/makefile", None): ("Makefile", ["Makefile"]), ("a/config.H.IN", "x"): ("C Template", ["C Template"]), ("config.in", None): ("Template", ["Template"]), ("v1.2/notes", None): ("unknown", ["unknown"]),
        ("x.h", None): ("C", ["C", "C++", "Objective-C"]), ("x.h", "int a;\n  namespace b {}"): ("C++", ["C", "C++", "Objective-C"]), ("x.h", "#import <a>"): ("Objective-C", ["C", "C++", "Objective-C"]),
        ("x.ts", '﻿ <?xml version="1.0"?>\n<!-- a -->\n<!DOCTYPE TS>\n<TS version="2">'): ("XML", ["TypeScript", "XML"]), ("x.ts", "let a = '<TS';"): ("TypeScript", ["TypeScript", "XML"]),
        ("x.json", '{"openapi": "3.1"}'): ("OASv3-json", ["JSON", "OASv3-json"]), ("x.json", '{"openapi": 3}'): ("JSON", ["JSON", "OASv3-json"]), ("x.json", '{"swagger": "2.0"}'): ("ambiguous", ["JSON", "OASv3-json"]), ("x.json", "[1"): ("JSON", ["JSON", "OASv3-json"]),
        ("x.q", "a"): ("ambiguous", ["K", "Q"]), ("x.m", None): ("ambiguous", ["MATLAB", "Mercury"]), ("run", "#!/usr/bin/env -S -i Python3.12 -u\nx"): ("Python", ["Python"]), ("run", "#! /usr/bin/perl5"): ("Perl", ["Perl"]), ("run", "#!/bin/other\n"): ("unknown", ["unknown"]),
        ("data", "null"): ("JSON", ["JSON"]), ("data", "{"): ("unknown", ["unknown"]), ("over.h", None): ("Zig", ["Zig"]),
    }
    rows = [(p, c, str(i)) for i, (p, c) in enumerate(paths)]
    got = languages.language_of_paths(
        spark.createDataFrame(rows, "path string, content string, n string"), spark.createDataFrame(index, "kind string, key string, language string"), spark.createDataFrame([("over.h", "Zig")], "path string, language string")
    )
    assert {(r["path"], r["content"]): (r["language"], r["candidates"]) for r in got.collect()} == paths


def test_mentions_are_handed_on_in_parts(spark, monkeypatch):
    """A text of more mentions than a task may hold gives all of them, each under its own text."""
    monkeypatch.setattr(search, "MENTIONS", 2)
    texts = spark.createDataFrame([(i, "\n".join(["a b a"] * 3)) for i in range(4)], "id long, text string").coalesce(1)
    terms = spark.createDataFrame([("a", "a"), ("b", "b")], "term string, name string")
    got = sorted(tuple(r) for r in search.term_mentions(texts, terms).collect())
    assert got == [(i, n, t, c) for i in range(4) for n in (1, 2, 3) for t, c in (("a", 2), ("b", 1))]
