import re
from itertools import product

import pytest

import regex

from specloom.llm.licences import BASE, TEMPLATES, Automaton, Scanner, licence_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), sorted((i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def test_rows(spark, documents, odd_docs, no_docs):
    lines = spark.createDataFrame(
        [
            (1, "CC BY\n\ncc-by xcc by cc by1 GNU General Public License, version 3; all rights.reserved ÉCC BY"),
            (2, "(c) 2021 Copyright (c) 2021 Foo. All rights reserved. Released under the MIT License."),
            (3, "Licensed under the Apache License, Version 2.0."), (4, "licensed under the apache license version 3 0"), (5, "the mit licence"),
        ],
        "doc_id long, text string",
    )
    for docs in (documents, odd_docs, lines):
        texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        got = sorted(licence_scan(docs).collect(), key=lambda r: (str(r["doc_id"]), r["n_words"]))
        assert len(got) == len(texts)
        expected = sorted(((d, *base(t)) for d, t in texts), key=lambda r: (str(r[0]), r[1]))
        for (d, n, places), r in zip(expected, got):
            assert (r["doc_id"], r["n_words"], r["n_base"]) == (d, n, len(places))
            assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
            assert 0 <= r["score"] <= 1
    found = {r["doc_id"]: r["labels"] for r in licence_scan(lines).collect()}
    assert found == {1: "cc-by,gpl,reserved", 2: "copyright-notice,mit,reserved", 3: "apache-2.0", 4: "", 5: ""}
    assert licence_scan(no_docs).count() == 0


def test_automaton_against_expansion():
    """All texts that a template spells out are accepted whole, and no other of the same words."""
    automaton = Automaton("a [[b | c [[d]]]] <<2>> e")
    spelled = {("a", *x, *y, "e") for x in ((), ("b",), ("c",), ("c", "d")) for n in (0, 1, 2) for y in product("abcde", repeat=n)}
    for n in range(1, 6):
        for words in product("abcde", repeat=n):
            assert (automaton.match(list(words), 0) == n) == (words in spelled)
    with pytest.raises(ValueError):
        Automaton("[[a]]")


def pattern(template):
    """A template as a pattern over words that each end in a space, leftmost and longest."""
    parts = re.findall(r"\[\[|\]\]|\||<<\d+>>|[a-z0-9]+", template.lower())
    spell = {"[[": "(?:(?:", "]]": "))?", "|": ")|(?:"}
    one = lambda x: spell.get(x) or (r"(?:[^ ]+ ){0,%s}" % x[2:-2] if x.startswith("<<") else x + " ")
    return regex.compile("(?p)" + "".join(map(one, parts)))


def spelled(template, seed):
    """A text that a template stands for."""
    import random

    r = random.Random(seed)
    parts, out, skip = re.findall(r"\[\[|\]\]|\||<<\d+>>|[^\s\[\]|<>]+", template), [], []
    for x in parts:
        if x == "[[":
            skip.append("all" if r.random() < 0.5 else "")
        elif x == "]]":
            skip.pop()
        elif x == "|":
            skip[-1] = "all" if skip[-1] == "" or r.random() < 0.5 else skip[-1]
        elif not any(skip):
            out += [f"Name{k}" for k in range(r.randint(0, int(x[2:-2])))] if x.startswith("<<") else [x]
    return " ".join(out)


def brute_spans(text, patterns):
    words = WORD.findall(text.translate(LOWER))
    line, starts = "", []
    for w in words:
        starts.append(len(line))
        line += w + " "
    found = set()
    for label, p in patterns:
        for i, at in enumerate(starts):
            m = p.match(line, at)
            if m and m.end() > at:
                found.add((label, i, i + m.group().count(" ")))
    return sorted(s for s in found if not any(o != s and o[0] == s[0] and o[1] <= s[1] and s[2] <= o[2] for o in found))


def test_templates_against_patterns(spark, documents):
    """The spans of all templates, on documents, on texts that they spell and on such texts with one word changed."""
    import random

    r = random.Random(5)
    patterns = [(label, pattern(t)) for label, texts in TEMPLATES.items() for t in texts]
    texts = [x["text"] or "" for x in documents.collect() if len(x["text"] or "") < 20_000]
    for seed in range(6):
        for whole in (t for ts in TEMPLATES.values() for t in ts):
            words = f"before the {spelled(whole, seed)} after it".split()
            texts.append(" ".join(words))
            words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    scanner = Scanner(TEMPLATES)
    got = [scanner.scan(t)[2] for t in texts]
    assert got == [brute_spans(t, patterns) for t in texts]
    assert {label for spans in got for label, *_ in spans} == set(TEMPLATES)
    assert any(b - a > 150 for spans in got for _, a, b in spans)


def test_alternatives_and_templates_without_a_common_word(spark):
    docs = spark.createDataFrame([(1, "It is released under the MIT License."), (2, "foo bar"), (3, "baz qux"), (4, "foo qux"), (5, "x " * 100_000 + "foo bar")], "doc_id long, text string")
    assert {x["doc_id"]: tuple(x["template_spans"][0])[1:] for x in licence_scan(docs).collect() if x["labels"] == "mit"} == {1: (2, 7)}
    own = {r["doc_id"]: r["labels"] for r in licence_scan(docs, {"own": ["foo bar | baz qux"]}).collect()}
    assert own == {1: "", 2: "own", 3: "own", 4: "", 5: "own"}
