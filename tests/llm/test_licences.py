import random
import re

from factsieve.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    doc = words(text)
    form = " " + " ".join(doc) + " "
    places = []
    labels = set()
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(doc)) if doc[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    found = []
    for nth, r in enumerate(licences.rules()):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", form):
            start = form[: m.start()].count(" ") - 1
            found.append((start, start + m.group().count(" ") + 1, r.priority, nth, r))
    kept = [x for x in found if not any(
        y[0] <= x[0] and y[1] >= x[1] and (y[2] < x[2] or (y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or (y[:2] == x[:2] and y[3] < x[3])))) for y in found)]
    score = max([r.confidence for *_, r in kept] + ([0.7] if places else []), default=0.0)
    return len(doc), len(places), min(places, default=None), max(places, default=None), sorted(labels), sorted(labels | {x[4].label for x in kept}), score


def texts():
    rng = random.Random(3)
    parts = ["MIT License", "mit license mit license", "Apache License,\nVersion 2.0", "GNU Lesser General Public License v2.1", "General Public License", "SPDX-License-Identifier: GPL-2.0 or later",
             "Licensed under the Apache License, Version 2.0", "spdx license identifier mit 0", "the unlicense", "All rights reserved", "Copyright (c) 2019", "l'été", "plain words", "license",
             "you can redistribute it and/or modify it under the terms of the GNU General Public License as published", "Creative Commons Attribution-ShareAlike 4.0 International", "submit license", "Kelvin K mitK license"]
    return [(i, rng.choice(" \n;").join(rng.choice(parts) for _ in range(rng.randrange(9)))) for i in range(80)] + [(100, None), (101, ""), (102, "MIT LICENSE " * 3000), (103, "MIT LICENSE " * 3000)]


def test_against_every_rule(spark):
    rows = texts()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels), list(r.labels), r.score) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: brute(t) for i, t in rows[:82]}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert got[102] == got[103] == (6000, 3000, 0, 5998, ["mit"], ["mit"], 0.7)


def test_rules_are_sound():
    scan = licences.rules()
    assert len(scan) > 250
    for r in scan:
        plain = re.sub(r"\(\?:[^()]*\)\?", "", r.pattern)
        assert r.keyword in r.pattern or any(r.keyword in x for x in plain.split()), r
        assert re.compile(r.pattern) and licences._gate(r)


def test_awkward_rows(spark, awkward, no_rows):
    got = licences.scan(awkward.withColumn("labels", awkward.lang))
    assert got.columns[:5] == awkward.columns[:5] and got.count() == awkward.count()
    assert licences.scan(no_rows).count() == 0


def test_copies_and_empty_texts(spark):
    """Copies of a text and texts without any licence, nine tenths of the rows each, keep their rows and labels."""
    for hot in ("released under the mit license", None, ""):
        docs = spark.createDataFrame([(i, hot if i % 10 else "apache license version 2.0") for i in range(2000)], "doc_id long, text string").repartition(7)
        got = licences.scan(docs).groupBy("base_labels").count().collect()
        assert {tuple(r.base_labels): r["count"] for r in got} == {("apache",): 200, ("mit",) if hot else (): 1800}
