import hashlib
import random
import re

import pytest

from factsieve.llm.decontaminate import decontaminate, digest, find_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(13, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            for i in range(len(doc) - size + 1):
                if doc[i : i + size] == w[j : j + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


def cases():
    rng = random.Random(5)
    sea = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(sea) for _ in range(rng.choice((1, 2, 5, 13, 20))))) for k in range(12)] + [(10, None), (11, ""), (3, "Été-là")]
    docs = []
    for k in range(60):
        parts = [rng.choice(sea) for _ in range(rng.randrange(60))]
        if k % 2:
            parts[3:3] = (items[rng.randrange(12)][1]).upper().split()
        docs.append((k, ("- " if k % 3 else " ").join(parts)))
    return docs + [(100, None), (101, ""), (102, "été là été")], items


@pytest.mark.parametrize("block_words", [1, 10**6])
def test_against_every_place(spark, block_words):
    docs, items = cases()
    found = find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in digest(found).collect()}
    assert got == {i: brute(t, items) for i, t in docs}


def test_longest_matches_and_places(spark):
    item = " ".join(f"k{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a b " + item + " c"), (2, " ".join(item.split()[4:18]))], "doc_id long, text string")
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in find_matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: [("7", 0, 2, 20)], 2: [("7", 4, 0, 14)]}


def test_awkward_rows_and_empty_tables(spark, awkward, no_rows):
    items = spark.createDataFrame([(1, "word word word")], "item_id long, text string")
    kept = decontaminate(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1
    assert decontaminate(no_rows, items).count() == 0
    assert decontaminate(awkward, items.limit(0)).count() == awkward.count()
    assert find_matches(awkward, items).where("size(spans) > 0").count() == 1
    clash = awkward.withColumnsRenamed({"n.words": "spans"}).select("*", "n_chars", "spans").select("doc_id", "text", "spans")
    assert find_matches(clash, items).where("size(spans) > 0").count() == 1
