import random
import re
from collections import Counter

import numpy as np
import pytest

from factsieve.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, threshold=10, longest=3, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[(lang or "und", *w[i : i + k])] += 1
    found = {g: a for g, a in counts.items() if len(g) > 2 and a >= threshold}
    out = {}
    for g, a in found.items():
        lang, w = g[0], g[1:]
        if any(100 * b >= 50 * a for h, b in found.items() if h[0] == lang and len(h) > len(g) and any(h[i : i + len(w)] == w for i in range(1, len(h) - len(w) + 1))):
            continue
        cut = min((1000000 * a * a // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), counts[(lang, *w[: cut[1]])], counts[(lang, *w[cut[1] :])]))
    return {(lang, i, p.decode(), -a, l, r, totals[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)}


def texts(seed, n=150):
    rng = random.Random(seed)
    sea = ["New", "york", "city", "état", "of", "the", "art", "x", "y", "數"]
    odd = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(sea), rng.choice(odd), "new york city", "state  of\tthe art", "ha ha ha ha"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.choice((0, 5, 60)))]
        out.append(("".join(parts), rng.choice(["en", "en", "fr", None])))
    return [*out, (None, "en"), ("", None), ("a b " * 2000, "de"), ("new york city " * 50, "en"), ("new york city " * 50, "en")]


@pytest.mark.parametrize("seed, top", [(1, 2000), (2, 5)])
def test_against_plain_counts(spark, monkeypatch, seed, top):
    monkeypatch.setattr(phrases, "BLOCK", 3000)
    monkeypatch.setattr(phrases, "PARTITION", 2000)
    monkeypatch.setattr(phrases, "GATHERED", 900)
    monkeypatch.setattr(phrases, "HELD", 100)
    rows = texts(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = {tuple(r) for r in phrases.collocations(docs, top=top).collect()}
    want = brute(rows, top=top)
    assert got == want and len(want) > 5


def test_longer_phrases_and_other_thresholds(spark):
    rows = texts(5)
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {tuple(r) for r in phrases.collocations(docs, threshold=4, longest=5, top=None).collect()}
    assert got == brute(rows, 4, 5, 1 << 60)


def test_summaries_lose_no_frequent_key():
    rng = np.random.default_rng(4)
    for capacity in (20, 60, 500):
        stream = rng.zipf(1.3, 6000).astype(np.uint64) % np.uint64(3000)
        halves = []
        for half in (stream[:2500], stream[2500:]):
            own = phrases.Summary(capacity)
            for part in np.array_split(half, 7):
                own.add(*np.unique(part, return_counts=True))
                own.settle()
            halves.append(own)
        halves[0].merge(halves[1])
        both = halves[0]
        keys, counts = np.unique(stream, return_counts=True)
        assert len(both.keys) <= capacity and both.removed * (capacity + 1) <= len(stream)
        for threshold in (both.removed + 1, both.removed + 30):
            assert set(keys[counts >= threshold].tolist()) <= set(both.frequent(threshold).tolist())
        have = dict(zip(both.keys.tolist(), both.counts.tolist(), strict=True))
        assert all(0 <= n - have.get(k, 0) <= both.removed for k, n in zip(keys.tolist(), counts.tolist(), strict=True))


def test_hot_text_and_awkward_rows(spark, awkward, no_rows):
    assert phrases.collocations(no_rows).count() == 0
    clash = awkward.selectExpr("*", "'x' as phrase", "'y' as a", "'z' as score", "'q' as `rank`")
    rows = [(r.text, r.lang) for r in awkward.collect()]
    assert {tuple(r) for r in phrases.collocations(clash).collect()} == brute(rows)
    hot = [("good day to you", "en")] * 3000 + [("", "en")] * 300 + [("to you", "en")] * 20
    assert {tuple(r) for r in phrases.collocations(spark.createDataFrame(hot, "text string, lang string")).collect()} == brute(hot)
