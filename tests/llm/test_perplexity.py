import math
import random
from collections import Counter, defaultdict

import pytest

from factsieve.llm import perplexity as px


def plain_model(texts):
    """Interpolated modified Kneser-Ney probabilities by dictionaries, as a function of (context, character)."""
    counts = {5: Counter()}
    for t in texts:
        s = list("\0" * 4 + t)
        for i in range(4, len(s)):
            counts[5][tuple(s[i - 4 : i + 1])] += 1
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, contexts = {}, {}
    for k in counts:
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        cut[k] = []
        for j in (1, 2, 3):
            ok = n[1] and n[2] and n[j] and n[j + 1]
            v = j - (j + 1) * y * n[j + 1] / n[j] if ok else 0
            cut[k].append(v if 0 < v < j else j * 0.5)
        total, lost = defaultdict(int), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            lost[g[:-1]] += cut[k][min(c, 3) - 1]
        contexts[k] = {c: (total[c], lost[c] / total[c]) for c in total}

    def p(g):
        if not g:
            return 1 / px.SYMBOLS
        k = len(g)
        total, gamma = contexts[k].get(g[:-1], (1, 1.0))
        c = counts[k][g]
        return (max(0, c - cut[k][min(c, 3) - 1]) / total if c else 0.0) + gamma * p(g[1:])

    return p


def plain_score(p, text):
    s = "\0" * 4 + text
    return math.exp(-sum(math.log(p(tuple(s[i - 4 : i + 1]))) for i in range(4, len(s))) / len(text))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    sea = {"en": ["the", "and", "thing", "other", "est"], "fr": ["été", "le", "château", "naïve"]}
    rows = []
    for i in range(90):
        lang = "fr" if i % 3 == 0 else "en"
        text = " ".join(rng.choice(sea[lang]) for _ in range(rng.randrange(1, 30)))
        rows.append((i, lang, text if i % 10 else "Ω#!7 " * 5 + text))
    return rows + [(200, "en", None), (201, "en", ""), (202, "xx", "no trusted text"), (203, None, "no language"), (None, "en", "no id at all")]


def test_against_a_plain_model(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, lang string, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 10 != 0), int(i % 11 == 0)) for i in range(80)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in px.classify(docs, labels, quantile=0.9, least=3).collect()}
    rows = docs.join(labels, "doc_id", "left").selectExpr("doc_id", "lang", "text", "coalesce(quality = 1 and toxic = 0, false) as trusted", "pmod(xxhash64(doc_id, 5), 5) = 0 as held").collect()
    for lang in ("en", "fr"):
        own = [r for r in rows if r.lang == lang]
        p = plain_model([r.text for r in own if r.trusted and not r.held])
        for r in own:
            if r.text:
                assert math.isclose(got[r.doc_id].perplexity, plain_score(p, r.text.lower().replace("Ω", "ω")), rel_tol=1e-4), r
        held = sorted(got[r.doc_id].perplexity for r in own if r.trusted and r.held)
        if len(held) >= 3:
            limit = held[math.ceil(0.9 * len(held)) - 1]
            assert all(math.isclose(got[r.doc_id].threshold, limit) for r in own)
            assert all(got[r.doc_id].kept == (got[r.doc_id].perplexity <= limit) for r in own if r.text)
    assert [got[i].kept for i in (200, 201, 202, 203)] == [False, False, True, True]
    assert [got[i].perplexity for i in (200, 201, 202, 203)] == [None] * 4
    assert len(got) == len(corpus)


def test_awkward_rows(spark, awkward, no_rows):
    labels = spark.createDataFrame([(7, 1, 0), (9, 1, None), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = px.classify(awkward.withColumn("kept", awkward.lang), labels)
    assert got.columns == [c for c in awkward.columns if c != "text"] + ["perplexity", "threshold", "kept"] and got.count() == awkward.count()
    assert px.classify(no_rows, labels).count() == 0
    assert px.classify(awkward, labels.limit(0)).where("perplexity is not null").count() == 0


def test_short_texts_do_not_set_the_limit_of_long_ones(spark):
    """Held back are some few-word texts of other letters; long junk that is far below them in perplexity goes."""
    rng = random.Random(3)
    words = ["the", "and", "thing", "other", "est"]
    good = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(500)]
    odd = [(i, "".join(chr(rng.randrange(97, 123)) for _ in range(4))) for i in range(500, 600)]
    junk = [(i, " ".join("".join(rng.sample(w, len(w))) for w in rng.choices(words, k=60))) for i in range(600, 620)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in good + odd + junk], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in px.classify(docs, labels, per_class=10).collect()}
    limits = {r.doc_id: r.threshold for r in got.values()}
    assert max(got[i].perplexity for i, _ in junk) < min(limits[i] for i, _ in odd)  # one limit for all would keep the junk
    assert not any(got[i].kept for i, _ in junk)
    assert sum(got[i].kept for i, _ in good) >= 485 and sum(got[i].kept for i, _ in odd) >= 90


def test_languages_with_few_trusted_documents_have_limits(spark):
    rng = random.Random(4)
    sea = {"de": ["der", "und", "ein", "schon"], "es": ["el", "cosa", "este"], None: ["the", "and", "thing"], "it": ["una", "cosa"], "fr": ["le", "et"]}
    size = {"de": 40, "es": 6, None: 3, "it": 2, "fr": 1}
    rows, junk = [], {}
    for lang, n in size.items():
        rows += [(len(rows) + i, lang, " ".join(rng.choices(sea[lang], k=50))) for i in range(n)]
        junk[lang] = 1000 + len(junk)
    docs = spark.createDataFrame(rows + [(i, lang, "#7Q!x ~9Z% " * 20) for lang, i in junk.items()] + [(2000, "it", None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    out = px.classify(docs, labels).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(junk) + 1
    assert [got[i].kept for i in junk.values()] == [False] * 4 + [True] and got[junk["fr"]].threshold is None
    assert sum(got[i].kept for i, *_ in rows) >= len(rows) - 1 and not got[2000].kept
