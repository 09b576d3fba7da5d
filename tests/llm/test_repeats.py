import hashlib
import random

import numpy as np
import pytest

from factsieve.llm import repeats


def brute(texts, length=400):
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        hit = np.cumsum(cover)[:-1] > 0
        edges = np.diff(np.concatenate([[0], hit.astype(int), [0]]))
        kept = np.frombuffer(t, np.uint8)[~hit].tobytes()
        out.append((len(t), int(hit.sum()), int((edges > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    sea = ["ab", "c", "déf", "ghi ", "\n", "jk", "über", "q"]
    make = lambda n: "".join(rng.choice(sea) for _ in range(n))
    passages = [make(n) for n in (150, 200, 260, 400, 900)]
    out = []
    for k in range(40):
        parts = [make(rng.choice((0, 1, 30, 300)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 12)
            parts += [p[a : len(p) - rng.randrange(0, 40)], make(rng.choice((0, 2, 120)))]
        out.append("".join(parts))
    edited = list(out[5] * 3)
    edited[700:701] = "Z"
    return out + ["".join(edited), out[7] + out[7], "ab" * 900, "ab" * 450 + "x", "word " * 300, out[9], out[9], "", "short"]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_substring(spark, seed):
    rows = list(enumerate(texts(seed))) + [(900, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = dict(zip([i for i, _ in rows], brute([(t or "").encode() for _, t in rows]), strict=True))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert sum(w[1] > 0 for w in want.values()) > 20


@pytest.mark.parametrize("length", [32, 60, 143, 200, 270, 528, 900])
def test_other_lengths(spark, length):
    rows = list(enumerate(texts(length)))
    cut = repeats.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length)
    got = {r.doc_id: (r.size, r.n_removed, r.n_spans, r.sha) for r in cut.select("row.doc_id", "size", "n_removed", "n_spans", "sha").collect()}
    want = dict(zip([i for i, _ in rows], brute([t.encode() for _, t in rows], length), strict=True))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_long_texts_are_named_in_parts(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.randrange(97, 123) for _ in range(9000))
    whole = repeats.ranges_of([text])
    monkeypatch.setattr(repeats, "PIECE", 2000)
    windows = lambda r: {(int(p), int(c), int(p + o - q)) for q, e, c, o in zip(r[1], r[2], r[3], r[5], strict=True) for p in range(q, e + 1)}
    assert {w[:2] for w in windows(whole)} == {w[:2] for w in windows(repeats.ranges_of([text]))}


def test_cut_documents_keep_their_columns(spark, awkward, no_rows):
    rows = awkward.collect()
    got = repeats.remove_repeats(awkward)
    assert got.columns == awkward.columns
    kept = {r.doc_id: r for r in got.collect()}
    assert set(kept) == {r.doc_id for r in rows} - {8, 9}
    assert kept[5].text == rows[5].text and kept[1].text is None
    assert repeats.remove_repeats(no_rows).count() == 0 and repeats.digest(no_rows).count() == 0
