import itertools
import zlib

import numpy as np
import pytest

from factsieve.llm import common, langid

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"))


def every_segmentation(word, pieces, probability):
    """The probability of a word by enumerating all cuts."""
    total = np.zeros(probability.shape[1])
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        p = np.ones(probability.shape[1])
        for a, b in zip(edges, edges[1:]):
            part = word[a:b]
            p = p * (probability[pieces[part]] if part in pieces else langid.STRAY if b - a == 1 else 0)
        total += p
    return np.log(total)


def test_forward_sums_all_segmentations(model):
    hashes = langid.piece_hashes(langid.read_pieces())
    at = {p: int(np.searchsorted(model.hashes, h)) for p, h in zip(langid.read_pieces(), hashes, strict=True)}
    assert len(at) == len(model.hashes) and all(model.hashes[i] == h for i, h in zip(at.values(), hashes, strict=True))
    words = ["▁the", "▁schöne", "▁ñandú", "▁x", "ça", "▁日本語", "▁eauonpa"]
    want = np.array([every_segmentation(w, at, model.probability) for w in words])
    assert np.allclose(langid.score_words(words, model), want, rtol=1e-4)


def test_expected_counts_add_up():
    pieces = ["▁", "a", "b", "ab", "▁a"]
    hashes = np.sort(langid.piece_hashes(pieces))
    at = {p: int(np.searchsorted(hashes, h)) for p, h in zip(pieces, langid.piece_hashes(pieces), strict=True)}
    p = np.zeros(5)
    for x, v in zip(pieces, (0.2, 0.3, 0.1, 0.25, 0.15), strict=True):
        p[at[x]] = v
    got = langid.expected_counts(["▁ab", "ab"], np.array([2.0, 3.0]), hashes, 2, p)
    ways = {("▁", "a", "b"): 0.2 * 0.3 * 0.1, ("▁", "ab"): 0.2 * 0.25, ("▁a", "b"): 0.15 * 0.1}
    short = {("a", "b"): 0.03, ("ab",): 0.25}
    want = np.zeros(5)
    for table, n in ((ways, 2), (short, 3)):
        for seq, w in table.items():
            for x in seq:
                want[at[x]] += n * w / sum(table.values())
    assert np.allclose(got, want)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.predict(docs, model).select("*", langid.is_held_out().alias("held_out")).collect()
    assert {r.doc_id: r.held_out for r in rows} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    held = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark, model, awkward, no_rows):
    got = langid.predict(awkward, model)
    assert got.columns == [*awkward.columns, "lang_pred", "score"]
    by = {r.doc_id: r for r in got.collect()}
    assert [by[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and by[0].score == 0
    assert by[5].lang_pred != "und" and by[8].score > 0
    assert langid.predict(no_rows, model).count() == 0
    kept = langid.keep_identified(awkward, model, least=0.0)
    assert kept.columns == awkward.columns and kept.where("text is null").count() == 0
    empty = langid.train(no_rows)
    assert {(r.lang_pred, r.score) for r in langid.predict(awkward, empty).collect()} == {("und", 0.0)}


def test_a_step_gives_its_memory_back(monkeypatch):
    trimmed = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": staticmethod(trimmed.append)}))
    assert list(common.released(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and trimmed == [0]
