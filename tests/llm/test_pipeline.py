"""Each stage against a plain version of what it keeps, on the smallest table."""

import corpus_pipeline
import pytest
from test_decontaminate import brute as contaminated
from test_repeats import brute as cut_repeats
from test_simhash import brute as groups
from test_simhash import plain

from factsieve.llm.common import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), "test")
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def test_stages_in_order(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "mixing sources"]
    assert all(columns == kept[0][0] for columns, _ in kept[1:5])
    sizes = [len(rows) for _, rows in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


def test_language(kept):
    have = {r.doc_id for r in kept[1][1]}
    for r in kept[0][1]:
        if not any(c.isalpha() for c in r.text or ""):
            assert r.doc_id not in have
    assert len(have) > 0.95 * len(kept[0][1])


def test_one_of_each_near_duplicate_group(kept):
    fps = {r.doc_id: plain(r.text) for r in kept[1][1]}
    assert {r.doc_id for r in kept[2][1]} == set(groups(fps).values())


def test_repeated_passages_are_cut(kept):
    want = {r.doc_id: c for r, c in zip(kept[2][1], cut_repeats([(r.text or "").encode() for r in kept[2][1]], corpus_pipeline.PASSAGE), strict=True)}
    got = {r.doc_id: r for r in kept[3][1]}
    assert set(got) == {i for i, (size, removed, *_) in want.items() if size == 0 or removed < size}
    for r in kept[2][1]:
        if r.doc_id in got:
            size, removed, *_ = want[r.doc_id]
            assert got[r.doc_id].text == r.text if not removed else 0 <= size - removed - len(got[r.doc_id].text.encode()) < 8 * want[r.doc_id][2]


def test_contaminated_documents_go(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in kept[4][1]} == {r.doc_id for r in kept[3][1] if not contaminated(r.text, items)[-1]}


def test_all_that_is_left_is_mixed(kept):
    assert {r.doc_id for r in kept[5][1]} == {r.doc_id for r in kept[4][1]}
    slots = [r.slot for r in kept[5][1]]
    assert len(set(slots)) == len(slots) and all(r.release <= r.slot < r.deadline for r in kept[5][1])
