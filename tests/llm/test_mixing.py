import math
from collections import Counter
from fractions import Fraction

import pytest

from factsieve.llm import mixing


def plain_slots(weights, blocks):
    """Earliest deadline first, slot by slot."""
    total, done, out, slot = sum(weights.values()), dict.fromkeys(weights, 0), [], 0
    while left := [k for k in weights if done[k] < blocks[k]]:
        ready = [(-(-(done[k] + 1) * total // weights[k]), k) for k in left if done[k] * total // weights[k] <= slot]
        if ready:
            k = min(ready)[1]
            out.append((slot, k, done[k]))
            done[k] += 1
        slot += 1
    return out


def spark_slots(spark, weights, blocks, chunk):
    return sorted((r.slot, r.source, r.block_no) for r in mixing.slots(spark, weights, blocks, chunk).collect())


@pytest.mark.parametrize("chunk", [7, 64, 5000])
@pytest.mark.parametrize(
    "weights, blocks",
    [
        ({"a": 5, "b": 3, "c": 2}, {"a": 500, "b": 300, "c": 200}),
        ({"a": 3, "b": 2, "c": 7}, {"a": 300, "b": 5, "c": 0}),
        ({f"s{i}": i * i + 1 for i in range(12)} | {"hot": 900, "rare": 1}, dict.fromkeys([f"s{i}" for i in range(12)], 9) | {"hot": 400, "rare": 2}),
        ({"x": 45, "y": 45} | {f"z{i:02}": 1 for i in range(10)}, {"x": 200, "y": 190} | {f"z{i:02}": 4 for i in range(10)}),
        ({"a": 1}, {"a": 40}),
    ],
)
def test_chunks_give_the_schedule_of_one_pass(spark, weights, blocks, chunk):
    """Also where sources are rarer than a chunk is long, run out early, or leave slots empty."""
    assert spark_slots(spark, weights, blocks, chunk) == plain_slots(weights, blocks)


def test_wrong_guesses_are_scheduled_again(spark, monkeypatch):
    weights, blocks = {"a": 5, "b": 3, "c": 2, "d": 1}, {"a": 100, "b": 60, "c": 45, "d": 22}
    guess = mixing._chunks

    def latest(*args):
        rows = guess(*args)  # no begun block is taken as done, whatever the slots that are left
        return rows.withColumn("done", mixing.F.transform("done", lambda j, i: j * 0 + mixing.F.floor(mixing.F.col("begin") * mixing.F.get(mixing.F.array(*[mixing.F.lit(w) for w in (5, 3, 2, 1)]), i) / 11)))

    monkeypatch.setattr(mixing, "_chunks", latest)
    assert spark_slots(spark, weights, blocks, 16) == plain_slots(weights, blocks)


def test_weights_that_no_schedule_can_hold(spark):
    with pytest.raises(ValueError, match="digits"):
        mixing.whole_weights({"a": 1, "b": 1}, {"a": 1e-30, "b": 1.0})
    with pytest.raises(ValueError, match="too small"):
        mixing.slots(spark, {"a": 1, "b": 10**19}, {"a": 5, "b": 5})


def test_every_prefix_keeps_the_weights(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"hot": 0.25, "s0": 0.3, "s1": 0.15, "s2": 0.1, "s3": 0.1, "s4": 0.1}
    got = mixing.interleave(docs, weights=weights, bucket_rows=10).collect()
    assert len(got) == 3000 and len({r.slot for r in got}) == 3000
    order = sorted(got, key=lambda r: (r.slot, r.in_block))
    given = Counter()
    mixed = [r for r in order if r.within_mix]
    assert len(mixed) > 500 and [r.slot for r in mixed] == list(range(len(mixed)))
    share = {r.source: r.share for r in got}
    for k, r in enumerate(mixed, 1):
        given[r.source] += 1
        assert all(abs(given[s] - k * w) < 1 for s, w in share.items())
        assert r.release <= r.slot < r.deadline
    for s in weights:
        assert sorted(r.block_no for r in got if r.source == s) == list(range(sum(x[1] == s for x in rows)))


def test_blocks_by_size_and_awkward_rows(spark, awkward, no_rows):
    got = mixing.interleave(awkward, size="n_chars", block=1000)
    rows = got.collect()
    assert len(rows) == awkward.count() and got.columns[:6] == awkward.columns
    assert {r.source for r in rows} == {"src0", None}
    ahead = 0
    for r in sorted((r for r in rows if r.source == "src0"), key=lambda r: (r.block_no, r.in_block)):
        assert r.block_no == ahead // 1000
        ahead += r.n_chars
    assert mixing.interleave(no_rows).count() == 0
    assert mixing.interleave(awkward, weights={"other": 1.0}).count() == 0
    assert math.isclose(sum({r.source: r.share for r in rows}.values()), 1)


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 0.00001, "b": 0.99999}, {"hot": 0.5} | {f"s{i}": 0.01 for i in range(50)}, {"a": 1, "b": 2, "c": 4}])
def test_long_prefixes_keep_the_target_weights(spark, weights):
    whole = mixing.whole_weights(dict.fromkeys(weights, 1), weights)
    target = {k: Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for k, w in weights.items()}
    given, total = dict.fromkeys(weights, 0), sum(whole.values())
    assert {k: Fraction(w, total) for k, w in whole.items()} == target
    blocks = {k: int(30_000 * w) + 2 for k, w in target.items()}
    for at, (slot, k, j) in enumerate(spark_slots(spark, whole, blocks, mixing.CHUNK)[:30_000], 1):
        assert j == given[k] and slot == at - 1
        given[k] += 1
        assert abs(given[k] - at * target[k]) < 1
        if at % 997 == 0 or at == 30_000:
            assert all(abs(given[x] - at * target[x]) < 1 for x in weights)


def test_columns_named_like_the_results(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "x", "y", "z") for i in range(20)], "doc_id long, source string, slot string, share string, stop string")
    got = mixing.interleave(docs)
    assert got.columns == ["doc_id", "source", "stop", "block_no", "release", "deadline", "slot", "in_block", "share", "within_mix"]
    assert sorted(r.doc_id for r in got.collect()) == list(range(20)) and {r.stop for r in got.collect()} == {"z"}


def test_rows_are_mixed_to_weights_finer_than_a_thousandth(spark):
    docs = spark.range(24_000).selectExpr("id as doc_id", "if(id % 10 = 0, 'b', 'a') as source")
    rows = mixing.interleave(docs, weights={"a": 0.8995, "b": 0.1005}).select("source", "slot", "within_mix", "share").collect()
    assert len({r.slot for r in rows}) == len(rows) == 24_000
    assert {r.source: r.share for r in rows} == {"a": 0.8995, "b": 0.1005}
    mixed = sorted((r for r in rows if r.within_mix), key=lambda r: r.slot)
    assert len(mixed) > 20_000 and [r.slot for r in mixed] == list(range(len(mixed)))
    given = 0
    for k, r in enumerate(mixed, 1):
        given += r.source == "b"
        assert abs(given - Fraction(201, 2000) * k) < 1


def test_default_weights_are_square_roots(spark):
    docs = spark.range(9_010).selectExpr("id as doc_id", "case when id < 9000 then 'a' when id < 9009 then 'b' else 'c' end as source")
    share = {r.source: r.share for r in mixing.interleave(docs).collect()}
    total = math.sqrt(9000) + 3 + 1
    assert all(math.isclose(share[k], w / total, rel_tol=1e-12) for k, w in {"a": math.sqrt(9000), "b": 3, "c": 1}.items())
