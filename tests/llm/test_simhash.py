import random

import numpy as np
import pytest
import xxhash

from factsieve.llm import simhash
from factsieve.llm.components import stars


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    """The smallest id reachable over links of four bits or fewer."""
    ids = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 4 and ids[b] < ids[a]:
                    ids[a], changed = ids[b], True
    return ids


def texts(n=160):
    rng = random.Random(9)
    sea = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    base = [[rng.choice(sea) for _ in range(rng.choice((1, 3, 4, 60, 300)))] for _ in range(n // 4)]
    out = []
    for k in range(n):
        words = list(base[k % len(base)])
        for _ in range(k // len(base)):
            words[rng.randrange(len(words))] = rng.choice(sea)
        out.append((k, " ".join(words).capitalize() if k % 5 else "\n".join(words)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \x0b"), (n + 3, "É é\x0cß")]


def test_against_all_pairs(spark):
    rows = texts()
    fps = {i: plain(t) for i, t in rows}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("power", [0, 3, 6, 12])
def test_buckets_find_every_link(power):
    rng = random.Random(power)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 8)):
                v ^= 1 << b
            values.add(v)
    fps = dict(enumerate(sorted(values)))
    array = np.array(list(fps.values()), np.uint64)
    label = {v: v for v in fps.values()}
    links = [(int(a), int(b)) for bucket in range(1 << power) for a, b in zip(*simhash.bucket_links(array, bucket, power), strict=True)]
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: label[v] for k, v in fps.items()} == {k: fps[i] for k, i in brute(fps).items()}
    assert all(bin(a ^ b).count("1") for a, b in links)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 14)] + [(100, 101), (7, 7)], "u long, v long")
    assert {(r.u, r.v) for r in stars(edges).collect()} == {(i, 0) for i in range(1, 15)} | {(101, 100)}


def test_one_of_each_group_stays(spark, awkward, no_rows):
    got = simhash.keep_one(awkward)
    assert got.columns == awkward.columns
    kept = got.collect()
    want = brute({k: plain(r.text) for k, r in enumerate(awkward.collect())})
    assert len(kept) == len(set(want.values()))
    assert sum(r.doc_id == 0 for r in kept) == 1 and simhash.keep_one(no_rows).count() == 0
    assert simhash.near_duplicates(no_rows).count() == 0
    assert simhash.fingerprints(awkward).columns == [c for c in awkward.columns if c != "text"] + ["fp"]
    nulls = [r for r in simhash.near_duplicates(awkward).collect() if r.doc_id is None]
    assert {r.component_id for r in nulls} == {None, 0}
