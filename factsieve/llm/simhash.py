"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance ``2r`` or less have a common variant within ``r`` bits of either. Every distinct
fingerprint (copies collapse before anything is emitted) therefore stands for its 2,081 variants of at most two
flipped bits, variants are dealt to buckets, and fingerprints with a common variant are linked.

A bucket is a linear code of the variant: the xor of one short word per set bit. Which flips of a fingerprint fall
into which bucket is then known from the fingerprint's own code, so a fingerprint travels once per bucket, not once per
variant, and the bucket's task makes the variants anew, one slice of finer codes at a time. All variants are made and
compared. Equal variants are chained rather than paired, each chained pair is verified, and a bucket returns a
spanning forest of its links, so large groups stay linear; :mod:`components` joins the forests.

Defined results: a null or wordless text has fingerprint zero and links like any other; a null ``doc_id`` never is a
``component_id`` unless its whole component has none; repeated rows stay (``near_duplicates``) or count as copies
(``keep_one``); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.common import ASCII_LOWER, col, map_batches, released, slices, stage, text_bytes
from factsieve.llm.components import stars

BITS = 64
SEED = 42
#: Variants compared at a time in a task, and distinct fingerprints one bucket may receive.
SLICE, BUCKET_ROWS = 1 << 21, 1 << 26
#: Number of buckets as a power of two; more are taken when ``BUCKET_ROWS`` asks for it.
BUCKET_POWER = 6


def fingerprint(text: bytes, words: int = 4) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    tokens = text.translate(ASCII_LOWER).split()  # at space, tab, line feed, vertical tab, form feed and carriage return
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = min(words, len(tokens))
    total = len(tokens) - n + 1
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    for at in range(0, total, 1 << 15):
        to = min(total, at + (1 << 15))
        s, e = starts[at:to].tolist(), ends[at + n - 1 : to + n - 1].tolist()
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(s, e, strict=True)), np.uint64, to - at)
        votes += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * votes > total, bitorder="little").view("<i8")
    return int(bits[0])


def fingerprints(documents: DataFrame, text: str = "text", name: str = "fp", words: int = 4) -> DataFrame:
    """``documents`` with a bigint column of fingerprints in place of its text."""
    kept = [c for c in documents.columns if c not in (text, name)]
    schema = documents.select(*[col(c) for c in kept], F.lit(None).cast("long").alias(name)).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = pa.array([fingerprint(t, words) for t in text_bytes(batch.column(len(kept)))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], own], names=[*kept, name])

    return map_batches(documents.select(*[col(c) for c in kept], col(text)), step, schema)


def _codes(power: int) -> np.ndarray:
    """The code word of each bit: the high bits of multiples of an odd constant, so sums of two spread evenly."""
    return ((np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(BITS, np.int64)


def _flips(radius: int = 2) -> np.ndarray:
    """Masks of at most ``radius`` (two) set bits."""
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    masks = [np.zeros(1, np.uint64), one]
    if radius > 1:
        i, j = np.triu_indices(BITS, 1)
        masks.append(one[i] | one[j])
    return np.concatenate(masks)


def _code_of(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for bit in range(BITS):
        out ^= np.where((values >> np.uint64(bit)) & np.uint64(1), codes[bit], 0)
    return out


def _forest(n: int, edges: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of ``n`` nodes (pointer jumping on whole arrays)."""
    root = np.arange(n)
    u, v = edges[:, 0], edges[:, 1]
    while len(u):
        a, b = root[u], root[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def bucket_links(values: np.ndarray, bucket: int, power: int, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """``(value, smallest linked value)`` of the fingerprints that share a variant of this bucket with another."""
    values = np.unique(values)
    masks = _flips(radius)
    extra = max(0, math.ceil(math.log2(max(1, len(values) * len(masks) / (1 << power) / SLICE))))
    codes = _codes(power + extra)
    own = _code_of(values, codes)
    by_code = np.argsort(own, kind="stable")
    present, first = np.unique(own[by_code], return_index=True)
    bounds = np.append(first, len(values))
    mask_code = _code_of(masks, codes)
    mask_order = np.argsort(mask_code, kind="stable")
    mask_bounds = np.searchsorted(mask_code[mask_order], np.arange((1 << (power + extra)) + 1))
    links = np.zeros((0, 2), np.int64)
    for fine in range(1 << extra):
        target = (bucket << extra) | fine
        made, who = [], []
        for k, code in enumerate(present.tolist()):
            flips = masks[mask_order[mask_bounds[target ^ code] : mask_bounds[(target ^ code) + 1]]]
            if len(flips):
                rows = by_code[bounds[k] : bounds[k + 1]]
                made.append((values[rows][:, None] ^ flips).reshape(-1))
                who.append(np.repeat(rows, len(flips)))
        if not made:
            continue
        variants, rows = np.concatenate(made), np.concatenate(who)
        order = np.argsort(variants)
        variants, rows = variants[order], rows[order]
        same = np.flatnonzero(variants[1:] == variants[:-1])
        a, b = rows[same], rows[same + 1]
        near = np.bitwise_count(values[a] ^ values[b]) <= 2 * radius
        pairs = np.unique(np.minimum(a, b)[near] * len(values) + np.maximum(a, b)[near])
        links = np.concatenate([links, np.stack([pairs // len(values), pairs % len(values)], 1)])
        if len(links) > SLICE:
            root = _forest(len(values), links)
            node = np.flatnonzero(root != np.arange(len(values)))
            links = np.stack([root[node], node], 1)
    root = _forest(len(values), links)
    node = np.flatnonzero(root != np.arange(len(values)))
    return values[node], values[root[node]]


def ball_links(distinct: DataFrame, name: str = "fp", radius: int = 2) -> DataFrame:
    """``(u, v)``: links that connect the distinct fingerprints at most ``2 * radius`` bits apart."""
    n = distinct.count()
    power = max(BUCKET_POWER, math.ceil(math.log2(max(1, n * 2081 / BUCKET_ROWS))) if n > BUCKET_ROWS else 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(power)
        reach = np.unique(_code_of(_flips(radius), codes))
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            own = _code_of(values, codes)
            order = np.argsort(own, kind="stable")
            values, own = values[order], own[order]
            present, first = np.unique(own, return_index=True)
            parts = dict(zip(present.tolist(), np.split(values, first[1:]), strict=True))
            to: dict[int, list[np.ndarray]] = {}
            for code, part in parts.items():
                for bucket in (reach ^ code).tolist():
                    to.setdefault(bucket, []).append(part)
            yield pa.RecordBatch.from_arrays([pa.array(list(to), pa.int32()), pa.array([np.concatenate(x).tobytes() for x in to.values()], pa.binary())], names=["bucket", "packed"])

    def link(key: tuple, table: pa.Table) -> pa.Table:
        values = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("packed").to_pylist()])
        node, root = bucket_links(values, key[0].as_py(), power, radius)
        return pa.table({"u": pa.array(node.view(np.int64)), "v": pa.array(root.view(np.int64))})

    dealt = distinct.select(col(name).cast("long").alias("fp")).mapInArrow(released(deal), "bucket int, packed binary")
    return dealt.groupBy("bucket").applyInArrow(link, "u long, v long")


def components(rows: DataFrame, order: list[str]) -> DataFrame:
    """``(fp, first)``: each distinct fingerprint of ``rows`` with the least struct of ``order`` in its component."""
    distinct = stage(rows.groupBy("fp").agg(F.min(F.struct(*order)).alias("first")), "fingerprints")
    linked = stars(ball_links(distinct)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "first")


def near_duplicates(documents: DataFrame, words: int = 4) -> DataFrame:
    """Every row's ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` reachable."""
    rows = stage(fingerprints(documents.select("doc_id", "text"), words=words), "simhash")
    least = components(rows.withColumn("none", F.col("doc_id").isNull()), ["none", "doc_id"])
    joined = rows.join(least, "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(documents: DataFrame, words: int = 4) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest ``doc_id`` (nulls last), whole, in its own columns."""
    numbered = stage(documents.select(F.struct(*[col(c) for c in documents.columns]).alias("row"), F.monotonically_increasing_id().alias("n")), "documents")
    keyed = numbered.select("n", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    rows = stage(fingerprints(keyed, words=words), "simhash")
    least = components(rows.withColumn("none", F.col("doc_id").isNull()), ["none", "doc_id", "n"])
    kept = least.select(F.col("first.n").alias("n")).distinct()
    return numbered.join(kept, "n", "left_semi").select(*[F.col("row")[c].alias(c) for c in documents.columns])
