"""Removal of long repeated byte strings by bucket-pointer refinement.

A bucket names the byte strings that agree to a depth. The buckets of all 8-byte strings are their own values; sorting
on the bucket of a position together with the bucket of a later offset refines depth d to 2d, and every refinement
reuses the one before: 8, 16, ... to the last power of two that :func:`depth_of` allows (256 for 400 bytes), then ``length``. Buckets are named by mixing the two names (64 bits), not by
rank, so tasks name them alike without a global sort.

Buckets are refined only where they can hold two positions:

* Of each window of ``length`` bytes the least bucket of half the last depth (128 bytes for 400) is its anchor, a choice by content alone, so equal
  windows have equal anchors at equal offsets. Windows in a row with one anchor are one row of ``ranges``.
* Ranges whose anchor's bucket has one member hold no repeated window: buckets are counted, and a second scan leaves
  most of those ranges out by a Bloom filter of bounded size. Ranges whose whole string (all their windows)
  has a second member hold nothing else. Both are settled by counts, combined before the shuffle.
* What is left (edges of passages) is refined to depth ``length`` window by window, against one range of every
  distinct string of the same anchor bucket.

No group is gathered in a task; hot buckets are counters. Texts travel only if a Bloom filter of bounded size says
that they hold ranges still to be looked at or to be cut.

Defined results: null reads as empty; texts shorter than ``length`` bytes keep every byte; equal texts of at least
``length`` bytes are removed whole, repeated rows included; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.llm.common import col, groups_by_size, in_filter, key_filter, slices, released, stage, text_bytes

LENGTH = 400
#: Windows settled at once at the edges of a passage.
EDGE = 16
#: Bytes named at a time, and bits of the Bloom filter (its size bounds what is sent to every task).
PIECE, FILTER_BITS, CORE_BITS = 1 << 19, 1 << 24, 1 << 26
#: Parts that the copies of a text are dealt to where they meet the spans to be cut.
SALTS = 8
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One name for a pair of bucket names."""
    out = a * _A
    out ^= out >> np.uint64(29)
    out += b * _B
    out ^= out >> np.uint64(32)
    out *= _C
    out ^= out >> np.uint64(30)
    return out


def depth_of(length: int) -> int:
    """The last depth that is refined by doubling: a power of two that the shortest string named, ``length - EDGE + 1`` bytes, holds."""
    if length < 2 * EDGE:
        raise ValueError(f"length must be at least {2 * EDGE}")
    return 1 << (length - EDGE + 1).bit_length() - 1


class Buckets:
    """Names of the strings of 8, 16, ... ``depth_of(length)`` bytes that start at each byte of ``data``; the last two depths are kept."""

    def __init__(self, data: bytes, length: int = LENGTH):
        self.last = depth_of(length)
        self.anchor = self.last // 2
        # the longest string to be named: all windows of one anchor
        self.probes = -(-(2 * length - self.anchor) // self.last)
        self.names = {8: np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,)).copy()} if len(data) > 7 else {8: np.zeros(0, np.uint64)}
        depth = 8
        while depth < self.last:
            last = self.names[depth]
            self.names[2 * depth] = mix(last[:-depth], last[depth:]) if len(last) > depth else last[:0]
            if depth != self.anchor:
                del self.names[depth]
            depth *= 2

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Names of strings of the last depth or longer: the buckets at their start, at later offsets and at their end."""
        n = self.names[self.last]
        last = start + length - self.last
        out = n[start]
        for k in range(1, self.probes - 1):
            out = mix(out, n[np.minimum(start + k * self.last, last)])
        return mix(out, mix(n[last], np.broadcast_to(np.asarray(length, np.uint64), start.shape)))


def anchors(buckets: Buckets, length: int = LENGTH) -> np.ndarray:
    """The anchor of the window at each start: the leftmost position of the least anchor bucket inside it."""
    width = length - buckets.anchor + 1
    names = buckets.names[buckets.anchor]
    n = len(names)
    if n < width:
        return np.zeros(0, np.int64)
    blocks = -(-n // width)
    keys = np.full(blocks * width, np.iinfo(np.uint64).max)
    keys[:n] = (names >> np.uint64(21) << np.uint64(21)) | np.arange(n, dtype=np.uint64)
    grid = keys.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - width + 1
    return (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64((1 << 21) - 1)).astype(np.int64)


def pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Buffers to be named at once with their ``(text, offset in text, offset in buffer)``; long texts come in overlapping parts."""
    for first, last in groups_by_size([len(t) for t in texts], PIECE):
        own = [t for t in range(first, last) if len(texts[t]) >= length]
        if own and last - first == 1 and len(texts[first]) > PIECE:
            for at in range(0, len(texts[first]) - length + 1, PIECE):
                yield texts[first][at : at + PIECE + length - 1], [(first, at, 0)]
        elif own:
            offsets = np.concatenate([[0], np.cumsum([len(texts[t]) for t in own])])
            yield b"".join(texts[t] for t in own), [(t, 0, int(o)) for t, o in zip(own, offsets, strict=False)]


def ranges_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of every range: text index, first and last window start, anchor bucket, bucket of the whole string, anchor offset."""
    out: list[tuple[np.ndarray, ...]] = []
    for data, parts in pieces(texts, length):
        buckets = Buckets(data, length)
        anchor = anchors(buckets, length)
        firsts = np.array([p[2] for p in parts])
        part = np.searchsorted(firsts, np.arange(len(anchor)), "right") - 1
        ends = np.append(firsts[1:], len(data))
        inside = np.arange(len(anchor)) + length <= ends[part]
        change = np.ones(len(anchor) + 1, bool)
        change[1:-1] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])
        edges = np.flatnonzero(change)
        p1, p2 = edges[:-1], edges[1:] - 1
        good = inside[p1]
        p1, p2 = p1[good], p2[good]
        of = part[p1]
        shift = np.array([p[1] - p[2] for p in parts])[of]
        out.append((np.array([p[0] for p in parts])[of], p1 + shift, p2 + shift, buckets.names[buckets.anchor][anchor[p1]], buckets.of(p1, p2 - p1 + length), anchor[p1] - p1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64))


_KEY = ("k", "size")
_RANGE = "k long, size long, p1 long, p2 long, core long, hull long, lead int"


def _keyed(documents: DataFrame, text: Column) -> DataFrame:
    """Adds the key of a text (its hash and size) and the text as bytes."""
    read = F.coalesce(text, F.lit(""))
    return documents.select("*", F.xxhash64(read).alias("k"), F.octet_length(read).cast("long").alias("size"), read.alias("body"))


def _ranges(texts: DataFrame, length: int, cores: Broadcast | None = None) -> DataFrame:
    """Rows of ``_RANGE``; ``lead`` is how far the anchor lies behind the first window's start. With ``cores`` only those whose anchor may pass that filter."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k, size = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            bodies = text_bytes(batch.column(2))
            for first, last in groups_by_size([len(t) for t in bodies], 8 << 20):
                found = ranges_of(bodies[first:last], length)
                if cores is not None:
                    kept = in_filter(found[3], cores.value)
                    found = tuple(x[kept] for x in found)
                of, p1, p2, core, hull, lead = found
                of = of + first
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[of], size[of], p1, p2, core.view(np.int64), hull.view(np.int64), lead.astype(np.int32))], names=["k", "size", "p1", "p2", "core", "hull", "lead"])

    return texts.where(F.col("size") >= length).select("k", "size", "body").mapInArrow(released(step), _RANGE)


def _with_body(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """``documents`` where only texts that may have one of ``keys`` still carry their body."""
    words = key_filter(keys.select("k").distinct(), "k", FILTER_BITS)
    names = documents.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(names.index("body"))
            kept = pc.if_else(pa.array(in_filter(np.asarray(batch.column(names.index("k"))), words)), body, pa.scalar(None, body.type))
            yield pa.RecordBatch.from_arrays([kept if n == "body" else batch.column(i) for i, n in enumerate(names)], names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name == "body") for f in documents.schema])
    return documents.mapInArrow(released(step), schema)


def _chosen(documents: DataFrame, keys: DataFrame, wanted: bool) -> DataFrame:
    """The rows of ``documents`` whose text may have one of ``keys``, or the others."""
    words = key_filter(keys.select("k").distinct(), "k", FILTER_BITS)
    at = documents.columns.index("k")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(np.asarray(batch.column(at)), words) == wanted))

    return documents.mapInArrow(released(step), documents.schema)


def _contexts(texts: DataFrame, active: DataFrame, length: int) -> DataFrame:
    """``c, lead, n, body``: of every active range its name, anchor offset, number of windows and bytes."""
    wanted = active.groupBy(*_KEY).agg(F.collect_list(F.struct("hull", "p1", "p2", "lead")).alias("r"))
    # copies of a text have the same ranges: one of them stands for all
    bodies = _with_body(texts.select(*_KEY, "body"), active).where(F.col("body").isNotNull()).groupBy(*_KEY).agg(F.first("body").alias("body"))
    joined = bodies.join(wanted, list(_KEY)).select("body", "r")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, rows in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["hull"] for r in rows], pa.int64()), pa.array([r["lead"] for r in rows], pa.int32()), pa.array([r["p2"] - r["p1"] + 1 for r in rows], pa.int32()),
                    pa.array([body[r["p1"] : r["p2"] + length] for r in rows], pa.binary()),
                ], names=["c", "lead", "n", "body"])

    return joined.mapInArrow(released(step), "c long, lead int, n int, body binary")


def _parts(contexts: DataFrame, block: int, length: int) -> DataFrame:
    """``c, a, b, core, hull``: the windows of each context in blocks of ``block`` anchor offsets, with their buckets.

    ``core`` names the bytes common to all windows of the block, which every context with one of them has; ``hull``
    the bytes of the windows at hand. ``parts`` of a context restricts it to those window ranges.
    """
    limited = "parts" in contexts.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for first, last in groups_by_size([len(x) for x in rows["body"]], 1 << 18):
                bodies = rows["body"][first:last]
                base = np.concatenate([[0], np.cumsum([len(x) for x in bodies])])
                buckets = Buckets(b"".join(bodies), length)
                a, b, of = [], [], []
                for i in range(first, last):
                    lead = rows["lead"][i]
                    for lo, hi in [(p["a"], p["b"]) for p in rows["parts"][i]] if limited else [(0, rows["n"][i] - 1)]:
                        # window w lies lead - w before the anchor; blocks end where that is a multiple of ``block``
                        ends = [*range(lo + (lead - lo) % block, hi, block), hi]
                        a += [lo, *(e + 1 for e in ends[:-1])]
                        b += ends
                        of += [i - first] * len(ends)
                a, b, of = np.array(a, np.int64), np.array(b, np.int64), np.array(of, np.int64)
                lead = np.array(rows["lead"][first:last], np.int64)[of]
                low = (lead - b) // block * block  # the least offset of the block
                start = lead - low
                core = buckets.of(base[of] + start, np.full(len(of), length - block + 1))
                hull = buckets.of(base[of] + a, b - a + length)
                c = np.array(rows["c"][first:last], np.int64)[of]
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(a), pa.array(b), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))], names=["c", "a", "b", "core", "hull"])

    return contexts.mapInArrow(released(step), "c long, a long, b long, core long, hull long")


def _settle(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(repeated, unsettled)`` parts: strings that two contexts have, and others whose core two contexts have."""
    parts = stage(parts, "parts")
    hulls = parts.groupBy("core", "hull").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count(F.lit(1)).alias("n"))
    hulls = stage(hulls, "part-strings")
    shared = hulls.where("least <> most").select("core", "hull")
    open_cores = hulls.groupBy("core").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1").select("core")
    repeated = parts.join(shared, ["core", "hull"], "left_semi").select("c", "a", "b")
    # one context for every string of a core that has several
    least = hulls.join(open_cores, "core", "left_semi").select("core", "hull", F.col("least").alias("c"))
    unsettled = parts.join(least, ["core", "hull", "c"], "left_semi").select("c", "a", "b")
    return repeated, unsettled


def removed_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``k, size, spans``: the window ranges ``(p1, p2)`` of each text whose windows start somewhere else as well."""
    counted = _ranges(texts, length).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    shared = texts.sparkSession.sparkContext.broadcast(key_filter(stage(counted, "shared"), "core", CORE_BITS))
    # ranges that the filter lets through though their anchor is the only one of its bucket settle as strings of their own
    ranges = stage(_ranges(texts, length, shared), "ranges")
    strings = stage(ranges.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "size", "p1", "p2", "lead")).alias("r")), "strings")
    settled = ranges.join(strings.where("n > 1").select("core", "hull"), ["core", "hull"], "left_semi").select(*_KEY, "p1", "p2")
    several = strings.groupBy("core").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1").select("core")
    active = stage(strings.join(several, "core", "left_semi").select("hull", "n", "r.*"), "active")
    contexts = stage(_contexts(texts, active, length), "contexts")
    repeated, unsettled = _settle(_parts(contexts, EDGE, length))
    wanted = unsettled.groupBy("c").agg(F.collect_list(F.struct("a", "b")).alias("parts"))  # at most as many windows as an anchor has bytes
    windows, _ = _settle(_parts(contexts.join(wanted, "c"), 1, length))
    fine = repeated.unionByName(windows)
    own = active.where("n = 1").join(fine.withColumnRenamed("c", "hull"), "hull").select(*_KEY, (F.col("p1") + F.col("a")).alias("q1"), (F.col("p1") + F.col("b")).alias("p2")).withColumnRenamed("q1", "p1")
    return settled.unionByName(own).distinct().groupBy(*_KEY).agg(F.collect_list(F.struct("p1", "p2")).alias("spans"))


def runs(spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows."""
    out: list[tuple[int, int]] = []
    for p1, p2 in sorted(spans):
        if out and p1 <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], p2 + length))
        else:
            out.append((p1, p2 + length))
    return out


def cut_repeats(documents: DataFrame, text: str = "text", length: int = LENGTH, carry: bool = False) -> DataFrame:
    """``documents`` as struct ``row`` (without its text) with what is left: ``kept`` (bytes; null: all of it), ``left`` (its whole characters), counts and hash.

    Untouched texts travel, as ``left``, only with ``carry``.
    """
    others = F.struct(*[col(c) for c in documents.columns if c != text], col(text).isNull().alias("__null"))
    keyed = _keyed(documents.select(others.alias("row"), col(text).alias("own")), F.col("own")).drop("own")
    spans = stage(removed_spans(keyed.select(*_KEY, "body"), length), "spans")
    whole = keyed.withColumn("sha", F.sha2(F.col("body").cast("binary"), 256))
    touched = _chosen(whole, spans, True) if carry else _with_body(whole, spans)
    # copies of a text are dealt to several tasks, each of which gets its spans
    dealt = touched.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    joined = dealt.join(spans.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), [*_KEY, "salt"], "left").drop("salt")
    names = joined.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = {n: batch.column(i) for i, n in enumerate(names)}
            bodies = text_bytes(at["body"])
            removed, count, kept, left, sha = [], [], [], [], at["sha"].to_pylist()
            for i, spans in enumerate(at["spans"].to_pylist()):
                cut = runs([(s["p1"], s["p2"]) for s in spans or ()], length)
                rest = None
                if cut:
                    edges = [0, *(x for run in cut for x in run), len(bodies[i])]
                    rest = b"".join(bodies[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    sha[i] = hashlib.sha256(rest).hexdigest()
                removed.append(sum(b - a for a, b in cut))
                count.append(len(cut))
                kept.append(rest)
                left.append(rest.decode("utf-8", "ignore") if cut else bodies[i].decode() if carry else None)
            yield pa.RecordBatch.from_arrays([at["row"], at["k"], at["size"], pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(left, pa.string()), pa.array(sha, pa.string())], names=["row", "k", "size", "n_removed", "n_spans", "kept", "left", "sha"])

    schema = joined.select("row", "k", "size", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(None).cast("binary").alias("kept"), F.lit(None).cast("string").alias("left"), "sha").schema
    cut = joined.mapInArrow(released(step), schema)
    if not carry:
        return cut
    # texts that surely have no spans stay where they are
    rest = _chosen(whole, spans, False)
    return cut.unionByName(rest.select("row", "k", "size", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(None).cast("binary").alias("kept"), F.col("body").alias("left"), "sha"))


def digest(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    return cut_repeats(documents.select("doc_id", "text")).select("row.doc_id", F.col("size").alias("n_bytes"), "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated bytes cut out of ``text`` (bytes of a character cut in half go with it), ``n_chars`` renewed.

    Documents of which nothing is left go; untouched ones, empty and null texts included, stay as they are.
    """
    names = documents.columns
    cut = cut_repeats(documents, length=length, carry=True).where("kept is null or octet_length(kept) > 0")
    made = {"text": F.when(~F.col("row.__null"), F.col("left"))}
    if "n_chars" in names:
        made["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast("long"))
    return cut.select(*[made.get(c, F.col("row")[c]).alias(c) for c in names])
