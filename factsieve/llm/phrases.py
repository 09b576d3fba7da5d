"""Phrase collocations from mergeable Misra-Gries summaries.

Phrases of 1 to ``longest`` words are counted length by length; a longer one is looked at only if both its parts one
word shorter have survived, which every frequent phrase's parts do. For each length:

1. A scan turns texts into blocks: about a million distinct keys (64-bit hashes with the language in them) with
   their counts, cut to 40 bits below those of their partition (keys made equal so only add to counts), split by ranges of the key into hash partitions, a row for each.
2. The mass of each partition, the sum of its counts, is joined to its rows. The partition's task merges them, one at
   a time, into a Misra-Gries summary of ``2 * mass / threshold`` counters. What it has taken off all counters is then
   below half the threshold, so every key of ``threshold`` occurrences is left, and few others are.
3. What survives becomes a Bloom filter of a fixed size, which the next scans test. A full filter would only let
   more through.

The last scan counts exactly: occurrences of phrases that pass all filters, by language and words, combined in the task
before the shuffle. Scores are exact decimals. Partitions are named by hash and rows are summed in their block, so a
frequent phrase is one counter a block wherever it occurs. The number of partitions follows the bytes of text.

Two phrases in one task whose 64-bit keys are equal would be counted as one; no other step trusts the hash.

Defined results: null reads as empty, a null language as ``und``; texts without words add nothing; repeated rows count
again; other columns are ignored. A piece of text without any of ``.,;:!?`` or line breaks is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factsieve.llm.common import ASCII_LOWER, col, in_filter, key_filter, slices, stage, text_bytes, word_edges, word_hashes

THRESHOLD, LONGEST, TOP = 10, 3, 2000
#: Bytes of text hashed at a time, bytes of text for each hash partition, bits of a filter, parts that a hot join key is dealt to.
BLOCK, PARTITION, FILTER_BITS, SALTS = 2 << 20, 16 << 20, 1 << 26, 8
#: Keys gathered from blocks before they are passed on, and phrases counted in a task before that.
GATHERED, HELD = 1 << 20, 200_000
BREAKS = np.zeros(256, np.int32)
BREAKS[[*b".,;:!?\n\x0b\x0c\r"]] = 1
WORD = 1 - BREAKS.astype(np.uint8)
WORD[[*b" \t"]] = 0
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters, each short of the truth by ``removed`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.removed = max(1, capacity), 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 1 << 16):
            self.settle()

    def merge(self, other: Summary) -> None:
        other.settle()
        self.add(other.keys, other.counts)
        self.removed += other.removed
        self.settle()

    def settle(self) -> None:
        """Sums equal keys; beyond the capacity takes the largest count that has no room off every counter."""
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c.astype(np.int64) for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            place = len(counts) - self.capacity - 1
            least = int(np.partition(counts, place)[place])
            kept = counts > least
            keys, counts, self.removed = keys[kept], counts[kept] - least, self.removed + least
        self.keys, self.counts = keys, counts

    def frequent(self, threshold: int) -> np.ndarray:
        """Keys that may have ``threshold`` occurrences; none that has is missing."""
        self.settle()
        return self.keys[self.counts + self.removed >= threshold]


class Words:
    """The words of some texts, lower-cased, with their language and the piece each stands in."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        self.data = b"\n".join(texts).translate(ASCII_LOWER)
        view = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = word_edges(view, WORD)
        self.piece = np.cumsum(BREAKS[view], dtype=np.int32)[self.starts] if len(self.starts) else np.zeros(0, np.int32)
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.searchsorted(firsts, self.starts, "right") - 1
        self.hashes = word_hashes(view, self.starts, self.ends)
        self.langs = langs[self.text] if len(self.starts) else np.zeros(0, np.uint64)

    def levels(self, filters: list[np.ndarray], longest: int, dropped: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length its first words and keys, of phrases whose parts pass ``filters``; those with a filter pass it."""
        n = len(self.starts)
        at, keys = np.arange(n), _pair(self.langs, self.hashes)
        for length in range(1, longest + 1):
            if length > 1:
                alive = np.zeros(n + 1, bool)
                alive[at] = True
                near = alive[at + 1]
                near[near] = self.piece[at[near] + length - 1] == self.piece[at[near]]
                at = at[near]
                keys = _pair(keys[near], self.hashes[at + length - 1])
            if length <= len(filters):
                good = in_filter(_name(keys, dropped), filters[length - 1])
                at, keys = at[good], keys[good]
            yield at, keys

    def phrase(self, first: int, length: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[first : first + length].tolist(), self.ends[first : first + length].tolist(), strict=True))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _A + (b ^ (b >> np.uint64(29))) * _B
    out ^= out >> np.uint64(32)
    out *= _A
    return out ^ (out >> np.uint64(28))


#: Bits of a key that a block keeps below those that name its partition.
KEPT_BITS = 40


def _dropped(parts: int) -> int:
    """Low bits of keys that are not kept; ``parts`` is a power of two. Keys made equal only raise counts of the first pass."""
    return max(0, 64 - KEPT_BITS - (parts.bit_length() - 1))


def _name(keys: np.ndarray, dropped: int) -> np.ndarray:
    """What a filter knows a key by."""
    out = (keys >> np.uint64(dropped)) * _A
    out ^= out >> np.uint64(32)
    return out * _B


def _packed(keys: np.ndarray, dropped: int) -> bytes:
    """The kept bits of keys of one partition, five bytes each."""
    return (keys >> np.uint64(dropped)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8].tobytes()


def _unpacked(data: memoryview, part: int) -> np.ndarray:
    """Keys without their dropped bits."""
    kept = np.frombuffer(data, np.uint8).reshape(-1, KEPT_BITS // 8)
    wide = np.zeros((len(kept), 8), np.uint8)
    wide[:, : KEPT_BITS // 8] = kept
    return wide.view("<u8").reshape(-1) | np.uint64(part << KEPT_BITS)


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at a break between pieces."""
    at = 0
    while len(text) - at > BLOCK:
        stop = max(text.rfind(bytes([b]), at, at + BLOCK) for b in b".,;:!?\n\x0b\x0c\r") + 1
        if stop <= at:
            found = [i for b in b".,;:!?\n\x0b\x0c\r" if (i := text.find(bytes([b]), at + BLOCK)) >= 0]
            stop = min(found) + 1 if found else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list]]:
    """Words of about ``BLOCK`` bytes of text at a time, with the language of each text; columns: language, its hash, text."""
    texts: list[bytes] = []
    names: list[str] = []
    hashes: list[np.ndarray] = []
    size = 0
    for batch in slices(batches, 500):
        langs, keys = batch.column(0).to_pylist(), np.asarray(batch.column(1)).view(np.uint64)
        for lang, key, text in zip(langs, keys, text_bytes(batch.column(2)), strict=True):
            for part in _cut(text):
                if texts and size + len(part) > BLOCK:
                    yield Words(texts, np.array(hashes, np.uint64)), names
                    texts, names, hashes, size = [], [], [], 0
                texts.append(part)
                names.append(lang)
                hashes.append(key)
                size += len(part)
    if texts:
        yield Words(texts, np.array(hashes, np.uint64)), names


def _blocks(texts: DataFrame, filters: list, parts: int) -> DataFrame:
    """``p, mass, keys, counts``: the distinct keys of the length after the filters' in each block, by hash partition."""
    dropped = _dropped(parts)

    def rows_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        own = Summary(1 << 62)  # with room for all, so exact
        for keys, counts in found:
            own.add(keys, counts)
        own.settle()
        keys, counts = own.keys, own.counts
        edges = np.searchsorted(keys >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64) * np.uint64(1 << 32) // np.uint64(parts))
        rows = [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([
            pa.array([p for p, _, _ in rows], pa.int32()), pa.array([int(counts[a:b].sum()) for _, a, b in rows], pa.int64()),
            pa.array([_packed(keys[a:b], dropped) for _, a, b in rows], pa.binary()), pa.array([counts[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary()),
        ], names=["p", "mass", "keys", "counts"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for words, _ in _word_blocks(batches):
            for _, found in words.levels(known, len(known) + 1, dropped):  # noqa: B007 the last level is the one to count
                pass
            gathered.append(np.unique(found >> np.uint64(dropped) << np.uint64(dropped), return_counts=True))
            size += len(gathered[-1][0])
            if size >= GATHERED:
                yield rows_of(gathered)
                gathered, size = [], 0
        if gathered:
            yield rows_of(gathered)

    return texts.mapInArrow(step, "p int, mass long, keys binary, counts binary")


def _survivors(blocks: DataFrame, threshold: int) -> DataFrame:
    """``key``: of every hash partition the names of the keys its summary cannot rule out."""
    blocks = stage(blocks, "phrase-blocks")
    masses = blocks.groupBy("p").agg(F.sum("mass").alias("total"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = None
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for part, total, keys, counts in zip(at["p"].to_pylist(), at["total"].to_pylist(), at["keys"], at["counts"], strict=True):
                summary = summary or Summary(2 * total // threshold + 1)
                summary.add(_unpacked(keys.as_buffer(), part), np.frombuffer(counts.as_buffer(), "<u4"))
        found = _name(summary.frequent(threshold), 0).view(np.int64) if summary else np.zeros(0, np.int64)
        for first in range(0, len(found), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(found[first : first + (1 << 18)])], names=["key"])

    return blocks.join(masses, "p").select("p", "total", "keys", "counts").groupBy("p").applyInArrow(step, "key long")


def _counts(met: dict[object, list]) -> pa.RecordBatch:
    langs, lengths, phrases, counts = zip(*met.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(lengths, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "length", "phrase", "f"])


def _counted(texts: DataFrame, filters: list, dropped: int) -> DataFrame:
    """``lang, length, phrase, f`` of phrases that pass the filters, exactly; length 0 counts all words of the language."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        met: dict[object, list] = {}
        for words, names in _word_blocks(batches):
            per_text = np.bincount(words.text, minlength=len(names)).tolist()
            for lang, n in zip(names, per_text, strict=True):
                met.setdefault(lang, [lang, 0, b"", 0])[3] += n
            for length, (at, keys) in enumerate(words.levels(known, len(known), dropped), 1):
                found, first, own = np.unique(keys, return_index=True, return_counts=True)
                for key, i, n in zip(found.tolist(), at[first].tolist(), own.tolist(), strict=True):
                    row = met.get(key)
                    if row is None:
                        met[key] = [names[words.text[i]], length, words.phrase(i, length), n]
                    else:
                        row[3] += n
            if len(met) >= HELD:
                yield _counts(met)
                met = {}
        if met:
            yield _counts(met)

    found = texts.mapInArrow(step, "lang string, length int, phrase string, f long")
    return found.groupBy("lang", "length", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(documents: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """``lang, length, phrase, f``: every phrase with ``threshold`` occurrences in its language; rows of length 0 count all words."""
    if threshold < 1 or longest < 1:
        raise ValueError("threshold and longest must be positive")
    spark = documents.sparkSession
    name = F.coalesce(col(lang), F.lit("und"))
    texts = documents.select(name.alias("lang"), F.xxhash64(name).alias("key"), F.coalesce(col(text), F.lit("")).alias("body"))
    size = documents.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    parts = min(1 << (max(1, -(-size // PARTITION)) - 1).bit_length(), 1 << 64 - KEPT_BITS)
    filters: list = []
    for _ in range(longest):
        keys = stage(_survivors(_blocks(texts, filters, parts), threshold), "phrase-keys")
        filters.append(spark.sparkContext.broadcast(key_filter(keys, "key", FILTER_BITS)))
    return _counted(texts, filters, _dropped(parts)).where((F.col("f") >= threshold) | (F.col("length") == 0))


def _salted_counts(grams: DataFrame, side: str) -> DataFrame:
    return grams.select(F.col("lang"), F.col("phrase").alias(f"{side}_part"), F.col("f").alias(side), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, top: int | None = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: phrases of two words and more by the cohesion of their loosest cut.

    A phrase goes if a longer candidate that contains it has half of its occurrences or more.
    """
    grams = stage(frequent_phrases(documents, text, lang, threshold, longest), "phrases")
    words = F.split("phrase", " ")
    candidates = grams.where("length > 1").select("lang", "length", "phrase", F.col("f").alias("a"), words.alias("w"), F.pmod(F.hash("phrase"), F.lit(SALTS)).alias("salt"))
    cuts = candidates.select("lang", "length", "phrase", "a", "w", "salt", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cuts = cuts.select("lang", "length", "phrase", "a", "k", "salt", F.expr("array_join(slice(w, 1, k), ' ')").alias("l_part"), F.expr("array_join(slice(w, k + 1, length - k), ' ')").alias("r_part"))
    parts = grams.where(F.col("length").between(1, longest - 1))
    scored = cuts.join(_salted_counts(parts, "l"), ["lang", "l_part", "salt"]).join(_salted_counts(parts, "r"), ["lang", "r_part", "salt"])
    wide = lambda name: f"cast({name} as decimal(19,0))"
    scored = scored.withColumn("score", F.expr(f"(1000000 * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})"))
    loosest = scored.groupBy("lang", "length", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = candidates.where("length > 2").select(
        "lang", "a", "w", "length", F.explode(F.expr("flatten(transform(sequence(2, length - 1), m -> transform(sequence(1, length - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    holders = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = loosest.join(holders, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
    totals = grams.where("length = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = free.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
