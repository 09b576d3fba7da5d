"""Benchmark decontamination with suffix arrays over the training text.

Every Arrow batch of documents is a shard. Its words become ids of the benchmark's vocabulary (0: a word no item
has), and the suffixes that begin with a benchmark bigram are sorted into the shard's suffix array; a suffix that
begins otherwise cannot match any test suffix, so leaving it out loses nothing. Every suffix of every item is then
binary-searched in the shard, the interval of equal windows gives the places, and each place is extended to its
longest verbatim match. Matched words are compared as bytes, so hash collisions cannot count.

The benchmark is streamed past the driver in blocks of some ``block_words`` words, one at a time. A block is a constant
of one Arrow step over the documents, without any shuffle. A benchmark of one block is matched in one lazy scan. For a
larger one the documents are written once with a number each; every block's scan of them writes the few rows it matches to
the shared folder before the next block is read, and those rows, summed up by document, are joined to all.

Defined results: null and empty texts have no words and no matches; repeated rows are judged one by one; columns of
the documents that share a name with an output are replaced by it; an empty benchmark matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.llm.common import ALNUM, ASCII_LOWER, col, groups_by_size, map_batches, stage, text_bytes, word_edges, word_hashes

#: Columns that ``find_matches`` adds.
ADDED = ("n_words", "spans", "matches")
#: Spans of hit words (end exclusive) and longest matches, both by word positions from 0.
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType()),
]))
_ARROW = {
    "n_words": pa.int64(),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    "matches": pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])),
}


def words_of(text: bytes) -> list[bytes]:
    """The words of one text: A-Z lower-cased, split at ASCII characters other than letters and digits."""
    low = text.translate(ASCII_LOWER)
    starts, ends = word_edges(np.frombuffer(low, np.uint8), ALNUM)
    return [low[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class Block:
    """Test suffixes of some items as sorted search keys of vocabulary ids."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        flat = [w for words in self.words for w in words]
        joined = b" ".join(flat)
        data = np.frombuffer(joined, np.uint8)
        starts, ends = word_edges(data, ALNUM)
        hashes = word_hashes(data, starts, ends)
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        codes = (codes + 1).astype(np.uint32)
        self.codes = np.concatenate([codes, np.zeros(window, np.uint32)]) if len(codes) else np.zeros(window, np.uint32)
        lengths = np.array([len(w) for w in self.words], np.int64)
        firsts = np.concatenate([[0], np.cumsum(lengths)])
        item, start, size = [], [], []
        for k, n in enumerate(lengths.tolist()):
            if n:
                last = max(1, n - window + 1)
                item += [k] * last
                start += range(last)
                size += [min(n, window)] * last
        self.item, self.start, self.size = (np.array(x, np.int64) for x in (item, start, size))
        at = firsts[self.item] + self.start if len(self.item) else np.zeros(0, np.int64)
        depth = np.arange(window)
        keys = self.codes[at[:, None] + depth]
        keys[depth >= self.size[:, None]] = 0
        # equal windows of several items are searched once; ``owners`` lists the (item, start) pairs of each
        packed, group = np.unique(np.concatenate([keys, self.size[:, None].astype(np.uint32)], 1), axis=0, return_inverse=True)
        group = group.reshape(-1)
        self.keys, self.sizes = packed[:, :-1], packed[:, -1].astype(np.int64)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(len(packed) + 1))
        self.owners = [order[bounds[g] : bounds[g + 1]] for g in range(len(packed))]
        upper = self.keys.copy()
        if len(upper):
            upper[np.arange(len(upper)), self.sizes - 1] += 1
        self.low, self.high = _sortable(self.keys), _sortable(upper)
        self.singles = np.unique(self.keys[self.sizes == 1, 0]) if len(packed) else np.zeros(0, np.uint32)
        pairs = self.keys[self.sizes > 1]
        self.pairs = np.unique(pairs[:, 0].astype(np.uint64) << np.uint64(32) | pairs[:, 1].astype(np.uint64))
        self.shortest = int(self.sizes.min()) if len(packed) else 0


def _sortable(keys: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort like the rows."""
    return np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * keys.shape[1]}").reshape(-1) if len(keys) else np.zeros(0, f"S{4 * keys.shape[1]}")


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table has."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def search_shard(texts: list[bytes], block: Block) -> tuple[list[int], list[list], list[list]]:
    """Word counts, spans of hit words and longest matches of each text of one shard."""
    low = b"\n".join(texts).translate(ASCII_LOWER)
    data = np.frombuffer(low, np.uint8)
    starts, ends = word_edges(data, ALNUM)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    firsts = np.searchsorted(starts, offsets)
    counts = np.diff(firsts).tolist()
    spans: list[list] = [[] for _ in texts]
    matches: list[list] = [[] for _ in texts]
    if not block.shortest or not len(starts):
        return counts, spans, matches
    hashes = word_hashes(data, starts, ends)
    at = np.searchsorted(block.vocabulary, hashes)
    at[at == len(block.vocabulary)] = 0
    ids = np.where(block.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)
    # runs of known words within one text
    known = np.flatnonzero(ids)
    if not len(known):
        return counts, spans, matches
    breaks = np.concatenate([np.flatnonzero(ids == 0), firsts])
    breaks.sort()
    until = breaks[np.searchsorted(breaks, known, "right")]
    fits = until - known >= block.shortest
    known, until = known[fits], until[fits]
    follow = np.where(known + 1 < until, ids[np.minimum(known + 1, len(ids) - 1)], 0).astype(np.uint64)
    begins = _member(ids[known].astype(np.uint64) << np.uint64(32) | follow, block.pairs) | _member(ids[known], block.singles)
    known, until = known[begins], until[begins]
    if not len(known):
        return counts, spans, matches
    depth = np.arange(block.window)
    reach = known[:, None] + depth
    keys = ids[np.minimum(reach, len(ids) - 1)]
    keys[reach >= until[:, None]] = 0
    suffixes = _sortable(keys)
    order = np.argsort(suffixes, kind="stable")
    suffixes, known = suffixes[order], known[order]
    left, right = np.searchsorted(suffixes, block.low), np.searchsorted(suffixes, block.high)
    words = lambda i, n: [low[starts[k] : ends[k]] for k in range(i, i + n)]
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for g in np.flatnonzero(right > left).tolist():
        size = int(block.sizes[g])
        owner = [(int(block.item[o]), int(block.start[o])) for o in block.owners[g]]
        wanted = block.words[owner[0][0]][owner[0][1] : owner[0][1] + size]
        for i in known[left[g] : right[g]].tolist():
            if words(i, size) == wanted:
                doc = int(np.searchsorted(firsts, i, "right")) - 1
                found.setdefault(doc, []).extend((item, start, i - int(firsts[doc]), size) for item, start in owner)
    for doc, places in found.items():
        spans[doc] = merged((p[2], p[2] + p[3]) for p in places)
        matches[doc] = _longest(places, block.ids)
    return counts, spans, matches


def merged(intervals: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _longest(places: list[tuple[int, int, int, int]], ids: list[str]) -> list[tuple]:
    """Windows of one item on one diagonal that follow each other word by word are one longer match."""
    out: list[list[int]] = []
    for item, start, at, size in sorted(set(places), key=lambda p: (p[0], p[2] - p[1], p[1])):
        last = out[-1] if out else None
        if last and last[0] == item and last[2] - last[1] == at - start and start <= last[1] + last[3] - size + 1:
            last[3] = start + size - last[1]
        else:
            out.append([item, start, at, size])
    return [(ids[item], start, at, size) for item, start, at, size in out]


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item: str = "item_id", block_words: int = 2_000_000) -> DataFrame:
    """``documents`` with ``n_words``, merged ``spans`` of hit words and ``matches``: the longest verbatim matches with their places.

    A match is at least ``window`` words long, or a whole item of fewer. ``block_words`` bounds what of the benchmark
    is in memory at a time, on the driver (besides one partition of it) and in a task.
    """
    names = [c for c in documents.columns if c not in ADDED]
    numbered, parts = None, []
    for rows, last in _item_blocks(benchmark.select(col(item).cast("string").alias("i"), F.coalesce(col("text"), F.lit("")).alias("t")), block_words):
        if last and not parts:
            return _through(documents.select(*[col(c) for c in names], *_nothing()), rows, window, text)
        if numbered is None:
            numbered = stage(documents.select(F.struct(*[col(c) for c in names]).alias("row"), col(text).alias("body"), F.monotonically_increasing_id().alias("n")), "numbered")
        found = _through(numbered.select("n", "body", *_nothing()), rows, window, "body")
        parts.append(stage(found.where(F.size("matches") > 0).select("n", "spans", "matches"), "matches"))
    met = reduce(DataFrame.unionByName, parts).groupBy("n").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("matches")).alias("m"))
    met = met.select("n", _union(F.array_sort("s")).alias("s"), "m")
    counted = _through(numbered.select("row", "body", "n", *_nothing()), [], window, "body")
    return counted.join(met, "n", "left").select(*[F.col("row")[c].alias(c) for c in names], "n_words", F.coalesce("s", "spans").alias("spans"), F.coalesce("m", "matches").alias("matches"))


def _nothing() -> list[Column]:
    """The columns that a step fills."""
    return [F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast(MATCHES).alias("matches")]


def _item_blocks(items: DataFrame, block_words: int) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The items in blocks of ``block_words`` words and an item at most, read as they are asked for; the flag marks the last."""
    rows, size = [], 0
    for r in items.toLocalIterator():
        if size >= block_words:
            yield rows, False
            rows, size = [], 0
        rows.append((r.i, r.t.encode("utf-8", "surrogatepass")))
        size += len(r.t) // 2 + 1
    yield rows, True


def _union(spans: Column) -> Column:
    """Sorted half-open spans, those that touch as one."""

    def add(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        meets = (F.size(out) > 0) & (s["start"] <= F.try_element_at(out, F.lit(-1))["end"])
        return F.when(meets, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(wider))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"), add)


def _through(frame: DataFrame, rows: list[tuple[str, bytes]], window: int, text: str) -> DataFrame:
    names = frame.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(rows, window)
        for batch in batches:
            texts = text_bytes(batch.column(names.index(text)))
            counts: list[int] = []
            spans: list[list] = []
            matches: list[list] = []
            for first, last in groups_by_size([len(t) for t in texts], 4 << 20):
                c, s, m = search_shard(texts[first:last], block)
                counts += c
                spans += s
                matches += m
            made = {"n_words": counts, "spans": [[dict(zip(("start", "end"), x, strict=True)) for x in s] for s in spans], "matches": [[dict(zip(("item_id", "item_word", "doc_word", "n_words"), x, strict=True)) for x in m] for m in matches]}
            yield pa.RecordBatch.from_arrays([pa.array(made[n], _ARROW[n]) if n in made else batch.column(k) for k, n in enumerate(names)], names=names)

    return map_batches(frame, step, frame.schema)


def digest(found: DataFrame) -> DataFrame:
    """Adds ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` to what :func:`find_matches` returns."""
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = found.withColumns({"n_hit": hits, "n_items": F.size(ids).cast("long"), "items_sha256": F.sha2(F.array_join(ids, ","), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, with their own columns: at least a twentieth of a removed one's words are hit."""
    plain = [f"c{i}" for i in range(len(documents.columns))]  # no name of theirs can clash with those added
    found = digest(find_matches(documents.toDF(*plain), benchmark, window, plain[documents.columns.index("text")]))
    return found.where(~F.col("contaminated")).select(*plain).toDF(*documents.columns)
