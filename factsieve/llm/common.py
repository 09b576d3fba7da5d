"""Helpers the operators of this package share: staged tables and byte-level views of Arrow text columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.sources.staging import checkpoint_folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once as Parquet in the shared folder and read back: lineage ends here, lost executors do not."""
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def released(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step``, whose memory goes back to the system at its end: the worker process is kept, and would hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
            if trim is not None:
                trim(0)

    return run


def map_batches(frame: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for any column names; ``step`` takes columns by position."""
    return frame.toDF(*[f"c{i}" for i in range(len(frame.columns))]).mapInArrow(released(step), schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of fewer rows, so that few texts are open at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of every value of a string column; null reads as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def groups_by_size(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to at most ``limit``; an item over the limit stands alone."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def byte_table(word: str) -> np.ndarray:
    """A table of 256 flags from a latin-1 string of the bytes that are set."""
    table = np.zeros(256, np.uint8)
    table[np.frombuffer(word.encode("latin-1"), np.uint8)] = 1
    return table


#: Bytes of words of lower-cased text: digits, a-z and every byte of a character beyond ASCII.
ALNUM = byte_table("0123456789abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(128, 256))))
#: Translation that lower-cases A-Z only.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_edges(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = table[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return edges[::2], edges[1::2]


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n`` of each; kept up to a few megabytes."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_MULTIPLIER, _INVERSE):
            table = np.full(max(n, 1 << 18), base, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        if n > 1 << 20:
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit polynomial hash of each ``data[start:end]``; runs are ascending and do not overlap.

    Works through the buffer in pieces that end between words, so that memory stays small.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + piece, "right")))
        stop = int(ends[to - 1])
        power, inverse = _power_tables(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * power[: stop - base], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * inverse[s]
        at = to
    return out ^ (out >> np.uint64(31))


def key_filter(keys: DataFrame, name: str, bits: int) -> np.ndarray:
    """A Bloom filter of the bigint column ``name``: ``bits`` (a power of two) flags, whatever the number of keys."""
    places = F.explode(F.array(F.col(name).bitwiseAND(bits - 1), F.shiftrightunsigned(name, 32).bitwiseAND(bits - 1)))
    words = keys.select(places.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


def in_filter(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which values may be keys of the filter; no key is ever missed."""
    values = values.view(np.uint64)
    found = np.ones(len(values), bool)
    for place in (values & np.uint64(64 * len(words) - 1), (values >> np.uint64(32)) & np.uint64(64 * len(words) - 1)):
        found &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return found
