"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word (a run of letters, lower-cased,
with its start mark) is scored by the forward algorithm: the sum over all its segmentations into pieces of the product
of their probabilities. A text's score is the sum over its words, its language the one with the largest posterior.

The probabilities come from expectation maximisation (forward-backward over the counted words of the training rows).
Training rows are the ``per_language`` labelled documents of each language with the smallest hashes, a bounded sample;
what reaches the driver is one number per language and piece. Predictions read whole texts in one scan, no shuffle.

Defined results: ``und`` with score 0 for a null text, a text without letters, and for every text if nothing is
labelled; runs of over ``LONGEST`` letters are scored in consecutive parts; repeated rows are scored alike; equal
posteriors go to the language first in the alphabet; the text and the two output columns are the only columns touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from factsieve.llm.common import byte_table, col, groups_by_size, map_batches, released, stage, text_bytes, word_edges, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
START = "▁"
#: Longest run scored at once, least piece probability and that of a letter no piece covers (in every language).
LONGEST, FLOOR, STRAY = 32, 1e-8, 1e-7
LETTERS = byte_table("abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(128, 256))))
_STEP = 0x9E3779B97F4A7C15
_POWER = np.multiply.accumulate(np.array([1] + [_STEP] * 64, np.uint64))
_BACK = np.multiply.accumulate(np.array([1] + [pow(_STEP, -1, 1 << 64)] * 64, np.uint64))


@dataclass
class Model:
    """Piece table (sorted hashes with their lengths) and, by language, prior and piece probabilities."""

    languages: list[str]
    prior: np.ndarray
    hashes: np.ndarray
    longest: int
    probability: np.ndarray


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The distinct lower-cased pieces of letters of a public vocabulary, with their start marks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p.removeprefix(START).isalpha() and len(p) <= 16)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded to a matrix, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros((len(words), int(sizes.max(initial=0))), np.uint64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def piece_hashes(pieces: list[str]) -> np.ndarray:
    points, _ = _points(pieces)
    return ((points + (points > 0)) * _POWER[: points.shape[1]]).sum(1, dtype=np.uint64)


def _cells(words: list[str], hashes: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Lengths of the words, and (start, end, piece index or -1) of every substring that is a piece of some word."""
    points, sizes = _points(words)
    n = points.shape[1]
    sums = np.zeros((n + 1, len(words)), np.uint64)
    np.cumsum(((points + (points > 0)) * _POWER[:n]).T, axis=0, out=sums[1:])
    cells = []
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            key = (sums[end] - sums[start]) * _BACK[start]
            at = np.searchsorted(hashes, key)
            at[at == len(hashes)] = 0
            piece = np.where((hashes[at] == key) & (sizes >= end), at, -1)
            if end - start == 1 or (piece >= 0).any():
                cells.append((start, end, piece))
    return sizes, cells


def _forward(sizes: np.ndarray, cells: list, probability: np.ndarray) -> np.ndarray:
    """Sums over the segmentations of each prefix: (position, word, language)."""
    padded = np.concatenate([probability, np.zeros((1, probability.shape[1]))])
    alpha = np.zeros((int(sizes.max(initial=0)) + 1, len(sizes), probability.shape[1]))
    alpha[0] = 1
    for start, end, piece in cells:
        p = padded[piece]
        if end - start == 1:
            p = np.where((piece < 0)[:, None], STRAY, p)
        alpha[end] += alpha[start] * p
    return alpha


def score_words(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word (with its start mark, at most ``LONGEST`` + 1 letters) in each language."""
    out = np.zeros((len(words), len(model.languages)), np.float32)
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for at in range(0, len(words), 1 << 13):
        rows = order[at : at + (1 << 13)]
        sizes, cells = _cells([words[i] for i in rows.tolist()], model.hashes, model.longest)
        alpha = _forward(sizes, cells, model.probability)
        out[rows] = np.log(alpha[sizes, np.arange(len(sizes))])
    return out


def expected_counts(words: list[str], weights: np.ndarray, hashes: np.ndarray, longest: int, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the weighted words, in one language."""
    out = np.zeros(len(hashes))
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    padded = np.append(probability, 0.0)
    for at in range(0, len(words), 1 << 13):
        rows = order[at : at + (1 << 13)]
        sizes, cells = _cells([words[i] for i in rows.tolist()], hashes, longest)
        alpha = _forward(sizes, cells, probability[:, None])[:, :, 0]
        here = np.arange(len(sizes))
        beta = np.zeros_like(alpha)
        beta[sizes, here] = 1
        scale = weights[rows] / alpha[sizes, here]
        for start, end, piece in reversed(cells):
            p = np.where((piece < 0) & (end - start == 1) & (sizes >= end), STRAY, padded[piece])
            use = p * beta[end]
            known = piece >= 0
            out += np.bincount(piece[known], (alpha[start] * use * scale)[known], minlength=len(out))
            beta[start] += use
    return out


def split_words(lowered: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, starts and ends of the runs of letters (long ones in parts), and the first run of each text."""
    joined = b"\n".join(lowered)
    data = np.frombuffer(joined, np.uint8)
    starts, ends = word_edges(data, LETTERS)
    long = np.flatnonzero(ends - starts > LONGEST)
    if len(long):
        cut_s, cut_e = [starts[ends - starts <= LONGEST]], [ends[ends - starts <= LONGEST]]
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            firsts = s + np.flatnonzero((data[s:e] & 0xC0) != 0x80)  # first bytes of characters
            parts = np.append(firsts[::LONGEST], e) if firsts.size else np.array([s, e])
            cut_s.append(parts[:-1])
            cut_e.append(parts[1:])
        starts, ends = np.sort(np.concatenate(cut_s)), np.sort(np.concatenate(cut_e))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    return joined, starts, ends, np.searchsorted(starts, offsets)


def _lower(column: pa.Array) -> list[bytes]:
    return text_bytes(pc.utf8_lower(column))


def _text(word: bytes) -> str:
    return START + word.decode("utf-8", "replace")


def training_rows(documents: DataFrame, per_language: int = 2000, held_out: bool = True) -> DataFrame:
    """``lang, text`` of the bounded sample; with ``held_out`` a third of the documents never is in it."""
    ids = documents.where(col("lang").isNotNull() & col("doc_id").isNotNull()).select("doc_id", "lang")
    if held_out:
        ids = ids.where(~is_held_out())
    order = W.Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("doc_id", "lang")
    # at most ``per_language`` ids of each language: small by construction
    return documents.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")


def is_held_out() -> F.Column:
    """The remainder of crc32(doc_id as text) by 3 is 1."""
    return F.coalesce(F.crc32(col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def count_words(rows: DataFrame) -> DataFrame:
    """``lang, word, n``: words with their start marks; combined per batch before the shuffle."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            lowered = _lower(batch.column(1))
            for first, last in groups_by_size([len(t) for t in lowered], 2 << 20):
                joined, starts, ends, firsts = split_words(lowered[first:last])
                code = {x: k for k, x in enumerate(sorted(set(langs[first:last])))}
                of = np.repeat([code[x] for x in langs[first:last]], np.diff(firsts))
                keys = word_hashes(np.frombuffer(joined, np.uint8), starts, ends) * np.uint64(len(code)) + of.astype(np.uint64)
                _, one, n = np.unique(keys, return_index=True, return_counts=True)
                names = list(code)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in of[one].tolist()], pa.string()), pa.array([_text(joined[starts[i] : ends[i]]) for i in one.tolist()], pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    counted = rows.select("lang", "text").mapInArrow(released(step), "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(documents: DataFrame, vocabulary: str = VOCABULARY, per_language: int = 2000, rounds: int = 3, held_out: bool = True) -> Model:
    """Piece probabilities of every labelled language, by ``rounds`` of expectation maximisation on the sample."""
    rows = training_rows(documents, per_language, held_out)
    words = stage(count_words(rows), "words")
    prior = {r.lang: r["count"] for r in documents.where(col("lang").isNotNull() & ~is_held_out() if held_out else col("lang").isNotNull()).groupBy("lang").count().collect()}
    languages = sorted(prior)
    pieces = read_pieces(vocabulary)
    hashes, one = np.unique(piece_hashes(pieces), return_index=True)
    longest = max(len(pieces[i]) for i in one.tolist())
    probability = np.full((len(hashes), len(languages)), 1 / len(hashes))
    code = {x: k for k, x in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        def step(batches: Iterator[pa.RecordBatch], probability: np.ndarray = probability) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = np.array([code[x] for x in batch.column(0).to_pylist()], np.int64)
                texts, n = batch.column(1).to_pylist(), np.asarray(batch.column(2)).astype(float)
                for k in np.unique(langs).tolist():
                    own = np.flatnonzero(langs == k)
                    counts = expected_counts([texts[i] for i in own.tolist()], n[own], hashes, longest, probability[:, k])
                    used = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[used])], names=["k", "piece", "n"])

        sums = words.mapInArrow(released(step), "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(probability)
        counts[sums["piece"].to_numpy(), sums["k"].to_numpy()] = sums["n"].to_numpy()
        probability = np.maximum((counts + 0.01) / (counts + 0.01).sum(0), FLOOR)
    share = np.array([prior[x] for x in languages], float)
    return Model(languages, np.log(share / share.sum()) if languages else share, hashes, longest, probability)


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``, the posterior of the language predicted."""
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    source = documents.select(*[col(c) for c in kept], F.coalesce(col(text).rlike(r"\p{L}"), F.lit(False)).alias("score"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = kept.index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_keys, known = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)), np.float32)
        for batch in batches:
            lettered = np.asarray(batch.column(len(kept)).cast(pa.int8())) > 0
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
            best, share = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            for first, last in groups_by_size(sizes, 1 << 20) if model.languages else ():
                joined, starts, ends, firsts = split_words(_lower(batch.column(at).slice(first, last - first)))
                keys, one, back = np.unique(word_hashes(np.frombuffer(joined, np.uint8), starts, ends), return_index=True, return_inverse=True)
                place = np.searchsorted(known_keys, keys)
                place[place == len(known_keys)] = 0
                new = known_keys[place] != keys if len(known_keys) else np.ones(len(keys), bool)
                if new.any():
                    if len(known_keys) + new.sum() > 1_000_000:  # what is kept between groups stays bounded
                        known_keys, known, new = known_keys[:0], known[:0], np.ones(len(keys), bool)
                    made = score_words([_text(joined[starts[i] : ends[i]]) for i in one[new].tolist()], model)
                    known_keys, known = np.concatenate([known_keys, keys[new]]), np.concatenate([known, made])
                    order = np.argsort(known_keys)
                    known_keys, known = known_keys[order], known[order]
                    place = np.searchsorted(known_keys, keys)
                sums = np.zeros((last - first, len(model.languages)))
                for k in range(len(model.languages)):
                    totals = np.concatenate([[0], np.cumsum(known[place, k][back], dtype=np.float64)])
                    sums[:, k] = np.diff(totals[firsts])
                sums += model.prior
                best[first:last] = sums.argmax(1)
                share[first:last] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            said = [model.languages[k] if ok and model.languages else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            score = np.where(lettered & bool(model.languages), share, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(said, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return map_batches(source, step, schema)


def keep_identified(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is identified with a posterior of at least ``least``, with their own columns."""
    plain = [f"c{i}" for i in range(len(documents.columns))]  # no name of theirs can clash with the two added
    kept = predict(documents.toDF(*plain), model, plain[documents.columns.index("text")]).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*plain).toDF(*documents.columns)
