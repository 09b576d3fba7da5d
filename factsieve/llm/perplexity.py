"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts characters from the four before them, one model for each language, from all trusted documents but a
fifth that is held back. Counts, continuation counts, discounts, back-off weights and probabilities are tables keyed by
language and n-gram, made by grouped counts and joins that are sharded by that key; nothing of the model is broadcast
or collected. Documents are scored in blocks: a block sends its distinct n-grams through one join with the table of
probabilities and gets back those it needs, so what is shuffled is each text once (compressed) and the distinct n-grams
of each block. Thresholds are quantiles of the perplexities of a language's trusted documents held back, one for each
class of length, as texts of a few words vary far more than long ones.

A symbol is a lower-cased character: itself below 2048, one of 2048 classes by hash beyond; white space is one symbol.

Defined results: a document without text, or in a language without trusted text, has null perplexity; the former is not
kept, the latter is. Null languages are a language of their own. A language with fewer than ``least`` documents held
back is cross-fit: each of its trusted documents is judged by a model of the others (in ``FOLDS`` parts), and its
threshold moves towards the spread of all languages as these get fewer than ``least`` too. Only a language with a
single trusted document has no threshold and keeps all. Repeated rows and repeated ids are scored one by one; other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from factsieve.llm.common import col, groups_by_size, map_batches, stage

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
#: Text of one scoring block; trusted ids sent to every task rather than shuffled against the texts.
BLOCK_BYTES, SMALL_IDS = 1 << 26, 2_000_000
#: Parts of the trusted documents of a language with few.
FOLDS = 5


_NARROW = np.arange(SYMBOLS // 2, dtype=np.int64)  # the symbol of each character below 2048
_NARROW[[9, 10, 11, 12, 13, 0xA0]] = 32
_NARROW[0] = 1


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character of the texts, and the index of each text's first."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    pad = "\0" * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")  # every text begins with ORDER - 1 zeros
    wide = np.flatnonzero(points >= SYMBOLS // 2)
    symbols = _NARROW[np.minimum(points, SYMBOLS // 2 - 1)]
    if len(wide):
        symbols[wide] = SYMBOLS // 2 + ((points[wide].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)
    starts = firsts[:-1] + (ORDER - 1) * np.arange(len(texts))
    inside = np.ones(len(points), bool)
    for k in range(ORDER - 1):
        symbols[starts + k] = 0
        inside[starts + k] = False
    out = symbols.copy()
    for k in range(1, ORDER):
        out[k:] |= symbols[:-k] << (BITS * k)
    return out[inside], firsts


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts."""
    keys = np.sort(keys)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    return keys[edges[:-1]], np.diff(edges)


def _by_language(languages: list, texts: list[str], limit: int = 1 << 20) -> Iterator[tuple]:
    """Rows of one language, at most some ``limit`` characters at a time."""
    rows: dict = {}
    for i, lang in enumerate(languages):
        rows.setdefault(lang, []).append(i)
    for lang, own in rows.items():
        for a, b in groups_by_size([len(texts[i]) for i in own], limit):
            yield lang, own[a:b]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that few texts are open at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def count_grams(rows: DataFrame) -> DataFrame:
    """``lang, g, n``: every n-gram of ``rows(lang, trusted, text)`` with its count in trusted rows; summed per task first."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

        def total(lang: str | None) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in held[lang]]), len(keys)).astype(np.int64)

        def row(lang: str | None) -> pa.RecordBatch:
            keys, n = total(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(keys), pa.array(n)], names=["lang", "g", "n"])

        for batch in _slices(batches):
            texts = pc.utf8_lower(batch.column(2)).to_pylist()
            trusted = batch.column(1).to_pylist()
            kinds = list(zip(batch.column(0).to_pylist(), trusted, strict=True))
            for (lang, counts), own in _by_language(kinds, texts):
                unique, n = _counted(grams([texts[i] for i in own])[0])
                held.setdefault(lang, []).append((unique, n if counts else np.zeros_like(n)))
                if sum(len(k) for k, _ in held[lang]) > 1_000_000:
                    held[lang] = [total(lang)]
                    if len(held[lang][0][0]) > 500_000:  # what a task holds is bounded
                        yield row(lang)
                        held[lang] = []
        for lang in held:
            if held[lang]:
                yield row(lang)

    counted = rows.select("lang", "trusted", "text").mapInArrow(step, "lang string, g long, n long")
    return counted.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> F.Column:
    """The n-gram without its first symbol, as one of the order below."""
    return F.col("g").bitwiseAND((1 << (BITS * (order - 1))) - 1)


def _context(name: str = "g") -> F.Column:
    return F.shiftright(name, BITS)


def discounts(counts: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: modified Kneser-Ney discounts from the counts of counts, with plain ones where those fail."""
    tallies = counts.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def made(k: int) -> F.Column:
        usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0)
        value = F.when(usable, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
        return F.when((value > 0) & (value < k), value).otherwise(F.lit(k * 0.5)).alias(f"d{k}")

    return tallies.select("lang", made(1), made(2), made(3))


def level(counts: DataFrame, lower: DataFrame | None, needed: DataFrame, order: int) -> DataFrame:
    """``lang, g, p``: probabilities of the ``needed(lang, g)`` n-grams of one order, interpolated with those of the order below."""
    rows = counts.join(F.broadcast(discounts(counts)), "lang")  # a row for each language
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    seen = rows.select("lang", "g", (F.col("n") - taken).alias("left"))
    contexts = rows.groupBy("lang", _context().alias("c")).agg(F.sum("n").alias("total"), (F.sum(taken) / F.sum("n")).alias("gamma"))
    out = needed.select("lang", "g", _context().alias("c"), _suffix(order).alias("s")).join(seen, ["lang", "g"], "left").join(contexts, ["lang", "c"], "left")
    if lower is None:
        below = F.lit(1.0 / SYMBOLS)
    else:
        out = out.join(lower.select("lang", F.col("g").alias("s"), F.col("p").alias("below")), ["lang", "s"])
        below = F.col("below")
    p = F.coalesce(F.col("left") / F.col("total"), F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * below
    return out.select("lang", "g", p.alias("p"))


def probabilities(table: DataFrame) -> DataFrame:
    """``lang, g, p`` of every n-gram of ``table(lang, g, n)``, ``n`` being its count in the trusted text."""
    counts, needed = {ORDER: stage(table.where("n > 0"), "counts")}, {ORDER: table.select("lang", "g")}
    for order in range(ORDER, 1, -1):  # continuation counts: by how many different symbols is it preceded?
        counts[order - 1] = stage(counts[order].groupBy("lang", _suffix(order).alias("g")).agg(F.count(F.lit(1)).alias("n")), "counts")
        needed[order - 1] = stage(needed[order].select("lang", _suffix(order).alias("g")).distinct(), "needed")
    lower = None
    for order in range(1, ORDER + 1):
        lower = stage(level(counts[order], lower, needed[order], order), "level")
    return lower


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class _Lookup:
    """Values of sorted keys: a table by the high bits of a product, and a binary search for keys that lost their place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(10, int(4 * len(keys)).bit_length()))
        slots = self._slots(keys)
        size = 1 << (64 - int(self.shift))
        self.own, self.value = np.full(size, -1, np.int64), np.zeros(size, np.float32)
        self.own[slots], self.value[slots] = keys, values

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        out = self.value[slots]
        lost = np.flatnonzero(self.own[slots] != keys)
        out[lost] = self.values[np.searchsorted(self.keys, keys[lost])]
        return out


def score(rows: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """``row, lang, trusted, held, n, logs``: characters and summed log probabilities of every row, block by block."""
    names = ["row", "lang", "trusted", "held", "text"]
    placed = rows.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.asarray(batch.column(5))
            order = np.argsort(block, kind="stable")
            whole = pa.Table.from_batches([batch]).drop_columns(["block"])
            present, first = np.unique(block[order], return_index=True)
            parts = [_pack(whole.take(pa.array(x))) for x in np.split(order, first[1:])] if len(order) else []
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array(parts, pa.binary())], names=["block", "packed"])

    packed = placed.mapInArrow(pack, "block int, packed binary")

    def opened(table: pa.Table) -> Iterator[tuple[pa.Table, str | None, list[int], np.ndarray, np.ndarray]]:
        for data in table.column("packed"):
            part = pa.ipc.open_stream(data.as_buffer()).read_all()
            texts = pc.utf8_lower(part.column("text")).to_pylist()
            for lang, own in _by_language(part.column("lang").to_pylist(), texts):
                keys, firsts = grams([texts[i] for i in own])
                yield part, lang, own, keys, firsts

    def wanted(key: tuple, table: pa.Table) -> pa.Table:
        parts: dict[str | None, list[np.ndarray]] = {}
        for _, lang, _, keys, _ in opened(table):
            parts.setdefault(lang, []).append(_counted(keys)[0])
            if len(parts[lang]) > 15:
                parts[lang] = [np.unique(np.concatenate(parts[lang]))]
        distinct = {lang: np.unique(np.concatenate(own)) for lang, own in parts.items()}
        sizes = [len(k) for k in distinct.values()]
        langs = pa.array(list(distinct), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        return pa.table({"block": pa.array(np.full(sum(sizes), key[0].as_py(), np.int32)), "lang": langs, "g": pa.array(np.concatenate([*distinct.values(), np.zeros(0, np.int64)]))})

    asked = packed.groupBy("block").applyInArrow(wanted, "block int, lang string, g long")
    answers = asked.join(table, ["lang", "g"]).select("block", "lang", "g", F.ln("p").cast("float").alias("lp"))
    schema = T.StructType([*rows.select("row", "lang", "trusted", "held").schema.fields, T.StructField("n", T.LongType()), T.StructField("logs", T.DoubleType())])

    def scored(key: tuple, packs: pa.Table, answers: pa.Table) -> pa.Table:
        known = {}
        if answers.num_rows:
            coded = answers.column("lang").combine_chunks().dictionary_encode()
            codes, g, lp = np.asarray(coded.indices), np.asarray(answers.column("g")), np.asarray(answers.column("lp"))
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(codes == k)
                order = own[np.argsort(g[own])]
                known[lang] = _Lookup(g[order], lp[order])
        out, seen = [], {}
        for part, lang, own, keys, firsts in opened(packs):
            if id(part) not in seen:
                seen[id(part)] = part, np.zeros(part.num_rows, np.int64), np.full(part.num_rows, np.nan)
                out.append(seen[id(part)])
            _, n, logs = seen[id(part)]
            n[own] = np.diff(firsts)
            if lang in known:  # every n-gram of a known language is in its table
                sums = np.concatenate([[0], np.cumsum(known[lang](keys), dtype=np.float64)])
                logs[own] = np.diff(sums[firsts])
        made = [p.select(["row", "lang", "trusted", "held"]).append_column("n", pa.array(n)).append_column("logs", pa.array(x)) for p, n, x in out]
        return pa.concat_tables(made)

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)


def _bits() -> F.Column:
    """Binary digits of the length: texts of 2 ** (k - 1) to 2 ** k - 1 characters have k."""
    return F.length(F.bin("n"))


def length_classes(held: DataFrame, per_class: int) -> DataFrame:
    """``lang, starts``: the binary digits at which a language's length classes begin, each of ``per_class`` rows of ``held(lang, n)`` or all there are."""
    tallies = held.groupBy("lang", _bits().alias("k")).agg(F.count(F.lit(1)).alias("m"))
    listed = tallies.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("s"))  # as many as a length has digits

    def add(classes: F.Column, x: F.Column) -> F.Column:
        before = F.greatest(F.size(classes) - 1, F.lit(0))
        last = F.get(classes, F.size(classes) - 1)
        grown = F.struct(last["k"].alias("k"), (last["m"] + x["m"]).alias("m"))
        return F.when((F.size(classes) == 0) | (last["m"] >= per_class), F.concat(classes, F.array(x))).otherwise(F.concat(F.slice(classes, 1, before), F.array(grown)))

    classes = listed.select("lang", F.aggregate("s", F.expr("cast(array() as array<struct<k: int, m: bigint>>)"), add).alias("c"))
    short = (F.size("c") > 1) & (F.get(F.col("c"), F.size("c") - 1)["m"] < per_class)  # the longest go with the class before
    return classes.select("lang", F.transform(F.when(short, F.slice("c", 1, F.size("c") - 1)).otherwise(F.col("c")), lambda c: c["k"]).alias("starts"))


def in_class(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows(lang, n, ...)`` with ``class``; texts shorter than any held back are in the first."""
    k = _bits()
    return rows.join(F.broadcast(starts), "lang", "left").withColumn("class", F.greatest(F.size(F.filter("starts", lambda x: x <= k)), F.lit(1))).drop("starts")


def cross_fit(rows: DataFrame, least: int) -> DataFrame:
    """``rows(row, id, lang, trusted, held, text)`` and those of the extra models of languages with few held back, without ``id``.

    Such a language's own model learns from all its trusted documents. The models beside it are languages of their own,
    named by a digit before the name, which no other has: model ``k`` learns from all parts but ``k`` and holds that back.
    """
    labelled = rows.where("(trusted or held) and text <> ''").select("lang", "id", "held")
    few = labelled.groupBy("lang").agg(F.count_if("held").alias("m"), F.count_if(~F.col("held")).alias("learned")).where((F.col("m") < least) | (F.col("learned") == 0)).select("lang")
    few = stage(few.withColumn("few", F.lit(True)), "few")
    ids = labelled.join(F.broadcast(few), "lang").select("lang", "id").distinct()  # some 5 * least for each language
    part = F.row_number().over(W.Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")) % FOLDS
    parts = stage(ids.select("lang", "id", part.alias("part")), "parts")
    copies = rows.where("(trusted or held) and text <> ''").join(F.broadcast(parts), ["lang", "id"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    copies = copies.select("row", F.concat(F.col("k").cast("string"), "lang").alias("lang"), (F.col("k") != F.col("part")).alias("trusted"), (F.col("k") == F.col("part")).alias("held"), "text")
    few = F.broadcast(few)
    own = rows.join(few, "lang", "left").select("row", "lang", F.when(F.col("few"), F.col("trusted") | F.col("held")).otherwise(F.col("trusted")).alias("trusted"), (F.col("held") & F.col("few").isNull()).alias("held"), "text")
    return own.unionByName(copies)


def thresholds(judged: DataFrame, starts: DataFrame, quantile: float, least: int) -> DataFrame:
    """``lang, class, threshold`` from ``judged(lang, n, perplexity)``, documents their models have not learned from.

    With fewer than ``least`` of a language, the log of the threshold is a weighted mean of the quantile's own and of
    the language's mean plus the same quantile of all languages' distances from their means.
    """
    centres = judged.groupBy("lang").agg(F.avg(F.ln("perplexity")).alias("centre"), F.least(F.count(F.lit(1)) / least, F.lit(1.0)).alias("w"))
    spread = judged.join(F.broadcast(centres), "lang").agg(F.percentile_approx(F.ln("perplexity") - F.col("centre"), quantile, 10_000).alias("spread"))
    own = in_class(judged, starts).groupBy("lang", "class").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    shrunk = F.exp(F.col("w") * F.ln("own") + (1 - F.col("w")) * (F.col("centre") + F.col("spread")))
    return own.join(F.broadcast(centres), "lang").join(F.broadcast(spread), F.lit(True)).select("lang", "class", F.when(F.col("w") >= 1, F.col("own")).otherwise(shrunk).alias("threshold"))


def classify(documents: DataFrame, labels: DataFrame, quantile: float = 0.98, least: int = 20, per_class: int = 40) -> DataFrame:
    """``documents`` without text, with ``perplexity``, the ``threshold`` of their language and length, and ``kept``.

    Trusted are documents labelled of quality 1 and not toxic. A threshold is the ``quantile`` of the trusted documents
    held back of one language and class of length; a class has ``per_class`` of them, or is all lengths;
    languages with fewer than ``least`` are cross-fit.
    """
    names = [c for c in documents.columns if c not in ("text", "perplexity", "threshold", "kept")]
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select(F.col("doc_id").alias("trusted_id"))
    ids = stage(ids, "trusted")
    ids = F.broadcast(ids) if ids.count() <= SMALL_IDS else ids
    rows = documents.select(F.struct(*[col(c) for c in names], F.lit(0).alias("__row")).alias("row"), col("doc_id").alias("id"), F.coalesce(F.concat(F.lit("="), col("lang").cast("string")), F.lit("")).alias("lang"), F.coalesce(col("text"), F.lit("")).alias("text"))
    rows = rows.join(ids, F.col("id") == F.col("trusted_id"), "left").withColumn("trusted", F.col("trusted_id").isNotNull())
    held = F.col("trusted") & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0)
    rows = cross_fit(rows.select("row", "id", "lang", (F.col("trusted") & ~held).alias("trusted"), held.alias("held"), "text"), least)
    counted = stage(count_grams(rows.where("text <> ''")), "grams")
    known = counted.where("n > 0").select("lang").distinct()
    table = probabilities(counted.join(F.broadcast(known), "lang", "left_semi"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scores = score(rows, table, 1 + size // BLOCK_BYTES).join(F.broadcast(known.withColumn("known", F.lit(True))), "lang", "left")
    perplexity = F.when((F.col("n") > 0) & F.col("known"), F.exp(-F.col("logs") / F.col("n")))
    scores = stage(scores.select("row", "lang", "held", "n", perplexity.alias("perplexity")), "scores")
    judged = scores.where("held and perplexity is not null").select(F.regexp_replace("lang", "^[0-9]", "").alias("lang"), "n", "perplexity")
    judged = stage(judged, "judged")
    starts = stage(length_classes(judged, per_class), "classes")
    limits = thresholds(judged, starts, quantile, least)
    scores = scores.where(~F.col("lang").rlike("^[0-9]"))
    joined = in_class(scores, starts).join(F.broadcast(limits), ["lang", "class"], "left")  # a row for each language and class
    kept = (F.col("n") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return joined.select(*[F.col("row")[c].alias(c) for c in names], "perplexity", "threshold", kept.alias("kept"))
