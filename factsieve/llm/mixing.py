"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks. Block ``j`` (from 0) of a source with weight ``w`` is released at slot ``floor(j / w)`` and
due by ``ceil((j + 1) / w)``; every slot takes the released block with the earliest deadline. As long as no source has
run out, each has been given its weight's share of any prefix to within less than one block.

Weights are whole numbers over their sum and never rounded: given weights are read as the decimals they print as, others
(square roots) at the binary digits that a sum of 18 digits has room for. Releases and deadlines are exact decimals.

The axis of slots is cut into chunks of about ``CHUNK`` blocks, which are scheduled side by side, each by one fold over
its picks whose state is the next block of each source. What a chunk needs of those before it is how many blocks each
source has been given, which is the rounded-down share or one more. All chunks start from a guess (the blocks begun with
the earliest deadlines); a chunk that started from other counts than its predecessor ended with is scheduled again until
none is left. Two schedules that differ in which blocks are done agree again once those are due, so a chunk's wrong guess
is mended within itself if ``1 / w`` is less than its length, and two or three rounds are enough; sources rarer than that take
further rounds, never other results. A fold costs the number of sources for each block.

Rows meet their slot in one join by source and block, both dealt out by both. Order within a source is by hash of the
row's key. It is numbered in two levels, buckets of a source first and rows of a bucket (some ``bucket_rows``) after, so
the largest source is never sorted in one task. Weights are by rows or, with ``size``, by summed sizes: a block then ends
where the running size passes a multiple of ``block``.

Defined results: null sources are a source of their own; null or negative sizes count as 0; repeated rows each have a
place; without ``weights`` a source weighs the square root of its size; when a source has run out, the others go on in
their own proportions, and slots in which none of them has a block released stay empty; ``within_mix`` says which rows
come before that; an empty table gives an empty mixture; weights whose common denominator has more than 20 digits, and
schedules of 2**62 slots or more, are refused.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from math import gcd, isqrt, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from factsieve.llm.common import col, stage

#: Blocks of a chunk, and of a part of its fold (whose picks are appended to an array one by one).
CHUNK, PART = 16_384, 256
#: Sums of weights and numbers of slots stay below these.
WHOLE, SLOTS = 10**20, 1 << 62
_PICKS = "cast(array() as array<struct<i: int, block_no: bigint, release: bigint, deadline: bigint, slot: bigint>>)"


def whole_weights(totals: dict[str, int], weights: dict[str, float] | None) -> dict[str, int]:
    """Whole numbers in the proportions of the weights of the sources that have rows."""
    if weights is None:
        digits = 64
        while True:
            whole = {k: isqrt(max(n, 1) << 2 * digits) for k, n in totals.items()}
            if sum(whole.values()) < 10**18:
                return whole
            digits -= 1
    exact = {k: Fraction(str(weights[k])) for k in totals}
    common = lcm(*[x.denominator for x in exact.values()])
    whole = {k: int(x * common) for k, x in exact.items()}
    shared = gcd(*whole.values())
    whole = {k: x // shared for k, x in whole.items()}
    if sum(whole.values()) >= WHOLE:
        raise ValueError("weights have more digits than a schedule can hold")
    return whole


def _decimal(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _down(a: Column, b: Column, by: Column) -> Column:
    """``floor(a * b / by)`` exactly."""
    return F.call_function("div", _decimal(a) * _decimal(b), _decimal(by))


def _up(a: Column, b: Column, by: Column) -> Column:
    """``ceil(a * b / by)`` exactly."""
    return -F.call_function("div", -(_decimal(a) * _decimal(b)), _decimal(by)) + F.when(F.call_function("mod", _decimal(a) * _decimal(b), _decimal(by)) > 0, 1).otherwise(0)


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _chunks(spark: SparkSession, sources: list[tuple[int, int]], chunk: int) -> DataFrame:
    """``chunk, begin, end, steps`` of slots, with ``done``: how many blocks each source may have been given before.

    ``sources`` are ``(weight, blocks)``. Where sources have run out a chunk has more slots, as fewer of them are taken.
    """
    everything = sum(w for w, _ in sources)
    runs_out = [-(-n * everything // w) for w, n in sources]
    if max(runs_out) >= SLOTS:
        raise ValueError("a weight is too small for the rows of its source")
    pieces, at, first = [], 0, 0
    for end in sorted({x for x in runs_out if x}):
        active = sum(w for (w, _), x in zip(sources, runs_out, strict=True) if x > at)
        length = -(-chunk * everything // active)
        pieces.append((first, at, end, length))
        first, at = first - (-(end - at) // length), end
    table = F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(p, ("first", "at", "end", "length"), strict=True)]) for p in pieces])
    piece = F.element_at(F.filter(table, lambda p: p["first"] <= F.col("chunk")), -1)
    rows = spark.range(0, first, 1, min(first, 4 * spark.sparkContext.defaultParallelism)).select(F.col("id").alias("chunk"), piece.alias("p"))
    begin = F.col("p.at") + (F.col("chunk") - F.col("p.first")) * F.col("p.length")
    rows = rows.select("chunk", begin.alias("begin"), F.least(begin + F.col("p.length"), F.col("p.end")).alias("end"))
    steps = F.least(F.col("end") - F.col("begin"), F.lit(chunk + 2 * len(sources) + 1))
    # the guess: full shares, and the begun blocks with the earliest deadlines in the slots that are left
    total = F.lit(Decimal(everything))
    shares = F.transform(_sources(sources), lambda s, i: F.struct(F.least(s["n"], _down(F.col("begin"), s["w"], total)).alias("j"), s["w"].alias("w"), s["n"].alias("n"), i.alias("i")))
    begun = F.filter("shares", lambda s: (s["j"] < s["n"]) & (_down(s["j"], total, s["w"]) < F.col("begin")) & (_up(F.col("begin"), s["w"], total) > s["j"]))
    early = F.array_sort(F.transform(begun, lambda s: F.struct(_up(s["j"] + 1, total, s["w"]).alias("due"), s["i"].alias("i"))))
    left = F.col("begin") - F.aggregate("shares", F.lit(0).cast("long"), lambda a, s: a + s["j"])
    ahead = F.transform(F.slice(early, F.lit(1), F.least(F.greatest(left, F.lit(0)), F.lit(len(sources))).cast("int")), lambda s: s["i"])
    rows = rows.withColumn("shares", shares).withColumn("ahead", ahead)
    done = F.transform("shares", lambda s: s["j"] + F.array_contains("ahead", s["i"]).cast("long"))
    return rows.select("chunk", "begin", "end", steps.cast("int").alias("steps"), done.alias("done"))


def _sources(sources: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(_decimal(F.lit(Decimal(w))).alias("w"), F.lit(n).cast("long").alias("n")) for w, n in sources])


def _fold(sources: list[tuple[int, int]], picks: bool) -> Column:
    """The state of a chunk after its slots: the next block of each source (``next``) and, on demand, all ``picks`` in parts."""
    total = F.lit(Decimal(sum(w for w, _ in sources)))

    def block(j: Column, w: Column, n: Column) -> Column:
        return F.struct(j.alias("j"), _down(j, total, w).alias("free"), _up(j + 1, total, w).alias("due"), w.alias("w"), n.alias("n"))

    def pick(state: Column, _: Column) -> Column:
        # the earliest start, which is the present slot for all released blocks, then the earliest deadline
        options = F.transform(state["next"], lambda b, i: F.when(b["j"] < b["n"], F.struct(F.greatest(b["free"], state["slot"]).alias("slot"), b["due"].alias("due"), i.alias("i"))))

        def take(best: Column) -> Column:
            after = F.transform(state["next"], lambda b, i: F.when(i == best["i"], block(b["j"] + 1, b["w"], b["n"])).otherwise(b))
            fields = [(best["slot"] + 1).alias("slot"), after.alias("next")]
            if picks:
                taken = F.get(state["next"], best["i"])
                one = F.struct(best["i"].alias("i"), taken["j"].alias("block_no"), taken["free"].alias("release"), taken["due"].alias("deadline"), best["slot"].alias("slot"))
                fields.append(F.concat(state["out"], F.array(one)).alias("out"))
            return F.when(best["slot"] < F.col("end"), F.struct(*fields)).otherwise(state)

        return _let(F.array_min(options), take)

    def part(state: Column, _: Column) -> Column:
        fields = [state["slot"].alias("slot"), state["next"].alias("next")]
        inner = F.struct(*fields, F.expr(_PICKS).alias("out")) if picks else F.struct(*fields)
        folded = F.aggregate(F.sequence(F.lit(1), F.lit(PART)), inner, pick)
        if not picks:
            return folded
        return _let(folded, lambda s: F.struct(s["slot"].alias("slot"), s["next"].alias("next"), F.concat(state["parts"], F.array(s["out"])).alias("parts")))

    first = F.zip_with(_sources(sources), "done", lambda s, j: block(j, s["w"], s["n"]))
    start = [F.col("begin").alias("slot"), first.alias("next")]
    if picks:
        start.append(F.expr(f"cast(array() as array<{_PICKS.split(' as ')[1][:-1]}>)").alias("parts"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.col("steps") / PART).cast("int")), F.struct(*start), part)


def slots(spark: SparkSession, weights: dict[str, int], blocks: dict[str, int], chunk: int = CHUNK) -> DataFrame:
    """``source, block_no, release, deadline, slot``: earliest deadline first among released blocks, ties to the source first in order."""
    kinds = "source string, block_no long, release long, deadline long, slot long"
    names = sorted(weights)
    if not any(blocks[k] for k in names):
        return spark.createDataFrame([], kinds)
    sources = [(weights[k], blocks[k]) for k in names]
    chunks = _chunks(spark, sources, chunk)

    def ended(rows: DataFrame) -> DataFrame:
        return rows.withColumn("after", F.transform(_fold(sources, False)["next"], lambda b: b["j"]))

    known = stage(ended(chunks), "chunks")
    while True:
        before = known.select((F.col("chunk") + 1).alias("chunk"), F.col("after").alias("given"))
        joined = known.join(before, "chunk", "left").withColumn("right", F.col("given").isNull() | (F.col("given") == F.col("done")))
        joined = stage(joined, "chunks")
        if joined.where("not right").isEmpty():
            break
        again = joined.where("not right").select("chunk", "begin", "end", "steps", F.col("given").alias("done"))
        again = again.repartition(4 * spark.sparkContext.defaultParallelism, "chunk")
        known = stage(joined.where("right").select(*known.columns).unionByName(ended(again)), "chunks")
    dealt = known.repartition(4 * spark.sparkContext.defaultParallelism, "chunk")
    taken = dealt.select(F.explode(F.flatten(_fold(sources, True)["parts"])).alias("p"))
    order = F.array(*[F.lit(k) for k in names])
    return taken.select(F.get(order, F.col("p.i")).alias("source"), "p.block_no", "p.release", "p.deadline", "p.slot")


def _named(name: str | Column) -> Column:
    """A source as a text that is never null."""
    c = col(name).cast("string") if isinstance(name, str) else name
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c))


def interleave(
    documents: DataFrame, key: str = "doc_id", source: str = "source", size: str | None = None, block: int = 1,
    weights: dict[str | None, float] | None = None, bucket_rows: int = 50_000, chunk: int = CHUNK,
) -> DataFrame:
    """``documents`` with their place in the mixture, which is in the order of ``slot, in_block``.

    Adds ``block_no`` (within the source), ``release``, ``deadline`` and ``slot`` of the block, ``in_block`` (the row's
    place in it), ``share`` (the weight) and ``within_mix``. Sources that ``weights`` leave out are not mixed.
    """
    names = [c for c in documents.columns if c not in ("block_no", "release", "deadline", "slot", "in_block", "share", "within_mix")]
    own = F.greatest(F.coalesce(col(size).cast("long"), F.lit(0)), F.lit(0)) if size else F.lit(1)
    rows = documents.select(F.struct(*[col(c) for c in names]).alias("row"), _named(source).alias("source"), F.xxhash64(col(key)).alias("h"), own.cast("long").alias("size"))
    if weights is not None:
        weights = {"" if k is None else f"={k}": v for k, v in weights.items() if v > 0}
        rows = rows.where(F.col("source").isin(list(weights)))
    spread = rows.count() // bucket_rows + 64
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 16), F.lit(spread)))
    # level one: where each bucket of a source begins, and what each source amounts to
    sums = stage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("amount")), "buckets")
    begins = sums.withColumn("begin", F.coalesce(F.sum("amount").over(W.Window.partitionBy("source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).drop("amount")
    totals = {r.source: r.total for r in sums.groupBy("source").agg(F.sum("amount").alias("total")).collect()}  # a row for each source
    spark, whole = rows.sparkSession, whole_weights(totals, weights) if totals else {}
    blocks = {k: n // block + 1 for k, n in totals.items()}  # the last may be begun only, or stand for rows of size 0 at the end
    places = stage(slots(spark, whole, blocks, chunk), "slots")
    given = spark.createDataFrame([(k, float(Fraction(whole[k], sum(whole.values()))), blocks[k] - 1) for k in sorted(whole)], "source string, share double, last long")
    stop = places.join(F.broadcast(given), "source").where("block_no = last").agg(F.min("slot")).first()[0]
    targets = given.select("source", "share")
    # level two: the rows of one bucket
    inside = W.Window.partitionBy("source", "bucket").orderBy("h", "size", F.xxhash64("row"))
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn("ahead", ahead).withColumn("nr", F.row_number().over(inside))
    numbered = numbered.join(begins, ["source", "bucket"]).withColumn("block_no", F.floor((F.col("begin") + F.col("ahead")) / block))
    placed = numbered.join(places, ["source", "block_no"]).join(F.broadcast(targets), "source")
    first = F.col("bucket") * F.lit(1 << 32) + F.col("nr")
    return placed.select(
        *[F.col("row")[c].alias(c) for c in names], "block_no", "release", "deadline", "slot", first.alias("in_block"), "share",
        (F.col("slot") < F.lit(stop)).alias("within_mix"),
    )
