"""Learned decision lists over text statistics, in DataFrame operations alone.

:func:`statistics` gives every whole text its counts. :func:`learn` runs sequential covering on labelled statistics:
a rule is grown by adding the threshold condition of the best FOIL gain until it covers no good document of the growing
part, pruned from its end on the held back part, kept if it is precise enough there, and the documents it covers leave;
then the next rule starts. Every step is one aggregate over the labelled rows that counts all candidate conditions at
once; a driver step sees counts only. :func:`verdict` turns the ordered rules into one conditional expression.

Labelled rows are at most ``max_labelled`` (those with the smallest hashes of their id), candidate thresholds are
``cuts`` quantiles of each statistic; statistics of documents to be judged cover every whole text.

Defined results: null and empty texts have zero counts and fail the base checks; repeated rows are judged alike; with no
labels of either kind no rule is learned and the base checks decide; null labels and ids are not learned from.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.llm.common import col, stage

SPACE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Statistics the rules may test, as expressions of the counts.
FEATURES = {
    "length": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions go; counts are those of the held back rows."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])


def _number_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(hashes: Column) -> Column:
    """Words in windows of three whose hash occurs twice or more: sort, compare neighbours, add up the cover of the places."""
    twin = lambda s, x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
    places = lambda s: F.array_sort(F.array_compact(F.transform(s, lambda x, i: F.when(twin(s, x, i), x["i"]))))
    cover = lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x)
    windows = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(windows, lambda s: _let(places(s), cover))).otherwise(0)


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the counts of their whole texts, without the text."""
    names = [c for c in documents.columns if c != text]
    own = F.coalesce(col(text), F.lit(""))
    rows = documents.select(F.struct(*[col(c) for c in names], F.lit(0).alias("__row")).alias("row"), own.alias("t"))
    bare = F.trim(F.col("t"), F.lit(SPACE))
    rows = rows.withColumn("w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP)))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0))
    # three-word windows by their hashes
    windows = F.arrays_zip(F.slice("w", 1, F.size("w") - 2), F.slice("w", 2, F.size("w") - 2), F.slice("w", 3, F.size("w") - 2))
    rows = rows.withColumn("h", F.when(F.size("w") > 2, F.transform(windows, lambda x: F.xxhash64(x["0"], x["1"], x["2"]))))
    counts = {
        "n_words": F.size("w"), "word_chars": F.length(F.translate("t", SPACE, "")), "n_symbols": _number_of(F.col("t"), SYMBOLS), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated_words(F.col("h")), "n_lines": F.size("lines"), "n_upper": _number_of(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": _number_of(F.col("t"), "0123456789"), "n_marks": _number_of(F.col("t"), "!?"),
    }
    return rows.select(*[F.col("row")[c].alias(c) for c in names], *[c.cast("long").alias(n) for n, c in counts.items()])


def base_failed() -> Column:
    """Too few words, or over half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(counted: DataFrame) -> DataFrame:
    return counted.withColumns({n: F.expr(e) for n, e in FEATURES.items()})


def labelled(documents: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """Features and ``bad`` (0 or 1) of the labelled rows learned from, staged; a third is ``held`` back."""
    known = labels.where(col("doc_id").isNotNull() & col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 0).cast("int").alias("bad"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # bounded by ``max_labelled``
    rows = features(stage(statistics(documents.select("doc_id", "text").join(sample, "doc_id")), "statistics"))
    return stage(rows.where(~base_failed()).select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("held"), *FEATURES), "labelled")


def _gain(bad: int, good: int, before_bad: int, before_good: int) -> float:
    """FOIL gain of narrowing one cover to another."""
    return bad * (math.log2(bad / (bad + good)) - math.log2(before_bad / (before_bad + before_good))) if bad else 0.0


def _best(table: DataFrame, cuts: list[list[float]], bad: int, good: int) -> tuple[int, bool, int] | None:
    """The condition (feature, above, cut) of the best gain, from counts by feature and bin: one aggregate."""
    cells = table.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    best, chosen = 0.0, None
    for f in range(len(cuts)):
        own = {r.b: (r.bad, r.n - r.bad) for r in cells if r.f == f}
        low_bad = low_good = 0
        for k in range(len(cuts[f])):
            low_bad, low_good = low_bad + own.get(k, (0, 0))[0], low_good + own.get(k, (0, 0))[1]
            for above, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                gain = _gain(b, g, bad, good)
                if gain > best + 1e-9:
                    best, chosen = gain, (f, above, k)
    return chosen


def learn(rows: DataFrame, cuts: int = 24, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.95, least: int = 3) -> list[Rule]:
    """The ordered rules for bad documents, from what :func:`labelled` returns.

    A rule counts if at least ``least`` bad documents of the held back part meet it and they are ``precision`` of all that do.
    """
    names = list(FEATURES)
    grid = rows.agg(*[F.percentile_approx(n, [k / cuts for k in range(1, cuts)]).alias(n) for n in names]).first()
    edges = [sorted(set(grid[n] or [])) for n in names]
    above = lambda n, e: reduce(lambda a, b: a + b, [(F.col(n) > x).cast("int") for x in e], F.lit(0))
    bins = F.array(*[above(n, e) for n, e in zip(names, edges, strict=True)])  # how many cuts lie below the value
    table = stage(rows.select("bad", "held", bins.alias("bins")), "binned")
    meets = lambda f, above, k: (F.col("bins")[f] > k) if above else (F.col("bins")[f] <= k)
    left, found = table, []
    count = lambda t: tuple(x or 0 for x in t.agg(F.sum("bad"), F.sum(1 - F.col("bad"))).first())
    while len(found) < max_rules:
        cover, chosen = left.where("not held"), []
        bad, good = count(cover)
        while bad and good and len(chosen) < max_conditions:
            condition = _best(cover, edges, bad, good)
            if condition is None:
                break
            chosen.append(condition)
            cover = cover.where(meets(*condition))
            bad, good = count(cover)
        if not chosen:
            break
        # prune: the shortest beginning that is no less precise on the held back rows
        prefix = [reduce(lambda a, b: a & b, [meets(*c) for c in chosen[: k + 1]]) for k in range(len(chosen))]
        tested = left.where("held").agg(*[F.sum(p.cast("int") * y).alias(f"{n}{k}") for k, p in enumerate(prefix) for n, y in (("b", F.col("bad")), ("g", 1 - F.col("bad")))]).first()
        scores = [(tested[f"b{k}"] or 0, tested[f"g{k}"] or 0) for k in range(len(chosen))]
        worth = [(b + 1) / (b + g + 2) for b, g in scores]
        keep = max(range(len(chosen)), key=lambda k: (worth[k], -k))
        bad, good = scores[keep]
        if bad < least or bad < precision * (bad + good):
            break
        found.append(Rule(tuple(Condition(names[f], above, edges[f][k]) for f, above, k in chosen[: keep + 1]), bad, good))
        left = left.where(~prefix[keep])
    return found


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule met (from 1), 0 if none: one conditional expression over the features."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), k).otherwise(out)
    return out


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """``documents`` without text, with their counts, ``base_failed``, ``rule`` (the first met) and ``kept``."""
    names = [c for c in documents.columns if c != "text"]
    rows = features(statistics(documents)).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return rows.select(*[col(c) for c in names if c not in (*counts, "base_failed", "rule", "kept")], *counts, "base_failed", "rule", "kept")
