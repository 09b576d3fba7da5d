"""Candidates to answers: best value, distinct list or null, with provenance and coverage.

A site may hold any share of the corpus, so every reduction is an aggregate with map-side combine or a
``row_number() <= k`` window, which Spark limits per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions.text import round_half_up
from factsieve.plans.options import NO_LIMIT

MIN_CONFIDENCE = 0.4


def spec_array(specs: list[Row]) -> Column:
    """``array<struct(pos, key, label, type, plural)>`` of the requested labels."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"), F.lit(s.key).alias("field_key"), F.lit(s.label).alias("label"),
                F.lit(s.type).alias("value_type"), F.lit(s.plural).alias("plural"),
            )
            for i, s in enumerate(specs)
        ]
    )


def requested(sites: DataFrame, specs: list[Row]) -> DataFrame:
    """One row per site and label."""
    return sites.select("site").distinct().select("site", F.explode(spec_array(specs)).alias("s")).select("site", "s.*")


def pool(candidates: DataFrame, site_pages: DataFrame) -> DataFrame:
    """Candidates of all pages of a site; ``site_pages(page_id, site, visit)`` says which pages and in what order."""
    return candidates.join(site_pages.select("page_id", "site", "visit"), "page_id")


def floor(candidates: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return candidates.where(F.col("confidence") >= min_confidence)


def _order() -> list[Column]:
    return [F.desc("confidence"), F.col("ord"), F.col("visit"), F.col("seq")]


def best(candidates: DataFrame) -> DataFrame:
    """The most confident candidate per site and field, earlier position first on ties."""
    top = F.min_by(
        F.struct("value", "confidence", "method", "selector", "source_url"),
        F.struct(-F.col("confidence"), F.col("ord"), F.col("visit"), F.col("seq")),
    )
    return candidates.groupBy("site", "field_key").agg(top.alias("b"), F.count("*").alias("candidate_count")).select(
        "site", "field_key", "b.*", "candidate_count"
    )


def alternatives(candidates: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` runners-up per site and field, best first."""
    ranked = candidates.withColumn(
        "rank", F.row_number().over(W.partitionBy("site", "field_key").orderBy(*_order()))
    ).where(F.col("rank") <= n + 1)
    entry = F.struct(
        "rank", "value", round_half_up(F.col("confidence"), 100).alias("confidence"), "method", "source_url"
    )
    return ranked.where("rank > 1").groupBy("site", "field_key").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("rank")
        ).alias("alternatives")
    )


def list_answer(candidates: DataFrame, max_items: int = NO_LIMIT) -> DataFrame:
    """Distinct values per site and field in confidence-bucket, then document order."""
    bucket = F.floor(F.col("confidence") * 10 + 0.5)
    first = F.struct(-bucket, F.col("ord"), -F.col("confidence"), F.col("visit"), F.col("seq"))
    distinct = candidates.withColumn("at", first).groupBy("site", "field_key", "identity").agg(
        F.min_by(F.struct("value", "source_url"), "at").alias("v"), F.min("at").alias("at")
    )
    ranked = distinct.withColumn(
        "rank", F.row_number().over(W.partitionBy("site", "field_key").orderBy("at"))
    ).where(F.col("rank") <= max_items)
    return ranked.groupBy("site", "field_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "v.value"))), lambda e: e["value"]).alias("items"),
        F.array_sort(F.collect_set("v.source_url")).alias("source_urls"),
    )


def site_fields(
    candidates: DataFrame, sites: DataFrame, specs: list[Row], min_confidence: float = MIN_CONFIDENCE,
    max_items: int = NO_LIMIT,
) -> DataFrame:
    """The answer table: one row per site and label, ``value`` or ``items``, null or empty when not found."""
    good = floor(candidates, min_confidence)
    out = requested(sites, specs).join(best(good), ["site", "field_key"], "left")
    out = out.join(alternatives(good), ["site", "field_key"], "left")
    empty = F.array().cast("array<string>")
    if any(s.plural for s in specs):
        plural = [s.key for s in specs if s.plural]
        out = out.join(list_answer(good.where(F.col("field_key").isin(*plural)), max_items), ["site", "field_key"], "left")
    else:
        out = out.withColumn("items", F.lit(None).cast("array<string>")).withColumn(
            "source_urls", F.lit(None).cast("array<string>")
        )
    found = F.col("method").isNotNull()
    return out.select(
        "site", "pos", "label", "field_key", "value_type", "plural",
        F.when(~F.col("plural"), F.col("value")).alias("value"),
        F.when(F.col("plural"), F.coalesce("items", empty)).alias("items"),
        "source_url", F.coalesce("source_urls", empty).alias("source_urls"), "method", "selector",
        F.when(found, round_half_up(F.col("confidence"), 100)).otherwise(0.0).alias("confidence"), found.alias("found"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.when(~F.col("plural"), F.col("alternatives")).alias("alternatives"),
    )


def site_status(fields: DataFrame, pages: DataFrame, errors: DataFrame) -> DataFrame:
    """ok / partial / error per site with the missing labels and page counts."""
    asked = fields.groupBy("site").agg(
        F.count("*").alias("labels_requested"), F.count_if("found").alias("labels_found"),
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("pos", "label")))), lambda x: x["label"]
        ).alias("missing_fields"),
    )
    fetched = pages.groupBy("site").agg(F.count("*").alias("pages_fetched"))
    failed = errors.groupBy("site").agg(F.count("*").alias("n_errors"))
    out = asked.join(fetched, "site", "left").join(failed, "site", "left").fillna(0, ["pages_fetched", "n_errors"])
    status = (
        F.when((F.col("pages_fetched") == 0) | ((F.col("labels_found") == 0) & (F.col("n_errors") > 0)), "error")
        .when(F.size("missing_fields") == 0, "ok").otherwise("partial")
    )
    return out.withColumn("status", status)


def half_up_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(0).cast("int")


def coverage(record_fields: DataFrame) -> DataFrame:
    """In how many records of a site each label was found."""
    return record_fields.groupBy("site", "field_key", "label").agg(
        F.count_if("found").alias("found_in"), F.count("*").alias("of")
    ).withColumn("percent", half_up_percent(F.col("found_in"), F.col("of")))


def list_status(record_fields: DataFrame, sites: DataFrame, specs: list[Row]) -> DataFrame:
    """Status of a list run: a label is missing only when no record of the site has it."""
    seen = record_fields.groupBy("site", "field_key").agg(F.bool_or("found").alias("seen"))
    out = requested(sites, specs).join(seen, ["site", "field_key"], "left").groupBy("site").agg(
        F.bool_or(F.col("seen").isNotNull()).alias("any_records"),
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.coalesce("seen", F.lit(False)), F.struct("pos", "label")))),
            lambda x: x["label"],
        ).alias("missing_fields"),
    )
    status = F.when(F.col("any_records") & (F.size("missing_fields") == 0), "ok").otherwise("partial")
    return out.withColumn("status", status)


def error_result(failed: DataFrame, specs: list[Row]) -> DataFrame:
    """Null answers for seeds that never gave a page: ``failed(site, type, message)``."""
    return failed.select("site", F.col("type").alias("error_type"), F.col("message").alias("error_message"),
                         F.explode(spec_array(specs)).alias("s")).select(
        "site", "error_type", "error_message", "s.*", F.lit(None).cast("string").alias("value"),
        F.when(F.col("s.plural"), F.array().cast("array<string>")).alias("items"), F.lit(0.0).alias("confidence"),
        F.lit(False).alias("found"), F.lit("error").alias("status"),
    )


def unresolved(candidates: DataFrame, sites: DataFrame, specs: list[Row], min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Labels a site still lacks: no good candidate, or a plural label with fewer than two."""
    good = floor(candidates, min_confidence).groupBy("site", "field_key").agg(F.count("*").alias("good"))
    return requested(sites, specs).join(good, ["site", "field_key"], "left").fillna(0, ["good"]).where(
        F.col("good") < F.when(F.col("plural"), 2).otherwise(1)
    )


def good_count(candidates: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """How many labels have a good candidate, per page."""
    return floor(candidates, min_confidence).groupBy("page_id").agg(F.count_distinct("field_key").alias("good"))


def missing_count(candidates: DataFrame, sites: DataFrame, specs: list[Row], min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """How many labels have no good candidate at all, per site."""
    good = floor(candidates, min_confidence).select("site", "field_key").distinct()
    return requested(sites, specs).join(good, ["site", "field_key"], "left_anti").groupBy("site").agg(
        F.count("*").alias("missing")
    )


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.select("site", "message").dropDuplicates()


def best_snapshot(snapshots: DataFrame, list_mode: bool = False) -> DataFrame:
    """One snapshot per URL: the rendered one if it is more than half as long and answers at least as much.

    ``snapshots(page_id, url_key, renderer, html_chars, good)``; ``good`` counts labels, or rows in list mode.
    Both snapshots of a URL meet in one aggregate row, so no group is ever collected.
    """
    rendered = F.col("renderer") == "playwright"
    def latest(condition: Column) -> Column:
        return F.max_by(
            F.when(condition, F.struct("page_id", "html_chars", "good")), F.when(condition, F.struct("good", "page_id"))
        )

    both = snapshots.groupBy("url_key").agg(latest(~rendered).alias("s"), latest(rendered).alias("r"))
    longer = F.col("r.html_chars") > F.col("s.html_chars") * 0.5
    helps = F.col("r.good") >= F.col("s.good")
    if list_mode:
        helps = helps & (F.col("r.good") > 0)
    take = F.col("s").isNull() | (F.col("r").isNotNull() & longer & helps)
    return both.select(
        "url_key", F.when(take, F.col("r.page_id")).otherwise(F.col("s.page_id")).alias("page_id"),
        F.when(take, "playwright").otherwise("static").alias("renderer"),
    )
