"""Tables around an external matcher: requests, responses, grounding and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions import kinds as K
from factsieve.functions.text import squish

MATCH_CONFIDENCE = 0.6
SNIPPET_CHARS = 200
#: Characters of page digests that fill a request.
REQUEST_CHARS = 60_000


def pack_digests(digests: DataFrame, max_chars: int = REQUEST_CHARS, bucket: int = 1024) -> DataFrame:
    """``digests`` with ``number`` (of the page in its site, from 1) and ``part``: the numbered request it travels in.

    Running sums of the sizes deal pages out: a request begins where ``max_chars`` are full, so none holds more than that
    and one digest. A site may have any share of the pages, so the sums are two-level: inside buckets of visits, and
    over the buckets of a site.
    """
    rows = digests.withColumn("bucket", F.floor(F.col("visit") / bucket)).withColumn("chars", F.length("digest").cast("bigint"))
    inside = W.partitionBy("site", "bucket").orderBy("visit", "url").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("site").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("site", "bucket").agg(F.sum("chars").alias("c"), F.count("*").alias("k")).select(
        "site", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("pages_before"))
    placed = rows.withColumn("at", F.coalesce(F.sum("chars").over(inside), F.lit(0))).withColumn("i", F.count("*").over(inside)).join(sums, ["site", "bucket"])
    return placed.select(*digests.columns, (F.col("pages_before") + F.col("i") + 1).alias("number"), F.floor((F.col("chars_before") + F.col("at")) / max_chars).alias("part"))


def match_requests(unresolved: DataFrame, digests: DataFrame, max_chars: int = REQUEST_CHARS) -> DataFrame:
    """``(site, part, request)``: the labels still open with the page digests of the site, some pages a request.

    ``unresolved(site, pos, field_key, label, value_type, plural)``, ``digests(site, visit, url, digest)``.
    """
    line = F.concat(
        F.lit("- key: "), "field_key", F.lit(' | label: "'), "label", F.lit('" | expected kind: '), "value_type",
        F.when(F.col("plural"), F.lit(" (list of values)")).otherwise(F.lit("")),
    )
    fields = unresolved.groupBy("site").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n").alias("fields")
    )
    page = F.concat(F.lit("--- PAGE "), "number", F.lit(": "), "url", F.lit(" ---\n"), "digest")
    extract = pack_digests(digests.select("site", "visit", "url", "digest"), max_chars).groupBy("site", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", page.alias("p")))), lambda x: x["p"]), "\n\n").alias("extract"))
    return fields.join(extract, "site").select(
        "site", "part", F.concat(F.lit("FIELDS TO FIND:\n"), "fields", F.lit("\n\nPAGE EXTRACT:\n"), "extract").alias("request")
    )


def match_responses(responses: DataFrame, specs: list[Row]) -> DataFrame:
    """``(site, field_key, value, snippet)`` out of raw JSON replies; unknown keys and nulls are skipped."""
    parsed = responses.select("site", F.from_json("response", "struct<fields:array<struct<key:string,value:string,snippet:string>>>").alias("r"))
    rows = parsed.select("site", F.explode("r.fields").alias("f")).where(F.col("f.key").isin(*[s.key for s in specs]))
    listed = F.from_json(F.col("f.value"), "array<string>")
    values = F.when(F.col("f.value").startswith("[") & listed.isNotNull(), listed).otherwise(F.array("f.value"))
    return rows.select(
        "site", F.col("f.key").alias("field_key"), F.explode(F.filter(F.transform(values, squish), lambda v: v != "")).alias("value"),
        F.col("f.snippet").alias("snippet"),
    )


def grounded(value: Column, haystack: Column) -> Column:
    """Is the value in the text, ignoring case, spacing and punctuation?"""
    n, h = F.lower(squish(value)), F.lower(squish(haystack))
    bare = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", "")
    bare_text = F.regexp_replace(F.lower(haystack), r"[^\p{L}\p{N}]+", "")
    return ((F.length(n) > 0) & h.contains(n)) | ((F.length(bare) >= 3) & bare_text.contains(bare))


def ground(values: DataFrame, digests: DataFrame) -> DataFrame:
    """Adds ``grounded``, ``reason`` and ``source_url``: a value counts only if a page of its site shows it.

    Each value meets its site's few page digests in an equi join and folds straight back into one row per
    value, so nothing is paired beyond a site's own pages and no text is gathered into a group.
    """
    keyed = values.withColumn("value_id", F.xxhash64("site", "field_key", "value", F.coalesce("snippet", F.lit(""))))
    verbatim = F.lower(squish(F.col("digest"))).contains(F.lower(squish(F.col("value"))))
    has_snippet = F.coalesce(F.length("snippet") > 0, F.lit(False))
    shown = F.lower(squish(F.col("digest"))).contains(F.lower(squish(F.coalesce("snippet", F.lit("")))))
    joined = keyed.join(digests, "site", "left").groupBy("site", "field_key", "value", "snippet", "value_id").agg(
        F.bool_or(F.coalesce(grounded(F.col("value"), F.col("digest")), F.lit(False))).alias("hit"),
        F.bool_or(F.coalesce(shown, F.lit(False))).alias("snippet_hit"),
        F.min_by("url", F.struct(F.when(verbatim, 0).otherwise(1), F.col("visit"))).alias("source_url"),
    )
    reason = (
        F.when(F.col("hit"), F.lit(None))
        .when(has_snippet & ~F.col("snippet_hit"), F.lit("neither the value nor its claimed snippet appears in the page extract"))
        .otherwise(F.lit("value is not present verbatim in the page extract"))
    )
    return joined.select("site", "field_key", "value", "snippet", F.col("hit").alias("grounded"), reason.alias("reason"), "source_url")


def attribute(values: DataFrame, digests: DataFrame) -> DataFrame:
    """``source_url`` per value: the first page that shows it, else the site's first page."""
    return ground(values, digests).select("site", "field_key", "value", "source_url")


def to_candidates(rows: DataFrame, specs: list[Row]) -> DataFrame:
    """Grounded values that validate, as candidates at a fixed confidence."""
    kinds = sorted({s.type for s in specs})
    types = F.create_map(*[F.lit(x) for s in specs for x in (s.key, s.type)])
    typed = rows.where("grounded").withColumn("type", F.element_at(types, F.col("field_key")))
    value = K.normalize_value(F.col("type"), F.col("value"), kinds)
    checked = typed.select(
        "site", "field_key", "type", "snippet", "source_url",
        F.explode(F.filter(F.array(value), lambda v: (v != "") & K.validate(F.col("type"), v, F.coalesce("snippet", F.lit("")), kinds))).alias("value"),
    )
    return checked.select(
        "site", "field_key", "type", "value", K.identity_key(F.col("type"), F.col("value"), kinds).alias("identity"),
        F.lit(MATCH_CONFIDENCE).alias("confidence"), F.lit("external match").alias("method"), F.lit(None).cast("string").alias("selector"),
        "source_url", F.lit(0).alias("ord"), F.substring(squish(F.col("snippet")), 1, SNIPPET_CHARS).alias("snippet"),
    )


def with_replies(candidates: DataFrame, responses: DataFrame, digests: DataFrame, specs: list[Row], wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(candidates, rejected)``: a site's pool with what its replies add, and reply values that no page shows.

    ``candidates(site, visit, field_key, type, identity, value, ...)``, ``responses(site, response)``, several to a site if
    its digests travelled in several requests. A value the pool has under the same identity keeps its place and the
    higher confidence; others come after all pages. With ``wanted(site, field_key)`` replies count for those labels only.
    """
    values = match_responses(responses, specs).distinct()
    if wanted is not None:
        values = values.join(wanted.select("site", "field_key").distinct(), ["site", "field_key"], "left_semi")
    judged = ground(values, digests)
    key = ["site", "field_key", "identity"]
    told = to_candidates(judged, specs).groupBy(*key, "type").agg(
        F.min_by(F.struct("value", "method", "selector", "source_url"), "value").alias("m"), F.max("confidence").alias("told"))
    merged = candidates.join(told.withColumnRenamed("type", "m_type"), key, "full_outer")
    own = F.col("type").isNotNull()
    better = F.coalesce(F.col("told") > F.col("confidence"), ~own)
    made = {
        "type": F.coalesce("type", "m_type"), "value": F.coalesce("value", "m.value"), "confidence": F.greatest("confidence", "told"),
        "method": F.when(better, F.col("m.method")).otherwise(F.col("method")), "selector": F.when(own & ~better, F.col("selector")),
        "source_url": F.coalesce("source_url", "m.source_url"), "visit": F.coalesce("visit", F.lit(2**31 - 1)), "ord": F.coalesce("ord", F.lit(0)),
    }
    return merged.select(*[made[c].alias(c) if c in made else F.col(c) for c in candidates.columns]), judged.where(~F.col("grounded"))
