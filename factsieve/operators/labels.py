"""Free-text labels to field specs: joins of the label table against the ontology."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factsieve.functions.kinds import EDGE_L, EDGE_R
from factsieve.functions.memo import once
from factsieve.functions.ontology import (
    NARROW_CHANNELS,
    SINGULAR_WORDS,
    SOCIAL_RULES,
    TYPE_RULES,
    alias_index,
    ontology,
)
from factsieve.functions.text import (
    alnum,
    gram_dice,
    grams,
    squish,
    to_key,
    token_overlap,
    tokens,
)

def _empty() -> Column:
    return F.array().cast("array<string>")


def infer_type(label: Column) -> Column:
    """``struct(type, plural)`` from the label's own words; ``text`` when no rule hits."""
    out = F.struct(F.lit("text").alias("type"), F.lit(False).alias("plural"))
    for pattern, kind, plural in reversed(TYPE_RULES):
        hit = label.rlike(f"(?i){EDGE_L}({pattern}){EDGE_R}")
        out = F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(plural).alias("plural"))).otherwise(out)
    return out


def detect_social(label: Column) -> Column:
    """Network named in a label, else null."""
    lowered = F.lower(label)
    out = F.lit(None).cast("string")
    for network, pattern in reversed(SOCIAL_RULES):
        hit = lowered.rlike(f"{EDGE_L}({pattern}){EDGE_R}")
        if network == "twitter":
            hit = hit | lowered.rlike(r"(^|\s)x(\s|$)")
        out = F.when(hit, F.lit(network)).otherwise(out)
    return out


def is_plural(label: Column, kind: Column) -> Column:
    last = F.coalesce(F.try_element_at(tokens(label, keep_stopwords=True), F.lit(-1)), F.lit(""))
    plural_word = squish(label).rlike(
        rf"(?i){EDGE_L}(\w+s|\w+es|amenities|facilities|galleries|all|list|multiple|every|each){EDGE_R}\s*$"
    )
    return (
        F.when(kind.isin("image_list", "list"), F.lit(True))
        .when(last.isin(*SINGULAR_WORDS), F.lit(False))
        .when(last.rlike("^(images?|photos?)$"), last.endswith("s"))
        .otherwise(plural_word & last.endswith("s"))
    )


def clean_labels(labels: DataFrame) -> DataFrame:
    """``(pos, label, key)`` without blanks; the first label of each key stays."""
    cleaned = (
        labels.select("pos", squish(F.col("label")).alias("label"))
        .where(F.col("label") != "")
        .withColumn("key", to_key(F.col("label")))
    )
    return cleaned.groupBy("key").agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label"))


def match_exact(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``match_score`` for spellings the alias index holds (1.0, 0.98 or 0.9)."""
    loose = F.trim(F.regexp_replace(F.regexp_replace(F.col("norm"), "[^a-z0-9 ]+", " "), r"\s+", " "))
    keyed = (
        labels.withColumn("norm", F.lower(squish(F.col("label"))))
        .withColumn("loose", loose)
        .withColumn(
            "singular", F.regexp_replace(F.col("loose"), rf"{EDGE_L}(\w+)s{EDGE_R}", "$1")
        )
    )
    out = keyed
    for column, score in (("norm", 1.0), ("loose", 0.98), ("singular", 0.9)):
        side = aliases.select(
            F.col("alias").alias(column),
            F.struct(F.col("kind"), F.lit(score).alias("score")).alias(f"hit_{column}"),
        )
        out = out.join(F.broadcast(side), column, "left")
    best = F.coalesce("hit_norm", "hit_loose", "hit_singular")
    return out.withColumn("kind", best["kind"]).withColumn("match_score", best["score"]).drop(
        "loose", "singular", "hit_norm", "hit_loose", "hit_singular"
    )


def alias_literal(aliases: DataFrame) -> Column:
    """The alias index as one array literal, in index order: a fixed vocabulary of a few hundred spellings."""
    prepared = aliases.select(
        "alias_pos", "alias", "kind", tokens(F.col("alias")).alias("words"), alnum(F.col("alias")).alias("bare")
    ).withColumn("grams", grams(F.col("bare")))

    rows = [r.asDict() for r in prepared.orderBy("alias_pos").collect()]
    return F.from_json(
        F.lit(json.dumps(rows)),
        "array<struct<alias_pos:int,alias:string,kind:string,words:array<string>,bare:string,grams:array<string>>>",
    )


def match_fuzzy(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best alias by word cover, containment or trigrams (score at least 0.55) for labels without ``kind``.

    The alias index rides along as a literal, so this is a narrow expression per label: no join, no pairs.
    """
    prepared = (
        labels.withColumn("label_words", tokens(F.col("norm")))
        .withColumn("label_bare", alnum(F.col("norm")))
        .withColumn("label_grams", grams(F.col("label_bare")))
    )

    def score(a: Column) -> Column:
        cover = token_overlap(a["words"], F.col("label_words"))
        back = token_overlap(F.col("label_words"), a["words"])
        contained = F.col("norm").contains(a["alias"]) & (F.length(a["alias"]) >= 4)
        sim = gram_dice(F.col("label_bare"), F.col("label_grams"), a["bare"], a["grams"])
        return F.greatest(
            F.when(cover >= 0.75, 0.6 + 0.2 * cover + 0.1 * back).otherwise(F.lit(0.0)),
            F.when(contained, 0.7 + F.least(F.lit(0.15), F.length(a["alias"]) / 100)).otherwise(F.lit(0.0)),
            F.when(sim >= 0.55, sim * 0.8).otherwise(F.lit(0.0)),
        )

    scored = F.transform(
        alias_literal(aliases),
        lambda a: F.struct(score(a).alias("score"), (-a["alias_pos"]).alias("at"), a["kind"].alias("kind")),
    )
    best = F.array_max(F.filter(scored, lambda s: s["score"] >= 0.55))
    return (
        prepared.withColumn("best", F.when(F.col("kind").isNull(), best))
        .withColumn("kind", F.coalesce("kind", F.col("best.kind")))
        .withColumn("match_score", F.coalesce("match_score", F.col("best.score"), F.lit(0.0)))
        .drop("best", "label_words", "label_bare", "label_grams")
    )


def _lowered_set(*parts: Column) -> Column:
    joined = F.transform(F.concat(*parts), lambda w: F.lower(F.trim(w)))
    return F.array_distinct(F.filter(joined, lambda w: w != ""))


def parse_labels(labels: DataFrame) -> DataFrame:
    """Field specs: one row per distinct label key, in the order the labels were given.

    ``labels(pos, label)`` never loses a label: what the ontology does not know gets a kind from its own
    words.
    """
    spark = labels.sparkSession
    onto = ontology(spark)
    aliases = alias_index(onto)
    matched = match_fuzzy(match_exact(clean_labels(labels), aliases), aliases)
    entry = F.broadcast(onto.withColumnRenamed("type", "entry_type").withColumnRenamed("plural", "entry_plural"))
    joined = matched.join(entry, "kind", "left")
    joined = (
        joined.withColumn("social", detect_social(F.col("label")))
        .withColumn("inferred", infer_type(F.col("label")))
        .withColumn("label_tokens", tokens(F.col("label")))
        .withColumn(
            "base_type",
            F.coalesce(
                "entry_type", F.when(F.col("social").isNotNull(), F.lit("social")), F.col("inferred.type")
            ),
        )
        .withColumn(
            "singulars",
            F.filter(
                F.transform(
                    "label_tokens", lambda t: F.regexp_replace(F.regexp_replace(t, "ies$", "y"), "s$", "")
                ),
                lambda t: F.length(t) > 2,
            ),
        )
        .withColumn(
            "said_plural",
            F.coalesce("entry_plural", F.col("inferred.plural") | is_plural(F.col("label"), F.col("base_type"))),
        )
    )

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), _empty())

    exclusive = F.coalesce("exclusive", F.lit(False))
    label_keywords = _lowered_set(F.col("label_tokens"), F.col("singulars"))
    social = F.when(F.col("social").isNotNull(), F.array("social")).otherwise(_empty())
    long_tokens = F.filter("label_tokens", lambda t: F.length(t) > 2)
    own_keys = F.array(
        F.regexp_replace("label", r"\s+", ""),
        F.array_join("label_tokens", ""),
        F.coalesce(F.try_element_at("label_tokens", F.lit(-1)), F.lit("")),
    )
    return joined.select(
        "pos", "label", "key",
        F.when(F.col("said_plural") & (F.col("base_type") == "image"), F.lit("image_list"))
        .otherwise(F.col("base_type")).alias("type"),
        (F.col("said_plural") | F.col("base_type").isin("image_list", "list")).alias("plural"),
        _lowered_set(F.col("label_tokens"), listed("keywords"), social, F.col("singulars")).alias("keywords"),
        _lowered_set(listed("schema_keys"), own_keys).alias("schema_keys"),
        label_keywords.alias("label_keywords"),
        exclusive.alias("exclusive"),
        _lowered_set(listed("meta_keys")).alias("meta_keys"),
        _lowered_set(listed("entity_types")).alias("entity_types"),
        F.when(exclusive, F.filter(label_keywords, lambda t: F.length(t) > 2))
        .otherwise(_lowered_set(listed("attr_hints"), long_tokens)).alias("attr_hints"),
        _lowered_set(listed("page_hints")).alias("page_hints"),
        F.col("kind").alias("ontology_key"),
        "social", "match_score", "label_tokens",
        F.filter(F.array(*[F.lit(c) for c in NARROW_CHANNELS]), lambda c: F.array_contains("label_tokens", c))
        .alias("narrow"),
    )


def preview_labels(specs: DataFrame, limit: int | None = None, keywords: int | None = None) -> DataFrame:
    """How labels will be read: all of them, or the first ``limit``, with all their keywords or the first ``keywords``."""
    shown = specs.orderBy("pos") if limit is None else specs.orderBy("pos").limit(limit)
    words = F.col("keywords") if keywords is None else F.slice("keywords", 1, keywords)
    return shown.select("pos", "label", "key", "type", "plural", F.col("ontology_key").alias("matched"), words.alias("keywords"))


def spec_rows(spark: SparkSession, labels: list[str] | DataFrame) -> list[Row]:
    """Field specs of one request, on the driver: a request names a handful of labels."""
    if isinstance(labels, DataFrame):
        return parse_labels(labels).orderBy("pos").collect()

    def parse() -> list[Row]:
        given = spark.createDataFrame(list(enumerate(labels)), "pos int, label string")
        return parse_labels(given).orderBy("pos").collect()

    return once(("spec_rows", tuple(labels)), parse)
