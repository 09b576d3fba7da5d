"""Page, label, seed and place-search sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions.text import squish
from factsieve.functions.urls import validate_url
from factsieve.operators.places import BATCH_SCHEMA, MAX_PLACES

MAX_BYTES = 5 * 1024 * 1024
HTML_TYPE = r"(?i)html|xml|text/plain"
_DEFAULTS = (
    ("final_url", "string"), ("status", "int"), ("renderer", "string"), ("content_type", "string"), ("fetched_at", "timestamp"),
)


def with_defaults(pages: DataFrame) -> DataFrame:
    """``page_id, url, final_url, status, renderer, content_type, html, fetched_at`` with the usual defaults."""
    for name, kind in _DEFAULTS:
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    return pages.select(
        F.col("page_id").cast("bigint"), "url", F.coalesce("final_url", "url").alias("final_url"),
        F.coalesce("status", F.lit(200)).alias("status"), F.coalesce("renderer", F.lit("static")).alias("renderer"),
        "content_type", F.coalesce("html", F.lit("")).alias("html"), "fetched_at",
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.parquet(path))


def filter_html(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with an HTML-like (or no) content type, and a warning row for each of the others."""
    known = F.coalesce(F.nullif("content_type", F.lit("")).rlike(HTML_TYPE), F.lit(True))
    warnings = pages.where(~known).select(
        "page_id", F.concat("url", F.lit(': unexpected content-type "'), "content_type", F.lit('"; skipped.')).alias("message")
    )
    return pages.where(known), warnings


def cap_html(pages: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Bodies cut at ``max_bytes`` bytes, as the fetcher's reader does; ``truncated`` says which."""
    too_long = F.octet_length("html") > max_bytes
    # a character split by the cut becomes the replacement character, as in a streaming decoder
    cut = F.make_valid_utf8(F.substring(F.encode("html", "UTF-8"), 1, max_bytes).cast("string"))
    return pages.withColumn("truncated", too_long).withColumn(
        "html", F.when(too_long, cut).otherwise(F.col("html"))
    )


def prepare_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages to read, with all columns, and a warning row for each of the others."""
    return filter_html(with_defaults(pages))


def read_labels(spark: SparkSession, source: str | list[str], is_path: bool = False) -> DataFrame:
    """``(pos, label)`` out of a comma list, a list, or a file of one label per line with ``#`` comments."""
    if is_path:
        lines = spark.read.text(source, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "label"))
    else:
        items = source.split(",") if isinstance(source, str) else source
        lines = spark.createDataFrame(list(enumerate(items)), "pos int, label string")
    label = F.trim("label")
    kept = lines.select("pos", label.alias("label")).where(F.col("label") != "")
    return kept.where(~F.col("label").startswith("#")) if is_path else kept


def read_seeds(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(input, url)`` of usable seed addresses, and ``(input, reason)`` of the others."""
    checked = seeds.select(F.col("url").alias("input"), validate_url(F.col("url")).alias("v"))
    good = checked.where("v.ok").select("input", F.col("v.url").alias("url"))
    return good, checked.where("not v.ok").select("input", F.col("v.reason").alias("reason"))


def read_place_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCH_SCHEMA).json(path)


def read_places(batches: DataFrame, max_results: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Places of each query in reply order, all of them or the first ``max_results``, and a warning where more were asked than a search gives."""
    order = W.partitionBy("query").orderBy("batch", "i")
    rows = batches.select(squish(F.col("query")).alias("query"), "batch", F.posexplode("places").alias("i", "p"))
    placed = rows.withColumn("place_pos", F.row_number().over(order) - 1)
    if max_results is not None:
        placed = placed.where(F.col("place_pos") < max_results)
    text = f"Google returns at most {MAX_PLACES} results for a text search; asked for {max_results}."
    warned = batches.select("query").distinct().where(F.lit((max_results or 0) > MAX_PLACES)).withColumn("message", F.lit(text))
    return placed.select("query", "place_pos", "p.*"), warned
