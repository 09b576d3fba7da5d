"""Image candidates: six harvest channels, junk filter, identity dedupe and two rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions.memo import memo
from factsieve.functions.text import let, squish, text_or_empty
from factsieve.functions.urls import absolutize, image_identity
from factsieve.operators.page import KEYS, attr, attr_text, class_list, inside, own_parent

# ---- fixed values ---------------------------------------------------------------------------
LAZY_ATTRS = (
    "data-src", "data-original", "data-lazy", "data-lazy-src", "data-lazyload", "data-echo", "data-hi-res-src",
    "data-large", "data-large-file", "data-full", "data-full-url", "data-image", "data-img", "data-img-src",
    "data-zoom-image", "data-zoom", "data-bg", "data-background", "data-background-image", "data-thumb",
    "data-flickity-lazyload", "data-srcset", "data-lazy-srcset",
)
META_IMAGES = (
    ("og:image:secure_url", 0.95), ("og:image:url", 0.95), ("og:image", 0.95), ("twitter:image", 0.9),
    ("twitter:image:src", 0.9), ("link:image_src", 0.85), ("thumbnailurl", 0.8), ("msapplication-tileimage", 0.3),
)
IMAGE_KEYS = ("image", "contenturl", "thumbnailurl", "photo", "logo", "primaryimageofpage")
JUNK_URL = (
    r"(?i)(sprite|favicon|(?<![A-Za-z0-9_])icons?(?![A-Za-z0-9_])|icon-|-icon|pixel|1x1|spacer|blank\.|transparent\.|"
    r"placeholder|loader|loading|spinner|avatar-default|tracking|analytics|beacon|/ads?/|badge|flag-|payment|visa|"
    r"mastercard|paypal|social|share-|btn-|button-|arrow|chevron|close\.|menu\.|hamburger)"
)
JUNK_CONTEXT = (
    r"(?i)(^|[\s_-])(icon|sprite|nav|navbar|menu-toggle|footer-logo|payment|social|share|advert|ads?|banner-ad|"
    r"cookie|newsletter)([\s_-]|$)"
)
GALLERY_CONTEXT = (
    r"(?i)(gallery|slider|carousel|slideshow|lightbox|photos?|images?|swiper|fotorama|thumbnails?|masonry|grid)"
)
HERO_CONTEXT = r"(?i)(hero|banner|masthead|jumbotron|cover|featured|main-image|primary-image|header-image)"
LOGO_CONTEXT = r"(?i)(^|[\s_-])logo([\s_-]|$)"
# ---------------------------------------------------------------------------------------------

@memo
def best_srcset(c: Column) -> Column:
    """``struct(url, width)`` of the largest srcset entry, else null."""
    def pick(s: Column) -> Column:
        spaced = F.split(s, r",(?=\s)")
        bare = (F.size(spaced) == 1) & s.rlike(r"\d+(?:\.\d+)?[wx]\s*,")
        shape = r"^(\S+)(?:\s+(\d+(?:\.\d+)?)([wx]))?\s*$"

        def entry(part: Column, i: Column) -> Column:
            part = F.trim(F.regexp_replace(part, r"^\s+|\s+$", ""))
            number = F.regexp_extract(part, shape, 2).try_cast("double")
            unit = F.regexp_extract(part, shape, 3)
            width = F.when(unit == "w", number)
            rank = F.coalesce(width, F.coalesce(F.when(unit == "x", number), F.lit(1.0)) * 1000)
            return F.struct(
                F.when(part.rlike(shape), rank).alias("rank"), (-i).alias("at"),
                F.regexp_extract(part, shape, 1).alias("url"), width.alias("width"),
            )

        entries = F.filter(
            F.transform(F.when(bare, F.split(s, ",")).otherwise(spaced), entry), lambda e: e["rank"].isNotNull()
        )
        best = F.array_max(entries)
        return F.when(best.isNotNull(), F.struct(best["url"].alias("url"), best["width"].alias("width")))

    return let(text_or_empty(c), pick)


def parse_dim(c: Column) -> Column:
    n = F.regexp_replace(text_or_empty(c), "[^0-9.]", "").try_cast("double")
    return F.when(n > 0, n)


def css_urls(c: Column) -> Column:
    pattern = r"(?i)url\(\s*(['\"]?)([^'\")]+)\1\s*\)"
    return F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(2)), F.trim)


def variant_score(url: Column, width: Column, trust: Column) -> Column:
    """How good a rendition one URL is: declared width, size hints in the URL, full or thumb words, trust."""
    hint = F.coalesce(
        *[
            F.regexp_extract(url, p, 1).try_cast("double")
            for p in (
                r"(?i)[?&](?:w|width)=(\d{2,5})", r"[-_/](\d{3,5})x\d{3,5}[-_./]",
                r"(?i)[-_/](\d{3,5})\.(?:jpe?g|png|webp|avif)$",
            )
        ],
        F.lit(0.0),
    )
    return (
        F.coalesce(width, F.lit(0.0)) / 100
        + hint / 100
        + F.when(url.rlike("(?i)(?:original|full|large|xl|2048|1920|1600)"), 8).otherwise(0)
        - F.when(url.rlike(r"(?i)(?:thumb|thumbnail|small|-150x|-300x|_s\.|_t\.)"), 10).otherwise(0)
        - F.when(url.rlike("(?i)^data:"), 100).otherwise(0)
        + F.coalesce(trust, F.lit(0.5)) * 2
    )


@memo
def image_selector() -> Column:
    classes = F.array_join(F.slice(class_list(attr("class")), 1, 2), ".")
    own = F.when(classes != "", F.concat("tag", F.lit("."), classes)).otherwise(F.col("tag"))
    parent_class = F.coalesce(F.try_element_at(class_list(own_parent("parent_class")), F.lit(1)), F.lit(""))
    parent = F.concat(
        own_parent("parent_tag"), F.when(parent_class != "", F.concat(F.lit("."), parent_class)).otherwise(F.lit(""))
    )
    return (
        F.when(attr_text("id") != "", F.concat("tag", F.lit("#"), attr("id")))
        .when(own_parent("parent_tag") != "", F.concat(parent, F.lit(" > "), own))
        .otherwise(own)
    )


@memo
def image_context() -> Column:
    """Words around an element: its own attributes, its parent's and enclosing sections', caption and heading."""
    def seen(column: str, kind: str) -> Column:
        return F.when(inside(kind), F.col(column))

    words = [
        attr("alt"), attr("title"), attr("aria-label"), seen("caption", "figure"), attr("class"), attr("id"),
        own_parent("parent_class"), own_parent("parent_html_id"), seen("near_class", "classsection"),
        seen("near_id", "idsection"), seen("near_heading", "section"),
    ]
    return F.lower(squish(F.concat_ws(" ", *[F.nullif(w, F.lit("")) for w in words])))


_FIELDS = (
    "channel_rank", "node_id", "at", "raw_url", "width", "height", "alt", "context", "selector", "channel", "trust",
    "in_gallery", "in_hero", "junk_context",
)


def _candidate(frame: DataFrame, **given: Column) -> DataFrame:
    defaults = dict(
        at=F.lit(0), width=F.lit(None).cast("double"), height=F.lit(None).cast("double"), alt=F.lit(""),
        context=F.lit(""), selector=F.lit(None).cast("string"), trust=F.lit(0.5), in_gallery=F.lit(False),
        in_hero=F.lit(False), junk_context=F.lit(False),
    )
    columns = {**defaults, **given}
    return frame.select(*KEYS, *[columns.get(f, F.col(f) if f == "node_id" else None).alias(f) for f in _FIELDS])


def images_meta(meta: DataFrame) -> DataFrame:
    """Channel 1: social preview and link images."""
    wanted = [k for k, _ in META_IMAGES]
    aside = meta.where(F.col("key").isin("og:image:width", "og:image:height", "og:image:alt")).groupBy(*KEYS).agg(
        F.max(F.when(F.col("key") == "og:image:width", parse_dim(F.col("value")))).alias("og_width"),
        F.max(F.when(F.col("key") == "og:image:height", parse_dim(F.col("value")))).alias("og_height"),
        F.max(F.when(F.col("key") == "og:image:alt", F.col("value"))).alias("og_alt"),
    )
    rows = meta.where(F.col("key").isin(*wanted)).join(aside, KEYS, "left")
    trust = F.lit(0.5)
    rank = F.lit(0)
    for i, (key, t) in enumerate(META_IMAGES):
        trust = F.when(F.col("key") == key, F.lit(t)).otherwise(trust)
        rank = F.when(F.col("key") == key, F.lit(i)).otherwise(rank)
    og = F.col("key").startswith("og:image")
    return _candidate(
        rows, channel_rank=F.lit(1), node_id=rank, raw_url=F.col("value"),
        channel=F.concat(F.lit("meta:"), F.col("key")), trust=trust, width=F.when(og, F.col("og_width")),
        height=F.when(og, F.col("og_height")), alt=F.coalesce("og_alt", F.lit("")),
        context=F.lit("og social preview primary main"), in_hero=og,
    )


def images_structured(entries: DataFrame) -> DataFrame:
    """Channel 2: image-like properties of structured data."""
    order = W.partitionBy(*KEYS).orderBy("seq")
    rows = (
        entries.where(F.col("key").isin(*IMAGE_KEYS) & F.col("value").rlike(r"(?i)^(https?:|/|\.)"))
        .withColumn("n", F.row_number().over(order))
    )
    return _candidate(
        rows, channel_rank=F.lit(2), node_id=F.col("n"), raw_url=F.col("value"),
        channel=F.concat("source", F.lit(":"), "path"), trust=F.when(F.col("is_primary"), 0.95).otherwise(0.8),
        context=F.lower(F.concat("path", F.lit(" "), "key")),
        in_hero=(F.col("key") == "primaryimageofpage") | (F.col("is_primary") & (F.col("key") == "image")),
    )


_VARIANTS = "array<struct<url:string,width:double,trust:double,channel:string>>"


@memo
def _variants(names: tuple[str, ...]) -> Column:
    """Renditions an ``<img>`` names in the given attributes, in attribute order."""
    width = parse_dim(attr("width"))
    # of the many names only those the element has are looked at, in the order of the names
    present = F.array_intersect(F.array(*[F.lit(n) for n in names]), F.map_keys("attrs"))
    given = F.filter(
        F.transform(
            present, lambda n: F.struct(n.alias("n"), F.coalesce(F.try_element_at(F.col("attrs"), n), F.lit("")).alias("v"))
        ),
        lambda x: x["v"] != "",
    )

    def renditions(x: Column) -> Column:
        trust = F.when(x["n"] == "srcset", 0.78).when(x["n"] == "src", 0.7).otherwise(0.8)

        def one(url: Column, own_width: Column) -> Column:
            return F.struct(
                url.alias("url"), F.coalesce(own_width, width).alias("width"), trust.alias("trust"),
                F.concat(F.lit("img["), x["n"], F.lit("]")).alias("channel"),
            )

        none = F.lit(None).cast("double")
        from_set = let(
            best_srcset(x["v"]),
            lambda b: F.when(b.isNotNull(), F.array(one(b["url"], b["width"]))).otherwise(F.array().cast(_VARIANTS)),
        )
        return (
            F.when(x["n"].endswith("srcset"), from_set)
            .when(x["n"].startswith("data-") & x["v"].contains("url("), F.transform(css_urls(x["v"]), lambda u: one(u, none)))
            .otherwise(F.array(one(x["v"], none)))
        )

    return F.flatten(F.transform(given, renditions))


def images_elements(nodes: DataFrame) -> DataFrame:
    """Channels 3 to 7: ``<img>``, bare ``<source>``, posters, inline backgrounds, anchors to image files.

    One pass over the image-like elements; only the sources of a ``<picture>`` are joined in, by id.
    """
    is_img = F.col("tag") == "img"
    to_image = (F.col("tag") == "a") & attr_text("href").rlike(r"(?i)\.(jpe?g|png|webp|avif|gif)(\?|$)")
    styled = attr_text("style").contains("background")
    bare = (F.col("tag") == "source") & (attr_text("srcset") != "")
    poster = (F.col("tag") == "video") & attr("poster").isNotNull()
    pictures = (
        nodes.where(F.col("tag").isin("img", "source") & inside("picture"))
        .withColumn(
            "best",
            F.when(
                F.col("tag") == "source",
                best_srcset(F.coalesce(F.nullif(attr("srcset"), F.lit("")), attr("data-srcset"))),
            ),
        )
        .groupBy(*KEYS, "a_picture")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("node_id", "best")))),
                lambda s: s["best"],
            ).alias("sources"),
            F.bool_or(F.col("tag") == "img").alias("pictured"),
        )
    )
    rows = (
        nodes.where(is_img | to_image | styled | bare | poster)
        .withColumn("context", image_context())
        .join(pictures, [*KEYS, "a_picture"], "left")
    )
    width = parse_dim(attr("width"))
    from_sources = F.transform(
        F.coalesce("sources", F.array().cast("array<struct<url:string,width:double>>")),
        lambda s: F.struct(
            s["url"].alias("url"), F.coalesce(s["width"], width).alias("width"), F.lit(0.75).alias("trust"),
            F.lit("picture>source[srcset]").alias("channel"),
        ),
    )
    renditions = F.concat(_variants((*LAZY_ATTRS, "srcset")), from_sources, _variants(("src",)))
    usable = F.filter(renditions, lambda v: (v["url"] != "") & ~F.trim(v["url"]).rlike("(?i)^data:"))

    def winner(all_of: Column) -> Column:
        ranked = F.transform(
            all_of,
            lambda v, i: F.struct(
                variant_score(v["url"], v["width"], v["trust"]).alias("score"), (-i).alias("at"), v.alias("v")
            ),
        )
        return F.when(F.size(all_of) > 1, F.array_max(ranked)["v"]).otherwise(F.try_element_at(all_of, F.lit(1)))

    container = squish(
        F.concat_ws(
            " ",
            *[
                F.nullif(c, F.lit(""))
                for c in (
                    attr("class"), attr("id"), own_parent("parent_class"), own_parent("parent_html_id"),
                    F.when(inside("class"), F.col("box_class")),
                )
            ],
        )
    )
    context = F.col("context")
    in_gallery, in_hero = context.rlike(GALLERY_CONTEXT), context.rlike(HERO_CONTEXT)
    no, no_size = F.lit(False), F.lit(None).cast("double")
    shape = "array<struct<channel_rank:int,raw_url:string,width:double,trust:double,channel:string,in_gallery:boolean,in_hero:boolean,junk_context:boolean>>"

    def found(rank: int, url: Column, w: Column, trust: Column, channel: Column, gal: Column, hero: Column, junk: Column):
        return F.struct(
            F.lit(rank).alias("channel_rank"), url.alias("raw_url"), w.alias("width"), trust.alias("trust"),
            channel.alias("channel"), gal.alias("in_gallery"), hero.alias("in_hero"), junk.alias("junk_context"),
        )

    def some(condition: Column, made: Column) -> Column:
        return F.when(condition, made).otherwise(F.array().cast(shape))

    rows = rows.withColumn("win", F.when(is_img, let(usable, winner))).withColumn("set", F.when(bare, best_srcset(attr("srcset"))))
    lightbox = (attr_text("data-lightbox") != "") | attr_text("class").rlike("(?i)lightbox|gallery")
    made = F.concat(
        some(F.col("win").isNotNull(), F.array(found(
            3, F.col("win.url"), F.col("win.width"), F.col("win.trust"), F.col("win.channel"), in_gallery, in_hero,
            container.rlike(JUNK_CONTEXT)))),
        some(F.col("set").isNotNull() & ~F.coalesce("pictured", no), F.array(found(
            4, F.col("set.url"), F.col("set.width"), F.lit(0.6), F.lit("source[srcset]"), no, no, no))),
        some(poster, F.array(found(5, attr("poster"), no_size, F.lit(0.5), F.lit("video[poster]"), no, no, no))),
        some(styled, F.transform(css_urls(attr("style")), lambda u: found(
            6, u, no_size, F.lit(0.55), F.lit("style:background-image"), in_gallery, in_hero,
            squish(attr_text("class")).rlike(JUNK_CONTEXT)))),
        some(to_image, F.array(found(
            7, attr("href"), no_size, F.lit(0.72), F.lit("a[href=image]"), in_gallery | lightbox, no, no))),
    )
    return rows.select(
        *KEYS, "node_id", "context", image_selector().alias("selector"),
        F.when(is_img, squish(attr("alt"))).otherwise(F.lit("")).alias("alt"),
        F.when(is_img, parse_dim(attr("height"))).alias("height"), F.posexplode(made).alias("at", "c"),
    ).select(*KEYS, "node_id", "context", "selector", "alt", "height", "at", "c.*")


def images_img(nodes: DataFrame) -> DataFrame:
    """Channel 3: the best rendition of each ``<img>``."""
    return images_elements(nodes).where(F.col("channel_rank") == 3)


def images_other(nodes: DataFrame) -> DataFrame:
    """Channels 4 to 7: sources, posters, inline backgrounds and anchors to image files."""
    return images_elements(nodes).where(F.col("channel_rank") > 3)


def drop_junk_images(images: DataFrame) -> DataFrame:
    """Chrome, trackers, placeholders and tiny images go; logos are marked."""
    context = F.coalesce("context", F.lit(""))
    junk = (
        F.col("url").rlike("(?i)^data:")
        | (F.col("url").rlike(r"(?i)\.svg(\?|$)") & ~context.rlike("(?i)photo|gallery|hero"))
        | F.col("url").rlike(JUNK_URL)
        | F.coalesce(F.col("width") <= 100, F.lit(False))
        | F.coalesce(F.col("height") <= 100, F.lit(False))
        | (F.col("junk_context") & (F.col("channel") != "meta:og:image"))
    )
    return images.where(~junk).withColumn(
        "is_logo", context.rlike(LOGO_CONTEXT) & ~context.rlike("(?i)gallery")
    )


def dedupe_images(images: DataFrame) -> DataFrame:
    """One row per image identity: better URL, largest size, union of the signals, earliest position.

    The fold runs over the renditions of one image on one page, in document order.
    """
    fields = (
        "ord", "url", "width", "height", "alt", "context", "selector", "channel", "trust", "in_gallery", "in_hero",
        "is_logo",
    )

    def merge(a: Column, c: Column) -> Column:
        better = variant_score(c["url"], c["width"], c["trust"]) > variant_score(a["url"], a["width"], a["trust"])
        return F.struct(
            a["ord"].alias("ord"),
            F.when(better, c["url"]).otherwise(a["url"]).alias("url"),
            F.greatest(a["width"], c["width"]).alias("width"),
            F.greatest(a["height"], c["height"]).alias("height"),
            F.when(a["alt"] != "", a["alt"]).otherwise(c["alt"]).alias("alt"),
            F.when(a["context"] == c["context"], a["context"])
            .otherwise(F.trim(F.concat(a["context"], F.lit(" "), c["context"]))).alias("context"),
            F.coalesce(a["selector"], c["selector"]).alias("selector"),
            F.when(a["trust"] >= c["trust"], a["channel"]).otherwise(c["channel"]).alias("channel"),
            F.greatest(a["trust"], c["trust"]).alias("trust"),
            (a["in_gallery"] | c["in_gallery"]).alias("in_gallery"),
            (a["in_hero"] | c["in_hero"]).alias("in_hero"),
            (a["is_logo"] | c["is_logo"]).alias("is_logo"),
        )

    grouped = images.withColumn("identity", image_identity(F.col("url"))).groupBy(*KEYS, "identity").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("all")
    )
    folded = F.aggregate(
        F.slice(F.col("all"), F.lit(2), F.size("all")), F.element_at("all", 1), merge
    )
    return grouped.select(*KEYS, "identity", folded.alias("m")).select(*KEYS, "identity", "m.*")


def harvest_images(nodes: DataFrame, bases: DataFrame, meta: DataFrame, entries: DataFrame) -> DataFrame:
    """Every image of a page or scope, deduplicated, with its document position ``ord`` from 0."""
    raw = (
        images_meta(meta).unionByName(images_structured(entries)).unionByName(images_elements(nodes))
    )
    order = W.partitionBy(*KEYS).orderBy("channel_rank", "node_id", "at")
    placed = (
        raw.join(bases, "page_id")
        .withColumn("url", absolutize(F.col("raw_url"), F.col("base_url")))
        .where(F.col("url").isNotNull())
        .withColumn("ord", F.row_number().over(order) - 1)
    )
    return dedupe_images(drop_junk_images(placed))


@memo
def main_score() -> Column:
    """Fitness as the one main image of a page."""
    channel = F.col("channel")
    area = F.coalesce("width", F.lit(0.0)) * F.coalesce("height", F.lit(0.0))
    return (
        F.col("trust")
        + F.when(channel.startswith("meta:og:image"), 0.6).otherwise(0.0)
        + F.when(channel.contains("jsonld") | channel.contains("microdata"), 0.35).otherwise(0.0)
        + F.when(F.col("in_hero"), 0.25).otherwise(0.0)
        - F.when(F.col("in_gallery"), 0.1).otherwise(0.0)
        + F.when(F.col("ord") <= 3, 0.15).otherwise(0.0)
        + F.when(area > 300000, 0.15).otherwise(0.0)
    )


def rank_main(images: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Adds ``main_score`` and ``rank`` (0 is best); logos are out."""
    scored = images.where(~F.col("is_logo")).withColumn("main_score", main_score())
    return scored.withColumn(
        "rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("main_score"), "ord")) - 1
    )


def rank_gallery(images: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Adds ``rank`` in document order: gallery images if there are two, else all; no logos, no previews."""
    in_gallery = F.count_if("in_gallery").over(W.partitionBy(*by))
    pool = (
        images.withColumn("galleried", in_gallery)
        .where(((F.col("galleried") < 2) | F.col("in_gallery")) & ~F.col("is_logo") & ~F.col("channel").startswith("meta:"))
        .drop("galleried")
    )
    return pool.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("ord")) - 1)
