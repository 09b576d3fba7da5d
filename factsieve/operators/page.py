"""The page model: element rows to meta, blocks, label/value pairs, links and text.

Every table is keyed by ``(page_id, scope_id)``. ``scope_id`` is 0 for the whole page, or the ``node_id``
of one repeated element when that element is read as a page of its own. Node tables arrive hash-partitioned
by ``page_id`` (see :func:`stage_nodes`), so the windows, joins and aggregations here need no further shuffle;
no group is larger than one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions.text import squish, squish_block, truncate
from factsieve.functions.urls import absolutize, normalize_url
from factsieve.sources.staging import bucketed
from factsieve.plans.options import NO_LIMIT

KEYS = ["page_id", "scope_id"]

# ---- fixed values ---------------------------------------------------------------------------
BLOCK_TAGS = (
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dd", "dt", "td", "th", "address", "figcaption", "blockquote",
    "span", "div", "a", "strong", "b", "em", "label", "time", "small",
)
PREFIX_TAGS = ("p", "li", "div", "span", "address")
LEAD_TAGS = ("strong", "b", "span", "label", "em", "i")
INLINE_PAIR = r"^([A-Za-z][A-Za-z ./&'-]{1,40}?)\s*[:：]\s*(.{2,300})$"
PAIR_KINDS = ("dl", "table", "sibling", "inline", "prefix")
# ---------------------------------------------------------------------------------------------


def attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def attr_text(name: str) -> Column:
    return F.coalesce(attr(name), F.lit(""))


def inside(kind: str) -> Column:
    """Is the element within (or itself) an enclosing element of this kind, seen from its scope?"""
    return (F.col(f"a_{kind}") > 0) & (F.col(f"a_{kind}") >= F.col("scope_id"))


def own_parent(name: str) -> Column:
    """A parent attribute, hidden when the parent lies outside the scope."""
    return F.when(F.col("parent_id") >= F.col("scope_id"), F.coalesce(F.col(name), F.lit(""))).otherwise(F.lit(""))


def class_list(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), F.lit(0))


def selector() -> Column:
    """``tag#id``, ``tag.c1.c2`` or ``tag``."""
    return selector_of(F.col("tag"), attr("class"), attr("id"))


def selector_of(tag: Column, of_class: Column, html_id: Column) -> Column:
    classes = F.array_join(F.slice(class_list(of_class), 1, 2), ".")
    return (
        F.when(F.coalesce(html_id, F.lit("")) != "", F.concat(tag, F.lit("#"), html_id))
        # most elements have no class or one, which needs no list
        .when(F.coalesce(of_class, F.lit("")) == "", tag)
        .when(~of_class.rlike(r"\s"), F.concat(tag, F.lit("."), of_class))
        .when(classes != "", F.concat(tag, F.lit("."), classes))
        .otherwise(tag)
    )


def stage_nodes(nodes: DataFrame, buckets: int | None = None, placed: bool = False) -> DataFrame:
    """Store element rows by page: every operator below reads this table's columns that it needs.

    ``placed`` says that they were made of pages dealt to as many tasks as there are buckets.
    """
    return bucketed(nodes, "page_id", placed=placed, buckets=buckets)


def page_scope(nodes: DataFrame) -> DataFrame:
    """Element rows of whole pages (``scope_id`` 0)."""
    return nodes.withColumn("scope_id", F.lit(0))


def nested_levels(items: DataFrame) -> DataFrame:
    """``items(page_id, node_id, last_desc)`` with ``level``: how many items enclose each, itself included.

    Items are intervals of document order, nested or apart, so the level is a running sum of openings less closings.
    """
    opens = items.select("page_id", F.col("node_id").alias("at"), F.lit(1).alias("step"), "node_id", "last_desc")
    closes = items.select("page_id", (F.col("last_desc") + 1).alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("int").alias("node_id"), F.lit(None).cast("int").alias("last_desc"))
    running = W.partitionBy("page_id").orderBy("at", "step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return opens.unionByName(closes).withColumn("level", F.sum("step").over(running)).where("step = 1").select("page_id", "node_id", "last_desc", "level")


def scope_members(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """``(page_id, node_id, scope_id)``: every element with each item it lies in, by a sweep in document order.

    At any element at most one item of each level is open, and it is the last of its level to have begun. Elements are
    looked at once for each level their page has; nothing is compared with every item.
    """
    levels = nested_levels(items)
    depth = levels.groupBy("page_id").agg(F.max("level").alias("levels"))
    places = nodes.select("page_id", "node_id").join(depth, "page_id").select("page_id", "node_id", F.explode(F.expr("sequence(1L, levels)")).alias("level"), F.lit(None).cast("struct<node_id:int,last_desc:int>").alias("item"))
    starts = levels.select("page_id", "node_id", "level", F.struct("node_id", "last_desc").alias("item"))
    order = W.partitionBy("page_id", "level").orderBy("node_id", F.col("item").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = places.unionByName(starts).select("page_id", "node_id", F.col("item").isNull().alias("element"), F.last("item", ignorenulls=True).over(order).alias("open"))
    return swept.where(F.col("element") & (F.col("open.last_desc") >= F.col("node_id"))).select("page_id", "node_id", F.col("open.node_id").alias("scope_id"))


def item_scopes(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Element rows re-keyed so that each ``items(page_id, node_id, last_desc)`` row is a page of its own."""
    return nodes.drop("scope_id").join(scope_members(nodes, items), ["page_id", "node_id"])


def text_nodes(nodes: DataFrame) -> DataFrame:
    """Elements whose text counts: scripts, styles, embeds and the like are left out."""
    return nodes.where("content")


def base_urls(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(page_id, base_url)``: the first ``<base href>`` resolved, else the final URL."""
    first = nodes.where((F.col("tag") == "base") & attr("href").isNotNull()).groupBy("page_id").agg(
        F.min_by(attr("href"), "node_id").alias("href")
    )
    located = pages.select("page_id", F.coalesce("final_url", "url").alias("page_url"))
    return located.join(first, "page_id", "left").select(
        "page_id",
        F.coalesce(
            F.when(F.col("href").isNotNull(), absolutize(F.col("href"), F.col("page_url"))), F.col("page_url")
        ).alias("base_url"),
    )


def page_meta(nodes: DataFrame) -> DataFrame:
    """``(key, value)``: the first non-empty value of each meta name and ``link:<rel>``."""
    name = F.coalesce(
        F.nullif(attr_text("property"), F.lit("")), F.nullif(attr_text("name"), F.lit("")), attr_text("itemprop")
    )
    named = nodes.where(F.col("tag").isin("meta", "link")).select(
        *KEYS, "node_id",
        F.when(F.col("tag") == "meta", F.trim(F.lower(name)))
        .when(F.trim(attr_text("rel")) != "", F.concat(F.lit("link:"), F.trim(F.lower(attr_text("rel")))))
        .otherwise(F.lit("")).alias("key"),
        F.when(F.col("tag") == "meta", squish(attr_text("content"))).otherwise(F.trim(attr_text("href"))).alias("value"),
        (F.when(F.col("tag") == "meta", attr_text("content")).otherwise(attr_text("href")) != "").alias("given"),
    )
    return (
        named.where((F.col("key") != "") & F.col("given"))
        .groupBy(*KEYS, "key")
        .agg(F.min_by("value", "node_id").alias("value"), F.min("node_id").alias("node_id"))
    )


def page_title(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("tag") == "title").groupBy(*KEYS).agg(
        squish(F.min_by("full_text", "node_id")).alias("title")
    )


def boilerplate_text(nodes: DataFrame) -> DataFrame:
    """``(chrome_text)``: the distinct lower-cased texts of the chrome containers, one per line."""
    chrome = nodes.where(
        F.col("content") & (F.col("a_chrome") == F.col("node_id")) & (F.coalesce("full_text", F.lit("")) != "")
    )
    distinct = chrome.groupBy(*KEYS, F.lower("full_text").alias("line")).agg(F.min("node_id").alias("at"))
    return distinct.groupBy(*KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
        .alias("chrome_text")
    )


def blocks(nodes: DataFrame) -> DataFrame:
    """Visible text blocks; ``pos``, the element's number, puts them in document order."""
    text = F.when(F.col("n_kids") == 0, F.col("full_text")).otherwise(F.col("own_text"))
    found = (
        nodes.where(F.col("content") & F.col("tag").isin(*BLOCK_TAGS))
        .withColumn("text", text)
        .where(F.col("text") != "")
    )
    return found.select(
        *KEYS, "node_id", F.col("node_id").alias("pos"), "text", "full_text", "tag",
        selector().alias("selector"), squish(attr_text("class")).alias("class_name"),
        squish(attr_text("id")).alias("html_id"), squish(attr_text("itemprop")).alias("itemprop"),
        inside("chrome").alias("boilerplate"), "depth",
    )


def page_text(block_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(text)``: content blocks joined by line breaks, or the body text when there is none."""
    joined = (
        block_rows.where(~F.col("boilerplate"))
        .groupBy(*KEYS)
        .agg(
            squish_block(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n"
                )
            ).alias("block_text")
        )
    )
    # every page has a first element and every scope its root, so no page or scope is lost
    outer = nodes.where((F.col("tag") == "body") | (F.col("node_id") == F.col("scope_id")) | (F.col("node_id") == 1))
    body = outer.groupBy(*KEYS).agg(
        F.max(F.when(F.col("tag") == "body", F.col("full_text"))).alias("body_text"),
        # a scope has no body of its own: its root is the whole text
        F.max(F.when(F.col("node_id") == F.col("scope_id"), F.col("full_text"))).alias("root_text"),
    )
    return body.join(joined, KEYS, "left").select(
        *KEYS,
        F.coalesce(
            F.nullif("block_text", F.lit("")), F.nullif("body_text", F.lit("")), F.col("root_text"), F.lit("")
        ).alias("text"),
    )


def page_links(nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """The edge table: one row per distinct target, first anchor's attributes, longest anchor text."""
    anchors = (
        nodes.where((F.col("tag") == "a") & attr("href").isNotNull())
        .select(
            *KEYS, "node_id", attr("href").alias("href"), F.coalesce("full_text", F.lit("")).alias("text"),
            squish(attr_text("title")).alias("title"), squish(attr_text("aria-label")).alias("aria_label"),
            squish(attr_text("rel")).alias("rel"), squish(attr_text("class")).alias("class_name"),
            inside("nav").alias("in_nav"),
        )
        .join(bases, "page_id")
        .withColumn("url", absolutize(F.col("href"), F.col("base_url")))
        .where(F.col("url").isNotNull())
        .withColumn("url_key", normalize_url(F.col("url")))
    )
    first = F.min_by(F.struct("url", "title", "aria_label", "rel", "class_name", "in_nav"), "node_id")
    return (
        anchors.groupBy(*KEYS, "url_key")
        .agg(
            first.alias("first"),
            F.max_by("text", F.struct(F.length("text"), -F.col("node_id"))).alias("text"),
            F.min("node_id").alias("node_id"),
        )
        .select(*KEYS, "url_key", "text", "node_id", "first.*")
    )


def _pair(frame: DataFrame, kind: str, label: Column, value: Column, where: Column, chrome: Column) -> DataFrame:
    return frame.select(
        *KEYS, "node_id", F.lit(PAIR_KINDS.index(kind)).alias("kind_rank"), F.lit(kind).alias("kind"),
        label.alias("label"), value.alias("value"), where.alias("selector"), chrome.alias("boilerplate"),
    )


def pairs_dl(nodes: DataFrame) -> DataFrame:
    """``<dt>`` with each ``<dd>`` that follows it."""
    rows = nodes.where(
        F.col("content") & (F.col("parent_tag") == "dl") & (F.col("tag") == "dd") & (F.col("parent_id") >= F.col("scope_id"))
        & (F.col("term") != "")
    )
    return _pair(rows, "dl", F.col("term"), F.col("full_text"), selector(), inside("chrome"))


def pairs_table(nodes: DataFrame) -> DataFrame:
    """Table rows of exactly two cells."""
    cells = nodes.where(
        F.col("content") & F.col("tag").isin("th", "td") & (F.col("parent_tag") == "tr")
        & (F.col("parent_id") >= F.col("scope_id"))
    ).withColumn("selector", selector()).withColumn("chrome", inside("chrome"))
    rows = (
        cells.groupBy(*KEYS, F.col("parent_id").alias("node_id"))
        .agg(
            F.count("*").alias("cells"), F.min_by("full_text", F.col("node_id")).alias("first"),
            F.max_by("full_text", F.col("node_id")).alias("second"),
            F.max_by("selector", F.col("node_id")).alias("cell_selector"), F.bool_or("chrome").alias("chrome"),
        )
        .where("cells = 2")
    )
    return _pair(rows, "table", F.col("first"), F.col("second"), F.col("cell_selector"), F.col("chrome"))


def pairs_sibling(nodes: DataFrame) -> DataFrame:
    """A label-like element and the element right after it, which the parser has looked up."""
    rows = nodes.where((F.col("next_text") != "") & (F.col("parent_id") >= F.col("scope_id")))
    after = selector_of(F.col("next_tag"), F.col("next_class"), F.col("next_id"))
    return _pair(rows, "sibling", F.col("full_text"), F.col("next_text"), after, inside("chrome"))


def pairs_inline(block_rows: DataFrame) -> DataFrame:
    """``Label: value`` inside one block."""
    rows = block_rows.where(F.col("text").rlike(INLINE_PAIR))
    return _pair(
        rows, "inline", F.regexp_extract("text", INLINE_PAIR, 1), F.regexp_extract("text", INLINE_PAIR, 2),
        F.col("selector"), F.col("boilerplate"),
    )


def pairs_prefix(nodes: DataFrame) -> DataFrame:
    """A container whose first child is the label of the text that follows."""
    rows = (
        nodes.where(
            F.col("content") & F.col("tag").isin(*PREFIX_TAGS) & F.col("lead_tag").isin(*LEAD_TAGS)
            & F.length("lead_text").between(1, 40)
        )
        .withColumn("rest", squish(F.substring(F.col("full_text"), F.length("lead_text") + 1, F.length("full_text"))))
        .withColumn("rest", F.regexp_replace("rest", r"^[:：\-–—]\s*", ""))
        .where(F.col("rest") != "")
    )
    return _pair(rows, "prefix", F.col("lead_text"), F.col("rest"), selector(), inside("chrome"))


def pairs(nodes: DataFrame, block_rows: DataFrame, max_label: int = NO_LIMIT, max_value: int = NO_LIMIT) -> DataFrame:
    """All label/value pairs, cleaned, in shape-then-document order; those longer than a limit go."""
    rows = (
        pairs_dl(nodes).unionByName(pairs_table(nodes)).unionByName(pairs_sibling(nodes))
        .unionByName(pairs_inline(block_rows)).unionByName(pairs_prefix(nodes))
    )
    return (
        rows.withColumn("label", F.regexp_replace(squish(F.col("label")), r"[:：\-–—]\s*$", ""))
        .withColumn("value", squish(F.col("value")))
        .where(
            (F.col("label") != "") & (F.col("value") != "") & (F.length("label") <= max_label)
            & (F.length("value") <= max_value) & (F.lower("label") != F.lower("value"))
        )
    )


def page_digest(
    titles: DataFrame, meta: DataFrame, pair_rows: DataFrame, texts: DataFrame,
    max_chars: int = NO_LIMIT, max_pairs: int = NO_LIMIT, max_value: int = NO_LIMIT,
) -> DataFrame:
    """``(digest)``: title, social title, description, labelled values and the text of a page, whole unless limits are set."""
    named = meta.where(F.col("key").isin("og:title", "og:description", "description")).groupBy(*KEYS).agg(
        F.max(F.when(F.col("key") == "og:title", F.col("value"))).alias("og_title"),
        F.coalesce(
            F.max(F.when(F.col("key") == "og:description", F.nullif("value", F.lit("")))),
            F.max(F.when(F.col("key") == "description", F.nullif("value", F.lit("")))),
        ).alias("meta_description"),
    )
    line = F.concat("label", F.lit(": "), truncate(F.col("value"), max_value))
    labelled = (
        pair_rows.where(~F.col("boilerplate")).groupBy(*KEYS)
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("kind_rank", "node_id", line.alias("line")))), 1, max_pairs).alias("rows"))
        .select(*KEYS, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("lines"))
    )
    def part(prefix: str, c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(prefix), F.col(c)))

    digest = F.concat_ws(
        "\n\n", part("TITLE: ", "title"), part("OG_TITLE: ", "og_title"),
        part("META_DESCRIPTION: ", "meta_description"), part("LABELLED VALUES:\n", "lines"),
        F.concat(F.lit("PAGE TEXT:\n"), F.col("text")),
    )
    joined = texts.join(titles, KEYS, "left").join(named, KEYS, "left").join(labelled, KEYS, "left")
    return joined.select(
        *KEYS,
        F.when(F.length(digest) <= max_chars, digest)
        .otherwise(F.concat(F.substring(digest, 1, max_chars - 1), F.lit("…"))).alias("digest"),
    )
