"""Page classification: access restrictions, login walls, script-only pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.text import squish
from factsieve.operators.page import attr, attr_text

# ---- fixed values ---------------------------------------------------------------------------
CAPTCHA_MARKERS = (
    "g-recaptcha", "grecaptcha", "recaptcha/api.js", "hcaptcha.com", "h-captcha", "cf-challenge", "cf_chl_opt",
    "__cf_chl", "challenges.cloudflare.com", "turnstile", "px-captcha", "perimeterx", "datadome", "incapsula",
    "distil_r_captcha",
)
CAPTCHA_PHRASES = (
    "just a moment", "checking your browser", "verify you are human", "are you a robot",
    "confirm you are not a robot", "enable javascript and cookies to continue", "unusual traffic", "access denied",
)
PAYWALL_PHRASES = (
    "subscribe to continue reading", "subscribers only", "this article is for subscribers", "become a member to read",
)
STATUS_TYPES = ((401, "login_required"), (402, "paywall"), (403, "blocked"), (429, "rate_limited"))
CHALLENGE_CHARS, LOGIN_CHARS = 1200, 2500
MOUNT_POINTS = ("#root", "#app", "#__next", "[data-reactroot]", "#__nuxt", "app-root")
LAZY_MARKS = ("data-src", "data-lazy", "data-lazy-src", "data-original", "data-srcset")
# ---------------------------------------------------------------------------------------------


def _first(haystack: Column, needles: tuple[str, ...]) -> Column:
    """First listed needle the text contains, else null."""
    return F.coalesce(*[F.when(haystack.contains(n), F.lit(n)) for n in needles])


def restriction_type(status: Column, html: Column, text: Column) -> Column:
    """``struct(type, marker)`` of the first restriction sign, else null."""
    by_status = F.coalesce(*[F.when(status == code, F.lit(kind)) for code, kind in STATUS_TYPES])
    marker = _first(F.lower(html), CAPTCHA_MARKERS)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    phrase = F.when(F.length(lowered) < CHALLENGE_CHARS, _first(lowered, CAPTCHA_PHRASES))
    paywall = _first(lowered, PAYWALL_PHRASES)

    def found(kind: Column, sign: Column) -> Column:
        return F.struct(kind.alias("type"), sign.alias("marker"))

    return (
        F.when(by_status.isNotNull(), found(by_status, status.cast("string")))
        .when(marker.isNotNull(), found(F.lit("captcha"), marker))
        .when(phrase.isNotNull(), found(F.lit("captcha"), phrase))
        .when(paywall.isNotNull(), found(F.lit("paywall"), paywall))
    )


def restriction(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """``(page_id, type, marker)`` of restricted pages; the text must be on the page row's side of the join."""
    joined = pages.join(texts.select("page_id", "text"), "page_id", "left")
    return joined.select("page_id", restriction_type(F.col("status"), F.col("html"), F.col("text")).alias("r")).where(
        F.col("r").isNotNull()
    ).select("page_id", "r.type", "r.marker")


def login_wall(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pages with a password field and little else."""
    fields = nodes.where((F.col("tag") == "input") & (F.lower(attr_text("type")) == "password")).select("page_id").distinct()
    return texts.where(F.length("text") <= LOGIN_CHARS).join(fields, "page_id", "left_semi").select(
        "page_id", F.lit("login_required").alias("type"), F.lit("password field").alias("marker")
    )


def usable_pages(pages: DataFrame, nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits off challenge and login pages; other restrictions are reported but the page is still read."""
    found = restriction(pages, texts).withColumn("rank", F.lit(0)).unionByName(
        login_wall(nodes, texts).withColumn("rank", F.lit(1))
    )
    errors = found.groupBy("page_id").agg(F.min_by(F.struct("type", "marker"), "rank").alias("e")).select("page_id", "e.*")
    dropped = errors.where(F.col("type").isin("captcha", "login_required"))
    return pages.join(dropped, "page_id", "left_anti"), errors


def needs_rendering(pages: DataFrame, nodes: DataFrame, texts: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """``(page_id, needed, reason)``: does the static HTML look inert? ``unresolved(page_id)`` lacks labels."""
    tag, html_id = F.col("tag"), attr_text("id")
    empty = (F.col("n_kids") == 0) & (F.length(F.coalesce("full_text", F.lit(""))) < 40)

    def mount(name: str) -> Column:
        if name.startswith("#"):
            here = html_id == name[1:]
        elif name.startswith("["):
            here = attr(name[1:-1]).isNotNull()
        else:
            here = tag == name
        return F.min_by(F.when(here, empty), F.when(here, F.col("node_id")))

    lazy = F.lit(False)
    for name in LAZY_MARKS:
        lazy = lazy | attr(name).isNotNull()
    facts = nodes.groupBy("page_id").agg(
        *[mount(m).alias(f"mount_{i}") for i, m in enumerate(MOUNT_POINTS)],
        F.bool_or((tag == "noscript") & F.lower(F.coalesce("raw_text", F.lit(""))).contains("enable javascript")).alias("asks"),
        F.count_if(tag == "img").alias("images"), F.count_if(lazy).alias("lazy"),
    )
    joined = (
        pages.select("page_id", F.length(F.coalesce("html", F.lit(""))).alias("html_chars"))
        .join(facts, "page_id", "left").join(texts.select("page_id", F.length(squish(F.col("text"))).alias("chars")), "page_id", "left")
        .fillna(0, ["chars", "images", "lazy"])
    )
    if unresolved is not None:
        joined = joined.join(unresolved.select("page_id").distinct().withColumn("open", F.lit(True)), "page_id", "left")
    else:
        joined = joined.withColumn("open", F.lit(None).cast("boolean"))
    ratio = F.col("chars") / F.col("html_chars")
    reason = F.when(F.col("html_chars") == 0, F.lit("empty response body"))
    for i, name in enumerate(MOUNT_POINTS):
        reason = reason.when(F.col(f"mount_{i}"), F.lit(f"empty SPA mount point ({name})"))
    reason = (
        reason.when(F.col("asks"), F.lit("<noscript> asks for JavaScript"))
        .when(F.col("chars") < 500, F.concat(F.lit("very little visible text ("), "chars", F.lit(" chars)")))
        .when((F.col("html_chars") > 20000) & (ratio < 0.06), F.concat(F.lit("low text-to-markup ratio ("), F.format_number(ratio, 3), F.lit(")")))
        .when((F.col("images") == 0) & (F.col("lazy") >= 3), F.concat("lazy", F.lit(" lazy-loaded images and no <img src>")))
        .when(F.col("open"), F.lit("fields unresolved in static HTML — retrying with a browser"))
    )
    return joined.select("page_id", reason.isNotNull().alias("needed"), reason.alias("reason"))
