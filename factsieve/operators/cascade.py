"""The resolution cascade: page relations x field specs to candidate values, then validation and dedupe.

Field specs ride along as one array literal that each generator opens per row and filters by kind, so a
generator is a narrow pass over its relation whatever the number of labels: no join, no pairing table. Only
generators some requested kind needs enter the plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factsieve.functions import kinds as K
from factsieve.functions.memo import once
from factsieve.functions.ontology import NARROW_CHANNELS
from factsieve.functions.text import alnum, gram_dice, grams, let, squish, token_overlap, tokens
from factsieve.functions.urls import absolutize, url_origin
from factsieve.operators.images import rank_gallery, rank_main
from factsieve.operators.page import KEYS, attr, attr_text, inside, selector
from factsieve.operators.tables import PageTables

# ---- fixed values: confidence by trust tier, generic keys, per-kind extra keys ---------------
TIER = {
    "entry_primary": 0.95, "entry": 0.88, "microdata": 0.86, "meta": 0.85, "semantic": 0.8, "pair": 0.7,
    "attribute": 0.62, "proximity": 0.52, "pattern": 0.45,
}
MARK = "\x01"  # set around a match where a text is cut up
GENERIC_KEYS = ("name", "url", "description", "image", "title", "headline", "identifier")
KIND_KEYS = {
    "address": "address streetaddress", "phone": "telephone phone", "email": "email",
    "price": "price lowprice pricerange", "latitude": "latitude", "longitude": "longitude",
    "hours": "openinghours openinghoursspecification", "rating": "ratingvalue starrating",
    "description": "description", "name": "name legalname headline",
}
GENERIC_IMAGE_WORDS = (
    "image images photo photos picture pictures pic pics gallery galleries media main primary all url urls link links"
).split()
WEBSITE_WORDS = ("website", "url", "homepage", "site", "web", "link")
FOOTER_FRIENDLY = ("phone", "email", "social", "address", "hours")
# ---------------------------------------------------------------------------------------------

TEXT_KINDS = ("text", "number", "rating", "date")
IMAGE_KINDS = ("image", "image_list")
VALUE_KINDS = tuple(k for k in K.KINDS if k not in IMAGE_KINDS)
PAIR_KINDS = tuple(k for k in VALUE_KINDS if k != "social")
PATTERNS = {"phone": K.PHONE_PATTERN, "email": K.EMAIL_PATTERN, "price": K.PRICE_PATTERN, "hours": K.HOURS_PATTERN}

RAW = (
    "field_key", "type", "value", "confidence", "method", "selector", "context", "boilerplate", "ord", "seq",
)


_SPEC_SCHEMA = (
    "array<struct<key:string,label:string,label_lower:string,type:string,plural:boolean,social:string,bare:string,"
    "label_tokens:array<string>,keywords:array<string>,spellings:array<string>,hunting:array<string>,"
    "near_words:array<string>,narrow:array<string>,schema_keys:array<string>,wanted:array<string>,"
    "meta_keys:array<string>,entity_types:array<string>,attr_hints:array<string>,"
    "label_grams:array<string>,schema_grams:array<struct<bare:string,grams:array<string>>>>>"
)


def _bare(word: str) -> str:
    return re.sub("[^a-z0-9]+", "", word.lower())


def _grams(bare: str) -> list[str]:
    padded = f"  {bare} "
    return list(dict.fromkeys(padded[i:i + 3] for i in range(len(padded) - 2)))


def spec_json(specs: Iterable[Row]) -> str:
    rows = []
    for s in specs:
        vocabulary = s.label_keywords if s.exclusive else s.keywords
        rows.append(
            dict(
                key=s.key, label=s.label, label_lower=s.label.lower(), type=s.type, plural=s.plural, social=s.social,
                label_tokens=s.label_tokens, keywords=s.keywords, spellings=[k for k in vocabulary if len(k) >= 2],
                hunting=[k for k in vocabulary if len(k) >= 3], near_words=[k for k in s.keywords if len(k) >= 3],
                narrow=s.narrow, schema_keys=s.schema_keys,
                wanted=list(dict.fromkeys([*s.schema_keys, *KIND_KEYS.get(s.type, "").split()])),
                meta_keys=s.meta_keys, entity_types=s.entity_types, attr_hints=s.attr_hints, bare=_bare(s.label),
                label_grams=_grams(_bare(s.label)),
                schema_grams=[dict(bare=_bare(k), grams=_grams(_bare(k))) for k in s.schema_keys],
            )
        )
    return json.dumps(rows)


def spec_literal(specs: Iterable[Row]) -> Column:
    """Field specs as one constant array of structs."""
    return F.from_json(F.lit(spec_json(specs)), _SPEC_SCHEMA)


def open_specs(
    frame: DataFrame, specs: list[Row], kinds: Iterable[str], score: Callable[[Column], dict[str, Column] | Column]
) -> DataFrame:
    """Each row once per field spec that scores above zero.

    The specs are tested inside one array expression, so a row never multiplies before the test and the score
    is computed once. Adds ``s`` (key, type, plural), ``score`` and whatever else ``score`` returns.
    """
    chosen = [s for s in specs if s.type in set(kinds)]

    def build() -> tuple[Column, list[str]]:
        names: list[str] = []

        def test(s: Column) -> Column:
            made = score(s)
            made = made if isinstance(made, dict) else {"score": made}
            names[:] = list(made)
            return F.struct(
                F.struct(s["key"].alias("key"), s["type"].alias("type"), s["plural"].alias("plural")).alias("s"),
                *[c.alias(n) for n, c in made.items()],
            )

        return F.filter(F.transform(spec_literal(chosen), test), lambda x: x["score"] > 0), names

    code = score.__code__
    kept, names = once(("open_specs", code.co_filename, code.co_firstlineno, spec_json(chosen)), build)
    opened = frame.select("*", F.explode(kept).alias("x"))
    return opened.select(
        *[c for c in frame.columns if c not in names], F.col("x.s").alias("s"), *[F.col(f"x.{n}").alias(n) for n in names]
    )


def yes(condition: Column) -> Column:
    """A test as a score."""
    return F.when(condition, 1.0).otherwise(0.0)


def every(_: Column) -> Column:
    """Every spec of the kind takes the row."""
    return F.lit(1.0)


# ---- matching expressions -------------------------------------------------------------------

def any_of(words: Iterable[str]) -> str:
    """One pattern that finds any of the words, those with the same first letter tried together; none: finds nothing."""
    groups: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        groups.setdefault(w[0], []).append(re.escape(w[1:]))
    tried = "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in groups.items())
    return f"(?=[{''.join(map(re.escape, groups))}])(?:{tried})" if groups else "(?!)"


def _near_label(specs: list[Row]) -> Column:
    """Can the label match any of the specs? A cheap test that lets through whatever :func:`label_match` scores above zero.

    It needs the very label, a spelling, a word of the label or a hunting word in the text, or a similarity of 0.7: more than half of
    the label's trigrams, and so one besides the first, which is two blanks and a letter.
    """
    rows = json.loads(spec_json(specs))
    words = [w for s in rows for w in (s["label_lower"], *s["spellings"], *s["label_tokens"], *s["hunting"]) if w]
    ends = "|".join(
        f"^{re.escape(g[1:].strip())}{'$' if g[2] == ' ' else ''}" if g[0] == " " else f"{re.escape(g[:2])}$"
        for g in dict.fromkeys(g for s in rows for g in s["label_grams"][1:] if " " in g)) or "(?!)"
    middles = any_of(g for s in rows for g in s["label_grams"][1:] if " " not in g)
    return F.col("m_text").rlike(any_of(words)) | F.col("m_bare").rlike(f"{ends}|{middles}")


def with_label(frame: DataFrame, label: Column, specs: list[Row]) -> DataFrame:
    """Prepares a page label for :func:`label_match` with these specs: its text, and its words where it may match, once per row."""
    said, near = F.col("m_said"), F.col("m_near")
    text = F.when(said.endswith(":") | said.endswith("："), F.substring(said, F.lit(1), F.length(said) - 1)).otherwise(said)
    return (
        frame.withColumn("m_said", F.lower(squish(label)))
        .withColumn("m_text", F.when(F.length(text) <= 80, text).otherwise(F.lit("")))
        .withColumn("m_bare", F.regexp_replace("m_text", "[^a-z0-9]+", ""))
        .withColumn("m_near", _near_label(specs))
        .withColumns({"m_tokens": F.when(near, tokens(F.col("m_text"))), "m_grams": F.when(near, grams(F.col("m_bare")))})
    )


def near_dice(word_a: Column, grams_a: Column, word_b: Column, grams_b: Column) -> Column:
    """Trigram similarity where it can reach 0.7 at all (twice the smaller set over both sizes), else 0."""
    reachable = 2.0 * F.least(F.size(grams_a), F.size(grams_b)) / (F.size(grams_a) + F.size(grams_b)) >= 0.7
    return F.when(reachable, gram_dice(word_a, grams_a, word_b, grams_b)).otherwise(F.lit(0.0))


def label_match(spec: Column) -> Column:
    """How well the prepared label names a field: 0 (not at all) to 1.1 (the very label)."""
    text, words = F.col("m_text"), F.col("m_tokens")

    def scored(cover: Column) -> Column:
        def by_hits(hits: Column) -> Column:
            longest = F.array_max(F.transform(hits, F.length))
            strength = (
                F.lit(0.45) + F.least(F.lit(0.3), longest / 12 * 0.3)
                + F.least(F.lit(0.25), F.size(hits) / F.greatest(F.lit(1), F.size(words)) * 0.5)
            )
            sim = near_dice(F.col("m_bare"), F.col("m_grams"), spec["bare"], spec["label_grams"])
            return (
                F.when(F.size(hits) > 0, F.least(F.lit(1.0), strength))
                .when(cover >= 0.5, cover * 0.6)
                .otherwise(let(sim, lambda x: F.when(x >= 0.7, x * 0.7).otherwise(F.lit(0.0))))
            )

        return F.when(cover >= 0.99, F.lit(1.0)).otherwise(
            let(F.filter(spec["hunting"], lambda k: text.contains(k)), by_hits)
        )

    return (
        F.when(~F.col("m_near") | (text == "") | (F.size(words) == 0), F.lit(0.0))
        .when(text == spec["label_lower"], F.lit(1.1))
        .when(F.array_contains(spec["spellings"], text), F.lit(1.05))
        .otherwise(let(token_overlap(spec["label_tokens"], words), scored))
    )


def channel_ok(context: Column, spec: Column) -> Column:
    """Named channels (fax, WhatsApp, ...) need their name nearby; plain labels refuse any channel name."""
    def check(text: Column) -> Column:
        named = F.exists(spec["narrow"], lambda c: text.contains(c))
        foreign = text.rlike("|".join(NARROW_CHANNELS))
        return F.when(F.size(spec["narrow"]) > 0, named).otherwise(~foreign)

    return let(F.lower(squish(context)), check)


def split_list(c: Column) -> Column:
    """The values of one cell, when it clearly holds several short ones."""
    def parts_of(s: Column) -> Column:
        parts = F.filter(
            F.transform(F.split(s, r"\s*[,;•·|–]\s*|\s{3,}|\s*/\s*(?=[A-Z])"), squish), lambda p: p != ""
        )
        return let(
            parts,
            lambda p: F.when(
                (F.length(s) >= 8) & (F.size(p) >= 2) & F.forall(p, lambda x: F.length(x) <= 80), p
            ).otherwise(F.array(s)),
        )

    return let(squish(c), parts_of)


def _emit(
    frame: DataFrame, rank: int, value: Column, confidence: Column, method: Column, ord: Column,
    seq: list[Column], selector: Column | None = None, context: Column | None = None,
    boilerplate: Column | None = None,
) -> DataFrame:
    s = F.col("s")
    return frame.select(
        *KEYS, s["key"].alias("field_key"), s["type"].alias("type"), value.cast("string").alias("value"),
        confidence.cast("double").alias("confidence"), method.alias("method"),
        (F.lit(None).cast("string") if selector is None else selector).alias("selector"),
        (method if context is None else context).alias("context"),
        (F.lit(False) if boilerplate is None else boilerplate).alias("boilerplate"),
        ord.cast("int").alias("ord"), F.concat(F.array(F.lit(rank)), *[c if isinstance(c, Column) else c for c in seq]).alias("seq"),
    )


def _ints(*columns: str | Column) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("int") for c in columns])


# ---- generators -----------------------------------------------------------------------------

def from_structured(t: PageTables, specs: list[Row]) -> DataFrame:
    """Structured entries under a wanted or similar key; social profiles out of ``sameAs`` and ``url``."""
    entries = (
        t.entries.withColumn("bare", alnum(F.col("key"))).withColumn("bare_grams", grams(F.col("bare")))
        .withColumn("key_tokens", tokens(F.col("key"))).withColumn("place", F.lower(F.concat_ws(" ", "key", "path")))
    )
    key, primary = F.col("key"), F.col("is_primary")

    def score(s: Column) -> Column:
        def near_key(k: Column) -> Column:
            return near_dice(k["bare"], k["grams"], F.col("bare"), F.col("bare_grams"))

        narrow_ok = (F.size(s["narrow"]) == 0) | F.exists(s["narrow"], lambda c: F.col("place").contains(c))
        entity_ok = (
            (F.size(s["entity_types"]) == 0) | ~key.isin(*GENERIC_KEYS)
            | F.array_contains(s["entity_types"], F.lower("entity_type"))
        )
        similar = F.greatest(
            token_overlap(s["keywords"], F.col("key_tokens")),
            F.coalesce(F.array_max(F.transform(s["schema_grams"], near_key)), F.lit(0.0)),
        )
        tier = F.when(
            F.array_contains(s["wanted"], key), F.when(primary, TIER["entry_primary"]).otherwise(TIER["entry"])
        ).when(similar >= 0.7, TIER["entry"] * 0.85).otherwise(0.0)
        capped = F.when(F.col("source") == "microdata", F.least(tier, F.lit(TIER["microdata"]))).otherwise(tier)
        nested_name = (key == "name") & ~primary & (s["type"] == "name")
        profile = key.isin("sameas", "url") & K.is_social_profile(F.col("value"), s["social"])
        return (
            F.when(s["type"] == "social", F.when(profile, TIER["entry_primary"]).otherwise(0.0))
            .when(~(narrow_ok & entity_ok), 0.0)
            .otherwise(let(capped, lambda c: F.when((c > 0) & nested_name, c - 0.2).otherwise(c)))
        )

    rows = open_specs(entries, specs, VALUE_KINDS, score)
    method = F.concat("source", F.lit(":"), "path")
    return _emit(
        rows, 1, F.col("value"), F.col("score"), method, F.lit(0), [F.col("seq")],
        context=F.when(F.col("s.type") == "social", method).otherwise(F.col("path")),
    )


def from_meta(t: PageTables, specs: list[Row]) -> DataFrame:
    """Meta values by wanted name or by name words; coordinates out of position pairs."""
    key, value = F.col("key"), F.col("value")
    bare = F.regexp_replace(key, r"^(og|twitter|al|fb|article|product|place):", "")
    rows = t.meta.withColumn("key_tokens", tokens(bare)).join(t.bases, "page_id").withColumn(
        "located", F.coalesce(absolutize(F.col("value"), F.col("base_url")), value)
    )
    handle = F.when(
        value.rlike(r"^@?[A-Za-z0-9_]{1,15}$"), F.concat(F.lit("https://twitter.com/"), F.regexp_replace(value, "^@", ""))
    )

    def named(s: Column) -> dict[str, Column]:
        known = F.array_position(s["meta_keys"], key)
        similar = (F.size("key_tokens") > 0) & (token_overlap(F.col("key_tokens"), s["keywords"]) >= 0.8)
        profile = K.is_social_profile(F.col("located"), s["social"])
        v = (
            F.when(
                (s["type"] == "social") & s["social"].isNotNull() & ~profile,
                F.when(s["social"] == "twitter", handle),
            )
            .when(s["type"].isin("url", "social"), F.col("located"))
            .otherwise(value)
        )
        hit = (known > 0) | similar
        return {
            "score": yes(hit & v.isNotNull()), "v": F.when(hit, v),
            "rank": F.when(known > 0, known).otherwise(F.lit(1000)).cast("int"),
        }

    og = key.startswith("og:") | key.startswith("twitter:")
    out = _emit(
        open_specs(rows, specs, VALUE_KINDS, named), 2, F.col("v"),
        F.when(og, TIER["meta"]).otherwise(TIER["meta"] - 0.08), F.concat(F.lit("meta:"), key), F.lit(1),
        [_ints("rank", "node_id")], context=key,
    )
    if not any(x.type in ("latitude", "longitude") for x in specs):
        return out
    parts = F.transform(F.split(value, "[;,]"), squish)

    def placed(s: Column) -> dict[str, Column]:
        wants_lat = s["type"] == "latitude"
        v = (
            F.when(key == "place:location:latitude", F.when(wants_lat, parts[0]))
            .when(key == "place:location:longitude", F.when(~wants_lat, parts[0]))
            .when(
                key.isin("geo.position", "icbm") & (F.size(parts) >= 2),
                F.when(wants_lat, parts[0]).otherwise(F.try_element_at(parts, F.lit(2))),
            )
        )
        return {"score": yes(v.isNotNull()), "v": v}

    position = t.meta.where(key.isin("geo.position", "icbm", "place:location:latitude", "place:location:longitude"))
    return out.unionByName(
        _emit(
            open_specs(position, specs, ("latitude", "longitude"), placed), 2, F.col("v"), F.lit(TIER["meta"]),
            F.concat(F.lit("meta:"), key), F.lit(1), [_ints(F.lit(2000), "node_id")],
        )
    )


def from_canonical(t: PageTables, specs: list[Row]) -> DataFrame:
    """The site's own origin for website-like labels."""
    own = (
        t.meta.where(F.col("key").isin("link:canonical", "og:url") & (F.col("value") != ""))
        .groupBy(*KEYS).agg(F.min_by("value", F.when(F.col("key") == "link:canonical", 0).otherwise(1)).alias("own"))
        .join(t.bases, "page_id")
        .withColumn("v", url_origin(absolutize(F.col("own"), F.col("base_url"))))
    )
    rows = open_specs(
        own, specs, ["url"],
        lambda s: yes(F.col("v").isNotNull() & F.exists(s["keywords"], lambda k: k.isin(*WEBSITE_WORDS))),
    )
    return _emit(
        rows, 5, F.concat("v", F.lit("/")), F.lit(TIER["semantic"]), F.lit("link:canonical (site origin)"), F.lit(2),
        [_ints(F.lit(0))],
    )


def _parent_words() -> Column:
    """Class, id and preceding text of an anchor's parent."""
    visible = F.col("parent_id") >= F.col("scope_id")
    before = F.when(F.col("parent_prev_at") >= F.col("scope_id"), F.col("parent_prev_text"))
    return F.concat_ws(" ", F.when(visible, F.col("parent_class")), F.when(visible, F.col("parent_html_id")), before)


def from_tel_links(t: PageTables, specs: list[Row]) -> DataFrame:
    """Phone links: the printed number when it validates, else the href; numbers in WhatsApp links."""
    href, text = attr_text("href"), F.coalesce("full_text", F.lit(""))
    anchors = t.nodes.where((F.col("tag") == "a") & href.rlike("(?i)^(tel|callto|sms):|wa\\.me|api\\.whatsapp\\.com"))
    anchors = (
        anchors.withColumn("href", href).withColumn("text", text).withColumn("sel", selector())
        .withColumn("bare", F.substring_index(F.regexp_replace("href", "(?i)^(tel|callto|sms):", ""), "?", 1))
        .withColumn("printed", F.when((F.col("text") != "") & K.valid_phone(F.col("text"), F.lit("phone")), F.col("text")))
        .withColumn(
            "context",
            F.concat_ws(" ", attr_text("class"), attr_text("aria-label"), F.col("text"), squish(_parent_words())),
        )
        .withColumn("chrome", inside("fnh"))
        .select(*KEYS, "node_id", "href", "text", "sel", "bare", "printed", "context", "chrome")
    )
    tel = open_specs(
        anchors.where(F.col("href").rlike("^(tel|TEL|callto|sms):")), specs, ["phone"],
        lambda s: yes(channel_ok(F.col("context"), s)),
    )
    value = F.coalesce("printed", F.nullif("bare", F.lit("")), F.col("text"))
    out = _emit(
        tel, 3, value, F.lit(TIER["semantic"]), F.lit("a[href^=tel:]"), F.lit(3), [_ints(F.lit(0), "node_id")],
        selector=F.col("sel"), context=F.col("context"), boilerplate=F.col("chrome"),
    )
    if not any(x.type == "phone" and (x.social == "whatsapp" or "whatsapp" in x.keywords) for x in specs):
        return out
    chat = open_specs(
        anchors.where(F.col("href").rlike(r"wa\.me|api\.whatsapp\.com")).withColumn(
            "number", F.regexp_extract("href", r"(?:wa\.me/|phone=)(\+?\d[\d\s-]{6,})", 1)
        ),
        specs, ["phone"],
        lambda s: yes(
            (F.col("number") != "")
            & (F.coalesce(s["social"] == "whatsapp", F.lit(False)) | F.array_contains(s["keywords"], "whatsapp"))
        ),
    )
    return out.unionByName(
        _emit(
            chat, 3, F.col("number"), F.lit(TIER["semantic"]), F.lit("a[href*=wa.me]"), F.lit(3),
            [_ints(F.lit(1), "node_id")], selector=F.col("sel"),
        )
    )


def from_mailto(t: PageTables, specs: list[Row]) -> DataFrame:
    """Mail links."""
    href = attr_text("href")
    anchors = (
        t.nodes.where((F.col("tag") == "a") & href.rlike("^(mailto|MAILTO):"))
        .withColumn("v", F.substring_index(F.regexp_replace(href, "(?i)^mailto:", ""), "?", 1))
        .withColumn("context", F.concat_ws(" ", attr_text("class"), F.coalesce("full_text", F.lit("")), squish(_parent_words())))
        .withColumn("sel", selector()).withColumn("chrome", inside("fnh"))
        .select(*KEYS, "node_id", "v", "context", "sel", "chrome")
    )
    rows = open_specs(anchors, specs, ["email"], lambda s: yes(channel_ok(F.col("context"), s)))
    return _emit(
        rows, 3, F.col("v"), F.lit(TIER["semantic"]), F.lit("a[href^=mailto:]"), F.lit(3), [_ints("node_id")],
        selector=F.col("sel"), context=F.col("context"), boilerplate=F.col("chrome"),
    )


def from_social_links(t: PageTables, specs: list[Row]) -> DataFrame:
    """Links to a profile on the wanted network."""
    rows = open_specs(
        t.links, specs, ["social"],
        lambda s: {
            "score": yes(s["social"].isNotNull() & K.is_social_profile(F.col("url"), s["social"])), "network": s["social"],
        },
    )
    first_class = F.try_element_at(F.split("class_name", r"\s+"), F.lit(1))
    return _emit(
        rows, 3, F.col("url"), F.lit(TIER["semantic"]), F.concat(F.lit("a[href] ("), "network", F.lit(" profile)")),
        F.lit(3), [_ints("node_id")],
        selector=F.when(F.col("class_name") != "", F.concat(F.lit("a."), first_class)).otherwise(F.lit("a[href]")),
    )


def from_address(t: PageTables, specs: list[Row]) -> DataFrame:
    """Address elements (the innermost ones) and titles of map embeds."""
    classed = attr_text("class").contains("address") | F.array_contains(F.split(attr_text("class"), r"\s+"), "adr")
    marked = (F.col("tag") == "address") | (attr_text("itemprop") == "address")
    found = t.nodes.where(marked | attr_text("itemtype").contains("PostalAddress") | classed).select(
        *KEYS, "node_id", "last_desc", "full_text", marked.alias("semantic"), selector().alias("sel"), inside("fnh").alias("chrome"),
    )
    # the next marked element in document order tells whether an element holds an inner one
    ahead = W.partitionBy(*KEYS).orderBy(F.desc("node_id")).rowsBetween(W.unboundedPreceding, -1)
    inner = F.last(F.when(F.col("semantic"), F.col("node_id")), True).over(ahead)
    elements = found.withColumn("inner", inner).where(
        (F.coalesce(F.col("inner") > F.col("last_desc"), F.lit(True))) & (F.coalesce("full_text", F.lit("")) != "")
    )
    out = _emit(
        open_specs(elements, specs, ["address"], every), 3, F.col("full_text"),
        F.when(F.col("semantic"), TIER["semantic"]).otherwise(TIER["attribute"]),
        F.when(F.col("semantic"), F.lit("<address>")).otherwise(F.lit("[class*=address]")), F.lit(3),
        [_ints(F.lit(0), "node_id")], selector=F.col("sel"), boilerplate=F.col("chrome"),
    )
    frames = t.nodes.where(
        (F.col("tag") == "iframe") & attr_text("src").rlike(r"google\.com/maps|maps\.google")
    ).withColumn("v", squish(attr_text("title"))).where(F.length("v") > 10).select(*KEYS, "node_id", "v")
    return out.unionByName(
        _emit(
            open_specs(frames, specs, ["address"], every), 3, F.col("v"), F.lit(TIER["attribute"]), F.lit("iframe[maps] title"),
            F.lit(4), [_ints(F.lit(1), "node_id")], selector=F.lit("iframe"),
        )
    )


def from_geo(t: PageTables, specs: list[Row]) -> DataFrame:
    """Coordinates out of data attributes, map URLs and map scripts."""
    wants_lat = F.col("s.type") == "latitude"
    tag = F.col("tag")
    placed = ((tag == "iframe") & attr("src").isNotNull()) | ((tag == "a") & attr_text("href").contains("maps")) | (
        (tag == "img") & attr_text("src").contains("maps"))
    for name in ("data-lat", "data-lng", "data-latitude", "data-longitude"):
        placed = placed | attr(name).isNotNull()
    src = F.coalesce(F.nullif(attr_text("src"), F.lit("")), attr_text("href"))
    rows = (
        t.nodes.where(placed)
        .withColumn("sel", selector())
        .withColumn("lat", F.coalesce(attr("data-lat"), attr("data-latitude")))
        .withColumn("lng", F.coalesce(attr("data-lng"), attr("data-longitude")))
        .withColumn("src", src)
        .withColumn("geo", F.when(F.col("src").rlike("(?i)maps|geo:|openstreetmap"), K.geo_from_url(F.col("src"))))
        .select(*KEYS, "node_id", "sel", "lat", "lng", "geo")
    )
    rows = open_specs(rows, specs, ["latitude", "longitude"], every)
    data = rows.withColumn("v", F.when(wants_lat, F.col("lat")).otherwise(F.col("lng"))).where("v != ''")
    urls = rows.where(F.col("geo").isNotNull())
    scripts = (
        t.nodes.where((tag == "script") & attr("src").isNull() & F.col("raw_text").isNotNull())
        .groupBy(*KEYS)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "raw_text"))), lambda r: r["raw_text"]), "").alias("js"))
    )
    pattern = (
        r"(?i)[\"']?lat(?:itude)?[\"']?\s*[:=]\s*[\"']?(-?\d{1,3}\.\d{3,})[\"']?[\s\S]{0,80}?[\"']?(?:lng|lon|longitude)"
        r"[\"']?\s*[:=]\s*[\"']?(-?\d{1,3}\.\d{3,})"
    )
    inline = open_specs(scripts.where(F.col("js").rlike(pattern)), specs, ["latitude", "longitude"], every)
    return (
        _emit(
            data, 3, F.col("v"), F.lit(TIER["attribute"] + 0.1),
            F.when(wants_lat, F.lit("data-lat attribute")).otherwise(F.lit("data-lng attribute")), F.lit(3),
            [_ints(F.lit(0), "node_id")], selector=F.col("sel"),
        )
        .unionByName(_emit(
            urls, 3, F.when(wants_lat, F.col("geo.latitude")).otherwise(F.col("geo.longitude")), F.lit(TIER["attribute"]),
            F.lit("coordinates parsed from map URL"), F.lit(4), [_ints(F.lit(1), "node_id")], selector=F.col("sel"),
        ))
        .unionByName(_emit(
            inline, 3,
            F.when(wants_lat, F.regexp_extract("js", pattern, 1)).otherwise(F.regexp_extract("js", pattern, 2)),
            F.lit(TIER["proximity"] + 0.1), F.lit("inline script map init"), F.lit(5), [_ints(F.lit(2))],
        ))
    )


def from_pairs(t: PageTables, specs: list[Row]) -> DataFrame:
    """Label/value pairs whose label names the field."""
    rows = open_specs(
        with_label(t.pairs, F.col("label"), specs).where("m_near"), specs, PAIR_KINDS,
        # most labels name nothing: the channel of those that do is looked at last
        lambda s: let(label_match(s), lambda m: F.when(m <= 0, 0.0).when(channel_ok(F.col("label"), s), m).otherwise(0.0)),
    ).select("*", F.posexplode(F.when(F.col("s.plural"), once(("split_list",), lambda: split_list(F.col("value")))).otherwise(F.array("value"))).alias("i", "v"))
    return _emit(
        rows, 4, F.col("v"), F.col("score") * TIER["pair"],
        F.concat(F.lit("label pair ("), "kind", F.lit('): "'), "label", F.lit('"')), F.lit(6),
        [_ints("kind_rank", "node_id", "i")], selector=F.col("selector"), context=F.col("label"),
        boilerplate=F.col("boilerplate"),
    )


def from_attributes(t: PageTables, specs: list[Row]) -> DataFrame:
    """Blocks whose class, id or itemprop carries one of the field's hints."""
    marked = t.blocks.where(
        ((F.col("class_name") != "") | (F.col("html_id") != "") | (F.col("itemprop") != "")) & (F.length("text") <= 300)
    ).withColumn("attr_text", F.lower(F.concat_ws(" ", "class_name", "html_id", "itemprop")))
    marked = marked.where(F.col("attr_text").rlike(any_of(h for s in specs for h in s.attr_hints if len(h) >= 3)))

    def hinted(s: Column) -> dict[str, Column]:
        hint = F.try_element_at(
            F.filter(s["attr_hints"], lambda h: (F.length(h) >= 3) & F.col("attr_text").contains(h)), F.lit(1)
        )
        return {"score": yes(hint.isNotNull()), "hint": hint}

    rows = open_specs(marked, specs, ("price", "name", *TEXT_KINDS), hinted)
    own = F.col("itemprop") != ""
    return _emit(
        rows, 6, F.col("text"), TIER["attribute"] * F.when(own, 1.15).otherwise(1.0),
        F.concat(F.lit("attribute match ["), F.when(own, F.lit("itemprop")).otherwise(F.lit("class/id")), F.lit('*="'), "hint", F.lit('"]')),
        F.lit(7), [_ints("pos")], selector=F.col("selector"), context=F.col("attr_text"), boilerplate=F.col("boilerplate"),
    )


def from_proximity(t: PageTables, specs: list[Row]) -> DataFrame:
    """Values in the four blocks after a label-like block; confidence fades 12 % a step.

    A block that itself names the field is a further label, not a value, so each block is scored once and the
    windows look at the scores ahead.
    """
    near = [s for s in specs if s.type in ("address", "hours", *TEXT_KINDS)]
    scores = once(
        ("proximity", spec_json(near)),
        lambda: F.map_from_entries(
            F.filter(
                F.transform(spec_literal(near), lambda s: F.struct(s["key"].alias("k"), label_match(s).alias("v"))),
                lambda e: e["v"] > 0,
            )
        ),
    )
    order = W.partitionBy(*KEYS).orderBy("pos")
    block = F.struct("text", "selector", "boilerplate", "names")
    ahead = F.array(*[F.struct(F.lit(i).alias("step"), F.lead(block, i).over(order).alias("b")) for i in range(1, 5)])
    short = F.length("text") <= 80
    rows = (
        with_label(t.blocks.select(*KEYS, "pos", "text", "selector", "boilerplate"), F.when(short, F.col("text")).otherwise(F.lit("")), near)
        .withColumn("names", F.when(F.col("m_near"), scores))
        .select(*KEYS, "pos", "text", "selector", "boilerplate", "names")
        .withColumn("next", ahead)
        .where((F.length("text") <= 60) & (F.size("names") > 0))
        .select(*KEYS, "pos", "text", "names", "next")
    )
    rows = open_specs(
        rows, specs, ("address", "hours", *TEXT_KINDS),
        lambda s: F.coalesce(F.try_element_at(F.col("names"), s["key"]), F.lit(0.0)),
    )
    rows = rows.select("*", F.explode("next").alias("n")).where(
        F.col("n.b.text").isNotNull() & (F.length("n.b.text") <= 500)
        & ((F.length("n.b.text") >= 30) | F.try_element_at(F.col("n.b.names"), F.col("s.key")).isNull())
    )
    step = F.col("n.step")
    return _emit(
        rows, 5, F.col("n.b.text"), F.col("score") * TIER["proximity"] * (1 - (step - 1) * 0.12),
        F.concat(F.lit('text after "'), "text", F.lit('"')), step + 8, [_ints("pos", step)],
        selector=F.col("n.b.selector"), context=F.col("text"), boilerplate=F.col("n.b.boilerplate"),
    )


def from_headings(t: PageTables, specs: list[Row]) -> DataFrame:
    """The page's own name: first h1, title (with and without the site suffix), brand element."""
    classes = F.split(attr_text("class"), r"\s+")
    named = attr_text("class")
    branded = named.contains("brand") | (named.rlike("site-title|logo") & (F.array_contains(classes, "site-title") | F.array_contains(classes, "logo")))
    facts = t.nodes.where((F.col("tag").isin("h1", "title")) | branded).groupBy(*KEYS).agg(
        F.min_by(F.when(F.col("tag") == "h1", F.coalesce("full_text", F.lit(""))), F.when(F.col("tag") == "h1", F.col("node_id"))).alias("h1"),
        F.min_by(F.when(F.col("tag") == "title", F.coalesce("full_text", F.lit(""))), F.when(F.col("tag") == "title", F.col("node_id"))).alias("title"),
        F.min_by(F.when(branded, F.struct(F.coalesce("full_text", F.lit("")).alias("text"), selector().alias("sel"))), F.when(branded, F.col("node_id"))).alias("brand"),
    )
    def found(i: int, value: Column, confidence: float, method: str, sel: Column, ord: int) -> Column:
        return F.struct(
            F.lit(i).alias("i"), value.alias("v"), F.lit(confidence).alias("c"), F.lit(method).alias("m"), sel.alias("sel"), F.lit(ord).alias("o"),
        )

    short = F.split("title", r"\s+[|–—-]\s+")[0]
    made = F.array(
        found(0, F.col("h1"), TIER["semantic"] - 0.05, "h1", F.lit("h1"), 3),
        found(1, short, TIER["pair"], "<title>", F.lit("title"), 5),
        found(2, F.col("title"), TIER["pair"] - 0.1, "<title> (full)", F.lit("title"), 6),
        found(3, F.col("brand.text"), TIER["attribute"], "site title element", F.col("brand.sel"), 7),
    )
    rows = open_specs(
        facts.select(*KEYS, F.explode(made).alias("f")).where("f.v != ''"), specs, ["name"],
        lambda s: yes(F.size(s["entity_types"]) == 0),
    )
    return _emit(
        rows, 3, F.col("f.v"), F.col("f.c"), F.col("f.m"), F.col("f.o"), [_ints("f.i")], selector=F.col("f.sel"),
    )


def from_description(t: PageTables, specs: list[Row]) -> DataFrame:
    """Paragraphs, best first: long ones, near matching attributes or headings."""
    visible_parent = F.col("parent_id") >= F.col("scope_id")
    paragraphs = (
        t.nodes.where(F.col("content") & (F.col("tag") == "p") & (F.length("full_text") >= 40) & ~inside("aside"))
        .withColumn(
            "attr_text",
            F.lower(F.concat_ws(
                " ", attr("class"), attr("id"), F.when(visible_parent, F.col("parent_class")),
                F.when(visible_parent, F.col("parent_html_id")), F.when(inside("idsection"), F.col("near_id")))),
        )
        .withColumn("heading", F.when(inside("section"), F.coalesce("near_heading", F.lit(""))).otherwise(F.lit("")))
        .withColumn("sel", selector())
        .select(*KEYS, "node_id", "full_text", "attr_text", "heading", "sel")
    )
    def score(s: Column) -> Column:
        hinted = F.exists(s["attr_hints"], lambda h: (F.length(h) >= 4) & F.col("attr_text").contains(h))
        return F.least(
            F.lit(0.72),
            0.4 + F.least(F.lit(0.15), F.length("full_text") / 4000) + F.when(hinted, 0.12).otherwise(0.0)
            + F.when(label_match(s) > 0, 0.1).otherwise(0.0),
        )

    rows = open_specs(with_label(paragraphs, F.col("heading"), specs), specs, ["description"], score)
    best = W.partitionBy(*KEYS, "s.key").orderBy(F.desc("score"), F.desc(F.length("full_text")), "node_id")
    rows = rows.withColumn("rank", F.row_number().over(best))
    return _emit(
        rows, 3, F.col("full_text"), F.col("score"), F.lit("longest matching <p>"), F.lit(7), [_ints("rank")],
        selector=F.col("sel"),
    )


def from_lists(t: PageTables, specs: list[Row]) -> DataFrame:
    """Items of lists whose heading, attributes or content match; chips of a hinted container otherwise."""
    is_item = (
        F.col("content") & (F.col("tag") == "li") & F.col("parent_tag").isin("ul", "ol") & F.length("full_text").between(1, 200)
        & (F.col("parent_id") >= F.col("scope_id"))
    )
    is_list = F.col("tag").isin("ul", "ol") & ~inside("listskip")

    def near(at: str, text: str) -> Column:
        return F.when(F.col(at) >= F.col("scope_id"), F.nullif(F.col(text), F.lit("")))

    attr_text_of = F.lower(F.concat_ws(" ", attr("class"), attr("id"), F.when(F.col("parent_id") >= F.col("scope_id"), F.col("parent_class"))))
    heading = F.coalesce(
        near("prev_at", "prev_text"), near("parent_prev_at", "parent_prev_text"), F.when(inside("secdiv"), F.col("near_heading")), F.lit(""),
    )
    # a list and its items meet in one aggregate, where the page lies: a join by element would move both
    lists = (
        t.nodes.where(is_list | is_item)
        .groupBy(*KEYS, F.when(F.col("tag") == "li", F.col("parent_id")).otherwise(F.col("node_id")).alias("list_id"))
        .agg(
            F.max(F.when(is_list, F.struct(attr_text_of.alias("attr_text"), heading.alias("heading"), selector().alias("sel")))).alias("list"),
            F.array_sort(F.collect_list(F.when(is_item, F.struct(F.col("node_id").alias("n"), "full_text")))).alias("items"),
        )
        .where(F.col("list").isNotNull() & (F.size("items") >= 2))
        .select(*KEYS, F.col("list_id").alias("node_id"), "list.*", F.transform("items", lambda x: x["full_text"]).alias("items"))
        .withColumn("item_tokens", tokens(F.array_join("items", " ")))
    )

    def score(s: Column) -> Column:
        attr_hit = F.exists(s["attr_hints"], lambda h: (F.length(h) >= 4) & F.col("attr_text").contains(h))
        item_hit = token_overlap(F.filter(s["keywords"], lambda k: F.length(k) > 3), F.col("item_tokens")) >= 0.25
        return F.greatest(
            F.when(attr_hit, 0.9).otherwise(0.0), label_match(s), F.when(item_hit, 0.6).otherwise(0.0)
        )

    rows = open_specs(with_label(lists, F.col("heading"), specs), specs, ["list"], score)
    listed = _emit(
        rows.select("*", F.posexplode("items").alias("i", "item")), 3, F.col("item"), F.col("score") * TIER["pair"],
        F.when(F.col("heading") != "", F.concat(F.lit('list under "'), "heading", F.lit('"'))).otherwise(F.lit("list matching label")),
        F.lit(6), [_ints("node_id", "i")], selector=F.col("sel"), context=F.concat_ws(" ", "heading", "attr_text"),
    )
    # Chips: children of the elements carrying the first hint that yields anything, where no list answered.
    boxes = t.nodes.where(F.col("content") & (F.col("n_kids") >= 2) & (attr_text("class") != "")).select(
        *KEYS, F.col("node_id").alias("box_id"), attr_text("class").alias("cls")
    )

    def hinted(s: Column) -> dict[str, Column]:
        hits = F.filter(
            F.transform(s["attr_hints"], lambda h, i: F.struct(i.alias("hint_at"), h.alias("hint"))),
            lambda h: (F.length(h["hint"]) >= 5) & F.col("cls").contains(h["hint"]),
        )
        return {"score": yes(F.size(hits) > 0), "hits": hits}

    boxes = open_specs(boxes, specs, ["list"], hinted).select(*KEYS, "box_id", "s", F.explode("hits").alias("h"))
    # a chip's parent carries a hint, which the chip's own row tells: the others need not be moved
    hints = sorted({h for x in specs if x.type == "list" for h in x.attr_hints if len(h) >= 5})
    boxed = F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.col("parent_class").contains(h)) if hints else F.lit(False)
    chips = t.nodes.where(F.col("content") & F.length("full_text").between(1, 60) & boxed).select(
        *KEYS, F.col("parent_id").alias("box_id"), "node_id", "full_text", selector().alias("sel")
    )
    chips = boxes.join(chips, [*KEYS, "box_id"])
    first = W.partitionBy(*KEYS, "s.key")
    chips = chips.withColumn("best", F.min("h.hint_at").over(first)).where(F.col("h.hint_at") == F.col("best"))
    # only the lists of pages with chips are tested again
    contested = lists.join(chips.select("page_id").distinct(), "page_id", "left_semi")
    answered = open_specs(with_label(contested, F.col("heading"), specs), specs, ["list"], score).select(*KEYS, F.col("s.key").alias("done")).distinct()
    chips = chips.withColumn("done", F.col("s.key")).join(answered, [*KEYS, "done"], "left_anti")
    return listed.unionByName(
        _emit(
            chips, 3, F.col("full_text"), F.lit(TIER["attribute"]),
            F.concat(F.lit('chips in [class*="'), F.col("h.hint"), F.lit('"]')), F.lit(7), [_ints("box_id", "node_id")],
            selector=F.col("sel"),
        )
    )


def from_images(t: PageTables, specs: list[Row]) -> DataFrame:
    """Harvested images: narrowing words and logos pick the pool, then the main or gallery ranking."""
    def hits(s: Column) -> dict[str, Column]:
        narrowing = F.filter(s["label_tokens"], lambda k: (F.length(k) > 2) & ~k.isin(*GENERIC_IMAGE_WORDS))
        mentioned = F.exists(
            narrowing,
            lambda k: F.col("context").contains(k) | F.lower("alt").contains(k) | F.lower("url").contains(k),
        )
        logo = F.array_contains(s["label_tokens"], "logo") & (
            F.col("is_logo") | F.col("url").rlike("(?i)logo") | F.col("context").rlike("(?i)logo")
        )
        return {"score": F.lit(1.0), "narrow_hit": mentioned, "logo_hit": logo}

    s = F.col("s")
    rows = open_specs(t.images, specs, IMAGE_KINDS, hits)
    pool = W.partitionBy(*KEYS, "s.key")
    rows = (
        rows.withColumn("any_narrow", F.max("narrow_hit").over(pool)).withColumn("any_logo", F.max("logo_hit").over(pool))
        .where(
            F.when(F.col("any_logo"), F.col("logo_hit")).otherwise(~F.col("any_narrow") | F.col("narrow_hit"))
        )
    )
    by = [*KEYS, "s.key"]
    outs = []
    if any(x.type == "image_list" or x.plural for x in specs if x.type in IMAGE_KINDS):
        ranked = rank_gallery(rows.where((s["type"] == "image_list") | s["plural"]), by)
        confidence = F.least(F.lit(0.9), 0.55 + F.col("trust") * 0.35 + F.when(F.col("in_gallery"), 0.08).otherwise(0.0))
        outs.append((ranked, confidence))
    if any(x.type == "image" and not x.plural for x in specs):
        ranked = rank_main(rows.where((s["type"] == "image") & ~s["plural"]), by)
        outs.append((ranked, F.least(F.lit(0.95), F.col("main_score"))))
    made = [
        _emit(
            ranked, 1, F.col("url"), confidence, F.concat(F.lit("image:"), "channel"), F.col("rank") + 10,
            [_ints("rank")], selector=F.col("selector"), context=F.col("context"),
        )
        for ranked, confidence in outs
    ]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def pattern_hits(text: Column, pattern: str, limit: int | None = None) -> Column:
    """All matches, or the first ``limit``, with their 0-based position: ``array<struct(i, m, at)>``.

    The text is read once: each match is put between two marks, by which the text is split into gaps and matches in turn. A
    position is the sum of the lengths before it. A text that holds the mark is split by the pattern itself.
    """
    def woven(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return let(found, lambda ms: F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(ms), F.array(g, F.get(ms, i))).otherwise(F.array(g)))))

    def placed(parts: Column) -> Column:
        matches = F.filter(parts, lambda _, i: i % 2 == 1)
        sizes = F.transform(parts, F.length)
        return F.transform(
            matches if limit is None else F.slice(matches, 1, limit),
            lambda m, i: F.struct(i.alias("i"), m.alias("m"), F.aggregate(F.slice(sizes, F.lit(1), 2 * i + 1), F.lit(0), lambda a, x: a + x).alias("at")),
        )

    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    return let(F.when(text.contains(MARK), woven(F.split(text, pattern))).otherwise(marked), placed)


def from_pattern(t: PageTables, specs: list[Row]) -> DataFrame:
    """Kind-shaped runs in the page text and, a little weaker, in the chrome text."""
    texts = t.texts.select(*KEYS, F.lit(False).alias("boilerplate"), F.lit(1.0).alias("weight"), "text").unionByName(
        t.chrome.select(*KEYS, F.lit(True).alias("boilerplate"), F.lit(0.85).alias("weight"), F.col("chrome_text").alias("text"))
    ).where("text != ''")
    # The matches of a text are found once per kind, whatever the number of labels of that kind.
    kinds = [k for k in PATTERNS if any(x.type == k for x in specs)]
    def hits_of(kind: str) -> Column:
        if kind == "hours":
            hits = F.transform(
                F.filter(
                    F.array(F.array_join(F.transform(K.find_hours(F.col("text")), squish), "; ")), lambda v: v != ""
                ),
                lambda v: F.struct(F.lit(0).alias("i"), v.alias("m"), F.lit(0).alias("at")),
            )
        else:
            hits = pattern_hits(F.col("text"), PATTERNS[kind])
        return F.transform(hits, _hit_of(kind))

    found = [once(("pattern", kind), lambda kind=kind: hits_of(kind)) for kind in kinds]
    rows = texts.select(*KEYS, "boilerplate", "weight", F.explode(F.concat(*found)).alias("h"))
    rows = rows.withColumn("near", F.lower(squish(F.col("h.context"))))
    rows = open_specs(
        rows, specs, kinds,
        lambda s: {
            "score": yes(s["type"] == F.col("h.kind")), "about": F.exists(s["near_words"], lambda k: F.col("near").contains(k)),
        },
    )
    joined = F.col("h.kind") == "hours"
    confidence = F.when(joined, TIER["pattern"] * F.col("weight")).otherwise(
        F.least(F.lit(0.68), TIER["pattern"] * F.col("weight") * F.when(F.col("about"), 1.15).otherwise(0.8))
    )
    method = F.when(joined, F.lit("pattern match over page text (joined)")).otherwise(F.lit("pattern match over page text"))
    return _emit(
        rows, 7, F.col("h.m"), confidence, method, F.col("h.i") + 12, [_ints(F.col("boilerplate"), "h.i")],
        context=F.when(joined, method).otherwise(F.col("h.context")), boilerplate=F.col("boilerplate"),
    )


def _hit_of(kind: str) -> Callable[[Column], Column]:
    def hit(h: Column) -> Column:
        start = F.greatest(F.lit(0), h["at"] - 90)
        window = F.substring(F.col("text"), start + 1, h["at"] - start + F.length(h["m"]) + 40)
        return F.struct(F.lit(kind).alias("kind"), h["i"].alias("i"), h["m"].alias("m"), window.alias("context"))

    return hit


# Which generators serve which kinds (images are served by the harvest alone).
DISPATCH: tuple[tuple[Callable[[PageTables, list[Row]], DataFrame], tuple[str, ...]], ...] = (
    (from_structured, tuple(k for k in K.KINDS if k not in IMAGE_KINDS)),
    (from_meta, tuple(k for k in K.KINDS if k not in IMAGE_KINDS)),
    (from_canonical, ("url",)),
    (from_tel_links, ("phone",)),
    (from_mailto, ("email",)),
    (from_social_links, ("social",)),
    (from_address, ("address",)),
    (from_geo, ("latitude", "longitude")),
    (from_headings, ("name",)),
    (from_description, ("description",)),
    (from_lists, ("list",)),
    (from_pairs, PAIR_KINDS),
    (from_attributes, ("price", "name", *TEXT_KINDS)),
    (from_proximity, ("address", "hours", *TEXT_KINDS)),
    (from_pattern, tuple(PATTERNS)),
    (from_images, IMAGE_KINDS),
)


def raw_candidates(t: PageTables, specs: list[Row]) -> DataFrame:
    """Everything any generator offers for the requested labels."""
    out = None
    for generator, kinds in DISPATCH:
        chosen = [s for s in specs if s.type in kinds]
        if generator is from_headings:
            chosen = [s for s in chosen if not s.entity_types]
        if not chosen:
            continue
        made = generator(t, chosen).select(*KEYS, *RAW)
        out = made if out is None else out.unionByName(made)
    return out


def finalise(raw: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Normalise, validate, penalise chrome and keep the most confident spelling of each identity.

    The dedupe is one aggregation per (page, scope, field, identity) with map-side combine.
    """
    kinds = tuple(sorted(set(kinds)))
    kind, context = F.col("type"), F.coalesce("context", F.lit(""))

    def accept(v: Column) -> Column:
        made = F.struct(v.alias("value"), K.identity_key(kind, v, kinds).alias("identity"))
        return F.when((v != "") & K.validate(kind, v, context, kinds), F.array(made)).otherwise(
            F.array().cast("array<struct<value:string,identity:string>>")
        )

    # Opening an array of zero or one keeps the checks in one place: a plain filter would be copied, with all
    # the expressions it rests on, into every branch of the union below.
    checked = raw.select(
        *[c for c in raw.columns if c not in ("value", "context")],
        F.explode(
            once(("finalise", kinds), lambda: let(K.normalize_value(kind, F.col("value"), kinds), accept))
        ).alias("c"),
    )
    penalty = (
        F.when(F.col("boilerplate") & ~kind.isin(*FOOTER_FRIENDLY), 0.15).otherwise(0.0)
        + F.when(F.col("boilerplate"), 0.03).otherwise(0.0)
    )
    kept = checked.select(
        *KEYS, "field_key", "type", "c.value", "c.identity", "method", "selector", "ord", "seq",
        F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col("confidence") - penalty)).alias("confidence"),
    )
    best = F.min_by(
        F.struct("value", "confidence", "method", "selector", "ord"), F.struct(-F.col("confidence"), F.col("seq"))
    )
    return (
        kept.groupBy(*KEYS, "field_key", "type", "identity")
        .agg(best.alias("b"), F.min("seq").alias("seq"))
        .select(*KEYS, "field_key", "type", "identity", "b.*", "seq")
    )


def resolve(t: PageTables, specs: list[Row]) -> DataFrame:
    """Validated candidates of every label on every page or scope, with their source URL."""
    done = finalise(raw_candidates(t, specs), [s.type for s in specs])
    return done.join(t.bases.withColumnRenamed("base_url", "source_url"), "page_id")
