"""JSON-LD and microdata to flat entries, level by level with Spark's own JSON functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.memo import memo
from factsieve.functions.text import let, squish, squish_block
from factsieve.operators.page import KEYS, attr_text

# ---- fixed values ---------------------------------------------------------------------------
# Types that describe a page's subject even when nested.
PRIMARY_TYPES = (
    "hotel lodgingbusiness resort motel bedandbreakfast hostel localbusiness organization corporation restaurant "
    "foodestablishment store place product service event apartment house accommodation touristattraction "
    "realestatelisting medicalbusiness professionalservice travelagency person article newsarticle blogposting "
    "webpage itempage offer course recipe book movie softwareapplication jobposting"
).split()
# Types that say nothing about the subject.
NOISE_TYPES = (
    "breadcrumblist listitem sitenavigationelement wpheader wpfooter searchaction entrypoint website collectionpage"
).split()
MAX_DEPTH = 6
# ---------------------------------------------------------------------------------------------


def _strings() -> Column:
    return F.array().cast("array<string>")


def _is_object(raw: Column) -> Column:
    return raw.startswith("{") & F.try_parse_json(raw).isNotNull()


def _members(raw: Column) -> Column:
    """Ordered ``array<struct(key, value)>`` of a JSON object; nested values stay JSON text."""
    return F.map_entries(F.from_json(raw, "map<string,string>"))


def _items(raw: Column) -> Column:
    """A JSON array as its items, anything else as one item; items that are arrays are opened once more."""
    def open_array(v: Column) -> Column:
        return F.when(
            v.startswith("[") & F.try_parse_json(v).isNotNull(),
            F.coalesce(F.from_json(v, "array<string>"), _strings()),
        ).otherwise(F.array(v))

    return F.when(raw.startswith("["), F.flatten(F.transform(open_array(raw), open_array))).otherwise(F.array(raw))


ENTRY_DDL = (
    "page_id bigint, scope_id int, source string, seq array<int>, key string, path string, value string, "
    "entity_type string, is_primary boolean"
)


def structured_nodes(nodes: DataFrame) -> DataFrame:
    """Elements that carry JSON-LD or open a microdata item."""
    return nodes.where(
        F.col("item_json").isNotNull()
        | ((F.col("tag") == "script") & (F.lower(attr_text("type")) == "application/ld+json"))
    ).select("page_id")


def _is_json(c: Column) -> Column:
    """Is the text exactly one JSON value? (Parsers stop after the first one; inside brackets they cannot.)"""
    return let(
        F.concat(F.lit("["), c, F.lit("]")),
        lambda w: F.try_parse_json(w).isNotNull() & (F.size(F.from_json(w, "array<string>")) == 1),
    )


@memo
def _roots() -> Column:
    """JSON values of one script, repaired where possible."""
    salvaged = F.filter(
        F.regexp_extract_all(F.col("json"), F.lit(r"\{[\s\S]*?\}(?=\s*(?:,|\]|\}|$))"), F.lit(0)),
        _is_json,
    )
    repaired = F.regexp_replace("json", r",\s*([}\]])", "$1")
    return (
        F.when(_is_json(F.col("json")), _items(F.col("json")))
        .when(_is_json(repaired), _items(repaired))
        .otherwise(salvaged)
    )


@memo
def _graph_members() -> Column:
    """A graph wrapper stands for its members; it stays itself only when it says something of its own."""
    graph = F.get_json_object("raw", "$['@graph']")
    rest = F.map_filter(F.from_json("raw", "map<string,variant>"), lambda k, v: k != "@graph")
    own = F.when(F.exists(F.map_keys(rest), lambda k: ~k.startswith("@")), F.array(F.to_json(rest))).otherwise(_strings())
    wraps = ~F.coalesce(F.nullif(graph, F.lit("")), F.lit("null")).isin("null", "false", "0")
    return F.when(_is_object(F.col("raw")) & wraps, F.concat(_items(graph), own)).otherwise(F.array("raw"))


def _is_script() -> Column:
    return (
        (F.col("tag") == "script") & (F.lower(attr_text("type")) == "application/ld+json")
        & (F.trim(F.coalesce("raw_text", F.lit(""))) != "")
    )


def _is_outer_item() -> Column:
    return F.col("item_json").isNotNull() & ((F.col("a_item") == 0) | (F.col("a_item") < F.col("scope_id")))


def entities(nodes: DataFrame, jsonld: bool = True, microdata: bool = True) -> DataFrame:
    """``(source, ent, raw)``: every JSON-LD node of a page, broken markup repaired where possible, and the outermost item
    scopes, nested scopes as nested objects.

    Both kinds come out of one pass over the elements, which may have to be parsed for it.
    """
    text = F.regexp_replace("raw_text", r"^\s*<!\[CDATA\[", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\]\]>\s*$", ""), r"^\s+|\s+$", "")
    script, item = F.lit(jsonld) & _is_script(), F.lit(microdata) & _is_outer_item()
    found = F.array_compact(F.array(
        F.when(script, F.struct(F.lit("jsonld").alias("source"), text.alias("json"))),
        F.when(item, F.struct(F.lit("microdata").alias("source"), F.col("item_json").alias("json"))),
    ))
    is_jsonld = F.col("source") == "jsonld"
    rows = nodes.where(script | item).select(*KEYS, "node_id", F.explode(found).alias("f")).select(*KEYS, "node_id", "f.source", "f.json")
    rows = rows.select(*KEYS, "source", "node_id", F.posexplode(F.when(is_jsonld, _roots()).otherwise(F.array("json"))).alias("i", "raw"))
    for level in ("g1", "g2"):
        keep = [c for c in ("i", "g1") if c in rows.columns]
        members = F.when(is_jsonld, _graph_members()).otherwise(F.array("raw"))
        rows = rows.select(*KEYS, "source", "node_id", *keep, F.posexplode(members).alias(level, "raw"))
    return rows.where(~is_jsonld | _is_object(F.col("raw"))).select(*KEYS, "source", F.array("node_id", "i", "g1", "g2").alias("ent"), "raw")


def jsonld_entities(nodes: DataFrame) -> DataFrame:
    """``(ent, raw)``: every JSON-LD node of a page."""
    return entities(nodes, microdata=False)


def microdata_entities(nodes: DataFrame) -> DataFrame:
    """``(ent, raw)``: the outermost item scopes of a page."""
    return entities(nodes, jsonld=False)


def _field(m: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(name)), F.lit(""))


def _number_text(value: Column, owner: Column) -> Column:
    """Text of a scalar as JSON reads it: a number 4.0 is 4, a string "4.0" (quoted in its owner) stays."""
    bare = value.rlike(r"^-?\d+\.0+$") & ~owner.contains(F.concat(F.lit('"'), value, F.lit('"')))
    return F.when(bare, F.regexp_replace(value, r"\.0+$", "")).otherwise(value)


def _address(m: Column, lower_types: Column) -> Column:
    country = _field(m, "addressCountry")
    parts = F.concat(
        _items(_field(m, "streetAddress")), _items(_field(m, "addressLocality")),
        F.array(
            F.concat_ws(
                " ", F.nullif(_field(m, "addressRegion"), F.lit("")), F.nullif(_field(m, "postalCode"), F.lit(""))
            )
        ),
        F.when(country.startswith("{"), F.array(F.coalesce(F.get_json_object(country, "$.name"), F.lit(""))))
        .otherwise(_items(country)),
    )
    joined = F.array_join(F.filter(F.transform(parts, squish), lambda p: p != ""), ", ")
    wanted = F.array_contains(lower_types, "postaladdress") | (_field(m, "streetAddress") != "") | (
        _field(m, "addressLocality") != "")
    return F.when(wanted, joined)


def _hours(m: Column) -> Column:
    def one(spec: Column) -> Column:
        days = F.array_join(
            F.transform(
                F.filter(_items(F.coalesce(F.get_json_object(spec, "$.dayOfWeek"), F.lit(""))), lambda d: d != ""),
                lambda d: F.regexp_replace(d, r"(?i)^https?://schema\.org/", ""),
            ),
            ", ",
        )
        opens = F.get_json_object(spec, "$.opens")
        closes = F.get_json_object(spec, "$.closes")
        return F.when((days == "") & (F.coalesce(opens, F.lit("")) == ""), F.lit("")).otherwise(
            F.concat(
                days, F.when(days != "", F.lit(": ")).otherwise(F.lit("")), F.coalesce(opens, F.lit("?")), F.lit("–"),
                F.coalesce(closes, F.lit("?")),
            )
        )

    spec = _field(m, "openingHoursSpecification")
    plain = _field(m, "openingHours")
    from_spec = F.array_join(F.filter(F.transform(_items(spec), one), lambda s: s != ""), "; ")
    from_plain = F.array_join(F.filter(F.transform(_items(plain), squish), lambda s: s != ""), "; ")
    return F.coalesce(
        F.when(plain != "", F.nullif(from_plain, F.lit(""))), F.when(spec != "", F.nullif(from_spec, F.lit("")))
    )


def _geo(m: Column, name: str) -> Column:
    geo = _field(m, "geo")
    return F.when(geo.startswith("{"), F.get_json_object(geo, f"$.{name}"))


def _offer(m: Column) -> Column:
    def priced(first: Column) -> Column:
        def of(path: str) -> Column:
            return F.get_json_object(first, path)

        amount = F.coalesce(of("$.price"), of("$.lowPrice"), of("$.priceSpecification.price"))

        def shown(a: Column) -> Column:
            currency = F.coalesce(
                of("$.priceCurrency"), of("$.priceSpecification.priceCurrency"), F.try_element_at(m, F.lit("priceCurrency"))
            )
            number = _number_text(a, first)
            return let(
                F.coalesce(currency, F.lit("")), lambda c: F.when(c != "", F.concat(c, F.lit(" "), number)).otherwise(number)
            )

        return let(amount, lambda a: F.when(a.isNotNull(), shown(a)))

    offers = F.filter(_items(_field(m, "offers")), lambda o: o.startswith("{"))
    return F.when(_field(m, "offers") != "", let(F.try_element_at(offers, F.lit(1)), priced))


def structured_composites(m: Column, lower_types: Column) -> Column:
    """Ready-made values of one entity: joined address, hours text, coordinates, priced offer."""
    named = (
        ("address", _address(m, lower_types)), ("openinghours", _hours(m)), ("latitude", _geo(m, "latitude")),
        ("longitude", _geo(m, "longitude")), ("price", _offer(m)),
    )
    made = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named]
    return F.filter(F.array(*made), lambda c: c["value"].isNotNull())


_OUT = (
    "array<struct<kind:string,key:string,path:string,value:string,entity_type:string,is_primary:boolean,raw:string>>"
)


@memo
def _level(depth: int) -> Column:
    """Children of an object row: its composites, scalar entries, URL wrappers and nested objects."""
    def build(m: Column) -> Column:
        types = F.transform(
            F.filter(
                _items(F.coalesce(F.try_element_at(m, F.lit("@type")), F.try_element_at(m, F.lit("type")), F.lit(""))),
                lambda t: (t != "") & ~t.startswith("{"),
            ),
            lambda t: F.regexp_replace(t, r"(?i)^https?://schema\.org/", ""),
        )

        def typed(facts: Column) -> Column:
            label, base, noise, primary = facts["label"], facts["base"], facts["noise"], facts["main"]

            def row(kind: str, key: Column, value: Column, raw: Column, is_primary: Column) -> Column:
                path = base if kind == "object" else F.concat(base, F.lit("."), key)
                return F.struct(
                    F.lit(kind).alias("kind"), F.lower(key).alias("key"), path.alias("path"), value.alias("value"),
                    label.alias("entity_type"), is_primary.alias("is_primary"), raw.alias("raw"),
                )

            none = F.lit(None).cast("string")
            rows_type = F.array().cast(_OUT)
            composites = F.transform(
                facts["composites"], lambda c: row("entry", c["key"], c["value"], none, primary & ~noise)
            )

            def member(e: Column) -> Column:
                def each(v: Column) -> Column:
                    keys = F.map_keys(F.from_json(v, "map<string,string>"))
                    link = F.coalesce(
                        F.get_json_object(v, "$.url"), F.get_json_object(v, "$.contentUrl"),
                        F.get_json_object(v, "$['@id']"),
                    )
                    wrapped = link.isNotNull() & ~link.rlike(r"^[\[{]") & (F.size(keys) <= 3)
                    return (
                        F.when(v.isNull(), rows_type)
                        .when(
                            _is_object(v),
                            F.concat(
                                F.when(wrapped, F.array(row("entry", e["key"], link, none, primary & ~noise)))
                                .otherwise(rows_type),
                                F.array(row("object", e["key"], none, v, F.lit(False))),
                            ),
                        )
                        .when(noise, rows_type)
                        .otherwise(F.array(row("entry", e["key"], _number_text(v, F.col("raw")), none, primary)))
                    )

                return F.flatten(F.transform(_items(e["value"]), each))

            members = F.filter(F.map_entries(m), lambda e: ~e["key"].startswith("@") & e["value"].isNotNull())
            return F.concat(composites, F.flatten(F.transform(members, member)))

        lower_types = F.transform(types, F.lower)
        label = F.coalesce(F.try_element_at(types, F.lit(1)), F.nullif(F.col("path"), F.lit("")), F.lit("Thing"))
        noise = F.exists(lower_types, lambda t: t.isin(*NOISE_TYPES))
        top = ~noise if depth == 0 else F.lit(False)
        facts = F.struct(
            label.alias("label"),
            F.when(F.col("path") != "", F.concat("path", F.lit("."), label)).otherwise(label).alias("base"),
            noise.alias("noise"),
            (top | F.exists(lower_types, lambda t: t.isin(*PRIMARY_TYPES))).alias("main"),
            structured_composites(m, lower_types).alias("composites"),
        )
        return let(facts, typed)

    return let(F.from_json("raw", "map<string,string>"), build)


def structured_entries(entities: DataFrame) -> DataFrame:
    """Flat ``(key, path, value, entity_type, is_primary, source, seq)`` rows, objects opened to depth six.

    A single narrow pass: each of the seven stages opens the object rows and hands finished entries on.
    ``seq`` keeps document order.
    """
    rows = entities.select(
        *KEYS, "source", F.col("ent").alias("seq"), F.lit("object").alias("kind"), F.lit("").alias("key"),
        F.lit("").alias("path"), F.lit(None).cast("string").alias("value"), F.lit("").alias("entity_type"),
        F.lit(False).alias("is_primary"), "raw",
    )

    def open_level(frame: DataFrame, depth: int) -> DataFrame:
        same = F.array(F.struct("kind", "key", "path", "value", "entity_type", "is_primary", "raw"))
        out = F.when(F.col("kind") == "object", _level(min(depth, 1))).otherwise(same)
        return frame.select(*KEYS, "source", "seq", F.posexplode(out).alias("at", "o")).select(
            *KEYS, "source", F.concat("seq", F.array("at")).alias("seq"), "o.*"
        )

    flat = reduce(open_level, range(MAX_DEPTH + 1), rows)
    return (
        flat.where(F.col("kind") == "entry")
        .withColumn("value", squish_block(F.col("value")))
        .where(F.col("value") != "")
        .select(*KEYS, "source", "seq", "key", "path", "value", "entity_type", "is_primary")
    )


def page_entries(nodes: DataFrame) -> DataFrame:
    """Structured entries of a page: JSON-LD first, then microdata."""
    ranked = entities(nodes).withColumn(
        "ent", F.concat(F.array(F.when(F.col("source") == "jsonld", 0).otherwise(1)), F.col("ent"))
    )
    return structured_entries(ranked)


def find_entries(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries under any of ``keys``; entries of a page's subject sort first."""
    return entries.where(F.col("key").isin(*[k.lower() for k in keys])).orderBy(*KEYS, F.desc("is_primary"), "seq")
