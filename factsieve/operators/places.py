"""Place-search results: labels to place fields, places to records, photos, error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from factsieve.functions.text import squish
from factsieve.operators.select import coverage

# ---- fixed values: place fields in matching order --------------------------------------------
# key, mask, any of these label words, or this kind (empty: words only)
PLACE_FIELDS = (
    ("name", "places.displayName", "name title business place shop store", "name"),
    ("address", "places.formattedAddress", "address location street", "address"),
    ("phone_international", "places.internationalPhoneNumber", "", ""),
    ("phone", "places.nationalPhoneNumber,places.internationalPhoneNumber", "phone tel telephone mobile contact", "phone"),
    ("website", "places.websiteUri", "website web site url homepage", "url"),
    ("maps_url", "places.googleMapsUri", "maps", ""),
    ("rating", "places.rating", "rating stars score rated", "rating"),
    ("review_count", "places.userRatingCount", "", ""),
    ("latitude", "places.location", "latitude lat", "latitude"),
    ("longitude", "places.location", "longitude lng lon", "longitude"),
    ("opening_hours", "places.regularOpeningHours", "hours opening schedule timing open", "hours"),
    ("category", "places.types,places.primaryTypeDisplayName", "category type types cuisine kind", "list"),
    ("price_level", "places.priceLevel", "price cost expensive budget", "price"),
    ("business_status", "places.businessStatus", "status open closed operational", ""),
    ("place_id", "places.id", "placeid", ""),
    ("photo", "places.photos", "image images photo photos picture pictures", "image|image_list"),
)
MAX_PLACES, PLACES_PER_CALL, PLACE_CONFIDENCE = 60, 20, 0.95
SEARCH_ENDPOINT = "https://places.googleapis.com/v1/places:searchText"
KEY_PROBLEM = (
    r"(?i)api[ _-]?key|API_KEY_INVALID|PERMISSION_DENIED|not authorized|has not been used|is disabled|billing"
)
# ---------------------------------------------------------------------------------------------

BATCH_SCHEMA = (
    "query string, batch int, nextPageToken string, places array<struct<id:string,displayName:struct<text:string>,"
    "formattedAddress:string,nationalPhoneNumber:string,internationalPhoneNumber:string,websiteUri:string,"
    "googleMapsUri:string,rating:double,userRatingCount:bigint,location:struct<latitude:double,longitude:double>,"
    "regularOpeningHours:struct<weekdayDescriptions:array<string>>,primaryTypeDisplayName:struct<text:string>,"
    "types:array<string>,priceLevel:string,businessStatus:string,photos:array<struct<name:string>>>>"
)


def _wants(key: str, words: Column, kind: Column, listed: str, kinds: str) -> Column:
    def has(*names: str) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))

    if key == "phone_international":
        return has("international") & has("phone", "tel", "telephone", "number")
    if key == "review_count":
        return has("review", "reviews", "ratings") & ~has("rating")
    hit = has(*listed.split())
    if key == "maps_url":
        hit = hit | (has("google") & has("link"))
    if key == "place_id":
        hit = hit | (has("place") & has("id"))
    return hit | kind.isin(*kinds.split("|")) if kinds else hit


def map_place_fields(specs: DataFrame) -> DataFrame:
    """``(pos, key, label, type, plural, place_field, mask)``: first matching place field, null when there is none."""
    hit = F.lit(None).cast("struct<place_field:string,mask:string>")
    for key, mask, words, kinds in reversed(PLACE_FIELDS):
        made = F.struct(F.lit(key).alias("place_field"), F.lit(mask).alias("mask"))
        hit = F.when(_wants(key, F.col("label_keywords"), F.col("type"), words, kinds), made).otherwise(hit)
    return specs.withColumn("hit", hit).select("pos", "key", "label", "type", "plural", "hit.place_field", "hit.mask")


def field_mask(mapping: DataFrame) -> DataFrame:
    """The distinct source fields a request needs: column pruning pushed to the source."""
    asked = mapping.where(F.col("mask").isNotNull()).select(F.explode(F.split("mask", ",")).alias("field"))
    always = mapping.sparkSession.createDataFrame([("places.id",), ("nextPageToken",)], "field string")
    return asked.unionByName(always).distinct()


def read_place(key: Column) -> Column:
    """Text of a place field on a place row, null when absent."""
    def number(c: str) -> Column:
        return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")

    empty_null = lambda c: F.nullif(squish(c), F.lit(""))
    spaced = F.array_join(F.transform("types", lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ", ")
    level = F.lower(F.replace(F.regexp_replace("priceLevel", "^PRICE_LEVEL_", ""), F.lit("_"), F.lit(" ")))
    cases = {
        "name": empty_null(F.col("displayName.text")), "address": empty_null(F.col("formattedAddress")),
        "phone_international": empty_null(F.col("internationalPhoneNumber")),
        "phone": F.coalesce(empty_null(F.col("nationalPhoneNumber")), empty_null(F.col("internationalPhoneNumber"))),
        "website": empty_null(F.col("websiteUri")), "maps_url": empty_null(F.col("googleMapsUri")),
        "rating": number("rating"), "review_count": F.col("userRatingCount").cast("string"),
        "latitude": number("location.latitude"), "longitude": number("location.longitude"),
        "opening_hours": F.nullif(F.array_join("regularOpeningHours.weekdayDescriptions", "; "), F.lit("")),
        "category": F.coalesce(empty_null(F.col("primaryTypeDisplayName.text")), F.nullif(spaced, F.lit(""))),
        "price_level": F.nullif(level, F.lit("")),
        "business_status": F.nullif(F.lower(F.replace("businessStatus", F.lit("_"), F.lit(" "))), F.lit("")),
        "place_id": empty_null(F.col("id")),
    }
    out = F.lit(None).cast("string")
    for name, value in reversed(cases.items()):
        out = F.when(key == name, value).otherwise(out)
    return out


def place_photos(places: DataFrame, photo_uris: DataFrame, n: int = 1) -> DataFrame:
    """``(query, place_pos, urls)``: URLs of each place's first ``n`` photos; unresolved ones are skipped."""
    wanted = places.select("query", "place_pos", F.posexplode(F.slice("photos", 1, n)).alias("i", "p")).select(
        "query", "place_pos", "i", F.col("p.name").alias("name")
    )
    return wanted.join(photo_uris, "name").groupBy("query", "place_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "photoUri"))), lambda x: x["photoUri"]).alias("urls")
    )


def place_records(places: DataFrame, mapping: list[Row], photos: DataFrame | None = None) -> DataFrame:
    """Long records: one row per place and label. Places that answer nothing are dropped."""
    asked = F.array(
        *[
            F.struct(
                F.lit(m.pos).alias("pos"), F.lit(m.key).alias("field_key"), F.lit(m.label).alias("label"), F.lit(m.type).alias("value_type"),
                F.lit(m.plural).alias("plural"), F.lit(m.place_field).cast("string").alias("place_field"), F.lit(m.mask).cast("string").alias("mask"),
            )
            for m in mapping
        ]
    )
    rows = places if photos is None else places.join(photos, ["query", "place_pos"], "left")
    if photos is None:
        rows = rows.withColumn("urls", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    def one(m: Column) -> Column:
        raw = read_place(m["place_field"])
        split = F.filter(F.split(raw, r"\s*[;,]\s*"), lambda p: p != "")
        many = F.coalesce(F.when(m["place_field"] == "photo", F.col("urls")).otherwise(split), empty)
        single = F.when(m["place_field"] == "photo", F.try_element_at("urls", F.lit(1))).otherwise(raw)
        found = F.when(m["plural"], F.size(many) > 0).otherwise(single.isNotNull())
        return F.struct(
            *[m[c].alias(c) for c in ("pos", "field_key", "label", "value_type", "plural")],
            F.when(~m["plural"], single).alias("value"), F.when(m["plural"], many).alias("items"),
            F.concat(F.lit("places:"), F.substring_index(m["mask"], ",", 1)).alias("method"),
            F.when(found, PLACE_CONFIDENCE).otherwise(0.0).alias("confidence"), found.alias("found"),
        )

    answered = rows.withColumn("answers", F.transform(asked, one)).where(F.exists("answers", lambda a: a["found"]))
    return answered.select(
        F.col("query").alias("site"), F.col("place_pos").alias("record_index"), F.coalesce("googleMapsUri", F.lit(SEARCH_ENDPOINT)).alias("source_url"),
        F.explode("answers").alias("a"),
    ).select("site", "record_index", "source_url", "a.*")


def classify_place_error(status: Column, message: Column) -> Column:
    """Error class of a refused place search; key problems show in the message whatever the status."""
    return (
        F.when(squish(message).rlike(KEY_PROBLEM), "auth").when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limited").when(status == 400, "bad_request").otherwise("http_error")
    )


def places_result(records: DataFrame, batches: DataFrame, wants_photos: bool) -> tuple[DataFrame, DataFrame]:
    """Coverage per label, and per query the record and call counts (one call per batch, one per photo place)."""
    calls = batches.groupBy(F.col("query").alias("site")).agg(F.count("*").alias("searches"))
    counted = records.select("site", "record_index").distinct().groupBy("site").agg(F.count("*").alias("record_count"))
    totals = calls.join(counted, "site", "left").fillna(0, ["record_count"]).withColumn(
        "api_calls", F.col("searches") + (F.col("record_count") if wants_photos else F.lit(0))
    )
    return coverage(records), totals
