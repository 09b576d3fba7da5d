"""Value-level behaviour of the text, URL and kind expressions."""

import pytest
from pyspark.sql import functions as F

from factsieve.functions import kinds as K
from factsieve.functions import text as T
from factsieve.functions import urls as U


def evaluate(spark, values, fn, schema="v string"):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    out = rows.select(fn(*[F.col(c) for c in rows.columns]).alias("out")).collect()
    return [r.out for r in out]


def test_squish_and_tokens(spark):
    assert evaluate(spark, ["a   b\n c ", None], T.squish) == ["a b c", ""]
    assert evaluate(spark, ["  a \t b \n\n\n c  \n d "], T.squish_block) == ["a b\n\nc\nd"]
    assert evaluate(spark, ["Phone Number", "The Number", "faxNumber"], T.tokens) == [
        ["phone"], ["the", "number"], ["faxnumber"]]
    assert evaluate(spark, ["  Room   Type ", "faxNumber", "!!"], T.to_key) == ["room_type", "fax_number", "field"]


def test_similarity(spark):
    pairs = [("phone", "Phone"), ("", "x"), ("phones", "phone")]
    same, empty, near = evaluate(spark, pairs, T.trigram_dice, "a string, b string")
    assert (same, empty) == (1.0, 0.0)
    # phones: 7 grams, phone: 6 grams, 5 shared
    assert near == pytest.approx(2 * 5 / 13)
    assert evaluate(spark, [(["a", "a", "b"], ["a"])], T.token_overlap, "a array<string>, b array<string>") == [
        pytest.approx(2 / 3)]
    assert evaluate(spark, [(["A", " a ", "", "b", "B"],)], T.dedupe_strings, "a array<string>") == [["A", "b"]]
    assert evaluate(spark, [("Hello  World", "o w"), ("x", "")], T.contains_text, "a string, b string") == [True, False]
    assert evaluate(spark, ["abcdef", "ab"], lambda c: T.truncate(c, 4)) == ["abc…", "ab"]


def test_urls(spark):
    got = evaluate(
        spark,
        ["https://WWW.Example.com/Page/?utm_source=x&b=2&a=1#frag", "https://example.com/Page?a=1&b=2", "http://a.com"],
        U.normalize_url)
    assert got == ["https://example.com/Page?a=1&b=2"] * 2 + ["http://a.com/"]
    ids = evaluate(
        spark,
        ["https://cdn.x.com/photo.jpg?w=400&quality=80", "https://cdn.x.com/photo.jpg?w=1600",
         "https://cdn.x.com/photo.jpg", "https://cdn.x.com/photo-300x200.jpg", "https://cdn.x.com/photo_thumb.jpg"],
        U.image_identity)
    assert set(ids) == {"https://cdn.x.com/photo.jpg"}
    joined = evaluate(
        spark,
        [("/rooms", "https://a.com/x/"), ("mailto:x@y.com", "https://a.com"), ("b/../c.html?q=1#z", "https://a.com/x/y"),
         ("?p=2", "http://a.com/l?p=1"), ("//cdn.b.com/i.png", "https://a.com"), ("/für", "http://a.com:80/"),
         ("ftp://a.com/x", "http://a.com"), ("../../up", "http://a.com/a/b/c")],
        U.absolutize, "h string, b string")
    assert joined == ["https://a.com/rooms", None, "https://a.com/x/c.html?q=1#z", "http://a.com/l?p=2",
                      "https://cdn.b.com/i.png", "http://a.com/f%C3%BCr", None, "http://a.com/up"]
    same = evaluate(spark, [("https://www.a.com/x", "https://a.com/y"), ("https://a.com", "https://b.com")],
                    U.same_site, "a string, b string")
    assert same == [True, False]
    assert evaluate(spark, ["https://a.com/file.pdf", "https://a.com/contact"], U.looks_non_html) == [True, False]
    assert evaluate(spark, ["https://a.com/Contact-us.html?x=ab"], U.url_tokens) == [["contact", "us", "ab"]]
    assert evaluate(spark, ["http://A.com:8080/x?y"], U.url_origin) == ["http://a.com:8080"]


def test_validate_url(spark):
    got = evaluate(
        spark,
        ["example-hotel.com", "https://a.com/x?b=1#frag", "", "ftp://a.com", "not a url", "javascript:alert(1)",
         "localhost:8099"],
        U.validate_url)
    assert [g.ok for g in got] == [True, True, False, False, False, False, True]
    assert [g.url for g in got][:2] == ["https://example-hotel.com/", "https://a.com/x?b=1"]
    assert got[6].url == "http://localhost:8099/"


def test_page_number(spark):
    got = evaluate(
        spark, ["http://a.com/l?page=12", "http://a.com/page/3/", "http://a.com/x?start=40", "http://a.com/x"],
        U.page_number)
    assert [(g.number, g.kind) if g else None for g in got] == [(12, "query"), (3, "path"), (40, "offset"), None]


def test_phones(spark):
    values = ["+95 9 7712 3456", "(01) 555 0142", "2024-01-15", "12/03/2025", "USD 1,250.00", "12345",
              "1234567890123456789", "0000000", "012345678"]
    assert evaluate(spark, values, K.valid_phone) == [True, True] + [False] * 7
    assert evaluate(spark, [("1234567890123", "company registration"), ("0977123456", "Tel"), ("0977123456", "x")],
                    K.valid_phone, "a string, b string") == [False, True, False]
    assert evaluate(spark, ["+95 (9) 7712-3456", "09 - 421116317"], K.normalize_phone) == [
        "+95 (9) 7712-3456", "09-421116317"]
    assert evaluate(spark, ["+95 (9) 7712-3456", "0095 9 7712 3456", "09-421116317"], K.canonical_phone) == [
        "+95977123456", "+95977123456", "09421116317"]


def test_other_kinds(spark):
    assert evaluate(spark, ["stay@lakeview.example", "someone@example.com", "logo@2x.png", "not-an-email",
                            "abc@sentry.io", "no-reply@a.com"], K.valid_email) == [True] + [False] * 5
    assert evaluate(spark, ["USD 75", "$75.00 per night", "75", "2026", "call for pricing", "NZD 240"],
                    K.valid_price) == [True, True, True, False, False, True]
    assert evaluate(spark, ["12 Shore Road, Old Quarter, Sarnen 06060",
                            "Home | Rooms | Gallery | Contact | Book",
                            "We use cookies on this website. Privacy policy applies to 1 visit.", "Sarnen"],
                    K.valid_address) == [True, False, False, False]
    social = [("https://www.facebook.com/lakeviewlodge", "facebook"),
              ("https://www.facebook.com/sharer/sharer.php?u=x", "facebook"),
              ("https://twitter.com/intent/tweet?url=x", "twitter"), ("https://www.facebook.com/", "facebook"),
              ("https://www.instagram.com/x", "facebook")]
    assert evaluate(spark, social, K.is_social_profile, "a string, b string") == [True] + [False] * 4
    geo = evaluate(spark, ["https://www.google.com/maps/embed?pb=!1m18!3d21.9588!4d96.0891",
                           "https://maps.google.com/?q=21.9588,96.0891", "https://example.com/page"], K.geo_from_url)
    assert [tuple(g) if g else None for g in geo] == [("21.9588", "96.0891")] * 2 + [None]
    assert evaluate(spark, ["195.5", "21.9", "x"], K.valid_lat) == [False, True, False]
    assert evaluate(spark, ["Read more", "Deluxe Room", "---- a"], K.valid_text) == [False, True, False]
    assert evaluate(spark, ["4.5 out of 5", "none"], K.valid_rating) == [True, False]
    assert evaluate(spark, ["1,250", "12a"], K.valid_number) == [True, False]
    assert evaluate(spark, ["Open Mon-Fri 8:00-17:30, Sat closed"], K.find_hours) == [["Mon-Fri 8:00-17:30", "Sat closed"]]
    assert evaluate(spark, ["From USD 75 per night or 80 EUR"], K.find_prices) == [["USD 75 per night", "80 EUR"]]
