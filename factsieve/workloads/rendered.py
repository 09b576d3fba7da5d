"""Pages rendered out of the relational tables, so that what is extracted can be compared with the tables.

Every page is built from a bounded key range (never from "all rows of one group"), whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.sources.staging import spread

CARDS_PER_PAGE = 64
ORDERS_PER_PAGE, PAGES_PER_WALK = 3, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str | Column) -> DataFrame:
    """The rows of a table dealt to all cores before anything is made of them."""
    return spread(table(spark, sf_dir, name), key)


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def document(head: Column | str, body: Column | str) -> Column:
    return text("<!doctype html><html><head>", head, "</head><body>", body, "</body></html>")


def supplier_pages(spark: SparkSession, sf_dir: str, drop_phone_every: int | None = None) -> DataFrame:
    """A directory page per 64 supplier keys, one card per supplier."""
    key = F.col("s_suppkey")
    block = F.floor(key / CARDS_PER_PAGE)
    suppliers = dealt(spark, sf_dir, "supplier", block).join(
        F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")
    )
    number = text("09-42", pad(key, 7))
    name, street = F.col("s_name"), text("No.", key, ", Market Road, ", F.col("n_name"))
    phone = text('<p class="tel"><a href="tel:', F.replace(number, F.lit("-"), F.lit("")), '">', number, "</a></p>")
    if drop_phone_every:
        # digits would read as a phone number where the real one is left out
        name, street = text("Store ", F.translate(key.cast("string"), "0123456789", "abcdefghij")), text("Market Road, ", F.col("n_name"))
        phone = F.when(key % drop_phone_every == 0, text('<p class="tel"><i>not listed</i></p>')).otherwise(phone)
    card = text(
        '<div class="card card-', key, '"><h4>', name, "</h4>", phone, '<p class="addr">', street, "</p></div>",
    )
    cards = suppliers.groupBy(block.alias("page_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), card.alias("c")))), lambda x: x["c"]), "").alias("cards")
    )
    return cards.select(
        "page_id", text("http://dir.example/suppliers/", F.col("page_id")).alias("url"),
        document("<title>Suppliers</title>", text('<nav class="navbar"><a href="/">Home</a></nav><main class="results">', F.col("cards"), "</main>")).alias("html"),
    )


def part_pages(spark: SparkSession, sf_dir: str, microdata: bool = False) -> DataFrame:
    """A product page per part, its facts in JSON-LD or microdata only."""
    part = dealt(spark, sf_dir, "part", "p_partkey")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    if microdata:
        head: Column | str = ""
        body = text(
            '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">', F.col("p_name"), '</span><span itemprop="sku">SKU-',
            F.col("p_partkey"), '</span><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="', price,
            '"><meta itemprop="priceCurrency" content="USD"></div></div>',
        )
    else:
        product = F.to_json(
            F.struct(
                F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.col("p_name").alias("name"),
                text("SKU-", F.col("p_partkey")).alias("sku"), F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name")).alias("brand"),
                F.struct(F.lit("Offer").alias("@type"), price.alias("price"), F.lit("USD").alias("priceCurrency")).alias("offers"),
            )
        )
        head, body = text('<script type="application/ld+json">', product, "</script>"), "<p>See the data sheet.</p>"
    return part.select(
        F.col("p_partkey").alias("page_id"), text("http://shop.example/item/", F.col("p_partkey")).alias("url"), document(head, body).alias("html")
    )


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact sheet per customer: definition list, two-cell table or inline pairs by key."""
    customer = dealt(spark, sf_dir, "customer", "c_custkey")
    facts = [
        ("Name", F.col("c_name")), ("Telephone", text("+64 9 ", pad(F.col("c_custkey"), 7))), ("Industry", F.col("c_mktsegment")),
        ("Email", text("desk", F.col("c_custkey"), "@mail", F.col("c_nationkey"), ".example.org")),
    ]
    dl = text("<dl>", *[text(f"<dt>{k}</dt><dd>", v, "</dd>") for k, v in facts], "</dl>")
    rows = text("<table>", *[text(f"<tr><th>{k}</th><td>", v, "</td></tr>") for k, v in facts], "</table>")
    inline = text("<div>", *[text(f"<p>{k}: ", v, "</p>") for k, v in facts], "</div>")
    kind = F.col("c_custkey") % 3
    body = F.when(kind == 0, dl).when(kind == 1, rows).otherwise(inline)
    return customer.select(
        F.col("c_custkey").alias("page_id"), text("http://sheet.example/c/", F.col("c_custkey")).alias("url"), document("", body).alias("html")
    )


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged order lists: a walk per 12 order keys, three orders per page, numbered controls, no next on the last."""
    key = F.col("o_orderkey")
    span = ORDERS_PER_PAGE * PAGES_PER_WALK
    walk, page = F.floor(key / span), F.floor((key % span) / ORDERS_PER_PAGE) + 1
    orders = dealt(spark, sf_dir, "orders", walk)
    card = text(
        '<div class="row"><h4>Order ', pad(key, 9), '</h4><p class="price">USD ', F.col("o_totalprice").cast("decimal(18,2)"), '</p><p>Category: <span>',
        F.col("o_orderpriority"), "</span></p></div>",
    )
    pages = orders.groupBy(walk.alias("walk"), page.alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), card.alias("c")))), lambda x: x["c"]), "").alias("cards")
    )
    last = orders.groupBy(walk.alias("walk")).agg(F.max(page).alias("last"))
    def href(n: Column) -> Column:
        return text('<a class="page-numbers" href="/orders/', F.col("walk"), "?page=", n, '">', n, "</a>")

    before = F.when(F.col("page") > 1, href(F.col("page") - 1)).otherwise(F.lit(""))
    after = F.when(
        F.col("page") < F.col("last"),
        text(href(F.col("page") + 1), '<a class="pagination-next" href="/orders/', F.col("walk"), "?page=", F.col("page") + 1, '"><i></i></a>'),
    ).otherwise(F.lit('<span class="pagination-next disabled"></span>'))
    return pages.join(last, "walk").select(
        (F.col("walk") * PAGES_PER_WALK + F.col("page") - 1).alias("page_id"),
        text("http://orders.example/orders/", F.col("walk"), "?page=", F.col("page")).alias("url"), "walk", "page",
        document("<title>Orders</title>", text('<main class="results">', F.col("cards"), '</main><div class="pager">', before, after, "</div>")).alias("html"),
    )


def customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small site per customer: a root page naming it, a contact page with its number, two other pages."""
    customer = dealt(spark, sf_dir, "customer", "c_custkey")
    key = F.col("c_custkey")
    site = text("http://c", key, ".example")
    root = document(
        "<title>Welcome</title>",
        text('<nav><a href="/about-us">About us</a><a href="/contact.html">Contact</a><a href="/terms">Terms</a><a href="/news/2020/11/05/x">News</a></nav><h1>', F.col("c_name"), "</h1>"),
    )
    contact = document("", text("<h1>Contact</h1><dl><dt>Telephone</dt><dd>+64 9 ", pad(key, 7), "</dd></dl>"))
    about = document("", "<h1>About</h1><p>We sell things to people.</p>")
    def one(n: int, url: Column, html: Column) -> Column:
        return F.struct(F.lit(n).alias("n"), url.alias("url"), html.alias("html"))

    page = F.explode(
        F.array(
            one(0, site, root), one(1, text(site, "/contact.html"), contact), one(2, text(site, "/about-us"), about),
            one(3, text(site, "/terms"), about),
        )
    )
    return customer.select(key, page.alias("p")).select(
        (key * 4 + F.col("p.n")).alias("page_id"), F.col("p.url").alias("url"), F.col("p.html").alias("html"), F.col("p.n").alias("n"), "c_custkey",
    )


def gallery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture page per part: preview image, lazy image, srcset, picture sources, icons and trackers."""
    key = F.col("p_partkey")
    cdn = "https://cdn.example/p/"
    head = text('<meta property="og:image" content="', cdn, key, '/front.jpg?w=1200"><meta property="og:image:width" content="1200"><meta property="og:image:height" content="800">')
    body = text(
        '<section class="gallery"><img src="data:image/gif;base64,AAAA" data-src="', cdn, key, '/a.jpg" width="800" height="600">',
        '<img srcset="', cdn, key, "/b-600.jpg 600w, ", cdn, key, '/b-2000.jpg 2000w" src="', cdn, key, '/b-600.jpg">',
        '<picture><source srcset="', cdn, key, "/c-480.webp 480w, ", cdn, key, '/c-1600.webp 1600w"><img src="', cdn, key, '/c-480.webp"></picture>',
        '<img src="/img/icons/star.svg" width="20" height="20"><img src="', cdn, key, '/pixel.gif" width="1" height="1"></section>',
        '<section class="menu"><img src="', cdn, key, '/board.jpg?w=400" alt="', F.col("p_name"), ' chart" width="900" height="1200"></section>',
    )
    return dealt(spark, sf_dir, "part", "p_partkey").select(
        key.alias("page_id"), text("http://pics.example/", key).alias("url"), document(head, body).alias("html")
    )


def profile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contact page per supplier: address element, map link, social profile next to a share link, hours, meta data."""
    key = F.col("s_suppkey")
    lat, lng = latitude(key), longitude(key)
    head = text(
        '<meta name="description" content="Supplier ', key, ' ships parts to every region of the world."><link rel="canonical" href="http://s', key,
        '.example/start?utm_source=x"><meta name="icbm" content="', lat, ", ", lng, '">',
    )
    form = key % 3
    place = (
        F.when(form == 0, text('<iframe src="https://www.google.com/maps/embed?pb=!1m18!3d', lat, "!4d", lng, '"></iframe>'))
        .when(form == 1, text('<a href="https://maps.google.com/maps?q=', lat, ",", lng, '">map</a>'))
        .otherwise(text('<div data-lat="', lat, '" data-lng="', lng, '">map</div>'))
    )
    body = text(
        "<h1>", F.col("s_name"), "</h1><address>", key, " Harbour Street, Port Town ", pad(key, 5), "</address>", place,
        '<footer><a href="https://www.facebook.com/supplier', key, '">Facebook</a><a href="https://www.facebook.com/sharer/sharer.php?u=', key,
        '">Share</a></footer><p>Open Mon-Fri ', key % 4 + 6, ":00-18:00 all year round.</p>",
        "<h2>Facilities</h2><ul><li>Loading dock ", key, "</li><li>Cold store ", key, "</li></ul>",
    )
    return dealt(spark, sf_dir, "supplier", "s_suppkey").select(
        key.alias("page_id"), text("http://s", key, ".example/contact").alias("url"), document(head, body).alias("html")
    )


def contact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per supplier without meta data: mail link, map link in three forms, fax and messenger rows, a paragraph, a hero picture."""
    key = F.col("s_suppkey")
    lat, lng = latitude(key), longitude(key)
    form = key % 3
    place = (
        F.when(form == 0, text('<iframe src="https://www.google.com/maps/embed?pb=!1m18!3d', lat, "!4d", lng, '"></iframe>'))
        .when(form == 1, text('<a href="https://maps.google.com/maps?q=', lat, ",", lng, '">map</a>'))
        .otherwise(text('<a href="https://maps.example/?ll=', lat, "%2C", lng, '">map</a>'))
    )
    body = text(
        '<section class="hero" style="background-image:url(', "'/hero/", key, ".jpg'", ')"><h1>', F.col("s_name"), "</h1></section><p>Supplier ", key,
        " keeps a yard beside the canal and answers every letter within two days of its arrival.</p>", place, '<a href="mailto:desk', key, "@s", key,
        '.example?subject=hello">Write to the desk</a><dl><dt>Fax</dt><dd>+64 9 ', pad(key, 7), "</dd><dt>WhatsApp</dt><dd>+64 21 ", pad(key, 7), "</dd></dl>",
    )
    return dealt(spark, sf_dir, "supplier", "s_suppkey").select(
        key.alias("page_id"), text("http://s", key, ".example/desk").alias("url"), document("<title>Desk</title>", body).alias("html")
    )


def latitude(key: Column) -> Column:
    return text(key % 80, ".", pad(key % 9000 + 1000, 4))


def longitude(key: Column) -> Column:
    return text(key % 170, ".", pad(key % 8000 + 1000, 4))


def notice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per document, some with a restriction sign or status."""
    key = F.col("doc_id")
    sign = (
        F.when(key % 6 == 0, F.lit("<p>Please verify you are human.</p>")).when(key % 6 == 1, F.lit("<p>Subscribe to continue reading now.</p>"))
        .when(key % 6 == 2, F.lit('<div class="g-recaptcha"></div>')).otherwise(F.lit(""))
    )
    clean = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return dealt(spark, sf_dir, "documents", "doc_id").select(
        key.alias("page_id"), text("http://doc.example/", key).alias("url"), document("", text("<p>", clean, "</p>", sign)).alias("html"),
        F.when(key % 11 == 0, 403).when(key % 13 == 0, 429).otherwise(200).alias("status"),
    )


def snapshot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a page per customer: an empty shell and its rendered copy, or a full page and a broken copy, or the full page alone; one older version of every ninth."""
    key = F.col("c_custkey")
    full = document("<title>Welcome</title>", text("<h1>", F.col("c_name"), '</h1><p><a href="tel:+649', pad(key, 7), '">+64 9 ', pad(key, 7), "</a></p>"))
    old = document("<title>Welcome</title>", text("<h1>Former ", F.col("c_name"), "</h1><p>This page has moved and is kept for the record only, with no number to call.</p>"))
    shell = document("", '<div id="root"></div><script src="/app.js"></script><script src="/vendor.js"></script>')

    def one(n: int, renderer: str, html: Column, day: int, shown: Column) -> Column:
        return F.when(shown, F.struct((key * 4 + n).alias("page_id"), F.lit(renderer).alias("renderer"), html.alias("html"), F.make_timestamp(F.lit(2026), F.lit(1), F.lit(day), F.lit(0), F.lit(0), F.lit(0)).alias("fetched_at")))

    form = key % 3
    copies = F.array_compact(F.array(
        one(0, "static", F.when(form == 0, shell).otherwise(full), 2, F.lit(True)), one(1, "playwright", F.when(form == 0, full).otherwise(F.lit("<p>x</p>")), 3, form != 2),
        one(2, "static", old, 1, key % 9 == 0)))
    return dealt(spark, sf_dir, "customer", "c_custkey").select(key, F.explode(copies).alias("p")).select("p.page_id", text("http://r", key, ".example/").alias("url"), "p.html", "p.renderer", "p.fetched_at")


def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer whose trade stands in running text only."""
    key = F.col("c_custkey")
    return dealt(spark, sf_dir, "customer", "c_custkey").select(
        key.alias("page_id"), text("http://m", key, ".example/").alias("url"), "c_custkey", "c_mktsegment",
        document("<title>Welcome</title>", text("<h1>", F.col("c_name"), "</h1><p>Since 1901 the house has dealt in ", F.col("c_mktsegment"), " and nothing else.</p>")).alias("html"))


def access_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer: readable, a login form, a challenge, a shell that needs a browser, a page asking for scripts, lazy pictures only."""
    key = F.col("c_custkey")
    prose = "<p>" + "Plain words about the house and its trade. " * 16 + "</p>"
    forms = (
        document("<title>A</title>", prose), document("<title>B</title>", '<form><input type="text"><input type="password"></form>'),
        document("<title>C</title>", "<p>Checking your browser. Just a moment...</p>"), document("<title>D</title>", '<div id="app"></div>'),
        document("<title>E</title>", prose + "<noscript>Please enable JavaScript to go on.</noscript>"), document("<title>F</title>", prose + '<div data-src="/1.jpg"></div><div data-src="/2.jpg"></div><div data-src="/3.jpg"></div>'),
    )
    html = F.element_at(F.array(*forms), (key % 6 + 1).cast("int"))
    return dealt(spark, sf_dir, "customer", "c_custkey").select(key.alias("page_id"), text("http://v", key, ".example/").alias("url"), html.alias("html"))
