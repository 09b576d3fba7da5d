"""Element rows, page relations and the single-page cascade on small hand-written pages."""

import random

import pages as pg
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factsieve.operators import cascade, classify, images, page, records, structured
from factsieve.operators.labels import spec_rows
from factsieve.operators.select import pool, site_fields
from factsieve.operators.tables import PageTables
from factsieve.plans.extract import page_records, page_tables
from factsieve.sources.nodes import explode_nodes

LABELS = [
    "Business Name", "Phone Number", "WhatsApp", "Email", "Address", "Latitude", "Price", "Description", "Main Image",
    "Gallery Images", "Menu Image", "Amenities", "Room Type", "Facebook", "Twitter", "Opening Hours", "Pet Policy", "General Manager",
    "CEO Name",
]


def frame(spark, *html):
    rows = [(i, f"http://x.example/p{i}", h) for i, h in enumerate(html, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def nodes_of(spark, *html):
    return page.page_scope(explode_nodes(frame(spark, *html)))


@pytest.fixture(scope="module")
def place(spark):
    rows = spark.createDataFrame([(1, pg.PLACE_URL, pg.PLACE)], "page_id long, url string, html string")
    t = page_tables(rows)
    specs = spec_rows(spark, LABELS)
    own = t.pages.select("page_id", F.col("url").alias("site"), F.lit(0).alias("visit"))
    fields = site_fields(pool(cascade.resolve(t, specs), own), own, specs)
    return t, {r.field_key: r for r in fields.collect()}


def test_answers(place):
    got = place[1]
    value = {k: r.value if not r.plural else r["items"] for k, r in got.items()}
    assert value["business_name"] == "Kilnhouse" and got["business_name"].method == "jsonld:LodgingBusiness.name"
    assert value["phone_number"] == "+44 1835 55 01 77" and got["phone_number"].confidence >= 0.8
    assert value["whats_app"] == "+44 7700 90 01 42"
    assert value["email"] == "hello@kilnhouse.example"
    assert value["address"].startswith("Old Mill, Weirside, Selham")
    assert value["latitude"] == "55.6721"
    assert value["price"] == "from GBP 64 per night"
    assert value["main_image"] == "https://media.kilnhouse.example/yard.jpg?width=1400"
    assert value["gallery_images"][:3] == [f"https://media.kilnhouse.example/s/{n}.jpg" for n in ("wheel-1500", "glaze", "firing-small")]
    assert value["menu_image"].endswith("menu-summer.jpg")
    assert value["amenities"] == ["Drying room", "Two gas kilns", "Shared kitchen"]
    assert value["room_type"][:2] == ["Loft Twin", "Millrace Double"]
    assert value["facebook"] == "https://www.facebook.com/kilnhousepots"
    assert value["general_manager"] == "Isla Renwick"
    assert "Thursday" in value["opening_hours"]


def test_absent_values_are_null(place):
    got = place[1]
    for key in ("twitter", "pet_policy", "ceo_name"):
        assert got[key].value is None and not got[key].found and got[key].confidence == 0.0


def test_provenance(place):
    for row in place[1].values():
        if row.found:
            assert row.source_url == pg.PLACE_URL and row.method


def test_digest(place):
    text = place[0].digests.first().digest
    assert text.startswith("TITLE: Stay - Kilnhouse\n\nOG_TITLE: Kilnhouse")
    assert "WhatsApp: +44 7700 90 01 42" in text and "Charity number" not in text


def test_malformed_markup(spark):
    rows = nodes_of(spark, "<p>a<b>x<p>c<table><tr><td>1<td>2<tr><td>3</table><ul><li>q<li>r</ul><noscript>enable <b>j</b></noscript>tail").collect()
    by_tag = {}
    for r in sorted(rows, key=lambda r: r.node_id):
        by_tag.setdefault(r.tag, []).append(r)
    assert [r.full_text for r in by_tag["li"]] == ["q", "r"]
    assert [r.full_text for r in by_tag["td"]] == ["1", "2", "3"]
    assert by_tag["tr"][0].parent_tag == "tbody"
    assert [r.full_text for r in by_tag["p"]] == ["ax", "c"]
    assert by_tag["noscript"][0].raw_text == "enable <b>j</b>"
    body = by_tag["body"][0]
    assert all(body.node_id < r.node_id <= body.last_desc for r in by_tag["li"])


def test_long_texts_keep_their_length(spark):
    rows = nodes_of(spark, "<div><p>" + "word " * 4000 + "</p></div>").collect()
    p, div = (next(r for r in rows if r.tag == tag) for tag in ("p", "div"))
    assert len(p.full_text) == p.text_len > 19000 and div.full_text is None and div.text_len >= p.text_len


def test_long_paragraphs_and_long_lists(spark):
    long = "<p>" + "plain words " * 900 + "Telephone: +353 21 555 0186 " + "and more of them " * 300 + "</p>"
    many = "<ul>" + "".join(f"<li class='row'><h3>Item number {i}</h3><p>Some words on it</p></li>" for i in range(1000)) + "</ul>"
    t = page_tables(frame(spark, f"<body>{long}</body>", f"<body>{many}</body>"))
    specs = spec_rows(spark, ["Phone Number"])
    own = t.pages.select("page_id", F.col("url").alias("site"), F.lit(0).alias("visit"))
    got = {r.site: r.value for r in site_fields(pool(cascade.resolve(t, specs), own), own, specs).collect()}
    assert got["http://x.example/p1"] == "+353 21 555 0186"
    groups = records.record_groups(t.nodes).where("page_id = 2").groupBy("signature").count().collect()
    assert [r["count"] for r in groups if r.signature.startswith("li|row")] == [1000]


def test_pairs(spark):
    html = (
        "<dl><dt>Tel:</dt><dd>12 34</dd><dd>56 78</dd></dl><table><tr><th>Size</th><td>L</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>"
        "<div><label>Colour</label><span>red</span></div><p>Weight: 10 kg</p><p><strong>Lead</strong> - rest of it</p><nav><dl><dt>N</dt><dd>v</dd></dl></nav>"
    )
    nodes = page.page_scope(page.stage_nodes(explode_nodes(frame(spark, html))))
    got = {(r.kind, r.label, r.value, r.boilerplate) for r in page.pairs(nodes, page.blocks(nodes)).collect()}
    assert ("dl", "Tel", "12 34", False) in got and ("dl", "Tel", "56 78", False) in got
    assert ("table", "Size", "L", False) in got and not any(g[0] == "table" and g[1] == "a" for g in got)
    assert ("sibling", "Colour", "red", False) in got
    assert ("inline", "Weight", "10 kg", False) in got
    assert ("prefix", "Lead", "rest of it", False) in got
    assert ("dl", "N", "v", True) in got


def test_structured_data_repair_and_microdata(spark):
    html = (
        '<script type="application/ld+json">{"@type":"Thing","name":"A","list":[1,2.0,],}</script>'
        '<script type="application/ld+json">{"@type":"Thing","name":"B"}, {"@type":"Thing","name":"C"}</script>'
        '<script type="application/ld+json">{"@type":"WebSite","name":"noise","image":{"@type":"ImageObject","url":"http://x.example/i.png"}}</script>'
        '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">M</span><div itemprop="offers" itemscope '
        'itemtype="https://schema.org/Offer"><meta itemprop="price" content="5"></div><a itemprop="url" href="/m">x</a></div>'
    )
    rows = structured.page_entries(nodes_of(spark, html)).orderBy("seq").collect()
    names = [(r.value, r.source) for r in rows if r.key == "name"]
    assert names == [("A", "jsonld"), ("B", "jsonld"), ("C", "jsonld"), ("M", "microdata")]
    assert [r.value for r in rows if r.key == "list"] == ["1", "2"]
    image = next(r for r in rows if r.key == "image")
    assert image.value == "http://x.example/i.png" and not image.is_primary
    assert [(r.path, r.value) for r in rows if r.key == "price"] == [("Product.price", "5"), ("Product.Offer.price", "5")]


def test_srcset(spark):
    rows = spark.createDataFrame(
        [("a-480.jpg 480w, a-1200.jpg 1200w, a-800.jpg 800w",), ("a.jpg 1x, a@2x.jpg 2x",), ("single.jpg",), ("",),
         ("https://c.x/w_400,h_300/a.jpg 400w, https://c.x/w_800,h_600/a.jpg 800w",)], "s string")
    got = [r.b.url if r.b else None for r in rows.select(images.best_srcset(F.col("s")).alias("b")).collect()]
    assert got == ["a-1200.jpg", "a@2x.jpg", "single.jpg", None, "https://c.x/w_800,h_600/a.jpg"]


def test_restrictions_and_rendering(spark):
    long_text = "<p>" + "Real content about the hotel and its rooms. " * 40 + "</p>"
    rows = spark.createDataFrame(
        [(1, "http://a.example/1", "<p>x</p>", 403), (2, "http://a.example/2", "<div class='g-recaptcha'></div>", 200),
         (3, "http://a.example/3", "<p>Just a moment...</p>", 200), (4, "http://a.example/4", long_text + "<p>just a moment</p>", 200),
         (5, "http://a.example/5", "<form><input type='password'></form>", 200), (6, "http://a.example/6", "<div id='root'></div>", 200),
         (7, "http://a.example/7", "<noscript>Please enable JavaScript</noscript>" + long_text, 200)],
        "page_id long, url string, html string, status int")
    t = page_tables(rows)
    usable, errors = classify.usable_pages(t.pages, t.nodes, t.texts)
    assert {r.page_id: r.type for r in errors.collect()} == {1: "blocked", 2: "captcha", 3: "captcha", 5: "login_required"}
    assert {r.page_id for r in usable.select("page_id").collect()} == {1, 4, 6, 7}
    reasons = {r.page_id: r.reason for r in classify.needs_rendering(t.pages, t.nodes, t.texts).collect()}
    assert reasons[4] is None and reasons[6] == "empty SPA mount point (#root)" and reasons[7].startswith("<noscript>")
    asked = classify.needs_rendering(t.pages, t.nodes, t.texts, rows.select("page_id")).where("page_id = 4").first()
    assert asked.needed


def test_scope_is_a_page_of_its_own(spark):
    html = "<html><head><meta property='og:title' content='T'></head><body><header><div class='c'><p>one</p></div></header></body></html>"
    nodes = page.page_scope(page.stage_nodes(explode_nodes(frame(spark, html))))
    item = nodes.where(F.col("tag") == "div").select("page_id", "node_id", "last_desc")
    t = PageTables(frame(spark, html).withColumn("final_url", F.col("url")), page.item_scopes(nodes, item))
    assert t.meta.count() == 0
    assert [(r.text, r.boilerplate) for r in t.blocks.collect()] == [("one", False)]


def test_nested_scopes_by_sweep(spark):
    """Random trees, items nested in items: the sweep against every interval."""
    rng = random.Random(4)
    nodes, items = [], []
    for p in range(30):
        ends, stack, n = {}, [], rng.randrange(1, 60)
        for i in range(1, n + 1):
            while stack and rng.random() < 0.4:
                ends[stack.pop()] = i - 1
            stack.append(i)
        ends |= dict.fromkeys(stack, n)
        nodes += [(p, i, ends[i]) for i in range(1, n + 1)]
        items += [(p, i, ends[i]) for i in range(1, n + 1) if p and rng.random() < 0.3]
    frame = spark.createDataFrame(nodes, "page_id long, node_id int, last_desc int")
    chosen = spark.createDataFrame(items, "page_id long, node_id int, last_desc int")
    swept = page.item_scopes(frame.withColumn("scope_id", F.lit(0)), chosen)
    want = sorted((p, n, a) for p, n, _ in nodes for q, a, b in items if p == q and a <= n <= b)
    assert sorted((r.page_id, r.node_id, r.scope_id) for r in swept.collect()) == want
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and ">=" not in plan.split("Join")[0]


def test_a_list_led_by_adverts(spark):
    """Groups are judged by all their items: four empty ones in front do not hide a list."""
    adverts = "".join(f'<div class="card"><h4>Save now {i}</h4><p class="tel">on everything</p><p class="addr">while it lasts</p></div>' for i in range(4))
    cards = "".join(f'<div class="card"><h4>Firm {i}</h4><p class="tel"><a href="tel:0415550{i:03}">041 555 0{i:03}</a></p><p class="addr">Unit {i}, Harbour Lane, Eastwick</p></div>' for i in range(30))
    t = page_tables(frame(spark, f"<main>{cards}</main>", f"<main>{adverts}{cards}</main>"))
    out = page_records(t, spec_rows(spark, ["Name", "Phone Number", "Address"]))
    got = {r.page_id: r.n for r in out.records.where("fields_found = 3").groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 30, 2: 30}


def test_staged_tables_are_narrow_reads_without_shuffles(spark):
    t = page_tables(frame(spark, "<p>one</p>", "<p>two</p>"))
    ranked = t.nodes.select("page_id", "tag", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")).alias("n"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "full_text" not in plan and "attrs" not in plan and "Bucketed: true" in plan
    assert {(r.page_id, r.tag) for r in ranked.collect()} >= {(1, "p"), (2, "p")}
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and not [x for x in spark.catalog.listTables() if x.name.startswith("staged_")]


def test_many_paragraphs_and_chips(spark):
    """A hundred paragraphs are a hundred candidates, and a box of a hundred chips is read whole."""
    paragraphs = "".join(f"<p>Paragraph {i} tells of the house by the canal and its yard.</p>" for i in range(100))
    chips = "".join(f"<span>Thing {i}</span>" for i in range(100))
    t = page_tables(frame(spark, f"<body>{paragraphs}<div class='amenities'>{chips}</div></body>"))
    found = cascade.resolve(t, spec_rows(spark, ["Description", "Amenities"]))
    got = {r.field_key: r.n for r in found.groupBy("field_key").agg(F.count_distinct("value").alias("n")).collect()}
    assert got["description"] >= 100 and got["amenities"] >= 100


def test_long_pages_are_whole_in_digests_and_patterns(spark):
    facts = "".join(f"<dt>Fact {i}</dt><dd>{'word ' * 110}end{i}.</dd>" for i in range(130))
    phones = "".join(f"<p>Call +95 9 7712 {3000 + i}.</p>" for i in range(20))
    t = page_tables(frame(spark, f"<body><dl>{facts}</dl>{phones}<p>The last line.</p></body>"))
    text = t.digests.first().digest
    assert text.endswith("The last line.") and len(text) > 100_000
    labelled = text.split("PAGE TEXT:")[0]
    assert all(f"end{i}." in labelled for i in range(130))
    hits = spark.createDataFrame([("a1 " * 15,)], "text string").select(cascade.pattern_hits(F.col("text"), r"a\d").alias("h")).first().h
    assert [(h.i, h.m, h["at"]) for h in hits] == [(i, "a1", 3 * i) for i in range(15)]


def test_lists_and_their_items_meet_without_a_join(spark):
    """Lists, nested lists and lists in menus; chips answer only where no list does."""
    html = (
        "<h2>Amenities</h2><ul><li>Drying room</li><li>Kiln <ol><li>Gas</li><li>Wood</li></ol></li></ul><nav><ul><li>A way</li><li>B way</li></ul></nav>",
        "<ul class='amenities'><li>Only one</li></ul><div class='amenities box'><span>Sauna</span><span>Pool</span><b class='x'>Bar</b></div>",
        "<div class='amenities'><i>Lone</i></div>", "<h3>Facilities</h3><ol><li>Dock</li><li>Cold store</li></ol><div class='amenities'><i>Never</i><i>Shown</i></div>",
    )
    t = page_tables(frame(spark, *html))
    specs = spec_rows(spark, ["Amenities"])
    made = cascade.from_lists(t, specs)
    got = sorted((r.page_id, r.value, r.method.split(" ")[0]) for r in made.collect())
    assert got == [
        (1, "Drying room", "list"), (1, "Kiln GasWood", "list"), (2, "Bar", "chips"), (2, "Pool", "chips"), (2, "Sauna", "chips"),
        (4, "Cold store", "list"), (4, "Dock", "list"),
    ], got
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 2  # chips with their boxes, and once more for the lists of their pages
