"""What keeps the cost of a page low, and that it changes no result."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import Window
from pyspark.sql import functions as F

from factsieve.functions import kinds as K
from factsieve.functions import text as T
from factsieve.functions import urls as U
from factsieve.operators import cascade as C
from factsieve.operators import images as I
from factsieve.operators import page as P
from factsieve.operators import records as R
from factsieve.operators import structured as S
from factsieve.operators.labels import spec_rows
from factsieve.plans.extract import page_tables
from factsieve.sources import nodes as N
from factsieve.sources import staging

PIECES = (
    "<p>", "</p>", "<br/>", "<br />", "<script>", "</script>", "</script >", "<style>", "<!-- x -->", "<!--", "<!doctype html>", "<?x?>", "&amp", "a < b",
    '<a href="x&amp;y">', "<a b='c'>", "<a b=c>", "<svg>", "</svg>", "<noscript>", "</noscript>", "<title>a<b>", "</title>", "<DIV CLASS='x'>", "</DIV>", '<p a="1"b>',
    '<p a="1" a="2">', "<table><tr><td>1", "</table>", '<div class="nav x" role="navigation" id="q">', "text ", "\n\t ", "<p / >", "</>", "</ x>", '<img src="a"/>', "<", ">",
)


def test_plain_markup_is_not_read_by_the_standard_parser(monkeypatch):
    def fail(*_):
        raise AssertionError("read by the standard parser")

    for name in ("parse_starttag", "parse_endtag"):
        monkeypatch.setattr(HTMLParser, name, fail)
    tree = N._Tree()
    tree.feed('<!doctype html><html><head></head><body><p class="a" hidden>x &amp; y</p><img src="/1.jpg"/></body></html>')
    assert [(n.tag, n.attrs) for n in tree.rows()][2:] == [("body", {}), ("p", {"class": "a", "hidden": ""}), ("img", {"src": "/1.jpg"})]


def test_pages_are_read_as_by_the_standard_parser():
    def rows(feed, html):
        tree, out = N._Tree(), []
        feed(tree, html)
        N._rows(1, tree, out)
        return out

    rnd = random.Random(5)
    for _ in range(1500):
        html = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 14)))
        assert rows(N._Tree.feed, html) == rows(HTMLParser.feed, html), html


def test_plain_addresses_are_their_own_spelling(spark):
    plain = ["http://a.b/", "https://a-1.b/p/q.html?x=1&y=/z", "http://a.b/p//q"]
    other = ["http://A.b/p", "http://a.b", "http://a.b/p/../q", "http://a.b:80/p", "http://a.b/p?", "http://a.b/p#f", "http://a.b/p q", "http://a.b/p\n", "http://a.b/" + "q/" * 20000 + ".."]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(plain + other)], "i int, u string")
    got = [r.c for r in rows.select("i", U.canonical_url(F.col("u")).alias("c")).orderBy("i").collect()]
    assert got[:10] == plain + ["http://a.b/p", "http://a.b/", "http://a.b/q", "http://a.b/p", "http://a.b/p", "http://a.b/p#f", "http://a.b/p%20q"]
    assert U._PLAIN in rows.select(U.canonical_url(F.col("u")))._jdf.queryExecution().analyzed().toString()
    keys = spark.createDataFrame([("http://www.a.b/p/",), ("http://a.b/p/",), ("http://a.b/p",)], "u string").select(U.normalize_url(F.col("u")).alias("k")).collect()
    assert {r.k for r in keys} == {"http://a.b/p"}


def test_renditions_are_sought_among_the_attributes_an_image_has(spark):
    rows = spark.createDataFrame([({"src": "b.jpg", "data-src": "a.jpg", "alt": "x"},), ({"alt": "x"},)], "attrs map<string,string>")
    made = rows.select(I._variants(("data-src", "data-original", "src")).alias("v"))
    assert [[v.url for v in r.v] for r in made.collect()] == [["a.jpg", "b.jpg"], []]
    assert "array_intersect" in made._jdf.queryExecution().analyzed().toString()


def test_both_kinds_of_structured_data_come_from_one_parse(spark):
    pages = spark.createDataFrame([(1, '<script type="application/ld+json" itemscope>{"name":"a","offers":[{"price":4.0,"priceCurrency":"USD"}]}</script><p itemscope><b itemprop="name">m</b></p>')], "page_id long, html string")
    entries = S.page_entries(P.page_scope(N.explode_nodes(pages)))
    assert entries._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = [(r.source, r.key, r.value) for r in entries.orderBy("seq").collect()]
    assert ("jsonld", "price", "USD 4") in got and ("microdata", "name", "m") in got and got[0][0] == "jsonld" and got[-1][0] == "microdata"


def test_words_are_parted_without_squishing_first(spark):
    rows = spark.createDataFrame([("The ​ Big  \nred-Dog  9",), (None,)], "t string").select(T.tokens(F.col("t")).alias("w"), T.squish(F.col("t")).alias("s"))
    assert "regexp_replace" not in rows.select("w")._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.w, r.s) for r in rows.collect()] == [(["big", "red", "dog", "9"], "The Big red-Dog 9"), ([], "")]


def test_separators_of_an_address_are_counted_without_a_pattern(spark):
    texts = ["1 Dock Road", "1 Dock | Road | x", "1 a | b | c | d", "1 " + "a " * 43 + "b", "1 " + "a " * 44 + "b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", K.valid_address(F.col("t")).alias("ok"))
    assert "[^|]" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r.ok for r in rows.orderBy("i").collect()] == [True, True, False, True, False]


def test_texts_that_several_tests_read_are_written_once(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], "page_id long, url string, html string")
    t = page_tables(pages)
    plan = t.kept_texts._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and [r.text for r in t.kept_texts.collect()] == ["x"]


def test_staged_element_rows_are_never_broadcast(spark):
    html = "<ul>" + "".join(f"<li>{w} words of one item<b>{w}</b></li>" for w in ("some", "more", "last")) + "</ul>"
    t = page_tables(spark.createDataFrame([(i, f"http://a.b/{i}", html) for i in range(3)], "page_id long, url string, html string"))
    items = t.nodes.where("tag = 'li'").select("page_id", "node_id", "last_desc")
    scopes = P.item_scopes(t.nodes, items)
    found = {(r.page_id, r.scope_id, r.tag, r.full_text) for r in scopes.collect()}
    assert {x[2:] for x in found if x[0] == 1} == {(tag, text) for w in ("some", "more", "last") for tag, text in (("li", f"{w} words of one item{w}"), ("b", w))} and len(found) == 18
    assert "Broadcast" not in scopes._jdf.queryExecution().executedPlan().toString()


def test_texts_are_single_spaced_without_a_pattern(monkeypatch):
    rnd, pattern = random.Random(7), N._WS
    for _ in range(3000):
        text = "".join(rnd.choice("ab  \t\n\r\x0b\x1c\x1f\x85  ᠎ ​‍  　﻿") for _ in range(rnd.randint(0, 9)))
        assert N._single_spaced(text) == pattern.sub(" ", text), repr(text)
        pieces = [N._single_spaced(x) for x in text.partition("a")]
        assert N._joined(pieces) == pattern.sub(" ", "".join(pieces)).strip(), pieces

    class Fails:
        def sub(self, *_):
            raise AssertionError("tried a pattern")

    monkeypatch.setattr(N, "_WS", Fails())
    tree = N._Tree()
    tree.feed("<body><div>One <b>bold</b>\n word</div><p>A long  text\n of one piece</p></body>")
    assert [n.text for n in tree.rows()][1:] == ["One bold wordA long text of one piece", "One bold word", "bold", "A long text of one piece"]


def test_pairs_and_blocks_need_no_windows(spark):
    rnd = random.Random(11)
    pieces = (
        "<dl>", "</dl>", "<dt>Term {}</dt>", "<dt></dt>", "<dd>Value {}</dd>", "<div>", "</div>", "<b>Word {}</b>", "<label>Name {}</label>", "<p class='x label'>Kind {}</p>", "text ",
        "<i id='k'>Thing {}</i>", "<em class='a  b c'>Other {}</em>", "<script>x</script>", "<p class='title'>" + "long " * 12 + "</p>", "<h4> </h4>", "<table><tr><th>T {}</th><td>c</td></tr></table>",
    )
    pages = ["".join(rnd.choice(pieces).format(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 25))) for _ in range(300)] + ["", "<dl><dt>A</dt><dl><dd>b</dd></dl><dd>c</dd></dl>"]
    made = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    for nodes in (P.page_scope(N.explode_nodes(made)), P.page_scope(N.explode_nodes(made)).withColumn("scope_id", F.lit(3)).where("node_id >= 3")):
        kids = nodes.where(F.col("content") & (F.col("parent_id") >= F.col("scope_id")) & (F.col("parent_id") > 0))
        order = Window.partitionBy(*P.KEYS, "parent_id").orderBy("node_id")
        ahead = kids.withColumn("after", F.lead(F.struct("full_text", P.selector().alias("sel"))).over(order))
        marked = F.col("tag").isin("label", "strong", "b", "dt", "h3", "h4", "h5", "h6") | P.attr_text("class").contains("label") | P.attr_text("class").contains("title")
        siblings = ahead.where(marked & F.length("full_text").between(1, 50) & (F.col("after.full_text") != "")).select("page_id", "node_id", F.col("full_text").alias("label"), F.col("after.full_text").alias("value"), F.col("after.sel").alias("selector"))
        term = F.last(F.when(F.col("tag") == "dt", F.coalesce("full_text", F.lit(""))), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        terms = kids.where((F.col("parent_tag") == "dl") & F.col("tag").isin("dt", "dd")).withColumn("label", term).where("tag = 'dd' and label != ''").select("page_id", "node_id", "label", F.col("full_text").alias("value"), P.selector().alias("selector"))
        for found, wanted in ((P.pairs_sibling(nodes), siblings), (P.pairs_dl(nodes), terms)):
            assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
            got = sorted(map(tuple, found.select(*wanted.columns).collect()))
            assert got == sorted(map(tuple, wanted.collect())) and len(got) > 5
        blocks = P.blocks(nodes)
        assert "Window" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    whole = P.page_scope(N.explode_nodes(made))
    bodies = {r.page_id: r.t for r in whole.groupBy("page_id").agg(F.max(F.when(F.col("tag") == "body", F.col("full_text"))).alias("t")).collect()}
    texts = {r.page_id: r.text for r in P.page_text(P.blocks(whole).limit(0), whole).collect()}
    assert texts == {k: t or "" for k, t in bodies.items()}


def test_staged_tables_are_merged_where_their_pages_lie(spark):
    html = "<ul>" + "".join(f"<li>{w} words of one item<b>{w}</b></li>" for w in ("some", "more", "last")) + "</ul>"
    t = page_tables(spark.createDataFrame([(i, f"http://a.b/{i}", html) for i in range(3)], "page_id long, url string, html string"))
    items = t.nodes.where("tag = 'li'").select("page_id", "node_id", "last_desc")
    plans = []
    with staging._writing(spark):
        plans.append(P.item_scopes(t.nodes, items)._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plans[0] and not re.search(r"hashpartitioning\(page_id#\d+L?, node_id", plans[0])
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_words_and_classes_are_found_without_a_split(spark):
    rows = spark.createDataFrame([(" b a1\tc  ",), ("x",), ("",), (None,)], "c string")
    made = rows.select(P.class_list(F.col("c")).alias("l"), T.tokens(F.col("c"), True).alias("w"), P.selector_of(F.lit("p"), F.col("c"), F.lit(None)).alias("s"))
    assert "split(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in made.collect()] == [(["b", "a1", "c"], ["b", "a1", "c"], "p.b.a1"), (["x"], ["x"], "p.x"), ([], [], "p"), ([], [], "p")]


def test_labels_that_cannot_match_are_told_apart_cheaply(spark):
    specs = spec_rows(spark, ["Name", "Price", "Category", "Nightly Rate", "ID", "Ärzte", "C++"])
    rnd = random.Random(3)
    words = ["category", "categry", "ctegory", "name", "nam", "id", "x", "rates", "nightly", "price range", "ärzte", "c++", "c", "5-LOW", "Order 000000001", "USD 12.50", "total", "catgory!", "prize", "ratenightly"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(300)] + words + [f"{w}:" for w in words] + ["", ":", "a::", "Category：", "cat" * 40]
    rows = C.with_label(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), specs)
    known = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace(F.lower(T.squish(F.col("t"))), r"[:：]\s*$", "").alias("m_text"))
    known = known.withColumn("m_text", F.when(F.length("m_text") <= 80, F.col("m_text")).otherwise(F.lit(""))).withColumns(
        {"m_bare": T.alnum(F.col("m_text")), "m_tokens": T.tokens(F.col("m_text")), "m_near": F.lit(True)}).withColumn("m_grams", T.grams(F.col("m_bare")))
    found = [frame.select("t", "m_text", "m_bare", "m_near", F.transform(C.spec_literal(specs), C.label_match).alias("m")).orderBy("t", "m_text").collect() for frame in (rows, known)]
    assert [(r.t, r.m_text, r.m_bare, r.m) for r in found[0]] == [(r.t, r.m_text, r.m_bare, r.m) for r in found[1]]
    assert any(not r.m_near for r in found[0]) and any(max(r.m) > 0 for r in found[0])


def test_a_text_is_read_once_for_its_matches(spark):
    codes = "|".join(K.CURRENCY_CODES)
    code = rf"{K.EDGE_L}(?:{codes}){K.EDGE_R}"
    price = (
        rf"(?i)(?:(?:US\$|[{K.CURRENCY_SYMBOLS}]|{code})\s?\d[\d,.\s]*(?:\.\d{{1,2}})?|\d[\d,.]*\s?(?:US\$|[{K.CURRENCY_SYMBOLS}]|{code}))"
        r"(?:\s?(?:per|/)\s?(?:night|day|month|year|person|pax|room|week|hour|guest|adult))?"
    )
    rnd = random.Random(9)
    pieces = ["USD ", "usd", "xUSD 5", "12", "3.50", ",", ".", " ", "€", "US$", "$", "Rs. 5", "per night", "EURO", "EUR", "\n", "\x01", "$0", "order", "_"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    made = rows.select("text", C.pattern_hits(F.col("text"), K.PRICE_PATTERN).alias("h"), C.pattern_hits(F.col("text"), K.PRICE_PATTERN, 1).alias("one"), F.regexp_extract_all("text", F.lit(price), F.lit(0)).alias("old")).collect()
    for r in made:
        assert [h.m for h in r.h] == r.old and [h.i for h in r.h] == list(range(len(r.old))) and r.one == r.h[:1], r.text
        assert all(r.text[h.at:h.at + len(h.m)] == h.m for h in r.h) and [h.at for h in r.h] == sorted({h.at for h in r.h}), r.text
    assert sum(len(r.h) for r in made) > 200 and any(r.h and "\x01" in r.text for r in made)


def test_addresses_with_one_plain_parameter_are_their_own_key(spark):
    urls = ["http://a.b/p?page=2", "http://a.b/?x=", "http://a.b/p/?page=2", "http://a.b/p?ref=2", "http://a.b/p?UTM_x=2", "http://a.b/p?refs=2", "http://www.a.b/p?q=1", "http://a.b/p?q", "http://x.a.b/p?b=1&a=2", "http://localhost/p?q=1", "http://www.com/", "http://a.b:81/p", "http://A.b/p?q=%20"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", U.normalize_url(F.col("u")).alias("k"), U.site_root(F.col("u")).alias("s"), F.col("u").rlike(U._PLAIN_KEY).alias("plain")).orderBy("i").collect()
    assert [r.k for r in rows] == ["http://a.b/p?page=2", "http://a.b/?x=", "http://a.b/p?page=2", "http://a.b/p", "http://a.b/p", "http://a.b/p?refs=2", "http://a.b/p?q=1", "http://a.b/p?q=", "http://x.a.b/p?a=2&b=1", "http://localhost/p?q=1", "http://com/", "http://a.b:81/p", "http://a.b/p?q=+"]
    assert [r.s for r in rows] == ["a.b"] * 9 + ["localhost", "com", "a.b", "a.b"]
    assert [r.i for r in rows if r.plain] == [0, 1, 5, 9]


def test_fallbacks_leave_answered_fields_alone(spark):
    page = spark.createDataFrame([(1, "http://a.b/", "<h4>Lamp</h4><p>USD 5.00</p>")], "page_id long, url string, html string")
    t, specs = page_tables(page), spec_rows(spark, ["Name", "Price"])
    for done, wanted in ((["price"], {"name"}), ([], {"name", "price"})):
        answered = spark.createDataFrame([(1, 0, k) for k in done], "page_id long, scope_id int, field_key string")
        assert {r.field_key for r in R.record_fallbacks(t, specs, answered).collect()} == wanted
