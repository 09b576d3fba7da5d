"""List walks, site expansion, sinks and crawl tables."""

import datetime as dt
import hashlib
import random
import re

import pages as pg
import pytest
from pyspark.sql import functions as F

from factsieve.operators import fetching, links, matching, places, select
from factsieve.operators.labels import parse_labels, spec_rows
from factsieve.operators.records import record_fields
from factsieve.plans.expand import within_reach
from factsieve.plans import snapshots
from factsieve.plans.extract import extract, extract_list, extract_single, open_requests, page_records, page_tables, with_replies
from factsieve.plans.options import NO_LIMIT, Options, page_budget
from factsieve.plans.walk import page_facts, walk_pages
from factsieve.sources import pages as sources
from factsieve.sources import sinks
from factsieve.sources.staging import cut

LIST_LABELS = ["Name", "Category", "Address", "Phone Number", "Image"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"http://trades.example/ferries?page={i}", pg.walk_page(i)) for i in (1, 2, 3)]
    rows += [(10 + i, url, html) for i, (url, html) in enumerate(pg.SOCIETY_PAGES.items())]
    rows += [(20, pg.FIRMS_URL, pg.FIRM_LIST)]
    return page_tables(spark.createDataFrame(rows, "page_id long, url string, html string"))


@pytest.fixture(scope="module")
def found(spark, corpus):
    specs = spec_rows(spark, LIST_LABELS)
    result = page_records(corpus, specs)
    return specs, cut(result.records, "page_id"), result.groups


def test_directory_records(found):
    specs, records, groups = found
    rows = record_fields(records.where("page_id = 20"), specs, ["page_id", "record_index"]).collect()
    got = {(r.record_index, r.field_key): r.value for r in rows}
    for at, field in enumerate(("name", "address", "phone_number")):
        assert [got[i, field] for i in range(3)] == [f[at] for f in pg.FIRMS]
    assert [got[i, "image"] for i in range(3)] == [f"http://trades.example/pics/{f[3]}.png" for f in pg.FIRMS]
    assert {got[i, "category"] for i in range(3)} == {"Clock repair"} and len(got) == 15
    assert groups.where("page_id = 20").first().container == "ul.firms"
    # subject pages hold no list
    assert records.where("page_id between 10 and 13").count() == 0


def test_wide_sheet(found, tmp_path):
    specs, records, _ = found
    fields = record_fields(records.where("page_id = 20"), specs, ["page_id", "record_index"])
    wide = sinks.records_wide(fields, specs, ["record_index"])
    assert wide.columns == ["record_index", "name", "category", "address", "phone_number", "image", "source_url"]
    sinks.write_records_csv(fields, specs, ["record_index"], str(tmp_path / "out"))
    text = "".join(open(f, newline="").read() for f in sorted((tmp_path / "out").glob("part-*.csv")))
    lines = text.split("\r\n")
    assert lines[0] == "name,category,address,phone_number,image,source_url"
    assert lines[1].startswith('Pendulum Works,Clock repair,"Unit 4, Harbour Lane, Eastwick",041 555 0132,')
    shown = sinks.list_json(fields, ["record_index"], provenance=False).orderBy("record_index").first().json
    assert '"name":"Pendulum Works"' in shown


def _edges(corpus):
    return links.next_page_candidates(corpus.pages.select("page_id", "url").join(corpus.bases, "page_id"), corpus.links, corpus.meta)


@pytest.fixture(scope="module")
def facts(found, corpus):
    return page_facts(_edges(corpus), found[1])


SEED = "http://trades.example/ferries?page=1"


@pytest.mark.parametrize(
    "options, pages, records, reason",
    [
        (Options(), 1, 3, "pagination following is off"),
        (Options(allow_pagination=True, max_pagination_pages=1), 2, 6, "page budget"),
        (Options(allow_pagination=True, max_pagination_pages="all"), 3, 9, "last page"),
        (Options(allow_pagination=True, max_pagination_pages="all", max_records=4), 2, 4, "record cap"),
    ],
)
def test_walks(spark, facts, options, pages, records, reason):
    steps, walks = walk_pages(facts, spark.createDataFrame([(SEED,), (SEED + "#x",)], "url string"), options)
    row = walks.collect()
    assert len(row) == 1 and (row[0].pages_walked, row[0].n_records) == (pages, records) and reason in row[0].stop_reason
    assert steps.count() == pages


def test_walk_of_an_unknown_page(spark, facts):
    seeds = spark.createDataFrame([("http://trades.example/none",), ("http://tidewatch.example/people.html",)], "url string")
    reasons = {r.walk_id: r.stop_reason for r in walk_pages(facts, seeds, Options())[1].collect()}
    assert reasons["http://trades.example/none"] == "page 1 could not be fetched"
    assert reasons["http://tidewatch.example/people.html"] == "page 1 contained no list rows"


def test_auto_mode_and_expansion(spark, corpus, monkeypatch):
    monkeypatch.setattr("factsieve.plans.extract.page_tables", lambda pages: corpus)
    seeds = spark.createDataFrame([("http://tidewatch.example/",), (pg.FIRMS_URL,)], "url string")
    names = ["Society Name", "Phone Number", "Address", "Facebook", "CEO Name"]
    listed, single = extract(corpus.pages, seeds, names)
    assert {r.walk_id for r in listed.walks.where("n_records > 0").collect()} == {pg.FIRMS_URL}
    got = {r.field_key: r for r in single.fields.collect()}
    assert {r.site for r in got.values()} == {"http://tidewatch.example/"}
    assert got["society_name"].value == "Tidewatch Society" and got["society_name"].source_url == "http://tidewatch.example/"
    assert got["phone_number"].value == "+353 21 555 0186" and got["phone_number"].source_url == "http://tidewatch.example/contact.html"
    assert got["facebook"].value == "https://www.facebook.com/tidewatchsociety" and got["ceo_name"].value is None
    visits = {r.url: r.reasons for r in single.visits.collect()}
    assert f"{pg.SOCIETY}/contact.html" in visits and len(visits) <= 5 and all(visits.values())
    status = single.status.first()
    assert status.status == "partial" and status.missing_fields == ["CEO Name"]


def test_runs_read_what_their_roots_can_reach(spark):
    link = lambda u: (u, u, "", "", [], "", [], False, 1, "s.example", False)
    kind = "array<struct<url:string,url_key:string,text:string,path:string,path_tokens:array<string>,anchor:string,anchor_tokens:array<string>,paging:boolean,depth:int,site:string,in_nav:boolean>>"
    rows = [("http://s.example/", (1, None, None, [link("http://s.example/a"), link("http://s.example/b")], None)), ("http://s.example/a", (2, None, None, [link("http://s.example/c")], None)),
            ("http://s.example/c", (3, None, None, None, None)), ("http://other.example/", (4, None, None, None, None))]
    facts = spark.createDataFrame(rows, f"url_key string, f struct<page_id:bigint,base_url:string,good:map<string,bigint>,links:{kind},candidates:array<string>>")
    roots = spark.createDataFrame([("s.example", "http://s.example/")], "root_site string, url_key string")
    reach = lambda **o: {r.f.page_id for r in within_reach(facts, roots, Options(**o)).collect()}
    assert reach() == {1, 2} and reach(max_depth=2) == {1, 2, 3} and reach(follow_internal_links=False) == {1} and reach(allow_pagination=True) == {1, 2, 3}


def test_following_can_be_switched_off(spark, corpus):
    seeds = spark.createDataFrame([("http://tidewatch.example/",)], "url string")
    out = extract_single(corpus.pages, seeds, ["Society Name", "Phone Number"], Options(follow_internal_links=False), corpus)
    got = {r.field_key: r.value for r in out.fields.collect()}
    assert got == {"society_name": "Tidewatch Society", "phone_number": None} and out.visits.count() == 1


def test_next_page_forms(spark):
    html = {
        1: ("http://a.example/l", "<a href='/l?page=2'><i></i></a><a href='/l?page=3'>3</a>"),
        2: ("http://a.example/l?page=2", "<a rel='prev' href='/l?page=1'>Back</a>"),
        3: ("http://a.example/l?start=20", "<a href='/l?start=40'>b</a><a href='/l?start=60'>c</a><a href='/l?start=0'>a</a>"),
        4: ("http://a.example/m", "<a class='next disabled' href='/z'>Next</a>"),
        5: ("http://a.example/n", "<a href='/older'>Older</a>"),
        6: ("http://a.example/o", "<link rel='next' href='/o2'>"),
    }
    t = page_tables(spark.createDataFrame([(k, u, h) for k, (u, h) in html.items()], "page_id long, url string, html string"))
    out = links.next_page(t.pages.select("page_id", "url").join(t.bases, "page_id"), t.links, t.meta)
    got = {r.page_id: r.next_url for r in out.collect()}
    assert got == {1: "http://a.example/l?page=2", 2: None, 3: "http://a.example/l?start=40", 4: None, 5: "http://a.example/older", 6: "http://a.example/o2"}


def test_page_budget():
    assert page_budget(Options()) == 0
    on = dict(allow_pagination=True)
    assert [page_budget(Options(max_pagination_pages=n, **on)) for n in ("all", None, 0, 3, 900, "x")] == [NO_LIMIT, NO_LIMIT, NO_LIMIT, 3, 900, 0]


def test_selection(spark):
    specs = spec_rows(spark, ["Name", "Amenities"])
    rows = [("s", "name", "a", "A", 0.9, 5, [1]), ("s", "name", "b", "B", 0.9, 3, [2]), ("s", "name", "c", "C", 0.3, 0, [3]),
            ("s", "amenities", "x", "X", 0.70, 9, [1]), ("s", "amenities", "y", "Y", 0.72, 8, [2]), ("s", "amenities", "x", "X", 0.95, 7, [3])]
    c = spark.createDataFrame(rows, "site string, field_key string, identity string, value string, confidence double, ord int, seq array<int>")
    c = c.withColumn("visit", F.lit(0)).withColumn("method", F.lit("m")).withColumn("selector", F.lit(None).cast("string")).withColumn("source_url", F.lit("u"))
    sites = spark.createDataFrame([("s",), ("empty",)], "site string")
    got = {(r.site, r.field_key): r for r in select.site_fields(c, sites, specs).collect()}
    assert got["s", "name"].value == "B" and [a.value for a in got["s", "name"].alternatives] == ["A"]
    assert got["s", "amenities"]["items"] == ["X", "Y"] and got["empty", "amenities"]["items"] == [] and got["empty", "name"].value is None
    assert {(r.site, r.field_key) for r in select.unresolved(c, sites, specs).collect()} == {("empty", "name"), ("empty", "amenities")}
    failed = spark.createDataFrame([("bad", "invalid_url", "no")], "site string, type string, message string")
    assert {r.field_key for r in select.error_result(failed, specs).collect()} == {"name", "amenities"}


def test_sources(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("# comment\nName\n\n  Phone Number \n")
    assert [r.label for r in sources.read_labels(spark, str(tmp_path / "labels.txt"), True).orderBy("pos").collect()] == ["Name", "Phone Number"]
    assert [r.label for r in sources.read_labels(spark, "Name, Email,,").orderBy("pos").collect()] == ["Name", "Email"]
    rows = spark.createDataFrame([(1, "http://a.example", "<p>äx</p>", "text/html"), (2, "http://b.example", "%PDF", "application/pdf")],
                                 "page_id long, url string, html string, content_type string")
    ready = sources.with_defaults(rows)
    good, warned = sources.filter_html(ready)
    assert [r.page_id for r in good.collect()] == [1] and "application/pdf" in warned.first().message
    capped = {r.page_id: (r.html, r.truncated) for r in sources.cap_html(ready, 4).collect()}
    assert capped[2] == ("%PDF", False) and capped[1][0].startswith("<p>") and capped[1][1]


def test_result_tables_are_replaced_by_day(spark, tmp_path):
    spark.sql(f"create database if not exists results location '{tmp_path / 'db'}'")
    try:
        for day, values in (("2026-01-01", [1, 2]), ("2026-01-02", [3]), ("2026-01-01", [4])):
            sinks.save_tables({"answers": spark.createDataFrame([(v,) for v in values], "v int")}, "results", day)
        assert sorted((str(r.dt), r.v) for r in spark.table("results.answers").collect()) == [("2026-01-01", 4), ("2026-01-02", 3)]
    finally:
        spark.sql("drop database results cascade")


def test_places_are_read_whole(spark):
    places = [(str(k),) for k in range(90)]
    batches = spark.createDataFrame([("q  a", 0, places[:50]), ("q a", 1, places[50:])], "query string, batch int, places array<struct<id:string>>")
    found, warned = sources.read_places(batches)
    assert [r.id for r in found.orderBy("place_pos").collect()] == [str(k) for k in range(90)] and warned.count() == 0
    few, warned = sources.read_places(batches, 70)
    assert few.count() == 70 and "asked for 70" in warned.first().message


def test_sheet_of_answers(spark):
    rows = [("s", 0, "Name", "name", "name", False, 'A "quoted", comma', None, "http://a.com", "jsonld", 0.95, True),
            ("s", 1, "Formula", "formula", "text", False, "=SUM(A1:A2)", None, "", "", 0.5, True),
            ("s", 2, "Pics", "pics", "image_list", True, None, ["u1", "u2"], "http://a.com", "img", 0.8, True),
            ("s", 3, "Missing", "missing", "text", False, None, None, None, None, 0.0, False)]
    fields = spark.createDataFrame(rows, "site string, pos int, label string, field_key string, value_type string, plural boolean, value string, items array<string>, source_url string, method string, confidence double, found boolean")
    got = [tuple(r) for r in sinks.fields_sheet(fields).collect()]
    assert got[1][2] == "'=SUM(A1:A2)" and got[2][2] == "u1 | u2" and got[3][6:] == ("0", "no")
    cells = fields.select(sinks.csv_cell(F.col("value")).alias("c")).collect()
    assert cells[0].c == '"A ""quoted"", comma"'
    plain = sinks.single_json(fields.withColumn("selector", F.lit(None).cast("string")), provenance=False).first().json
    assert '"missing_fields":["Missing"]' in plain and '"fields"' not in plain


def test_robots_and_cache(spark):
    rules = spark.createDataFrame(
        [("http://a.example", "*", False, "/admin/", 3000), ("http://a.example", "*", True, "/admin/open", None), ("http://a.example", "*", False, "/*.pdf", None)],
        "origin string, agent string, allow boolean, pattern string, crawl_delay_ms bigint")
    urls = spark.createDataFrame([(u,) for u in ("http://a.example/admin/x", "http://a.example/admin/open/y", "http://a.example/f.pdf", "http://a.example/", "http://b.example/admin/")], "url string")
    got = {r.url: (r.allowed, r.crawl_delay_ms) for r in fetching.robots_gate(urls, rules).collect()}
    assert [v[0] for v in got.values()].count(False) == 2 and got["http://a.example/admin/open/y"] == (True, 3000) and got["http://b.example/admin/"] == (True, None)
    now = dt.datetime(2026, 1, 2)
    cache = spark.createDataFrame([("http://a.example/", dt.datetime(2026, 1, 1, 23)), ("http://b.example/admin", dt.datetime(2025, 1, 1))], "url string, fetched_at timestamp")
    due = {r.url for r in fetching.needs_fetch(urls, cache, 7200, F.lit(now)).collect()}
    assert "http://a.example/" not in due and "http://b.example/admin/" in due


def _plain_gate(rules, url):
    """The longest pattern of the origin that matches from the left, allow before disallow."""
    origin = "/".join(url.split("/")[:3])
    target = "/" + "/".join(url.split("/")[3:])
    hits = [(len(p), a) for o, _, a, p, _ in rules if o == origin and p and re.match(re.escape(p).replace(r"\*", ".*").replace(r"\$", "$"), target)]
    return max(hits)[1] if hits else True


def test_robots_of_a_hot_origin_with_many_rules(spark):
    rng = random.Random(2)
    words = ["a", "b", "en", "shop", "x1", "y", "list"]
    path = lambda: "/" + "/".join(rng.choice(words) for _ in range(rng.randrange(4)))
    rules = [("http://hot.example", "*", rng.random() < 0.4, path() + rng.choice(["", "", "/", "*", "*/y", "$", f"?q={k}"]), 100) for k in range(10_000)]
    rules += [("http://hot.example", "*", False, "/*?page=", None), ("http://o.example", "*", False, "", 5), ("http://p.example", "bot", False, "/", 7), ("http://p.example", "*", True, "/", 9)]
    urls = [f"http://hot.example{path()}{rng.choice(['', '', '?page=2', '?q=7', '/'])}" for _ in range(900)] + [f"http://o.example{path()}" for _ in range(100)]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    table = spark.createDataFrame(rules, "origin string, agent string, allow boolean, pattern string, crawl_delay_ms bigint")
    got = fetching.robots_gate(frame, table).collect()
    assert sorted(r.url for r in got) == sorted(urls)
    def rooted(u):
        return u if u.count("/") > 2 else u.replace("?", "/?") if "?" in u else u + "/"

    wrong = {r.url for r in got if r.allowed != _plain_gate(rules, rooted(r.url))}
    assert wrong == set() and len({r.allowed for r in got}) == 2
    plans = fetching.robots_gate(frame, table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plans and "Cartesian" not in plans
    named = spark.createDataFrame([("http://p.example/z",)], "url string")
    assert not fetching.robots_gate(named, table, "bot").first().allowed and fetching.robots_gate(named, table).first().allowed


def test_changes_of_one_url_with_most_crawls(spark):
    rng = random.Random(3)
    start = dt.datetime(2026, 1, 1)
    crawls = [("http://hot.example/", start + dt.timedelta(seconds=k // 3), rng.choice("ab")) for k in range(6000)]
    crawls += [(f"http://u{k % 50}.example/", start + dt.timedelta(days=k), rng.choice("ab")) for k in range(600)]
    got = fetching.changed_pages(spark.createDataFrame(crawls, "url string, fetched_at timestamp, html string").repartition(7)).collect()
    before, want = {}, []
    for u, at, _, h in sorted((u, at, hashlib.sha256(h.encode()).hexdigest(), h) for u, at, h in crawls):
        want.append((u, at, before.get(u) != h))
        before[u] = h
    key = lambda rows: sorted(rows)
    assert key((r.url_key, r.fetched_at, r.changed) for r in got) == key(want)


def test_snapshots_of_a_run(spark):
    full = "<h1>Acme Works</h1><p><a href='tel:+95977123456'>+95 977 123 456</a></p>" + "<p>words of the page</p>" * 5
    day = lambda n: dt.datetime(2026, 1, n)
    rows = [
        (1, "http://a.example/", "<div id='root'></div>" + " " * 80, "static", day(1)), (2, "http://a.example/", full, "playwright", day(2)),
        (3, "http://b.example/", full.replace("Acme", "Old"), "static", day(1)), (4, "http://b.example/", full.replace("Acme", "New"), "static", day(5)),
        (5, "http://c.example/", full.replace("Acme", "Shown"), "static", day(1)), (6, "http://c.example/", "<p>x</p>", "playwright", day(2)),
        (7, "http://d.example/private/", full, "static", day(1)),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, renderer string, fetched_at timestamp")
    rules = spark.createDataFrame([("http://d.example", "*", False, "/private", None)], "origin string, agent string, allow boolean, pattern string, crawl_delay_ms bigint")
    t = page_tables(pages)
    seeds = pages.select("url").distinct()
    out = extract_single(pages, seeds, ["Business Name", "Phone Number"], Options(follow_internal_links=False), t, rules)
    got = {r.site: r.value for r in out.fields.where("field_key = 'business_name'").collect()}
    assert got == {"http://a.example/": "Acme Works", "http://b.example/": "New Works", "http://c.example/": "Shown Works", "http://d.example/private": None}
    assert [(r.page_id, r.type) for r in out.errors.where("type = 'robots_disallowed'").collect()] == [(7, "robots_disallowed")]
    assert {r.page_id for r in out.visits.collect()} == {2, 4, 5}
    good = spark.createDataFrame([(3, 1), (4, 1)], "page_id long, good long")
    then = snapshots.pages_to_read(t.pages.where("page_id in (3, 4)"), good, as_of=day(3))
    assert [r.page_id for r in then.collect()] == [3]


def test_replies_join_the_pool(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<h1>Acme Works</h1><p>We are a Marine Chandlery since 1901.</p>")], "page_id long, url string, html string")
    names = ["Business Name", "Trade Segment"]
    t = page_tables(pages)
    out = extract_single(pages, pages.select("url"), names, Options(follow_internal_links=False), t)
    asked = open_requests(t, out, names).collect()
    assert len(asked) == 1 and "- key: trade_segment" in asked[0].request and "business_name" not in asked[0].request and "Marine Chandlery" in asked[0].request
    reply = '{"fields":[{"key":"trade_segment","value":"Marine Chandlery","snippet":"since 1901"},{"key":"trade_segment","value":"Bakery","snippet":"none"},{"key":"business_name","value":"Other Works"}]}'
    told = with_replies(t, out, names, spark.createDataFrame([("http://a.example/", reply)], "site string, response string"))
    got = {r.field_key: r for r in told.fields.collect()}
    assert got["business_name"].value == "Acme Works" and got["trade_segment"].value == "Marine Chandlery"
    assert (got["trade_segment"].confidence, got["trade_segment"].method, got["trade_segment"].source_url) == (0.6, "external match", "http://a.example/")
    assert any("rejected" in r.message for r in told.warnings.collect()) and told.status.first().status == "ok"


def test_requests_are_packed(spark):
    digests = spark.createDataFrame([("s", v, f"u{v}", "x" * (30 + v % 7)) for v in range(3000)] + [("t", 0, "w", "y" * 500)], "site string, visit int, url string, digest string")
    packed = matching.pack_digests(digests, 400, 64).collect()
    own = sorted((r.number, r.part, len(r.digest), r.url) for r in packed if r.site == "s")
    assert [o[0] for o in own] == list(range(1, 3001)) and [o[3] for o in own] == [f"u{v}" for v in range(3000)]
    total = 0
    for _, part, n, _ in own:
        assert part == total // 400
        total += n
    asked = matching.match_requests(spark.createDataFrame([("s", 0, "k", "K", "text", False), ("t", 0, "k", "K", "text", True)], "site string, pos int, field_key string, label string, value_type string, plural boolean"), digests, 400)
    sizes = [len(r.request) for r in asked.collect()]
    assert len(sizes) == own[-1][1] + 2 and max(sizes) < 2000


def test_matcher_tables(spark):
    specs = spec_rows(spark, ["Phone Number", "Amenities"])
    reply = '{"fields":[{"key":"phone_number","value":"+959 7712 3456","snippet":"Call us"},{"key":"amenities","value":["Sauna","Moon pool"],"snippet":"no such"},{"key":"other","value":"x"},{"key":"amenities","value":null}]}'
    values = matching.match_responses(spark.createDataFrame([("s", reply)], "site string, response string"), specs)
    digests = spark.createDataFrame([("s", 0, "u0", "Welcome"), ("s", 1, "u1", "Call us on +95 9 7712 3456. Sauna, wifi.")], "site string, visit int, url string, digest string")
    got = {r.value: r for r in matching.ground(values, digests).collect()}
    assert got["+959 7712 3456"].grounded and got["Sauna"].source_url == "u1" and not got["Moon pool"].grounded
    assert "snippet" in got["Moon pool"].reason
    kept = matching.to_candidates(matching.ground(values, digests), specs).collect()
    assert {(r.value, r.confidence) for r in kept} == {("+959 7712 3456", 0.6), ("Sauna", 0.6)}


def test_places(spark):
    names = ["Name", "International Phone", "Phone Number", "Rating", "Reviews", "PlaceID", "Maps", "Photo", "Warranty Period"]
    mapping = places.map_place_fields(parse_labels(spark.createDataFrame(list(enumerate(names)), "pos int, label string"))).orderBy("pos").collect()
    assert [m.place_field for m in mapping] == ["name", "phone_international", "phone", "rating", "review_count", "place_id", "maps_url", "photo", None]
    rows = spark.createDataFrame(
        [(400, "API key not valid."), (403, "x"), (429, "x"), (400, "bad mask"), (500, "x")], "status int, message string")
    assert [r[0] for r in rows.select(places.classify_place_error(F.col("status"), F.col("message"))).collect()] == [
        "auth", "auth", "rate_limited", "bad_request", "http_error"]
