"""Named queries over the given tables, one per operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factsieve.functions import kinds as K
from factsieve.functions import text as T
from factsieve.functions import urls as U
from factsieve.functions.ontology import alias_index, ontology
from factsieve.operators import classify, fetching, labels, links, matching, page, places, records, select, structured
from factsieve.operators.tables import PageTables
from factsieve.plans import extract as run
from factsieve.plans.options import Options
from factsieve.sources import pages as sources
from factsieve.sources import sinks
from factsieve.sources.nodes import explode_nodes
from factsieve.sources.staging import bucketed
from factsieve.workloads import rendered as R
from factsieve.workloads.rendered import dealt, table, text


def _tables(pages: DataFrame) -> PageTables:
    return run.page_tables(pages)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.page_scope(explode_nodes(table(spark, sf_dir, "pages")))


def _joined(c: Column) -> Column:
    return F.array_join(c, " ")


# ---- text, URL and kind expressions ---------------------------------------------------------

def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url_key"))


def url_identity(spark, sf):
    p = table(spark, sf, "pages")
    sized = F.when(F.col("page_id") % 2 == 0, text(U.url_origin(F.col("url")), "/img/", F.col("page_id"), "-300x200.jpg?w=40&v=1")).otherwise(
        text(U.url_origin(F.col("url")), "/w_200/img/", F.col("page_id"), "_thumb.jpg?quality=80"))
    return p.select("page_id", U.image_identity(sized).alias("identity"))


def url_pagenum(spark, sf):
    p = table(spark, sf, "pages").withColumn("n", U.page_number(F.col("url")))
    return p.select("page_id", F.col("n.number").alias("page_number"), F.col("n.kind").alias("kind"))


def url_site(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", U.site_root(u).alias("site"), U.url_origin(u).alias("origin"), U.looks_non_html(u).cast("int").alias("non_html"),
        U.same_site(u, F.lit("http://www.example.com/")).cast("int").alias("on_example_com"),
    )


def url_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", _joined(U.url_tokens(F.col("url"))).alias("tokens"))


def seed_check(spark, sf):
    form = F.col("page_id") % 4
    bare = F.regexp_replace("url", "^https?://", "")
    given = F.when(form == 0, F.col("url")).when(form == 1, bare).when(form == 2, F.concat(F.lit("ftp://"), bare)).otherwise(
        text("host", F.col("page_id")))
    seeds = table(spark, sf, "pages").select(given.alias("url"))
    good, bad = sources.read_seeds(seeds)
    return good.select("input", "url", F.lit("").alias("reason")).unionByName(bad.select("input", F.lit("").alias("url"), "reason"))


def text_clean(spark, sf):
    t = F.col("text")
    return dealt(spark, sf, "documents", "doc_id").select(
        "doc_id", F.md5(T.squish(t)).alias("squished"), F.md5(T.squish_block(t)).alias("blocks"), T.truncate(t, 40).alias("short"),
    )


def text_tokens(spark, sf):
    t = F.col("text")
    words = T.tokens(t)
    return dealt(spark, sf, "documents", "doc_id").select(
        "doc_id", F.size(T.tokens(t, keep_stopwords=True)).alias("n_raw"), F.md5(_joined(words)).alias("tokens"),
        T.to_key(F.concat_ws(" ", "source", "lang")).alias("key"),
    )


def trigram_names(spark, sf):
    a, b = F.col("p_name"), F.concat_ws(" ", F.lower("p_type"), F.reverse("p_name"))
    return dealt(spark, sf, "part", "p_partkey").select(
        "p_partkey", T.round_half_up(T.trigram_dice(a, b), 10000).alias("dice"),
        T.token_overlap(T.tokens(a), T.tokens(F.concat_ws(" ", "p_type", "p_name"))).alias("overlap"),
        T.contains_text(b, a).cast("int").alias("contained"),
    )


def _found(spark, sf, found: Callable, keep: Callable, shown: Callable) -> DataFrame:
    docs = dealt(spark, sf, "documents", "doc_id")
    return docs.select("doc_id", F.explode(F.array_distinct(found(F.col("text")))).alias("raw")).where(keep(F.col("raw"))).select(
        "doc_id", shown(F.col("raw")).alias("value")
    ).distinct()


def doc_emails(spark, sf):
    return _found(spark, sf, K.find_emails, K.valid_email, K.normalize_email)


def doc_phones(spark, sf):
    return _found(spark, sf, K.find_phones, lambda c: K.valid_phone(c, F.lit("phone")), K.canonical_phone)


def doc_prices(spark, sf):
    priced = F.concat_ws(" ", F.lit("now"), F.concat(F.lit("USD "), F.col("p_retailprice").cast("decimal(18,2)").cast("string")), F.lit("per night or"), F.concat(F.col("p_size").cast("string"), F.lit(" EUR")), F.col("p_name"))
    rows = dealt(spark, sf, "part", "p_partkey").select("p_partkey", F.explode(K.find_prices(priced)).alias("price"))
    return rows.where(K.valid_price(F.col("price"))).select("p_partkey", K.normalize_price(F.col("price")).alias("price"))


def line_kinds(spark, sf):
    line = F.col("line")
    lines = F.transform(F.split("text", "\n"), T.squish)
    rows = dealt(spark, sf, "documents", "doc_id").select("doc_id", F.explode(lines).alias("line"))
    flags = dict(
        n_text=K.valid_text(line), n_name=K.valid_name(line), n_description=K.valid_description(line), n_address=K.valid_address(line),
        n_list=K.valid_list_item(line), n_date=K.valid_date(line), n_rating=K.valid_rating(line), n_number=K.valid_number(line), n_hours=K.valid_hours(line),
    )
    return rows.groupBy("doc_id").agg(*[F.count_if(v).alias(n) for n, v in flags.items()])


def identity_words(spark, sf):
    c = dealt(spark, sf, "customer", "c_custkey")
    phone = text("0064 (9) ", R.pad(F.col("c_custkey"), 7), " ext. 12")
    kind = F.when(F.col("c_custkey") % 3 == 0, "phone").when(F.col("c_custkey") % 3 == 1, "email").otherwise("name")
    value = F.when(kind == "phone", phone).when(kind == "email", text("mailto:Desk.", F.col("c_custkey"), "@Shop.example?subject=x")).otherwise(text(" ", F.col("c_name"), " , ", F.col("c_mktsegment")))
    return c.select("c_custkey", K.normalize_value(kind, value).alias("shown"), K.identity_key(kind, value).alias("identity"))


def map_coordinates(spark, sf):
    key = F.col("s_suppkey")
    lat, lng = R.latitude(key), R.longitude(key)
    url = F.when(key % 3 == 0, text("https://www.google.com/maps/place/x/@", lat, ",", lng, ",17z")).when(
        key % 3 == 1, text("https://www.google.com/maps/embed?pb=!1m18!3d", lat, "!4d", lng)).otherwise(text("https://maps.example/?ll=", lat, "%2C", lng))
    rows = dealt(spark, sf, "supplier", "s_suppkey").select(key, K.geo_from_url(url).alias("g"))
    return rows.select(
        "s_suppkey", F.col("g.latitude").alias("latitude"), F.col("g.longitude").alias("longitude"),
        (K.valid_lat(F.col("g.latitude")) & K.valid_lng(F.col("g.longitude"))).cast("int").alias("valid"),
    )


def social_profiles(spark, sf):
    key = F.col("c_custkey")
    host = F.element_at(F.array(*[F.lit(h) for h in ("www.facebook.com", "instagram.com", "x.com", "uk.linkedin.com", "pinterest.co.uk", "notfacebook.com")]), (key % 6 + 1).cast("int"))
    path = F.element_at(F.array(*[F.lit(p) for p in ("/shop", "/sharer/x", "/", "/intent/post", "/shares")]), (key % 5 + 1).cast("int"))
    url = text("https://", host, path)
    return dealt(spark, sf, "customer", "c_custkey").select(
        "c_custkey", *[K.is_social_profile(url, F.lit(n)).cast("int").alias(n) for n in ("facebook", "instagram", "twitter", "linkedin", "pinterest")]
    )


def csv_cells(spark, sf):
    key = F.col("p_partkey")
    sign = F.element_at(F.array(*[F.lit(s) for s in ("=", "+", "@", "plain ", 'say "hi", ')]), (key % 5 + 1).cast("int"))
    return dealt(spark, sf, "part", "p_partkey").select("p_partkey", sinks.csv_cell(F.concat(sign, F.col("p_name"))).alias("cell"))


# ---- labels ---------------------------------------------------------------------------------

LABEL_ENDINGS = ("Phone Number", "Prices", "Gallery Images", "Zibble", "Opening Hours", "contact e-mail", "Web Site", "Delivery Fee", "Status", "Facebook Link")


def _labels(spark, sf) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(e) for e in LABEL_ENDINGS]), (F.col("p_partkey") % len(LABEL_ENDINGS) + 1).cast("int"))
    label = F.when(F.col("p_partkey") % 3 == 0, ending).otherwise(F.concat_ws(" ", "p_name", ending))
    return dealt(spark, sf, "part", "p_partkey").select(F.col("p_partkey").cast("int").alias("pos"), label.alias("label"))


def label_kinds(spark, sf):
    aliases = alias_index(ontology(spark))
    matched = labels.match_fuzzy(labels.match_exact(labels.clean_labels(_labels(spark, sf)), aliases), aliases)
    return matched.select("label", F.coalesce("kind", F.lit("")).alias("kind"), T.round_half_up(F.col("match_score"), 10000).alias("score"))


def label_types(spark, sf):
    rows = labels.clean_labels(_labels(spark, sf)).withColumn("t", labels.infer_type(F.col("label")))
    return rows.select(
        "key", "label", F.col("t.type").alias("type"), (F.col("t.plural") | labels.is_plural(F.col("label"), F.col("t.type"))).cast("int").alias("plural"),
        F.coalesce(labels.detect_social(F.col("label")), F.lit("")).alias("social"),
    )


def label_specs(spark, sf):
    specs = labels.parse_labels(_labels(spark, sf))
    return specs.select("pos", "label", "key", "type", "plural", _joined(F.col("keywords")).alias("keywords"), _joined(F.col("schema_keys")).alias("schema_keys"))


# ---- the page model on crawled pages --------------------------------------------------------

def node_counts(spark, sf):
    return _nodes(spark, sf).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def page_titles(spark, sf):
    return page.page_title(_nodes(spark, sf)).select("page_id", "title")


def page_links(spark, sf):
    t = table(spark, sf, "pages").select("page_id", "url", F.col("url").alias("final_url"))
    nodes = _nodes(spark, sf).where(F.col("tag").isin("a", "base"))
    return page.page_links(nodes, page.base_urls(t, nodes)).select("page_id", "url", "url_key", "text", F.col("in_nav").cast("int").alias("in_nav"))


def page_headings(spark, sf):
    nodes = _nodes(spark, sf).where(F.col("tag") == "h1")
    return nodes.groupBy("page_id").agg(F.min_by("full_text", "node_id").alias("h1"))


def page_chrome(spark, sf):
    return page.boilerplate_text(_nodes(spark, sf)).select("page_id", F.md5("chrome_text").alias("chrome"))


def page_names(spark, sf):
    out = run.extract_pages(table(spark, sf, "pages"), ["Name"])
    return out.select(F.col("site").alias("page_id"), F.coalesce("value", F.lit("")).alias("name"), F.coalesce("method", F.lit("")).alias("method"), "confidence")


def page_digests(spark, sf):
    t = _tables(table(spark, sf, "pages"))
    return t.digests.select("page_id", F.length("digest").alias("chars"), F.md5("digest").alias("digest"))


def page_rendering(spark, sf):
    t = _tables(table(spark, sf, "pages"))
    return classify.needs_rendering(t.pages, t.nodes, t.texts)


def page_next(spark, sf):
    t = _tables(table(spark, sf, "pages"))
    return links.next_page(t.pages.select("page_id", "url").join(t.bases, "page_id"), t.links, t.meta)


def link_relevance(spark, sf):
    pages = R.customer_sites(spark, sf)
    t = _tables(pages.select("page_id", "url", "html"))
    roots = t.pages.select("page_id", F.col("url").alias("root_url"))
    out = links.discover_links(t.links, labels.spec_rows(spark, ["Phone Number"]), roots)
    return out.select("page_id", "rank", "url", T.round_half_up(F.col("score"), 1000).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


def page_groups(spark, sf):
    return records.record_groups(_nodes(spark, sf)).groupBy("page_id", "signature").agg(F.count("*").alias("items"))


def page_notices(spark, sf):
    t = _tables(R.notice_pages(spark, sf))
    return classify.restriction(t.pages, t.texts).select("page_id", "type", "marker")


# ---- round trips: tables to pages and back --------------------------------------------------

def _card_fields(spark, sf, drop=None) -> tuple[DataFrame, list[Row]]:
    t = _tables(R.supplier_pages(spark, sf, drop))
    specs = labels.spec_rows(spark, ["Name", "Phone Number", "Address"])
    found = run.page_records(t, specs)
    return records.record_fields(found.records, specs, ["page_id", "record_index"]), specs


def supplier_cards(spark, sf):
    fields, specs = _card_fields(spark, sf)
    return sinks.records_wide(fields, specs, ["page_id", "record_index"]).drop("page_id")


def supplier_coverage(spark, sf):
    fields, _ = _card_fields(spark, sf, 5)
    return select.coverage(fields.withColumn("site", F.col("page_id"))).select("site", "field_key", "found_in", "of", "percent")


def _page_values(pages: DataFrame, names: list[str]) -> DataFrame:
    out = run.extract_pages(pages, names)
    return out.select(
        F.col("site").alias("page_id"), "field_key", F.coalesce("value", F.array_join("items", " | "), F.lit("")).alias("value"), "confidence",
        F.coalesce("method", F.lit("")).alias("method"),
    )


def part_jsonld(spark, sf):
    return _page_values(R.part_pages(spark, sf), ["Product Name", "Price", "SKU"])


def part_microdata(spark, sf):
    return _page_values(R.part_pages(spark, sf, microdata=True), ["Product Name", "Price", "SKU"])


def part_entries(spark, sf):
    nodes = page.page_scope(explode_nodes(R.part_pages(spark, sf)))
    return structured.page_entries(nodes).select("page_id", "key", "path", "value", F.col("is_primary").cast("int").alias("is_primary"))


def customer_pairs(spark, sf):
    return _page_values(R.customer_pages(spark, sf), ["Name", "Phone Number", "Industry", "Email"]).drop("method")


def customer_pair_shapes(spark, sf):
    nodes = page.page_scope(page.stage_nodes(explode_nodes(R.customer_pages(spark, sf))))
    rows = page.pairs(nodes, page.blocks(nodes))
    return rows.where(F.col("kind") != "sibling").select("page_id", "kind", "label", "value")


def part_pictures(spark, sf):
    return _page_values(R.gallery_pages(spark, sf), ["Main Image", "Gallery Images"])


def supplier_profiles(spark, sf):
    names = ["Address", "Latitude", "Longitude", "Facebook", "Opening Hours", "Website"]
    return _page_values(R.profile_pages(spark, sf), names)


def supplier_facilities(spark, sf):
    return _page_values(R.profile_pages(spark, sf), ["Amenities", "Description"])


def supplier_contacts(spark, sf):
    names = ["Email", "Latitude", "Longitude", "Fax Number", "WhatsApp", "Description", "Main Image"]
    return _page_values(R.contact_pages(spark, sf), names)


def long_pages(spark, sf):
    """A telephone number in a paragraph as long as the whole document, and how much of that paragraph is kept."""
    d = dealt(spark, sf, "documents", "doc_id")
    number = text("+64 9 ", R.pad(F.col("doc_id"), 7))
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " ")
    html = R.document("", text("<main><p>", F.repeat(text(words, " "), 3), "</p><dl><dt>Telephone</dt><dd>", number, "</dd></dl></main>"))
    pages = d.select(F.col("doc_id").alias("page_id"), text("http://d.example/", F.col("doc_id")).alias("url"), html.alias("html"))
    t = _tables(pages)
    found = t.blocks.where("tag = 'p'").select("page_id", F.length("text").alias("chars"))
    return pages.select("page_id").join(found, "page_id", "left").fillna(0, ["chars"])


def order_walk(spark, sf):
    pages = bucketed(R.order_pages(spark, sf), "page_id")  # rendered once, not by every step that reads a column of them
    seeds = pages.where("page = 1").select("url")
    options = Options(mode="list", allow_pagination=True, max_pagination_pages="all")
    out = run.extract_list(pages.select("page_id", "url", "html"), seeds, ["Name", "Price", "Category"], options)
    wide = sinks.records_wide(out.fields, labels.spec_rows(spark, ["Name", "Price", "Category"]), ["site", "step", "at"])
    return wide.join(out.walks.select(F.col("walk_id").alias("site"), "pages_walked", "stop_reason"), "site")


def list_warnings(spark, sf):
    """A forced list run over catalogue pages, every other not HTML, with a record cap, and over one page that is no list."""
    pages = R.supplier_pages(spark, sf).select(
        "page_id", "url", "html", F.when(F.col("page_id") % 2 == 1, "application/pdf").otherwise("text/html").alias("content_type"))
    lone = spark.createDataFrame([(-1, "http://dir.example/about", "<p>We list suppliers.</p>", None)], "page_id long, url string, html string, content_type string")
    seeds = pages.select("url").unionByName(lone.select("url"))
    out = run.extract_list(pages.unionByName(lone), seeds, ["Name", "Phone Number", "Address"], Options(mode="list", max_records=10))
    return out.warnings.select(F.coalesce("site", F.lit("")).alias("site"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "message")


def supplier_json(spark, sf):
    t = _tables(R.supplier_pages(spark, sf, drop_phone_every=5))
    specs = labels.spec_rows(spark, ["Name", "Phone Number", "Address"])
    found = records.record_fields(run.page_records(t, specs).records, specs, ["page_id", "record_index"])
    return sinks.list_json(found, ["page_id", "record_index"], provenance=False)


def site_answers(spark, sf):
    pages = R.customer_sites(spark, sf)
    seeds = pages.where("n = 0").select("url")
    out = run.extract_single(pages.select("page_id", "url", "html"), seeds, ["Business Name", "Phone Number"], Options(mode="single"))
    visits = out.visits.groupBy("site").agg(F.count("*").alias("pages"), F.max("depth").alias("depth"))
    rows = out.fields.join(visits, "site").join(out.status.select("site", "status"), "site")
    return rows.select("site", "field_key", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("source_url", F.lit("")).alias("source_url"), "confidence", "pages", "depth", "status")


def gated_snapshots(spark, sf):
    """Runs over several snapshots of each page; robots rules forbid every fifth site."""
    pages = R.snapshot_pages(spark, sf)
    seeds = pages.select("url").distinct()
    origin = F.regexp_extract("url", r"^http://r\d+\.example", 0)
    rules = seeds.where(F.regexp_extract("url", r"r(\d+)", 1).cast("long") % 5 == 0).select(
        origin.alias("origin"), F.lit("*").alias("agent"), F.lit(False).alias("allow"), F.lit("/").alias("pattern"), F.lit(None).cast("bigint").alias("crawl_delay_ms"))
    out = run.extract_single(pages, seeds, ["Business Name", "Phone Number"], Options(follow_internal_links=False), rules=rules)
    read = out.visits.select("site", "page_id")
    return out.fields.join(read, "site", "left").join(out.status.select("site", "status"), "site").select(
        "site", "field_key", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("page_id", F.lit(-1)).alias("page_id"), "status")


def matched_answers(spark, sf):
    """A run, and the replies of an external matcher to the labels it left open read back."""
    pages = R.segment_pages(spark, sf)
    names = ["Business Name", "Trade Segment"]
    key = F.col("c_custkey")
    said = F.when(key % 4 == 0, F.lit("Zeppelins")).otherwise(F.col("c_mktsegment"))
    reply = F.to_json(F.struct(F.array(
        F.struct(F.lit("trade_segment").alias("key"), said.alias("value"), F.lit("dealt in").alias("snippet")),
        F.struct(F.lit("business_name").alias("key"), F.lit("Since 1901").alias("value"), F.lit(None).cast("string").alias("snippet"))).alias("fields")))
    replies = pages.where(key % 4 != 1).select(U.normalize_url(F.col("url")).alias("site"), reply.alias("response"))
    own = pages.select("page_id", "url", "html")
    t = run.page_tables(own)
    out = run.extract_single(own, own.select("url"), names, Options(follow_internal_links=False), t)
    told = run.with_replies(t, out, names, replies)
    return told.fields.join(told.status.select("site", "status"), "site").select(
        "site", "field_key", F.coalesce("value", F.lit("")).alias("value"), "confidence", F.coalesce("method", F.lit("")).alias("method"), "status")


def page_access(spark, sf):
    """What kind of page each is: read or not, and whether a browser is wanted."""
    t = _tables(R.access_pages(spark, sf))
    usable, errors = classify.usable_pages(t.pages, t.nodes, t.kept_texts)
    wanted = classify.needs_rendering(t.pages, t.nodes, t.kept_texts)
    read = usable.select("page_id", F.lit(1).alias("usable"))
    return wanted.join(read, "page_id", "left").join(errors, "page_id", "left").select(
        "page_id", F.coalesce("usable", F.lit(0)).alias("usable"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("marker", F.lit("")).alias("marker"), F.coalesce("reason", F.lit("")).alias("reason"))


def sheet_digests(spark, sf):
    """The digests of fact sheets, whole."""
    t = _tables(R.customer_pages(spark, sf))
    return t.digests.select("page_id", "digest")


# ---- crawl tables ---------------------------------------------------------------------------

def _fetch_log(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    codes = F.array(*[F.lit(c) for c in (200, 404, 429, 503, 401, 403, 0, 0, 522, 302)])
    n = (F.col("event_id") % 10 + 1).cast("int")
    return e.select(
        "event_id", F.concat(F.lit("http://u.example/"), F.col("user_id").cast("string")).alias("url"), (F.col("event_id") % 4).cast("int").alias("attempt"),
        F.element_at(codes, n).alias("status"), F.when(n == 7, "TimeoutError").when(n == 8, "socket closed").alias("error"),
        F.when(F.col("event_id") % 7 == 0, (F.col("event_id") % 50).cast("int")).alias("retry_after_s"),
    )


def fetch_outcomes(spark, sf):
    out = fetching.retry_plan(_fetch_log(spark, sf))
    return out.select("event_id", "outcome", F.col("retryable").cast("int").alias("retryable"), F.coalesce("wait_ms", F.lit(-1)).alias("wait_ms"))


def host_schedule(spark, sf):
    frontier = table(spark, sf, "pages").select("url", F.col("page_id").alias("priority"))
    delays = frontier.select(U.url_origin(F.col("url")).alias("origin")).distinct().withColumn(
        "crawl_delay_ms", F.when(F.col("origin").startswith("https"), 3000).otherwise(500)
    )
    return fetching.schedule(frontier, delays).select("priority", "origin", "position", "start_ms")


def robots_checks(spark, sf):
    urls = table(spark, sf, "pages").select("url")
    rule = F.explode(F.array(*[
        F.struct(F.lit(a).alias("allow"), F.lit(p).alias("pattern")) for a, p in ((False, "/en/"), (True, "/en/6"), (False, "/*?page="), (False, "/es/5"))]))
    rules = urls.select(U.url_origin(F.col("url")).alias("origin")).distinct().where(F.col("origin").startswith("https")).select(
        "origin", F.lit("*").alias("agent"), rule.alias("r"), F.lit(2000).alias("crawl_delay_ms")).select("origin", "agent", "r.*", "crawl_delay_ms")
    out = fetching.robots_gate(urls, rules)
    return out.select("url", F.col("allowed").cast("int").alias("allowed"), F.coalesce("crawl_delay_ms", F.lit(0)).alias("crawl_delay_ms"))


def crawl_changes(spark, sf):
    e = table(spark, sf, "events")
    crawls = e.select(text("http://u", F.col("user_id"), ".example/").alias("url"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("html"))
    one = crawls.groupBy("url", "fetched_at").agg(F.max("html").alias("html"))  # of crawls at one moment the same one always
    out = fetching.changed_pages(one)
    return out.groupBy("url_key").agg(F.count("*").alias("crawls"), F.count_if("changed").alias("changes"))


def crawl_due(spark, sf):
    e = table(spark, sf, "events")
    url = text("http://u", F.col("user_id"), ".example/")
    cache = e.select(url.alias("url"), F.col("ts").alias("fetched_at"))
    newest = e.agg(F.max("ts").alias("now")).first()["now"]
    return fetching.needs_fetch(e.select(url.alias("url")).distinct(), cache, 3600 * 24, F.lit(newest)).select("url")


def snapshot_choice(spark, sf):
    p = table(spark, sf, "pages")
    key = U.normalize_url(F.col("url"))
    n = F.length("html")
    static = p.select("page_id", key.alias("url_key"), F.lit("static").alias("renderer"), n.alias("html_chars"), (F.col("page_id") % 4).alias("good"))
    rendered = p.select((F.col("page_id") + 1000000).alias("page_id"), key.alias("url_key"), F.lit("playwright").alias("renderer"), F.floor(n * (F.col("page_id") % 3) / 2).alias("html_chars"), (F.col("page_id") % 5).alias("good"))
    both = static.unionByName(rendered)
    return select.best_snapshot(both).select("url_key", "page_id", "renderer")


# ---- external matcher and places ------------------------------------------------------------

def _site() -> Column:
    """A site is read at most five pages deep, so five turns make one."""
    return text(F.col("conv_id"), "/", F.floor(F.col("turn") / 5))


def _digests(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        _site().alias("site"), F.col("turn").alias("visit"), text("http://conv.example/", F.col("conv_id"), "/", F.col("turn")).alias("url"), F.col("text").alias("digest"))


def grounding(spark, sf):
    words = F.split(T.squish(F.col("text")), " ")
    replies = table(spark, sf, "conversations").select(
        _site().alias("site"),
        F.to_json(F.struct(F.array(
            F.struct(F.lit("city").alias("key"), F.array_join(F.slice(words, 1, 3), "  ").alias("value"), F.lit(None).cast("string").alias("snippet")),
            F.struct(F.lit("city").alias("key"), F.concat(F.reverse(F.element_at(words, 1)), F.lit("qx")).alias("value"), F.lit("no such words here").alias("snippet")),
            F.struct(F.lit("unknown").alias("key"), F.lit("x").alias("value"), F.lit(None).cast("string").alias("snippet")),
        ).alias("fields"))).alias("response"))
    specs = labels.spec_rows(spark, ["City"])
    values = matching.match_responses(replies, specs).distinct()
    out = matching.ground(values, _digests(spark, sf))
    return out.select("site", "value", F.col("grounded").cast("int").alias("grounded"), F.coalesce("reason", F.lit("")).alias("reason"), "source_url")


def match_requests(spark, sf):
    specs = labels.spec_rows(spark, ["City", "Phone Numbers"])
    d = _digests(spark, sf)
    asked = select.requested(d.select("site"), specs)
    return matching.match_requests(asked, d, 2000).select("site", "part", F.md5("request").alias("request"))


def place_sheets(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    place = F.struct(
        text("id", key).alias("id"), F.struct(F.col("s_name").alias("text")).alias("displayName"), text(key, " Dock Road").alias("formattedAddress"),
        F.when(key % 2 == 0, text("09 ", R.pad(key, 7))).alias("nationalPhoneNumber"), text("+64 9 ", R.pad(key, 7)).alias("internationalPhoneNumber"),
        (key % 5 + F.lit(0.5)).alias("rating"), F.array(F.lit("hardware_store"), F.lit("supplier")).alias("types"), F.lit("PRICE_LEVEL_VERY_EXPENSIVE").alias("priceLevel"),
        F.array(F.struct(text("photo", key).alias("name")), F.struct(text("other", key).alias("name"))).alias("photos"),
    )
    raw = s.select(F.to_json(F.struct(F.col("n_name").alias("query"), key.cast("int").alias("batch"), F.array(place).alias("places"))).alias("json"))
    batches = raw.select(F.from_json("json", sources.BATCH_SCHEMA).alias("b")).select("b.*")
    found, _ = sources.read_places(batches, 60)
    specs = labels.parse_labels(spark.createDataFrame(list(enumerate(["Name", "Address", "Phone Number", "Rating", "Category", "Price", "Photo", "Warranty"])), "pos int, label string"))
    mapping = places.map_place_fields(specs).orderBy("pos").collect()
    uris = table(spark, sf, "supplier").where(F.col("s_suppkey") % 4 != 0).select(text("photo", key).alias("name"), text("https://img.example/", key).alias("photoUri"))
    rows = places.place_records(found, mapping, places.place_photos(found, uris))
    return rows.select("site", "record_index", "field_key", F.coalesce("value", F.array_join("items", " | "), F.lit("")).alias("value"), "confidence")


def place_errors(spark, sf):
    status = F.element_at(F.array(*[F.lit(c) for c in (400, 401, 403, 429, 500)]), (F.col("event_id") % 5 + 1).cast("int"))
    message = F.when(F.col("event_id") % 3 == 0, "API key not valid").when(F.col("event_id") % 3 == 1, "quota used up").otherwise("bad field mask")
    return table(spark, sf, "events").select("event_id", places.classify_place_error(status, message).alias("error_type"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        supplier_cards, supplier_coverage, part_jsonld, part_microdata, part_entries, customer_pairs, customer_pair_shapes, part_pictures,
        supplier_profiles, supplier_facilities, supplier_contacts, long_pages, list_warnings, supplier_json, order_walk, site_answers, gated_snapshots, matched_answers, page_access, sheet_digests, url_normalize, url_identity, url_pagenum, url_site, url_tokens,
        seed_check, text_clean, text_tokens, trigram_names, doc_emails, doc_phones, doc_prices, line_kinds, identity_words, map_coordinates,
        social_profiles, csv_cells, label_kinds, label_types, label_specs, node_counts, page_titles, page_links, page_headings, page_chrome,
        page_names, page_digests, page_rendering, page_next, link_relevance, page_groups, page_notices, fetch_outcomes, host_schedule,
        robots_checks, crawl_changes, crawl_due, snapshot_choice, grounding, match_requests, place_sheets, place_errors,
    )
}
