"""End-to-end runs: pages and labels in, answers or records out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from factsieve.functions.urls import normalize_url
from factsieve.operators import classify, matching
from factsieve.operators.cascade import resolve
from factsieve.operators.labels import spec_rows
from factsieve.operators.links import next_page_candidates
from factsieve.operators.page import page_scope, stage_nodes
from factsieve.operators.records import ListResult, extract_records, record_fields
from factsieve.operators.select import coverage, floor, list_status, pool, site_fields, site_status, unresolved
from factsieve.operators.tables import PageTables
from factsieve.plans import snapshots
from factsieve.plans.expand import expand_site, site_page_facts
from factsieve.plans.options import Options
from factsieve.plans.walk import dedupe_walk, page_facts, walk_pages
from factsieve.sources.nodes import explode_nodes
from factsieve.sources.pages import prepare_pages
from factsieve.sources.staging import buckets_for, cut


def page_tables(pages: DataFrame) -> PageTables:
    """Prepares pages (defaults, HTML-only) and stages their element rows."""
    ready, warnings = prepare_pages(pages)
    size = ready.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    buckets = buckets_for(pages.sparkSession, size)
    return PageTables(ready, page_scope(stage_nodes(explode_nodes(ready, buckets), buckets, placed=True)), warnings=warnings, buckets=buckets)


def extract_pages(pages: DataFrame, labels: list[str], options: Options = Options()) -> DataFrame:
    """Answers per page, each page read on its own: the ``fields`` table with the page as its site."""
    t = page_tables(pages)
    specs = spec_rows(pages.sparkSession, labels)
    own = t.pages.select("page_id", F.col("page_id").alias("site"), F.lit(0).alias("visit"))
    return site_fields(pool(resolve(t, specs), own), own, specs, options.min_confidence, options.max_list_items)


NO_LIST = 'No repeating list structure on this page yielded the requested labels. If this is a single-subject page, use mode "single".'


@dataclass
class SingleResult:
    """Answers of single-subject sites."""

    fields: DataFrame
    visits: DataFrame
    status: DataFrame
    errors: DataFrame
    warnings: DataFrame  # page_id, message
    pooled: DataFrame  # candidates of the pages read
    sites: DataFrame


def extract_single(
    pages: DataFrame, seeds: DataFrame, labels: list[str], options: Options = Options(), t: PageTables | None = None, rules: DataFrame | None = None,
) -> SingleResult:
    """One record per seed site, pooled from its root and the internal pages worth reading.

    Of several snapshots of a URL one is read (see :mod:`factsieve.plans.snapshots`). Pages that robots
    ``rules(origin, agent, allow, pattern, crawl_delay_ms)`` forbid count as never fetched.
    """
    t = t or page_tables(pages)
    specs = spec_rows(pages.sparkSession, labels)
    usable, errors = classify.usable_pages(t.pages, t.nodes, t.kept_texts)
    if rules is not None:
        forbidden = cut(snapshots.disallowed(t.pages, rules, options.robots_agent))
        usable = usable.join(forbidden, "page_id", "left_anti")
        errors = errors.join(forbidden, "page_id", "left_anti").unionByName(forbidden)
    answers = cut(resolve(t, specs).join(usable.select("page_id"), "page_id", "left_semi"), "page_id")
    good = floor(answers, options.min_confidence)
    read = cut(snapshots.pages_to_read(usable, good.groupBy("page_id").agg(F.count("*").alias("good")), as_of=options.as_of))
    candidates = answers.join(read, "page_id", "left_semi")
    counts = good.groupBy("page_id", "field_key").agg(F.count("*").alias("n"))
    located = usable.select("page_id", "url").join(read, "page_id", "left_semi")
    edges = next_page_candidates(located.join(t.bases, "page_id"), t.links, t.meta)
    visits = cut(expand_site(site_page_facts(located, t.links, edges, counts), seeds, specs, options))
    sites = seeds.select(normalize_url(F.col("url")).alias("site")).distinct()
    pooled = pool(candidates, visits)
    fields = site_fields(pooled, sites, specs, options.min_confidence, options.max_list_items)
    failed = errors.join(t.pages.select("page_id", normalize_url(F.col("url")).alias("site")), "page_id").join(sites, "site", "left_semi")
    return SingleResult(fields, visits, site_status(fields, visits, failed), errors, t.warnings, pooled, sites)


def visit_digests(t: PageTables, visits: DataFrame) -> DataFrame:
    """``(site, visit, url, digest)`` of the pages read for each site."""
    return t.digests.select("page_id", "digest").join(visits.select("page_id", "site", "visit", "url"), "page_id").select("site", "visit", "url", "digest")


def open_requests(t: PageTables, result: SingleResult, labels: list[str], options: Options = Options()) -> DataFrame:
    """``(site, part, request)`` for an external matcher: labels a run has left open, with the pages it read."""
    specs = spec_rows(result.pooled.sparkSession, labels)
    wanted = unresolved(result.pooled, result.sites, specs, options.min_confidence)
    return matching.match_requests(wanted, visit_digests(t, result.visits))


def with_replies(t: PageTables, result: SingleResult, labels: list[str], responses: DataFrame, options: Options = Options()) -> SingleResult:
    """The run with the matcher's ``responses(site, response)`` read back: grounded values of open labels join the pool."""
    specs = spec_rows(result.pooled.sparkSession, labels)
    wanted = unresolved(result.pooled, result.sites, specs, options.min_confidence)
    digests = cut(visit_digests(t, result.visits))
    pooled, rejected = matching.with_replies(cut(result.pooled), responses, digests, specs, wanted)
    pooled = cut(pooled)
    fields = site_fields(pooled, result.sites, specs, options.min_confidence, options.max_list_items)
    failed = result.errors.join(t.pages.select("page_id", normalize_url(F.col("url")).alias("site")), "page_id").join(result.sites, "site", "left_semi")
    said = rejected.select(F.lit(None).cast("long").alias("page_id"), F.concat(F.lit("value for "), "field_key", F.lit(" rejected: "), "reason").alias("message"))
    return SingleResult(fields, result.visits, site_status(fields, result.visits, failed), result.errors, result.warnings.select("page_id", "message").unionByName(said), pooled, result.sites)


@dataclass
class WalkResult:
    """Records of list sites."""

    records: DataFrame
    fields: DataFrame
    coverage: DataFrame
    status: DataFrame
    steps: DataFrame
    walks: DataFrame
    groups: DataFrame
    warnings: DataFrame  # site or page_id, message


def extract_list(
    pages: DataFrame, seeds: DataFrame, labels: list[str], options: Options = Options(), t: PageTables | None = None, rules: DataFrame | None = None,
) -> WalkResult:
    """One record per repeated block, over all list pages a walk reads from each seed; snapshots and ``rules`` as in :func:`extract_single`."""
    t = t or page_tables(pages)
    specs = spec_rows(pages.sparkSession, labels)
    result = page_records(t, specs, options)
    records = cut(result.records, "page_id")
    open_pages = t.pages if rules is None else t.pages.join(cut(snapshots.disallowed(t.pages, rules, options.robots_agent)), "page_id", "left_anti")
    read = cut(snapshots.pages_to_read(open_pages, records.groupBy("page_id").agg(F.count("*").alias("good")), True, options.as_of))
    located = t.pages.select("page_id", "url").join(read, "page_id", "left_semi").join(t.bases, "page_id")
    facts = page_facts(next_page_candidates(located, t.links, t.meta), records)
    steps, walks = walk_pages(facts, seeds, options)
    kept = dedupe_walk(records, steps)
    fields = record_fields(kept, specs, ["walk_id", "step", "at", "page_id", "record_index"]).withColumnRenamed("walk_id", "site")
    sites = walks.select(F.col("walk_id").alias("site"))
    return WalkResult(
        kept, fields, coverage(fields), list_status(fields, sites, specs), steps, walks, result.groups, list_warnings(t.warnings.unionByName(result.warnings), walks, options)
    )


def list_warnings(of_pages: DataFrame, walks: DataFrame, options: Options) -> DataFrame:
    """``(site, page_id, message)``: pages not read or cut short, and for a forced list run the seeds that are no lists."""
    out = of_pages.select(F.lit(None).cast("string").alias("site"), "page_id", "message")
    if options.mode != "list":
        return out
    rowless = walks.where("n_records = 0").select(F.col("walk_id").alias("site"), F.lit(None).cast("long").alias("page_id"), F.lit(NO_LIST).alias("message"))
    return out.unionByName(rowless)


def page_records(t: PageTables, specs: list[Row], options: Options = Options()) -> ListResult:
    return extract_records(t, specs, options.min_confidence, options.max_records, options.min_fields_per_record)


def extract(pages: DataFrame, seeds: DataFrame, labels: list[str], options: Options = Options()):
    """``(list_result, single_result)`` by mode: auto reads a seed as a list when it yields records, else as a subject."""
    t = page_tables(pages)
    if options.mode == "single":
        return None, extract_single(pages, seeds, labels, options, t)
    listed = extract_list(pages, seeds, labels, options, t)
    if options.mode == "list":
        return listed, None
    rowless = listed.walks.where("n_records > 0").select(F.col("walk_id").alias("site"))
    rest = seeds.withColumn("site", normalize_url(F.col("url"))).join(rowless, "site", "left_anti")
    return listed, extract_single(pages, rest, labels, options, t)
