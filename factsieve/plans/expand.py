"""Single-subject runs over a site: read the root, then the few internal pages likely to fill the gaps.

As in the walk, one step moves every site one page on; a site's queue, visited set and counts are one small row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from factsieve.functions.urls import normalize_url, site_root
from factsieve.operators.links import MIN_LINK_SCORE, NEXT_SCHEMA, link_features, link_score, usable_next
from factsieve.plans.options import Options, page_budget
from factsieve.sources.staging import bucketed, cut

_QUEUE = "array<struct<url:string,url_key:string,depth:int,reasons:array<string>>>"
_WANTS = "array<struct<key:string,plural:boolean,need:int,keywords:array<string>,hints:array<string>>>"


def site_page_facts(pages: DataFrame, links: DataFrame, next_pages: DataFrame, good: DataFrame) -> DataFrame:
    """One row per URL key: good candidates per label, featured links, next-page edges.

    ``good(page_id, field_key, n)`` counts candidates at or above the confidence floor.
    """
    counts = good.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", "n"))).alias("good"))
    names = ("url", "url_key", "text", "path", "path_tokens", "anchor", "anchor_tokens", "paging", "depth", "site", "in_nav")
    outgoing = link_features(links).where("followable").groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("node_id", F.struct(*names).alias("l")))), lambda x: x["l"]).alias("links")
    )
    facts = (
        pages.select("page_id", "url").join(counts, "page_id", "left").join(outgoing, "page_id", "left")
        .join(next_pages.select("page_id", "base_url", "candidates"), "page_id", "left")
        .withColumn("url_key", normalize_url(F.col("url")))
        .groupBy("url_key")
        .agg(F.min_by(F.struct("page_id", "base_url", "good", "links", "candidates"), "page_id").alias("f"))
    )
    return bucketed(facts, "url_key")


def _wants(specs: list[Row]) -> Column:
    rows = [
        dict(key=s.key, plural=s.plural, need=2 if s.plural else 1, keywords=[k for k in s.keywords if len(k) >= 3], hints=s.page_hints)
        for s in specs
    ]
    return F.from_json(F.lit(json.dumps(rows)), _WANTS)


def within_reach(facts: DataFrame, roots: DataFrame, options: Options) -> DataFrame:
    """The facts a run can come to from ``roots(root_site, url_key)``, so that no step reads the rest of the crawl.

    Links lead ``max_depth`` steps from a root, within its site; list pages may follow one another any distance, so with
    pagination all pages of the roots' sites stay.
    """
    if options.allow_pagination:
        sites = roots.select("root_site").distinct()
        return bucketed(facts.withColumn("root_site", site_root(F.col("url_key"))).join(sites, "root_site", "left_semi").drop("root_site"), "url_key")
    near = roots.select("root_site", "url_key").distinct()
    edge = near
    for _ in range(options.max_depth if options.follow_internal_links else 0):
        links = edge.join(facts, "url_key").select("root_site", F.explode("f.links").alias("l"))
        edge = links.where(F.col("l.site") == F.col("root_site")).select("root_site", F.col("l.url_key").alias("url_key")).distinct()
        near = cut(near.unionByName(edge).distinct())
    return bucketed(facts.join(near.select("url_key").distinct(), "url_key", "left_semi"), "url_key")


def expand_site(facts: DataFrame, seeds: DataFrame, specs: list[Row], options: Options) -> DataFrame:
    """``(site, visit, page_id, url, depth, reasons)``: which pages each site's answer is pooled from."""
    strings = F.array().cast("array<string>")
    entry = F.struct(
        F.col("root_url").alias("url"), F.col("site").alias("url_key"), F.lit(0).alias("depth"),
        F.array(F.lit("user-provided URL")).alias("reasons"),
    )
    state = (
        seeds.select(F.col("url").alias("root_url"), normalize_url(F.col("url")).alias("site"))
        .groupBy("site").agg(F.min("root_url").alias("root_url"))
        .select(
            "site", site_root(F.col("root_url")).alias("root_site"), F.array(entry).cast(_QUEUE).alias("queue"),
            strings.alias("visited"), F.create_map().cast("map<string,bigint>").alias("counts"), F.lit(0).alias("n_pages"),
            F.lit(0).alias("n_paging"),
        )
    )
    extra = page_budget(options)
    visits: DataFrame | None = None
    step = 0
    state = cut(state)
    facts = within_reach(facts, state.select("root_site", F.col("site").alias("url_key")), options)
    while True:
        head = F.element_at("queue", 1)
        looked = (
            state.withColumn("job", head).withColumn("queue", F.slice(F.col("queue"), F.lit(2), F.size("queue")))
            .withColumn("url_key", F.col("job.url_key"))
            .withColumn("skip", F.array_contains("visited", F.col("url_key")))
            .withColumn("visited", F.array_union("visited", F.array("url_key")))
            .join(facts, "url_key", "left")
            .withColumn("read", ~F.col("skip") & F.col("f").isNotNull())
            .withColumn(
                "counts",
                F.when(
                    F.col("read"),
                    F.map_zip_with(
                        F.col("counts"), F.coalesce(F.col("f.good"), F.create_map().cast("map<string,bigint>")),
                        lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
                    ),
                ).otherwise(F.col("counts")),
            )
            .withColumn("n_pages", F.col("n_pages") + F.col("read").cast("int"))
            .withColumn(
                "open", F.filter(_wants(specs), lambda w: F.coalesce(F.try_element_at("counts", w["key"]), F.lit(0)) < w["need"])
            )
        )
        looked = cut(looked)
        read = looked.where("read").select(
            "site", (F.col("n_pages") - 1).alias("visit"), F.col("f.page_id").alias("page_id"), F.col("job.url").alias("url"),
            F.col("job.depth").alias("depth"), F.col("job.reasons").alias("reasons"),
        )
        visits = read if visits is None else visits.unionByName(read)
        plural_open = F.exists("open", lambda w: w["plural"])
        turn = usable_next(F.coalesce("f.candidates", F.array().cast(NEXT_SCHEMA)), F.col("root_site"), F.col("visited"))
        paging = F.when(
            F.lit(options.allow_pagination) & F.col("read") & (F.col("n_paging") < extra) & plural_open, turn
        )
        looked = looked.withColumn("paging", paging)
        more = F.when(
            F.col("paging").isNotNull(),
            F.array(F.struct(F.col("paging.url"), F.col("paging.url_key"), F.col("job.depth"), F.array("paging.reason").alias("reasons"))).cast(_QUEUE),
        ).otherwise(F.array().cast(_QUEUE))
        looked = looked.withColumn("queue", F.concat("queue", more)).withColumn(
            "n_paging", F.col("n_paging") + F.col("paging").isNotNull().cast("int")
        )
        room = options.max_pages - F.col("n_pages") - F.size("queue")
        keywords = F.array_distinct(F.flatten(F.transform("open", lambda w: w["keywords"])))
        hints = F.array_distinct(F.flatten(F.transform("open", lambda w: w["hints"])))
        looked = looked.withColumn("words", keywords).withColumn("hint_words", hints)

        def scored(link: Column) -> Column:
            return F.struct(
                link_score(lambda name: link[name], F.col("words"), F.col("hint_words")).alias("x"), link["url"].alias("url"),
                link["url_key"].alias("url_key"), link["paging"].alias("paging"), link["site"].alias("site"),
            )

        eligible = F.filter(
            F.coalesce("f.links", F.array()),
            lambda link: (link["site"] == F.col("root_site")) & ~F.array_contains("visited", link["url_key"])
            & (~link["paging"] | (F.lit(options.allow_pagination) & plural_open)),
        )
        ranked = F.filter(F.transform(eligible, scored), lambda s: s["x"]["score"] >= MIN_LINK_SCORE)
        best = F.slice(
            F.transform(
                F.sort_array(F.transform(ranked, lambda s, i: F.struct(s["x"]["score"].alias("score"), (-i).alias("at"), s.alias("s"))), False),
                lambda r: F.struct(r["s"]["url"].alias("url"), r["s"]["url_key"].alias("url_key"), (F.col("job.depth") + 1).alias("depth"), r["s"]["x"]["reasons"].alias("reasons")),
            ),
            F.lit(1), F.greatest(F.lit(0), F.least(room, F.lit(4))),
        )
        follow = F.col("read") & F.lit(options.follow_internal_links) & (F.col("job.depth") < options.max_depth) & (room > 0)
        state = looked.withColumn(
            "queue", F.when(follow, F.concat("queue", best.cast(_QUEUE))).otherwise(F.col("queue"))
        ).where((F.size("open") > 0) & (F.size("queue") > 0) & (F.col("n_pages") < options.max_pages)).select(
            "site", "root_site", "queue", "visited", "counts", "n_pages", "n_paging"
        )
        state = cut(state)
        step += 1
        if state.isEmpty():
            return visits
