"""Walks over made-up page graphs against a page-by-page walker."""

import random

import pytest

from factsieve.plans.options import Options, page_budget
from factsieve.plans.walk import walk_pages
from factsieve.sources.staging import cut

FACTS = ("url_key string, f struct<page_id:bigint,base_url:string,ids:array<string>,has_controls:boolean,"
         "candidates:array<struct<rank:int,at:bigint,url:string,url_key:string,site:string,reason:string,text:string>>>")


def url(n, site="a"):
    return f"http://{site}.example/l?page={n}"


def fact(n, ids, targets, controls=True):
    """``targets``: page numbers, or ``(number, site)``."""
    targets = [t if isinstance(t, tuple) else (t, "a") for t in targets]
    links = [(1, i, url(*t), url(*t), f"{t[1]}.example", f"link {i}", "") for i, t in enumerate(targets)]
    return url(n), (n, url(n), ids, controls, links)


def plain(facts, seed, options):
    """One page after the other, as the definition reads."""
    budget, pages, seen, visited, steps = 1 + page_budget(options), dict(facts), set(), [], []
    key, how, total = seed, ("user-provided URL", seed), 0
    while True:
        k = len(visited)
        f = pages.get(key)
        visited.append(key)
        if f is None:
            return steps, total, f"page {k + 1} could not be fetched"
        page_id, _, ids, controls, links = f
        if not ids:
            return steps, total, f"page {k + 1} contained no list rows"
        fresh = [i for i in dict.fromkeys(ids) if i not in seen]
        added = fresh[: max(0, options.max_records - total)]
        seen.update(fresh)
        steps.append((k, page_id, how[1], how[0], len(ids), added))
        total += len(added)
        usable = [c for c in links if c[4] == "a.example" and c[3] not in visited]
        if total >= options.max_records:
            return steps, total, f"record cap (maxRecords: {options.max_records}) reached"
        if not added and k:
            return steps, total, "a page repeated rows already collected"
        if not options.allow_pagination:
            return steps, total, "this page is paginated, but pagination following is off (allowPagination)" if controls else "no further pages"
        if k + 1 >= budget:
            return steps, total, f"page budget ({budget} list page(s)) reached"
        if not usable:
            return steps, total, 'reached the last page (no further "next" link)' if controls else "no pagination controls on this page"
        key, how = usable[0][3], (usable[0][5], usable[0][2])


def check(spark, facts, seeds, options):
    table = cut(spark.createDataFrame(facts, FACTS), "url_key")
    steps, walks = walk_pages(table, spark.createDataFrame([(s,) for s in seeds], "url string"), options)
    got: dict = {}
    for r in steps.collect():
        got.setdefault(r.walk_id, []).append((r.step, r.page_id, r.url, r.reason, r.records_found, r.added))
    ends = {r.walk_id: (r.pages_walked, r.n_records, r.stop_reason) for r in walks.collect()}
    assert set(ends) == set(seeds)
    for seed in seeds:
        want, total, reason = plain(facts, seed, options)
        assert sorted(got.get(seed, [])) == want, seed
        assert ends[seed] == (len(want), total, reason), seed


def graph(seed, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        targets = [i + 1] if kind < 0.5 else [rng.randrange(n + 3) for _ in range(rng.randrange(4))] if kind < 0.8 else [i, max(0, i - 1), i + 1, (i, "b")]
        ids = [] if rng.random() < 0.04 else [f"r{i}-{j}" for j in range(3)] if rng.random() < 0.9 else [f"r{rng.randrange(n)}-0"]
        out.append(fact(i, ids, targets, rng.random() < 0.7))
    return out


@pytest.mark.parametrize("seed, options", [
    (1, Options(allow_pagination=True)), (2, Options(allow_pagination=True)), (3, Options(allow_pagination=True, max_pagination_pages=4)),
    (4, Options(allow_pagination=True, max_records=7)), (5, Options()),
])
def test_graphs_with_loops_and_gaps(spark, seed, options):
    facts = graph(seed)
    check(spark, facts, [url(i) for i in range(0, 44, 3)], options)


def test_a_long_walk_in_few_rounds(spark, monkeypatch):
    """600 pages; every page links back first, so each pointer has to be the link forward."""
    from factsieve.plans import walk

    facts = [fact(i, [f"r{i}", "same on all"], [i + 1] if i < 599 else []) for i in range(600)]
    cuts = []
    monkeypatch.setattr(walk, "cut", lambda frame, *a, **k: cuts.append(1) or cut(frame, *a, **k))
    check(spark, facts, [url(0), url(590)], Options(allow_pagination=True))
    assert len(cuts) < 40


def test_links_back_are_passed_over(spark):
    """Pages whose preferred link leads back go on from their next link."""
    facts = [fact(i, [f"r{i}"], [max(0, i - 1), i + 1]) for i in range(6)]
    check(spark, facts, [url(0), url(3)], Options(allow_pagination=True))
