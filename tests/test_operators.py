import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webloom.operators import curate, edges, frontier, graph, jobs, search, stats
from webloom.operators.index import build_index
from webloom.operators.orphans import orphan_links, orphan_report
from webloom.operators.skew import keyed_lookup
from webloom.schemas import CRAWL_JOBS, PAGE_LINKS, PAGES
from webloom.sources import fetch, robots
from webloom.sources.tables import Tables, latest_per_key

DAY = datetime(2024, 5, 1)


def pages_of(spark, rows):
    """rows: (id, job, url, title, text, hash)"""
    full = [(i, j, u, u, "d", t, None, h, x, 200, 0, DAY, DAY, 0, 1, DAY) for i, j, u, t, x, h in rows]
    return spark.createDataFrame(full, PAGES)


def edge_rows(spark, rows):
    return spark.createDataFrame([(k, 1, s, t, e, w, None) for k, (s, t, e, w) in enumerate(rows, 1)], "id bigint, crawl_job_id bigint, source_page_id bigint, target_page_id bigint, edge_type string, weight double, evidence string")


def test_keyed_lookup(spark):
    rows = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(50)], "k int, v int")
    table = spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    want = sorted((r.v, r.name) for r in rows.join(table, "k", "left").collect())
    assert sorted((r.v, r.name) for r in keyed_lookup(rows, table, ["k"]).collect()) == want
    assert keyed_lookup(rows, table, ["k"], "inner").count() == sum(1 for _, n in want if n)


def test_index_and_duplicate_skip(spark):
    pages = pages_of(spark, [(1, 1, "a", "FastAPI", "FastAPI is a modern Python framework", "h1"), (2, 1, "b", "FastAPI", "FastAPI is a modern Python framework", "h1"), (3, 1, "c", None, "the and of to 123", "h2"), (4, 1, "d", None, None, None)])
    index = build_index(pages)
    tf = {(r.page_id, r.term): r.tf for r in index.postings.collect()}
    assert tf[1, "fastapi"] == 4 and tf[1, "python"] == 1 and not any(p == 2 for p, _ in tf)
    assert {r.page_id: r.token_count for r in index.lengths.collect()} == {1: 7, 2: 0, 3: 0, 4: 0}


def test_bm25_order_and_value(spark):
    rows = [(i, 1, f"u{i}", None, "common word here", f"h{i}") for i in range(1, 6)] + [(6, 1, "u6", None, "rare common word", "h6")]
    index = build_index(pages_of(spark, rows))
    got = search.ranked_pages(index, "rare common", 1).collect()
    assert got[0].page_id == 6 and [r.page_id for r in got[1:]] == [1, 2, 3, 4, 5]
    idf = lambda df: math.log((6 + 1) / (df + 0.5))
    avg = 3
    part = lambda df, n: idf(df) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * n / avg))
    assert got[1].score == pytest.approx(part(6, 3))
    assert got[0].score == pytest.approx(part(6, 3) + part(1, 3))
    assert search.ranked_pages(index, "the of", 1).count() == 0


def test_similarity_edges(spark):
    pages = pages_of(spark, [(1, 1, "a", None, "alpha " * 10, "1"), (2, 1, "b", None, "alpha " * 10, "2"), (3, 1, "c", None, "beta " * 10, "3")])
    got = edges.similarity_edges(build_index(pages)).collect()
    assert {(r.source_page_id, r.target_page_id) for r in got} == {(1, 2), (2, 1)}
    assert all(r.weight == pytest.approx(1) and r.evidence.shared_terms == ["alpha"] for r in got)
    links = spark.createDataFrame([], PAGE_LINKS)
    dup = edges.similarity_duplicate_edges(build_index(pages), pages, links).collect()
    assert [(r.source_page_id, r.target_page_id) for r in dup] == [(1, 2)]


def test_link_hash_and_new_edges(spark):
    pages = pages_of(spark, [(1, 1, "https://a.example/long", None, "x", "h"), (2, 1, "https://a.example/s", None, "x", "h"), (3, 2, "https://a.example/s", None, "x", None)])
    links = spark.createDataFrame([(1, 1, 1, "https://a.example/s", None, 1, False), (2, 1, 1, "https://a.example/s", None, 1, False), (3, 1, 1, "https://a.example/long", None, 1, True), (4, 1, 1, "https://a.example/none", None, 1, True)], PAGE_LINKS)
    built = edges.link_edges(links, pages)
    assert [(r.source_page_id, r.target_page_id) for r in built.collect()] == [(1, 2)]
    assert edges.new_edges(built, built).count() == 0
    assert [(r.source_page_id, r.target_page_id) for r in edges.hash_duplicate_edges(pages, links).collect()] == [(2, 1)]


def test_pagerank_components_betweenness(spark):
    pages = pages_of(spark, [(i, 1, f"u{i}", None, "x", None) for i in (1, 2, 3, 4)])
    e = edge_rows(spark, [(1, 2, "link", 1.0), (2, 3, "link", 1.0), (9, 1, "link", 1.0), (2, 4, "near_duplicate", 1.0)])
    three = pages.where("id < 4")
    ranks = {r.page_id: r.pagerank for r in graph.pagerank(e, three, tolerance=1e-9).collect()}
    assert ranks[1] == pytest.approx(0.1844167819, abs=1e-6) and ranks[3] == pytest.approx(0.4744124715, abs=1e-6)
    assert {r.page_id: r.cluster_id for r in graph.components(e, pages).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.page_id: r.betweenness for r in graph.betweenness(e, pages).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}
    assert all(r.betweenness is None for r in graph.betweenness(e, pages, 2).collect())
    assert {r.page_id: (r.in_degree, r.out_degree) for r in graph.degrees(e, pages).collect()}[2] == (1, 1)


def test_bounded_walks(spark):
    pages = pages_of(spark, [(i, 1, f"u{i}", None, "x", None) for i in (1, 2, 3)])
    e = edge_rows(spark, [(1, 2, "link", 1.0), (2, 3, "near_duplicate", 1.0)])
    assert graph.reachable(e, pages, [1], 1, 5, 2) == [(1, 0), (2, 1)]
    assert graph.reachable(e, pages, [1], 1, 5, 3) == [(1, 0), (2, 1), (3, 2)]
    assert graph.explored(e, pages, [1], 1, 5, 9) == [(1, 0), (2, 1)]
    with pytest.raises(ValueError):
        graph.reachable(e, pages, [1], 1, 51, 2)


def test_curated_edges(spark):
    nodes = spark.createDataFrame([(1, "query_match"), (2, "related_neighbor"), (3, "related_neighbor")], "page_id bigint, role string")
    e = edge_rows(spark, [(1, 2, "link", 1.0), (2, 1, "link", 0.5), (1, 2, "url_hierarchy", 0.9), (1, 2, "content_similarity", 0.3), (2, 3, "link", 1.0)])
    assert {r.id for r in curate.forced_edges(e, nodes).collect()} == {1, 2, 4}
    assert {r.id for r in curate.pruned_edges(e, nodes, 2).collect()} == {1, 2, 4}
    assert curate.similarity_floor(301) == 0.28 and curate.similarity_floor(300) == 0.0


def test_orphans(spark):
    may = datetime(2024, 5, 20)
    rows = [(1, 1, "https://a.example/1", None, "x", None), (2, 1, "https://a.example/2?b=1", None, "x", None)]
    late = spark.createDataFrame([(3, 1, "u", "https://a.example/3", "d", None, None, None, "x", 200, 0, None, None, 0, 1, datetime(2024, 6, 2)), (4, 2, "u", "https://a.example/4", "d", None, None, None, "x", 200, 0, None, None, 0, 1, may)], PAGES)
    pages = pages_of(spark, rows).unionByName(late)
    url = "https://A.example/{}"
    links = [
        (1, 1, 1, url.format("2/?b=1&utm_source=x"), None, 1, True),
        (2, 1, 1, url.format("none"), None, 1, True),
        (2, 1, 1, url.format("none"), None, 1, True),
        (3, 1, 1, url.format("none"), None, 1, False),
        (4, 1, 1, url.format("none"), 2, 1, False),
        (5, 1, 1, url.format("1"), 99, 1, False),
        (6, 1, 1, url.format("3"), None, 1, True),
        (7, 1, 3, url.format("3"), None, 1, True),
        (8, 1, 1, url.format("1"), 4, 1, None),
        (9, 1, 1, "mailto:x", None, 1, True),
        (10, 1, 1, None, None, 1, True),
        (11, 1, 77, url.format("none"), None, 1, True),
    ]
    df = spark.createDataFrame(links, PAGE_LINKS)
    got = {(r.link_id, r.period) for r in orphan_links(df, pages).collect()}
    assert got == {(2, "2024-05"), (5, "2024-05"), (6, "2024-05"), (8, "2024-05"), (9, "2024-05")}
    assert sum(r.orphans for r in orphan_report(df, pages).collect()) == 5
    assert orphan_links(df.limit(0), pages).count() == 0 and orphan_links(df, pages.limit(0)).count() == 0


def test_fetch_and_robots(spark):
    rows = [(200, "text/html; charset=utf-8", 10), (404, "text/html", 10), (200, "image/png", 10), (200, "text/css", 10), (200, "text/html", 6_000_000), (None, None, 1)]
    kinds = [r[0] for r in spark.createDataFrame(rows, "s int, c string, b int").select(fetch.failure_kind(F.col("s"), F.col("c"), F.col("b"))).collect()]
    assert kinds == [None, "http_error", "not_indexable", "not_indexable", "oversized", "http_error"]
    answers = iter([("timeout", None), ("http_error", 503), (None, 200)])
    assert fetch.with_retries(lambda u: next(answers), "u", sleep=lambda s: None) == (None, 200, 2)
    assert not fetch.should_retry("http_error", 404)
    assert robots.disallowed_prefixes("User-agent: *\nDisallow: /private\nDisallow: admin/\nUser-agent: x\nDisallow: /x") == ["/private", "/admin/"]
    files = spark.createDataFrame([("a.example", 200, "User-agent: *\nDisallow: /p"), ("b.example", 404, "User-agent: *\nDisallow: /")], "host string, status int, body string")
    asked = spark.createDataFrame([("https://a.example/p/1",), ("https://a.example/q",), ("https://b.example/p",), ("not a url",)], "url string")
    assert robots.allowed(asked, robots.robots_rules(files)).count() == 3


def test_crawl_levels(spark):
    site = {"/": ["/a", "/b"], "/a": ["/c"], "/b": [], "/c": ["/d"], "/d": []}
    body = [("https://s.example" + p, 200, "text/html", f"<title>{p}</title>" + "".join(f'<a href="{q}">x</a>' for q in to)) for p, to in site.items()]
    web = spark.createDataFrame(body, "url string, status int, content_type string, body string")
    got = frontier.crawl(spark, "https://s.example", lambda asked: asked.join(web, "url", "left"), max_pages=3, max_depth=5)
    assert sorted(r.url for r in got.pages.collect()) == ["https://s.example/", "https://s.example/a", "https://s.example/b"]
    shallow = frontier.crawl(spark, "https://s.example", lambda asked: asked.join(web, "url", "left"), max_pages=50, max_depth=1)
    assert shallow.pages.count() == 3 and shallow.status == "completed"
    lost = frontier.crawl(spark, "https://nowhere.example", lambda asked: asked.join(web, "url", "left"))
    assert lost.status == "failed" and lost.errors.count() == 1


def test_jobs(spark):
    all_jobs, bad = jobs.create_jobs(spark, ["https://a.example", "nope", "https://b.example"], DAY)
    assert all_jobs.count() == 2 and bad[0][0] == "nope"
    cancelled = jobs.cancel_job(all_jobs, 1, DAY)
    assert cancelled.where("id = 1").first().status == "cancelled"
    with pytest.raises(ValueError):
        jobs.cancel_job(cancelled, 1, DAY)
    failed = jobs.finish_job(all_jobs, 2, 0, DAY)
    reset, left = jobs.retry_job(failed, {"pages": pages_of(spark, [(1, 2, "u", None, "x", None), (2, 3, "u", None, "x", None)])}, 2)
    assert reset.where("id = 2").first().status == "queued" and left["pages"].count() == 1
    with pytest.raises(ValueError):
        jobs.list_jobs(all_jobs, status="odd")
    assert jobs.list_jobs(all_jobs, seed="A.EX").count() == 1 and spark.createDataFrame([], CRAWL_JOBS).count() == 0


def test_tables(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert tables.append_absent("x", rows, ["k"]) == 2 and tables.append_absent("x", rows, ["k"]) == 0
    assert tables.truncate("x") == 2 and tables.read("x").count() == 0
    old = spark.createDataFrame([(1, "a", 1, 1)], "k int, v string, created_at int, updated_at int")
    new = spark.createDataFrame([(1, "b", 2, 2), (3, "c", 2, 2)], old.schema)
    assert sorted(map(tuple, latest_per_key(old, new, ["k"]).collect())) == [(1, "b", 1, 2), (3, "c", 2, 2)]


def test_status_classes(spark):
    rows = spark.createDataFrame([(200, 3), (301, 1), (404, 5), (500, 2), (99, 1)], "status_code int, responses bigint")
    assert tuple(stats.status_classes(rows).first()) == (3, 1, 5, 2)
