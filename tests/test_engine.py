from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webloom.engine import Engine
from webloom.operators import edges, frontier, graph, stats
from webloom.operators.index import build_index
from webloom.operators.similar import best_pairs
from webloom.schemas import CRAWL_ERRORS, CRAWL_JOBS, PAGE_GRAPH_EDGES, PAGE_LINKS, PAGES, SEARCH_QUERIES
from webloom.sources.tables import Tables, log_searches
from webloom.streaming.search_log import index_batch, index_stream, search_stream, windowed_searches

NOW = datetime(2024, 5, 1)


def page(i, job, text, title=None, content_hash=None, slug=None):
    url = f"https://a.example/{slug or f'p{i}'}"
    return (i, job, url, url, "a.example", title, None, content_hash, text, 200, 0, NOW, None, 5, 1, NOW)


def edge(i, job, a, b, kind="link", weight=1.0):
    return (i, job, a, b, kind, weight, None, NOW, NOW)


@pytest.fixture()
def folder(spark, tmp_path):
    """A small crawl: job 1 has a chain 1-2-3, a copy 4 of 1 and a lone page 5; job 2 has one page."""
    texts = {1: "caching servers store pages for readers", 2: "index servers rank pages by words", 3: "crawling queues follow links", 4: "caching servers store pages for readers", 5: "nothing of note"}
    rows = [page(i, 1, t, f"Title {i}", "h1" if i in (1, 4) else f"h{i}", {2: "p1/sub"}.get(i)) for i, t in texts.items()] + [page(9, 2, "caching elsewhere")]
    links = [(k, 1, a, f"https://a.example/{t}", None, 1, True) for k, (a, t) in enumerate([(1, "p1/sub"), (2, "p3"), (2, "p3"), (1, "new"), (1, "deep")])]
    links[-1] = (*links[-1][:5], 7, True)
    jobs = [(1, "s", "https://a.example/", "completed", 10, 3, True, 5, 0, 0, NOW, NOW, NOW, None), (2, "s", "s", "running", 1, 3, True, 1, 0, 0, NOW, NOW, None, None)]
    given = {
        "pages": (rows, PAGES), "page_links": (links, PAGE_LINKS), "crawl_jobs": (jobs, CRAWL_JOBS), "crawl_errors": ([], CRAWL_ERRORS), "search_queries": ([], SEARCH_QUERIES),
        "page_graph_edges": ([edge(1, 1, 1, 2), edge(2, 1, 2, 3), edge(3, 1, 1, 4, "near_duplicate")], PAGE_GRAPH_EDGES),
    }
    for name, (data, schema) in given.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_search(spark, folder):
    engine = Engine(spark, folder)
    answer = engine.search("  caching servers ", 1, related=2, mark_duplicates=True)
    assert [r.page_id for r in answer.results.orderBy("rank").collect()] == [1, 2]  # 4 is a copy, not indexed
    assert {(r.page_id, r.other_id) for r in answer.related.collect()} == {(1, 2), (1, 4), (2, 1), (2, 3)}
    assert answer.variants.count() == 0 and answer.collapsed.count() == 2
    assert {r.page_id for r in engine.search("caching", log=False).results.collect()} == {1, 9}
    assert [r.page_id for r in engine.search("caching", 1, by_graph=True, log=False).results.where("rank = 1").collect()] == [1]
    logged = Tables(spark, folder).read("search_queries").collect()
    assert [(r.query, r.result_count) for r in logged] == [("caching servers", 2)]
    for wrong in (dict(query=" "), dict(query="x", limit=0), dict(query="x", related=3), dict(query="x", by_graph=True), dict(query="x", job=1, related=11)):
        with pytest.raises(ValueError):
            engine.search(**wrong)
    with pytest.raises(LookupError):
        engine.search("x", 77)
    assert engine.search("???", 1, log=False).results.count() == 0


def test_graph_and_health(spark, folder):
    engine = Engine(spark, folder)
    nodes, own = engine.subgraph(1, 1, radius=2)
    assert [(r.page_id, r.hops, r.cluster_id) for r in nodes.collect()] == [(1, 0, 1), (2, 1, 1), (3, 2, 1)]
    assert [(r.source_page_id, r.target_page_id) for r in own.collect()] == [(1, 2), (2, 3)]
    nodes, _ = engine.graph_query("crawling queues", radius=1)
    assert {(r.page_id, r.role) for r in nodes.collect()} == {(3, "query_match"), (2, "related_neighbor")}
    assert engine.graph_query("zzz")[0].count() == 0
    assert [r.other_id for r in engine.neighbors(1, 2).collect()] == [1, 3]
    assert engine.clusters(1)[1].first().total == 5
    panels = engine.health(1)
    assert {r.page_id for r in panels["orphans"].collect()} == {4, 5} and panels["messages"] == []
    assert engine.health()["messages"]
    for wrong in (lambda: engine.subgraph(1, 99), lambda: engine.subgraph(7, 1), lambda: engine.health(7)):
        with pytest.raises(LookupError):
            wrong()
    with pytest.raises(ValueError):
        engine.subgraph(1, 1, radius=51)


def test_stats_and_backfill(spark, folder):
    engine = Engine(spark, folder)
    figures = engine.stats()
    assert figures["index_size"].first().unique_terms > 5 and figures["totals"].first().pages == 6
    assert stats.open_work(engine._table("pages"), engine._table("crawl_errors")).first().pending == 6
    done = engine.backfill()
    built = {(r.source_page_id, r.target_page_id, r.edge_type) for r in Tables(spark, folder).read("page_edges_built").collect()}
    assert {(1, 2, "link"), (2, 3, "link"), (1, 2, "url_hierarchy"), (1, 4, "near_duplicate")} <= built and done["edges"] == len(built) and done["metrics"] == 6
    assert engine.backfill() == done  # the same rows again, none twice
    found = {(r.url, r.depth) for r in frontier.job_frontier(engine._table("page_links"), engine._table("pages").select("crawl_job_id", F.col("normalized_url").alias("url")), engine._table("crawl_jobs")).collect()}
    assert found == {("https://a.example/new", 1)}


def test_large_jobs_give_the_same(spark):
    pages = spark.createDataFrame([page(i, 1 + i % 2, "x") for i in range(40)] + [page(99, 3, "x")], PAGES)
    e = spark.createDataFrame([edge(k, 1 + a % 2, a, b, "link", 0.5 + k % 3) for k, (a, b) in enumerate((a, (a * 7 + s) % 40) for a in range(36) for s in (4, 10) if (a * 7 + s - a) % 2 == 0)], PAGE_GRAPH_EDGES)
    one, many = graph.components(e, pages), graph.components(e, pages, one_task=0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    few, all_ = ({(r.crawl_job_id, r.page_id): r.pagerank for r in graph.pagerank(e, pages, rounds=6, one_task=n).collect()} for n in (10**6, 0))
    assert few.keys() == all_.keys() and all(abs(few[k] - all_[k]) < 1e-12 for k in few) and len(few) == 41
    assert abs(sum(v for (j, _), v in few.items() if j == 1) - 1) < 1e-9


def test_similar_pairs_match_brute_force(spark):
    import math
    import random

    rng = random.Random(4)
    words = [f"term{k}x" for k in range(14)]
    texts = {i: " ".join(rng.choices(words, weights=[30, 20, 10, *[2] * 11], k=rng.randrange(2, 16))) for i in range(30)} | {30: "term0x", 31: ""}
    vectors = edges.tfidf(build_index(spark.createDataFrame([page(i, 1, t) for i, t in texts.items()], PAGES)))
    rows = vectors.collect()
    by = {}
    for r in rows:
        by.setdefault(r.page_id, {})[r.term] = r
    for least, ordered in ((0.15, False), (0.92, True)):
        want = {}
        for a in by:
            for b in by:
                shared = [t for t in by[a] if t in by[b] and by[a][t].w > 0]
                if (a < b if ordered else a != b) and any(by[a][t].place <= 3 for t in shared):
                    score = sum(by[a][t].w * by[b][t].w for t in shared) / (by[a][shared[0]].norm * by[b][shared[0]].norm)
                    if score >= least:
                        want[a, b] = score
        got = {(r.source_page_id, r.target_page_id): r.score for r in edges.similar_pairs(vectors, least, important=3, ordered=ordered).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_best_pairs_whole_and_in_blocks(spark):
    import math
    import random

    rng = random.Random(5)
    words = [f"term{k}x" for k in range(40)]
    texts = {i: " ".join(rng.choices(words, weights=[30, 20, 10, *[2] * 37], k=rng.randrange(2, 16))) for i in range(60)} | {60: "term0x", 61: "", 62: "term5x term6x", 63: "term5x term6x", 64: "term5x term6x"}
    index = build_index(spark.createDataFrame([page(i, 1 + i % 2, t) for i, t in texts.items()] + [page(90, 3, "alone"), page(91, None, "term1x"), page(92, None, "term1x")], PAGES))
    by, terms = {}, {}
    for r in edges.tfidf(index).where("crawl_job_id is not null").collect():
        by.setdefault((r.crawl_job_id, r.page_id), {})[r.term] = r
    want = {}
    for j, a in by:
        near = []
        for k, b in by:
            one, two = by[j, a], by[k, b]
            shared = sorted(t for t in one if t in two)
            if j == k and a != b and any(one[t].place <= 3 and one[t].w > 0 for t in shared):
                score = sum(one[t].w * two[t].w for t in shared) / (one[shared[0]].norm * two[shared[0]].norm)
                if score >= 0.15:
                    near.append((-round(score, 9), b, shared[:4]))
        for score, b, shared in sorted(near)[:5]:
            want[j, a, b] = (-score, shared)
    for sizes in ({}, {"small_pages": 3, "block_pages": 4}):
        got = {(r.crawl_job_id, r.source_page_id, r.target_page_id): r for r in best_pairs(index.texts, 0.15, 5, 3, 4, **sizes).collect()}
        assert got.keys() == want.keys() and len(got) > 100
        assert all(math.isclose(got[k].score, want[k][0], abs_tol=1e-8) and got[k].shared_terms == want[k][1] for k in got)


def test_similarity_edges_shuffle_no_pairs(spark):
    n = 500
    index = build_index(spark.createDataFrame([page(i, 1, f"half{i % 2}x third{i % 3}x fifth{i % 5}x seventh{i % 7}x") for i in range(n)], PAGES))
    postings = index.postings.count()
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    assert len(edges.similarity_edges(index).collect()) == 10 * n
    # nearly all pairs share terms; what is moved grows with the postings, not with the pairs
    assert sum(m for s, m in stages().items() if s not in before) < 10 * postings < n * n / 4


def test_index_in_batches(spark, tmp_path):
    rows = [page(i, 1, t, None, h) for i, t, h in [(1, "one text", "a"), (2, "other text", "b"), (3, "one text", "a"), (4, "", "c"), (5, "late words", "c"), (6, "no hash", None)]]
    tables = Tables(spark, str(tmp_path / "t"))
    for batch in (rows[:2], rows[2:], rows[2:]):
        index_batch(tables, spark.createDataFrame(batch, PAGES))
    whole = build_index(spark.createDataFrame(rows, PAGES))
    for name, frame in (("postings", whole.postings), ("lengths", whole.lengths)):
        assert sorted(map(tuple, tables.read(name).select(*frame.columns).collect())) == sorted(map(tuple, frame.collect()))


def test_streams(spark, tmp_path):
    source = str(tmp_path / "pages")
    spark.createDataFrame([page(1, 1, "some words"), page(2, 1, "more words")], PAGES).write.parquet(source)
    tables = Tables(spark, str(tmp_path / "t"))
    for _ in range(2):  # started again, it goes on where it ended
        index_stream(spark, source, tables, str(tmp_path / "c")).awaitTermination()
    assert tables.read("postings").count() == 4 and tables.read("lengths").count() == 2
    log = Tables(spark, str(tmp_path / "log"))
    log_searches(log, [("a ", 0, 5, datetime(2024, 5, 1, 10, 5)), ("b", 3, 7, datetime(2024, 5, 1, 10, 50)), ("c", 1, 9, datetime(2024, 5, 1, 12, 0))])
    assert log.read("search_queries").select("id").distinct().count() == 3 and log.read("search_queries").where("id < 0").isEmpty()
    got = windowed_searches(search_stream(spark, log.path("search_queries")))
    query = got.writeStream.format("memory").queryName("searches_test").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.searches, r.zero_results, r.mean_ms) for r in spark.table("searches_test").orderBy("window_start").collect()] == [(2, 1, 6.0), (1, 0, 9.0)]
