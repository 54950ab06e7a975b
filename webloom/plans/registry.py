"""All queries of the core, by name. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html, reasons, text, urls
from webloom.operators import curate, edges, frontier, graph, health, jobs, orphans, rerank, search, stats
from webloom.operators.index import Index, build_index, live_pages, page_terms, pages_indexed
from webloom.operators.skew import keyed_lookup
from webloom.plans import oracle
from webloom.sources import fetch, robots

#: The queries' search words and job.
QUERY, WORDS, JOB = oracle.QUERY, oracle.WORDS, oracle.JOB

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_INDEXES: dict[tuple, Index] = {}


class _Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def index(self) -> Index:
        """The stored index of the folder's pages, built once a session for the files as they are."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pages.parquet")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pages.parquet*/*"))
        own = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files = tuple((str(x.getPath()), x.getLen(), x.getModificationTime()) for x in (own, *found))
        key = (self.spark.sparkContext.applicationId, files)
        if key not in _INDEXES:
            _INDEXES[key] = build_index(self.pages)
        return _INDEXES[key]


def _query(f: Callable[[_Tables], DataFrame]) -> Callable[[_Tables], DataFrame]:
    _QUERIES[f.__name__] = lambda spark, folder: f(_Tables(spark, folder))
    return f


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return _QUERIES["bm25_global"](spark, folder)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracle.SQL.items() if name in _QUERIES}


# text and index


@_query
def tokenize_pages(t):
    terms = text.search_terms(F.col("extracted_text"))
    return t.pages.select("id", terms.alias("terms")).select("id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


@_query
def tokenize_documents(t):
    terms = text.search_terms(F.col("text"), stopwords=["cache"], min_len=3, keep_numbers=True)
    return t.documents.select("doc_id", terms.alias("terms")).select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


@_query
def index_postings(t):
    return build_index(t.pages).postings.drop("token_count")


@_query
def term_df(t):
    return t.index.frequencies()


@_query
def page_lengths(t):
    return t.index.lengths


@_query
def dedupe_first_per_hash(t):
    return live_pages(page_terms(t.pages)).where("not live").select("crawl_job_id", "page_id", "content_hash")


@_query
def corpus_stats(t):
    index = t.index
    return index.stats(by_job=True).select("crawl_job_id", "n_docs", F.round("avg_length", 6).alias("avg_length"))


@_query
def pages_indexed_by_job(t):
    return pages_indexed(t.index)


# search


def _ranked(ranked):
    return ranked.select("page_id", "crawl_job_id", F.round("score", 6).alias("score"), F.array_join("matched_terms", " ").alias("matched_terms"))


@_query
def bm25_scoped(t):
    return _ranked(search.ranked_pages(t.index, QUERY, JOB))


@_query
def bm25_global(t):
    return _ranked(search.ranked_pages(t.index, QUERY))


@_query
def search_global_top(t):
    return search.search_results(t.index, t.pages, QUERY, None, 20).select("rank", "page_id", "url", F.array_join("matched_terms", " ").alias("matched_terms"))


@_query
def search_snippet(t):
    return search.search_results(t.index, t.pages, QUERY, JOB, 20)


def _hits(t):
    """The job's result page: (page_id, rank)."""
    from pyspark.sql import Window

    top = search.ranked_pages(t.index, WORDS, JOB, 100)
    return top.select("page_id", F.row_number().over(Window.orderBy(F.desc("score"), "page_id")).alias("rank"))


@_query
def related_neighbors(t):
    found = search.related_pages(_hits(t), t.page_graph_edges.where(F.col("crawl_job_id") == JOB), 3)
    return found.select("page_id", "other_id", "edge_type", F.round("weight", 6).alias("weight"), F.array_join("also_related_by", ",").alias("also_related_by"), F.col("place").cast("long").alias("place"))


@_query
def duplicate_variants(t):
    return search.duplicate_variants(_hits(t), t.page_graph_edges.where(F.col("crawl_job_id") == JOB))


@_query
def duplicate_collapse(t):
    hits = _hits(t)
    variants = search.duplicate_variants(hits, t.page_graph_edges.where(F.col("crawl_job_id") == JOB))
    return search.collapse_duplicates(hits, variants).select(F.col("rank").cast("long").alias("rank"), "page_id", F.array_join(F.transform("variants", lambda v: v.cast("string")), ",").alias("variants"))


@_query
def rerank_graph(t):
    e = t.page_graph_edges.where(F.col("crawl_job_id") == JOB)
    own = t.pages.where(F.col("crawl_job_id") == JOB)
    ranks = graph.pagerank(e, own)
    return rerank.reranked(t.index, t.pages, t.page_graph_edges, ranks, WORDS, JOB, 20).drop("explanation")


# URLs and HTML


@_query
def normalize_urls(t):
    return t.pages.select("id", urls.normalize_url(F.col("url")).alias("canonical"))


@_query
def normalize_link_urls(t):
    return t.page_links.select("target_normalized_url").distinct().select("target_normalized_url", urls.normalize_url(F.col("target_normalized_url")).alias("canonical"))


@_query
def url_parts(t):
    u = F.col("normalized_url")
    return t.pages.select("id", urls.host_of(u).alias("host"), urls.parent_url(u).alias("parent"), edges.url_path(u).alias("path"))


def _as_html(t):
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = escape(F.coalesce("extracted_text", F.lit("")))
    head = F.concat(F.lit("<html><head><title>"), escape(F.coalesce("title", F.lit(""))), F.lit("</title><style>p {}</style></head><body><nav>Menu</nav><article><p>"))
    tail = F.concat(F.lit('</p><a href="'), F.col("url"), F.lit('">self</a><a href="#x">x</a></article><div class="main-nav">Footer</div><footer>End</footer></body></html>'))
    return t.pages.where("url is not null").select("id", "url", F.concat(head, body, tail).alias("html"))


@_query
def extract_html(t):
    p = html.parse_html(F.col("html"), F.col("url"))
    return _as_html(t).select("id", p.alias("p")).select("id", "p.title", F.md5(F.col("p.text")).alias("text_md5"), F.array_join("p.links", " ").alias("links"))


# edges


def _edges(built):
    return built.select("crawl_job_id", "source_page_id", "target_page_id", "edge_type", F.round("weight", 6).alias("weight"))


@_query
def link_edges(t):
    return _edges(edges.link_edges(t.page_links, t.pages))


@_query
def url_hierarchy_edges(t):
    built = edges.hierarchy_edges(t.pages)
    return built.select("crawl_job_id", "source_page_id", "target_page_id", F.round("weight", 6).alias("weight"), "evidence.child_path", "evidence.parent_path")


def _site_tree(t):
    """A shop's page tree from the sales tables: root, regions, nations, customers."""
    root = F.lit("https://shop.example/")
    region = F.replace(F.lower("r_name"), F.lit(" "), F.lit("-"))
    nation = F.concat(root, region, F.lit("/"), F.lower("n_name"))
    nations = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    levels = [
        t.spark.range(1).select(F.lit(1).cast("long").alias("id"), root.alias("normalized_url")),
        t.region.select((F.col("r_regionkey") + 10).cast("long").alias("id"), F.concat(root, region).alias("normalized_url")),
        nations.select((F.col("n_nationkey") + 100).cast("long").alias("id"), nation.alias("normalized_url")),
        t.customer.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") + 1000).alias("id"), F.concat(nation, F.lit("/"), F.col("c_custkey")).alias("normalized_url")),
    ]
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.withColumn("crawl_job_id", F.lit(10).cast("long"))


@_query
def url_hierarchy_site_tree(t):
    built = edges.hierarchy_edges(_site_tree(t))
    return built.select("source_page_id", "target_page_id", F.round("weight", 6).alias("weight"), "evidence.child_path", "evidence.parent_path")


@_query
def content_similarity_edges(t):
    built = edges.similarity_edges(t.index)
    return built.select("crawl_job_id", "source_page_id", "target_page_id", F.round("weight", 6).alias("weight"), F.size("evidence.shared_terms").cast("long").alias("n_shared"))


@_query
def near_duplicate_hash_edges(t):
    return _edges(edges.hash_duplicate_edges(t.pages, t.page_links))


@_query
def near_duplicate_similarity_edges(t):
    return _edges(edges.similarity_duplicate_edges(t.index, t.pages, t.page_links))


@_query
def edge_insert_if_absent(t):
    return edges.new_edges(edges.link_edges(t.page_links, t.pages), t.page_graph_edges).select("crawl_job_id", "source_page_id", "target_page_id", "edge_type")


@_query
def edge_reason(t):
    return t.page_graph_edges.select("id", reasons.edge_reason(F.col("edge_type"), F.col("evidence"), F.col("weight")).alias("reason"))


# graph


@_query
def graph_degrees(t):
    return graph.degrees(t.page_graph_edges, t.pages)


@_query
def graph_pagerank(t):
    ranks = graph.pagerank(t.page_graph_edges, t.pages)
    return ranks.select("crawl_job_id", "page_id", F.round("pagerank", 9).alias("pagerank"))


@_query
def graph_wcc(t):
    return graph.components(t.page_graph_edges, t.pages)


@_query
def graph_betweenness(t):
    return graph.betweenness(t.page_graph_edges, t.pages).select("crawl_job_id", "page_id", F.round("betweenness", 6).alias("betweenness"))


def _center(t):
    """The job's page with most edges: where walks begin."""
    return graph.undirected(t.page_graph_edges).where(F.col("crawl_job_id") == JOB).join(t.pages.select("crawl_job_id", F.col("id").alias("a")), ["crawl_job_id", "a"], "left_semi").groupBy("a").count().orderBy(F.desc("count"), "a").first()


@_query
def bfs_bounded(t):
    center = _center(t)
    found = graph.reachable(t.page_graph_edges, t.pages, [center[0]], JOB, 2, 500) if center else []
    return t.spark.createDataFrame(found, "page_id bigint, hops int")


@_query
def induced_subgraph(t):
    center = _center(t)
    found = graph.reachable(t.page_graph_edges, t.pages, [center[0]], JOB, 2, 500) if center else []
    return graph.induced_edges(t.page_graph_edges, [p for p, _ in found], JOB).select("id", "source_page_id", "target_page_id", "edge_type")


@_query
def graph_stats(t):
    clusters = graph.components(t.page_graph_edges, t.pages)
    s = graph.graph_stats(t.page_graph_edges, t.pages, clusters)
    kinds = F.array_join(F.transform("edge_types", lambda x: F.concat(x["edge_type"], F.lit("="), x["n"].cast("string"))), ",")
    return s.select("crawl_job_id", "pages", "edges", kinds.alias("edge_types"), "clusters", "largest_cluster")


@_query
def clusters_page(t):
    return graph.clusters_page(graph.components(t.page_graph_edges, t.pages), JOB, 5, 50)[0].select("page_id", "cluster_id")


@_query
def graph_query_best_job(t):
    return graph.best_job(search.ranked_pages(t.index, QUERY, None, 50), t.crawl_jobs).select("crawl_job_id", F.round("total_score", 6).alias("total_score"), "hits")


@_query
def graph_query_nodes(t):
    return graph.graph_query(t.index, t.pages, t.page_graph_edges, t.crawl_jobs, WORDS, JOB, radius=2, max_nodes=100).select("page_id", "hops", "role")


def _curated(t):
    nodes = graph.graph_query(t.index, t.pages, t.page_graph_edges, t.crawl_jobs, WORDS, JOB, radius=2, max_nodes=100)
    own = t.page_graph_edges.where(F.col("crawl_job_id") == JOB)
    return nodes, curate.shown_edges(own, nodes, ("link", "url_hierarchy", "content_similarity", "near_duplicate"), 0.0, own.count())


@_query
def curate_forced_edges(t):
    nodes, shown = _curated(t)
    return curate.forced_edges(shown, nodes)


@_query
def curate_edges(t):
    nodes, shown = _curated(t)
    return curate.pruned_edges(shown, nodes, 3)


# health


def _metrics(t):
    own = t.pages.where(F.col("crawl_job_id") == JOB)
    e = t.page_graph_edges.where(F.col("crawl_job_id") == JOB)
    return graph.degrees(e, own).join(graph.pagerank(e, own), ["crawl_job_id", "page_id"])


@_query
def health_orphans(t):
    return health.orphans(t.pages, t.page_graph_edges, JOB, exact_counts=True).select("page_id", "url")


@_query
def health_duplicate_clusters(t):
    found = health.duplicate_clusters(t.page_graph_edges, JOB)
    return found.select("canonical_id", "copies", F.array_join(F.transform("neighbors", lambda v: v.cast("string")), ",").alias("neighbors"))


@_query
def health_hubs(t):
    return health.top_pages(t.pages, graph.degrees(t.page_graph_edges, t.pages), JOB, "out_degree")


@_query
def health_top_pagerank(t):
    return health.top_pages(t.pages, _metrics(t), JOB, "pagerank").select("page_id", "url", F.round("value", 9).alias("value"))


@_query
def health_authorities(t):
    return health.authorities(t.pages, _metrics(t), JOB).select(F.col("rank").cast("long").alias("rank"), "page_id", "url")


@_query
def health_most_linked(t):
    return health.most_linked(t.pages, t.page_graph_edges, JOB)


@_query
def health_clusters_large(t):
    found = health.largest_clusters(t.pages, graph.components(t.page_graph_edges, t.pages), JOB)
    return found.select("cluster_id", "size", "smallest_page", F.array_join("sample_urls", " ").alias("sample_urls"))


@_query
def health_clusters_small(t):
    return health.small_clusters(graph.components(t.page_graph_edges, t.pages), JOB)


# statistics


@_query
def stats_totals(t):
    s = stats.totals(t.pages, t.crawl_errors)
    return s.select("pages", "indexed", "domains", "errors", "skipped", "policy_rejected", "failed_urls", "rate_limited", "attempted", "fetch_failures", F.round("success_rate", 9).alias("success_rate"), F.round("index_coverage", 9).alias("index_coverage"), "last_indexed")


@_query
def stats_open_work(t):
    return stats.open_work(t.pages, t.crawl_errors)


@_query
def stats_index_size(t):
    return stats.index_size(t.index.postings)


@_query
def stats_lengths(t):
    return stats.lengths(t.pages).select(F.round("mean_tokens", 6).alias("mean_tokens"), "median_tokens", F.round("p95_tokens", 6).alias("p95_tokens"))


@_query
def stats_fetch_latency(t):
    return stats.fetch_latency(t.pages).select("fetches", F.round("mean_ms", 6).alias("mean_ms"), F.round("p95_ms", 6).alias("p95_ms"))


@_query
def stats_jobs(t):
    return stats.job_figures(t.crawl_jobs, t.pages).select("jobs", "completed", "failed", "running", "cancelled", F.round("mean_seconds", 3).alias("mean_seconds"), F.round("pages_per_job", 6).alias("pages_per_job"))


@_query
def stats_searches(t):
    return stats.search_figures(t.search_queries).select("searches", "zero_results", "at_cap", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p95_ms", "mean_results", "zero_rate")])


@_query
def stats_top_queries(t):
    return stats.top_queries(t.search_queries)


@_query
def stats_recent_zero(t):
    return stats.recent_without_result(t.search_queries)


@_query
def stats_slowest_query(t):
    return stats.slowest_query(t.search_queries)


@_query
def stats_largest_page(t):
    return stats.largest_page(t.pages)


@_query
def stats_top_domains(t):
    return stats.top_domains(t.pages)


@_query
def stats_failures_by_type(t):
    return stats.failures_by_type(t.crawl_errors)


@_query
def stats_recent_failed(t):
    return stats.recent_failures(t.crawl_errors)


@_query
def stats_failure_domains(t):
    return stats.failing_hosts(t.crawl_errors)


@_query
def stats_http_status(t):
    return stats.status_histogram(t.pages, t.crawl_errors)


@_query
def stats_http_classes(t):
    return stats.status_classes(stats.status_histogram(t.pages, t.crawl_errors))


@_query
def stats_skip_breakdown(t):
    return stats.skip_breakdown(t.crawl_errors).select("label", "errors")


@_query
def stats_fetch_breakdown(t):
    return stats.fetch_breakdown(t.crawl_errors)


# jobs, crawling


@_query
def jobs_list(t):
    return jobs.list_jobs(t.crawl_jobs, status="completed", seed="DOCS", offset=0, limit=50).select("id", "seed_url", "status", "created_at")


@_query
def jobs_count(t):
    return jobs.count_jobs(t.crawl_jobs, status="completed", seed="example")


@_query
def job_details(t):
    return jobs.job_details(t.crawl_jobs, t.page_links).select("id", "status", "pages_discovered", F.round("progress", 9).alias("progress"))


@_query
def pages_page(t):
    return jobs.list_pages(t.pages, JOB, 10, 50).select("id", "url", "depth", "status_code")


@_query
def errors_page(t):
    return jobs.list_errors(t.crawl_errors, JOB, 0, 50).select("id", "url", "error_type", "retry_count")


@_query
def query_log_page(t):
    return t.search_queries.orderBy(F.desc("created_at"), F.desc("id")).offset(5).limit(25).select("id", "query", "result_count")


@_query
def fetch_classify(t):
    kind = fetch.failure_kind(F.col("status_code"), F.col("content_type"), F.lit(1000))
    return t.crawl_errors.select("id", fetch.media_type(F.col("content_type")).alias("media"), kind.alias("kind"))


@_query
def robots_filter(t):
    rules = t.pages.select(urls.host_of(F.col("normalized_url")).alias("host")).where("host like 'docs.%'").distinct().select("host", F.lit("/notes/").alias("prefix"))
    return robots.allowed(t.pages.select("id", F.col("normalized_url").alias("url")), rules).select("id")


@_query
def frontier_round(t):
    seen = t.pages.select("crawl_job_id", F.col("normalized_url").alias("url"))
    return frontier.next_frontier(t.page_links, seen, 3)


@_query
def frontier_of_jobs(t):
    return frontier.job_frontier(t.page_links, t.pages.select("crawl_job_id", F.col("normalized_url").alias("url")), t.crawl_jobs)


@_query
def frontier_eligibility(t):
    seeds = t.crawl_jobs.select(F.col("id").alias("crawl_job_id"), "normalized_seed_url", "same_domain_only")
    marked = keyed_lookup(t.page_links, seeds, ["crawl_job_id"], "inner")
    return marked.select("id", frontier.eligible(F.col("target_normalized_url"), F.col("normalized_seed_url"), F.col("same_domain_only")).alias("eligible")).distinct()


@_query
def seed_lists(t):
    return t.crawl_jobs.select("id", F.array_join(text.seed_list(F.concat_ws(" ;, ", "seed_url", "normalized_seed_url", "seed_url")), "|").alias("seeds"))


@_query
def stale_jobs(t):
    from datetime import datetime

    now = datetime(2025, 1, 1)
    return jobs.recover_jobs(t.crawl_jobs, now).select("id", "status")


# references


@_query
def p5_found(t):
    return orphans.orphan_links(t.page_links, t.pages).select("link_id", "period")


@_query
def p5_report(t):
    return orphans.orphan_report(t.page_links, t.pages)
