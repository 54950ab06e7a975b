"""The engine over one folder of tables: what a caller asks of it, checked and put together.

Arguments out of range raise ``ValueError``, jobs and pages that are not there
``LookupError``. Every method is a few DataFrame plans over the stored tables
and the stored index.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.config import DEFAULTS, Settings
from webloom.operators import edges, graph, health, rerank, search, stats
from webloom.operators.index import Index, build_index
from webloom.session import Scratch
from webloom.sources.tables import Tables, log_search


@dataclass(frozen=True)
class SearchAnswer:
    """``results`` in order; ``related``, ``variants`` and ``collapsed`` if they were asked for."""

    results: DataFrame
    related: DataFrame | None = None
    variants: DataFrame | None = None
    collapsed: DataFrame | None = None


def _within(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low}..{high}")


class Engine:
    """Search, graph, health, statistics and rebuilds over the tables of ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> None:
        self.spark, self.tables, self.settings = spark, Tables(spark, folder), settings

    def _table(self, name: str) -> DataFrame:
        return self.tables.read(name)

    def _edges(self, job: int) -> DataFrame:
        return self._table("page_graph_edges").where(F.col("crawl_job_id") == job)

    def _pages(self, job: int) -> DataFrame:
        return self._table("pages").where(F.col("crawl_job_id") == job)

    @cached_property
    def index(self) -> Index:
        """The index of all pages, built when first asked for; ``refresh`` forgets it."""
        return build_index(self._table("pages"), self.settings.title_weight)

    def refresh(self) -> None:
        self.__dict__.pop("index", None)

    def _job(self, job: int) -> None:
        if self._table("crawl_jobs").where(F.col("id") == job).isEmpty():
            raise LookupError("crawl job not found")

    @staticmethod
    def _asked(query: str) -> str:
        if not (query := query.strip()):
            raise ValueError("the query must contain more than white space")
        return query

    def search(self, query: str, job: int | None = None, limit: int = 20, related: int = 0, by_graph: bool = False, mark_duplicates: bool = False, log: bool = True) -> SearchAnswer:
        """Ranked results; within a job also by graph, with neighbours and marked near-duplicates. The search is logged."""
        query = self._asked(query)
        _within("limit", limit, 1, 100)
        _within("related", related, 0, 10)
        if job is None and (related or by_graph or mark_duplicates):
            raise ValueError("neighbours, ranking by graph and duplicates need a job")
        if job is not None:
            self._job(job)
        began = time.time()
        if by_graph:
            ranks = graph.pagerank(self._edges(job), self._pages(job))
            found = rerank.reranked(self.index, self._table("pages"), self._table("page_graph_edges"), ranks, query, job, limit, self.settings)
            found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "page_id")))
        else:
            found = search.search_results(self.index, self._table("pages"), query, job, limit)
        # a result page is small, and everything below reads it
        found = Scratch(self.spark, "results").keep(found)
        if log:
            log_search(self.tables, query, found.count(), round(1000 * (time.time() - began)), datetime.now())
        variants = search.duplicate_variants(found, self._edges(job)) if mark_duplicates else None
        return SearchAnswer(
            found,
            search.related_pages(found, self._edges(job), related) if related else None,
            variants,
            search.collapse_duplicates(found, variants) if mark_duplicates else None,
        )

    def subgraph(self, job: int, page: int, radius: int = 1, max_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) around a page: reached pages with depth and metrics, and the edges among them."""
        return self.subgraph_of(job, [page], radius, max_nodes)

    def subgraph_of(self, job: int, seeds: list[int], radius: int = 1, max_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
        """``subgraph`` from several pages of a job, in order."""
        _within("radius", radius, 0, 50)
        _within("max_nodes", max_nodes, 1, 500)
        self._job(job)
        known = {r[0] for r in self._pages(job).where(F.col("id").isin(seeds[:max_nodes])).select("id").collect()}
        if missing := [s for s in seeds[:max_nodes] if s not in known]:
            raise LookupError(f"page {missing[0]} is not in the crawl job")
        depths = graph.explored(self._table("page_graph_edges"), self._table("pages"), seeds, job, radius, max_nodes)
        nodes = graph.subgraph_nodes(self._pages(job), self.metrics(job), depths)
        return nodes, graph.induced_edges(self._table("page_graph_edges"), [p for p, _ in depths], job)

    def graph_query(self, query: str, job: int | None = None, radius: int = 1, max_nodes: int = 100, max_seed_pages: int = 10) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) around a query's best matches, with their roles; no matches give none."""
        query = self._asked(query)
        _within("radius", radius, 0, 50)
        _within("max_nodes", max_nodes, 1, 500)
        _within("max_seed_pages", max_seed_pages, 1, 50)
        if job is not None:
            self._job(job)
        nodes = graph.graph_query(self.index, self._table("pages"), self._table("page_graph_edges"), self._table("crawl_jobs"), query, job, radius, max_nodes, max_seed_pages)
        row = nodes.select("crawl_job_id").first()
        ids = [r[0] for r in nodes.select("page_id").collect()]
        return nodes, graph.induced_edges(self._table("page_graph_edges"), ids, row[0] if row else -1)

    def neighbors(self, job: int, page: int, limit: int = 10) -> DataFrame:
        """A page's neighbours, the heaviest first, with the edge that joins them."""
        _within("limit", limit, 1, 500)
        self._job(job)
        return search.related_pages(self._pages(job).where(F.col("id") == page).select(F.col("id").alias("page_id")), self._edges(job), limit)

    def metrics(self, job: int) -> DataFrame:
        """Degrees, rank, betweenness and cluster of a job's pages."""
        return graph.graph_metrics(self._edges(job), self._pages(job))

    def clusters(self, job: int, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        _within("limit", limit, 1, 500)
        self._job(job)
        return graph.clusters_page(graph.components(self._edges(job), self._pages(job)), job, offset, limit)

    def health(self, job: int | None = None) -> dict[str, object]:
        """The panels by name, and the messages a reader should see first."""
        if job is None:
            return {"messages": health.messages(self._table("pages"), self._table("page_graph_edges"), None)}
        self._job(job)
        pages, own, metrics = self._table("pages"), self._table("page_graph_edges"), self.metrics(job)
        clusters = metrics.select("crawl_job_id", "page_id", "cluster_id")
        return {
            "messages": health.messages(pages, own, job),
            "orphans": health.orphans(pages, own, job, metrics),
            "duplicate_clusters": health.duplicate_clusters(own, job),
            "hubs": health.top_pages(pages, metrics, job, "out_degree"),
            "top_rank": health.top_pages(pages, metrics, job, "pagerank"),
            "authorities": health.authorities(pages, metrics, job),
            "most_linked": health.most_linked(pages, own, job),
            "largest_clusters": health.largest_clusters(pages, clusters, job),
            "small_clusters": health.small_clusters(clusters, job),
        }

    def stats(self) -> dict[str, DataFrame]:
        """The dashboard's figures by name."""
        pages, errors, jobs, queries = (self._table(n) for n in ("pages", "crawl_errors", "crawl_jobs", "search_queries"))
        return {
            "totals": stats.totals(pages, errors),
            "index_size": stats.index_size(self.index.postings),
            "lengths": stats.lengths(pages),
            "fetch_latency": stats.fetch_latency(pages),
            "jobs": stats.job_figures(jobs, pages),
            "searches": stats.search_figures(queries),
            "top_queries": stats.top_queries(queries),
            "top_domains": stats.top_domains(pages),
            "failing_hosts": stats.failing_hosts(errors),
            "http_classes": stats.status_classes(stats.status_histogram(pages, errors)),
            "skips": stats.skip_breakdown(errors),
            "fetches": stats.fetch_breakdown(errors),
        }

    def built_edges(self) -> DataFrame:
        """The edges of all jobs and kinds, built in one plan a kind, each once."""
        pages, links = self._table("pages"), self._table("page_links")
        kinds = [
            edges.link_edges(links, pages),
            edges.hierarchy_edges(pages, self.settings.hierarchy_weight),
            edges.similarity_edges(self.index, self.settings.similarity_top_k, self.settings.similarity_min_score),
            edges.hash_duplicate_edges(pages, links),
            edges.similarity_duplicate_edges(self.index, pages, links, self.settings.near_duplicate_min),
        ]
        every = kinds[0]
        for kind in kinds[1:]:
            every = every.unionByName(kind)
        return every.dropDuplicates(["crawl_job_id", "source_page_id", "target_page_id", "edge_type"])

    def backfill(self, edges_table: str = "page_edges_built", metrics_table: str = "page_graph_metrics") -> dict[str, int]:
        """Builds the edges of all jobs, then every page's metrics, and replaces those jobs' rows; gives both numbers of rows."""
        scratch = Scratch(self.spark, "backfill")
        built = scratch.keep(self.built_edges())
        self.tables.replace_jobs(edges_table, built)
        metrics = scratch.keep(graph.graph_metrics(built, self._table("pages")))
        self.tables.replace_jobs(metrics_table, metrics)
        return {"edges": built.count(), "metrics": metrics.count()}
