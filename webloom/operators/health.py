"""Health of a job's page graph. Each panel is one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How many rows the panels show.
SHOWN = {"pages": 15, "clusters": 12, "small_clusters": 15, "duplicates": 20, "duplicate_neighbors": 12, "sample_urls": 4, "orphans": 45}


def _own(pages: DataFrame, job: int) -> DataFrame:
    return pages.where(F.col("crawl_job_id") == job).select(F.col("id").alias("page_id"), "url", "title")


def orphans(pages: DataFrame, edges: DataFrame, job: int, metrics: DataFrame | None = None, exact_counts: bool = False) -> DataFrame:
    """Pages no edge touches: by degrees if every page has metrics, else by edges of any type. At most 45 unless ``exact_counts``."""
    if metrics is not None:
        lone = metrics.where((F.col("crawl_job_id") == job) & (F.col("in_degree") == 0) & (F.col("out_degree") == 0)).select("page_id")
        found = _own(pages, job).join(lone, "page_id", "left_semi")
    else:
        e = edges.where(F.col("crawl_job_id") == job)
        ends = e.select(F.col("source_page_id").alias("page_id")).unionByName(e.select(F.col("target_page_id").alias("page_id"))).distinct()
        found = _own(pages, job).join(ends, "page_id", "left_anti")
    return found if exact_counts else found.orderBy("page_id").limit(SHOWN["orphans"])


def duplicate_clusters(edges: DataFrame, job: int, exact_counts: bool = False) -> DataFrame:
    """(canonical_id, copies, neighbors): near-duplicate edges by source, most first; the 12 lightest are named."""
    e = edges.where((F.col("crawl_job_id") == job) & (F.col("edge_type") == "near_duplicate"))
    place = F.row_number().over(Window.partitionBy("source_page_id").orderBy("weight", "target_page_id", "id"))
    counted = e.groupBy("source_page_id").agg(F.count(F.lit(1)).alias("copies"))
    top = counted if exact_counts else counted.orderBy(F.desc("copies"), "source_page_id").limit(SHOWN["duplicates"])
    named = e.join(F.broadcast(top.select("source_page_id")) if not exact_counts else top.select("source_page_id"), "source_page_id", "left_semi").withColumn("place", place).where(F.col("place") <= SHOWN["duplicate_neighbors"])
    lists = named.groupBy("source_page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target_page_id"))), lambda s: s["target_page_id"]).alias("neighbors"))
    return top.join(lists, "source_page_id").select(F.col("source_page_id").alias("canonical_id"), "copies", "neighbors")


def top_pages(pages: DataFrame, metrics: DataFrame, job: int, by: str, limit: int = SHOWN["pages"]) -> DataFrame:
    """(page_id, url, value): the pages with most of a metric, nulls last, ties by id; texts are joined after the limit."""
    best = metrics.where(F.col("crawl_job_id") == job).orderBy(F.desc_nulls_last(by), "page_id").limit(limit).select("page_id", F.col(by).alias("value"))
    return _own(pages, job).join(F.broadcast(best), "page_id").select("page_id", "url", "value")


def authorities(pages: DataFrame, metrics: DataFrame, job: int, limit: int = SHOWN["pages"]) -> DataFrame:
    """The best pages by in-degree, then by rank, each once, in that order."""
    own = metrics.where(F.col("crawl_job_id") == job)
    lists = []
    for k, by in enumerate(("in_degree", "pagerank")):
        place = F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "page_id"))
        lists.append(own.orderBy(F.desc_nulls_last(by), "page_id").limit(limit).select("page_id", F.lit(k).alias("list"), place.alias("place")))
    once = lists[0].unionByName(lists[1]).groupBy("page_id").agg(F.min(F.struct("list", "place")).alias("o")).orderBy("o").limit(limit)
    rank = F.row_number().over(Window.orderBy("o"))
    return once.withColumn("rank", rank).join(_own(pages, job), "page_id").select("rank", "page_id", "url")


def most_linked(pages: DataFrame, edges: DataFrame, job: int, limit: int = SHOWN["pages"]) -> DataFrame:
    counted = edges.where((F.col("crawl_job_id") == job) & (F.col("edge_type") == "link")).groupBy(F.col("target_page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("links"))
    known = counted.join(_own(pages, job).select("page_id"), "page_id", "left_semi").orderBy(F.desc("links"), "page_id").limit(limit)
    return _own(pages, job).join(F.broadcast(known), "page_id").select("page_id", "url", "links")


def largest_clusters(pages: DataFrame, clusters: DataFrame, job: int, limit: int = SHOWN["clusters"]) -> DataFrame:
    """(cluster_id, size, smallest_page, sample_urls): the largest clusters with four addresses each."""
    own = clusters.where(F.col("crawl_job_id") == job)
    top = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.min("page_id").alias("smallest_page")).orderBy(F.desc("size"), "cluster_id").limit(limit)
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("page_id"))
    few = own.join(F.broadcast(top.select("cluster_id")), "cluster_id", "left_semi").withColumn("place", place).where(F.col("place") <= SHOWN["sample_urls"]).join(_own(pages, job), "page_id")
    urls = few.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda s: s["url"]).alias("sample_urls"))
    return top.join(urls, "cluster_id")


def small_clusters(clusters: DataFrame, job: int, most: int = 3, limit: int = SHOWN["small_clusters"]) -> DataFrame:
    return clusters.where(F.col("crawl_job_id") == job).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") <= most).orderBy("size", "cluster_id").limit(limit)


def messages(pages: DataFrame, edges: DataFrame, job: int | None) -> list[str]:
    """What a reader should know first; ``None`` asks for no job. The sentences are fixed values."""
    if job is None:
        return ["Pass job_id to load graph health for a crawl job."]
    out = []
    if pages.where(F.col("crawl_job_id") == job).isEmpty():
        out.append("No pages in this crawl job yet.")
    elif edges.where(F.col("crawl_job_id") == job).isEmpty():
        out.append("Graph edges have not been generated for this job (run graph edge jobs / backfill).")
    return out
