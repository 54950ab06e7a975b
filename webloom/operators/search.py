"""Ranked search over the index."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.config import DEFAULTS, EDGE_PRIORITY
from webloom.functions.text import snippet, terms_of
from webloom.operators.index import Index

RANKED = "page_id bigint, crawl_job_id bigint, score double, matched_terms array<string>"


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.when(n_docs > 0, F.log(1 + (n_docs - df + 0.5) / (df + 0.5))).otherwise(0.0)


def bm25_term(idf: Column, tf: Column, length: Column, avg_length: Column, k1: float = DEFAULTS.k1, b: float = DEFAULTS.b) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_length))


def ranked_pages(index: Index, query: str, crawl_job_id: int | None = None, limit: int | None = None) -> DataFrame:
    """``RANKED`` rows, best first, ties by id: pages with any of the query's terms.

    A term given twice counts twice. With a job, counts and lengths are that
    job's own; without, those of all jobs. A query without terms finds nothing.
    The query's terms are few and become a literal table.
    """
    spark = index.postings.sparkSession
    terms = Counter(terms_of(query))
    if not terms:
        return spark.createDataFrame([], RANKED)
    postings, lengths = index.postings, index.lengths.where("token_count > 0")
    if crawl_job_id is not None:
        postings, lengths = postings.where(F.col("crawl_job_id") == crawl_job_id), lengths.where(F.col("crawl_job_id") == crawl_job_id)
    asked = spark.createDataFrame(sorted(terms.items()), "term string, times int")
    hits = postings.where(F.col("term").isin(sorted(terms)))
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_length"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row for the corpus and one a query term: both are broadcast whatever the corpus' size
    weights = F.broadcast(df.join(F.broadcast(asked), "term").crossJoin(F.broadcast(stats)).withColumn("idf", bm25_idf(F.col("n_docs"), F.col("df"))).where("idf > 0"))
    scored = hits.join(weights, "term")
    part = F.col("times") * bm25_term(F.col("idf"), F.col("tf"), F.col("token_count"), F.col("avg_length"))
    ranked = scored.groupBy("page_id", "crawl_job_id").agg(F.sum(part).alias("score"), F.array_sort(F.collect_set("term")).alias("matched_terms")).orderBy(F.desc("score"), "page_id")
    return ranked.limit(limit) if limit is not None else ranked


def search_results(index: Index, pages: DataFrame, query: str, crawl_job_id: int | None = None, limit: int = 20) -> DataFrame:
    """Result rows (rank, page_id, url, title, score, snippet, matched_terms).

    Texts are fetched for the ranked pages only. A search over all jobs ranks
    five times as many, keeps the best of each URL and cuts then.
    """
    ranked = ranked_pages(index, query, crawl_job_id, limit if crawl_job_id is not None else 5 * limit)
    hydrated = pages.select(F.col("id").alias("page_id"), "url", "title", "extracted_text").join(F.broadcast(ranked), "page_id")
    if crawl_job_id is None:
        best = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "page_id"))
        hydrated = hydrated.withColumn("best", best).where("best = 1")
    top = hydrated.orderBy(F.desc("score"), "page_id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "page_id"))
    return top.select(rank.alias("rank"), "page_id", "url", "title", F.round("score", 4).alias("score"), snippet("title", "extracted_text", "matched_terms").alias("snippet"), "matched_terms")


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end; loops left out."""
    one = edges.where("source_page_id <> target_page_id")
    return one.withColumns({"page_id": F.col("source_page_id"), "other_id": F.col("target_page_id")}).unionByName(one.withColumns({"page_id": F.col("target_page_id"), "other_id": F.col("source_page_id")}))


def related_pages(hits: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """(page_id, other_id, edge_type, weight, edge_id, also_related_by, place) for each hit.

    Of the edges between a hit and a neighbour the most important type wins,
    then the heavier, then the older; its place among the hit's neighbours is by
    weight, then id. ``hits`` are a result page: they are broadcast.
    """
    near = _both_ways(edges.select(F.col("id").alias("edge_id"), "source_page_id", "target_page_id", "edge_type", "weight")).join(F.broadcast(hits.select("page_id").distinct()), "page_id", "left_semi")
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in EDGE_PRIORITY.items() for x in kv])[F.col("edge_type")], F.lit(99))
    pick = F.struct(priority.alias("p"), (-F.col("weight")).alias("w"), "edge_id", "edge_type")
    pairs = near.groupBy("page_id", "other_id").agg(F.min(pick).alias("first"), F.collect_set("edge_type").alias("types"))
    pairs = pairs.select("page_id", "other_id", F.col("first.edge_type").alias("edge_type"), (-F.col("first.w")).alias("weight"), F.col("first.edge_id").alias("edge_id"), F.array_sort(F.array_except("types", F.array("first.edge_type"))).alias("also_related_by"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("weight"), "other_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= max(0, limit))


def duplicate_variants(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, canonical_id): hits that near-duplicate an earlier hit, with the earliest such. ``hits`` has page_id and rank."""
    near = _both_ways(edges.where("edge_type = 'near_duplicate'").select("source_page_id", "target_page_id"))
    mine, other = F.broadcast(hits.select("page_id", "rank")), F.broadcast(hits.select(F.col("page_id").alias("other_id"), F.col("rank").alias("other_rank")))
    pairs = near.join(mine, "page_id").join(other, "other_id").where("other_rank < rank")
    return pairs.groupBy("page_id").agg(F.min_by("other_id", "other_rank").alias("canonical_id"))


def collapse_duplicates(hits: DataFrame, variants: DataFrame) -> DataFrame:
    """(rank, page_id, variants): hits that are no variants, with the variants under them; a variant of a variant disappears."""
    marked = hits.select("page_id", "rank").join(variants, "page_id", "left")
    below = marked.where("canonical_id is not null").groupBy(F.col("canonical_id").alias("page_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda s: s["page_id"]).alias("variants"))
    return marked.where("canonical_id is null").select("rank", "page_id").join(below, "page_id", "left").select("rank", "page_id", F.coalesce("variants", F.array().cast("array<bigint>")).alias("variants"))
