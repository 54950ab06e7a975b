"""Search results reranked by the page graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.config import DEFAULTS, Settings
from webloom.functions.reasons import score_reason
from webloom.operators.index import Index
from webloom.operators.search import ranked_pages


def _scaled(column: str, low: str, high: str) -> Column:
    """The column brought to 0..1; a constant column becomes 0."""
    span = F.col(high) - F.col(low)
    return F.when(span > 0, (F.col(column) - F.col(low)) / span).otherwise(0.0)


def reranked(index: Index, pages: DataFrame, edges: DataFrame, ranks: DataFrame, query: str, crawl_job_id: int, limit: int = 20, settings: Settings = DEFAULTS) -> DataFrame:
    """Candidates by a mix of text score, page rank, support by neighbours and duplicate penalty.

    Candidates are the best text matches and all pages one edge of any type
    away, cut to ``rerank_candidates`` (seeds first). They are at most 2,000,
    so every join after the edge scans is a broadcast. ``ranks`` has page_id
    and pagerank of pages with metrics.
    """
    cap = settings.rerank_candidates
    pool = ranked_pages(index, query, crawl_job_id, min(settings.rerank_pool, max(3 * cap, 20 * settings.rerank_seeds)))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "page_id"))
    pool = pool.withColumn("place", place).cache()
    best = pool.where(F.col("place") <= cap)
    own = edges.where((F.col("crawl_job_id") == crawl_job_id) & (F.col("source_page_id") != F.col("target_page_id"))).select("source_page_id", "target_page_id", "edge_type", "weight")
    ends = own.select(F.col("source_page_id").alias("a"), F.col("target_page_id").alias("b"), "weight").unionByName(own.select(F.col("target_page_id").alias("a"), F.col("source_page_id").alias("b"), "weight"))
    near = ends.join(F.broadcast(best.select(F.col("page_id").alias("a"))), "a", "left_semi").select(F.col("b").alias("page_id")).distinct()
    there = pages.where(F.col("crawl_job_id") == crawl_job_id).select(F.col("id").alias("page_id"), "content_hash")
    wide = best.select("page_id").unionByName(near.join(there, "page_id", "left_semi")).distinct().join(F.broadcast(pool.select("page_id", "score", "place")), "page_id", "left")
    order = Window.orderBy(F.desc(F.coalesce(F.col("place") <= settings.rerank_seeds, F.lit(False))), F.desc(F.col("score").isNotNull()), F.desc_nulls_last("score"), F.desc("page_id"))
    kept = wide.withColumn("keep", F.row_number().over(order)).where(F.col("keep") <= cap).select("page_id", F.coalesce("score", F.lit(0.0)).alias("bm25"), F.coalesce(F.col("place") <= settings.rerank_seeds, F.lit(False)).alias("seed")).cache()

    inside = F.broadcast(kept.select(F.col("page_id").alias("b")))
    heaviest = ends.groupBy("a", "b").agg(F.max("weight").alias("w"))
    seeds = F.broadcast(kept.where("seed").select(F.col("page_id").alias("a"), F.log1p(F.greatest("bm25", F.lit(1e-9))).alias("boost")))
    support = heaviest.join(seeds, "a").join(inside, "b", "left_semi").groupBy(F.col("b").alias("page_id")).agg(F.sum(F.col("w") * F.col("boost")).alias("support"))

    score = lambda end: F.broadcast(kept.select(F.col("page_id").alias(end), F.col("bm25").alias(f"{end}_bm25")))
    copies = own.where("edge_type = 'near_duplicate'").join(score("source_page_id"), "source_page_id").join(score("target_page_id"), "target_page_id")
    s, t = F.col("source_page_id_bm25"), F.col("target_page_id_bm25")
    loser = F.when(s < t, F.col("source_page_id")).when(t < s, F.col("target_page_id")).otherwise(F.greatest("source_page_id", "target_page_id"))
    by_edge = copies.select(loser.alias("page_id"), F.when(s == t, F.col("weight") / 2).otherwise(F.col("weight")).alias("penalty"))
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy(F.desc("bm25"), "page_id"))
    hashed = there.where("content_hash is not null").join(F.broadcast(kept.select("page_id", "bm25")), "page_id").withColumn("first", first)
    by_hash = hashed.where("first > 1").select("page_id", F.lit(1.0).alias("penalty"))
    penalty = by_edge.unionByName(by_hash).groupBy("page_id").agg(F.sum("penalty").alias("penalty"))

    facts = kept.join(F.broadcast(support), "page_id", "left").join(F.broadcast(penalty), "page_id", "left").join(ranks.select("page_id", "pagerank"), "page_id", "left")
    facts = facts.select("page_id", "bm25", "pagerank", F.coalesce("support", F.lit(0.0)).alias("support"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"))
    names = ("bm25", "pagerank", "support", "penalty")
    spans = facts.agg(*[f(c).alias(f"{c}_{k}") for c in names for k, f in (("low", F.min), ("high", F.max))])
    scaled = facts.crossJoin(F.broadcast(spans)).select("page_id", *names, *[F.coalesce(_scaled(c, f"{c}_low", f"{c}_high"), F.lit(0.0)).alias(f"{c}_norm") for c in names])
    final = settings.weight_bm25 * F.col("bm25_norm") + settings.weight_pagerank * F.col("pagerank_norm") + settings.weight_neighbors * F.col("support_norm") - settings.weight_duplicates * F.col("penalty_norm")
    top = scaled.withColumn("final_score", final).orderBy(F.desc("final_score"), "page_id").limit(limit)
    reason = score_reason(F.col("final_score"), F.col("bm25_norm"), F.col("pagerank_norm"), F.col("support_norm"), F.col("penalty_norm"), F.col("bm25"))
    return top.select("page_id", *[F.round(c, 6).alias(c) for c in ("final_score", "bm25", "bm25_norm", "pagerank_norm", "support_norm", "penalty", "penalty_norm")], reason.alias("explanation"))
