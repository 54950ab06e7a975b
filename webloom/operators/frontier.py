"""Breadth-first crawling as rounds of DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.html import parse_html
from webloom.functions.urls import canonical_url, host_of, normalize_url
from webloom.operators.skew import keyed_lookup
from webloom.session import Scratch
from webloom.sources.fetch import failure_kind
from webloom.sources.robots import allowed


def eligible(target: Column, seed: Column, same_domain_only: Column) -> Column:
    """Whether a link may be crawled: it has a host, which is the seed's own if only one domain is crawled."""
    host = host_of(target)
    return F.coalesce(host.isNotNull() & (~same_domain_only | (host == host_of(seed))), F.lit(False))


def next_frontier(links: DataFrame, seen: DataFrame, max_depth: int) -> DataFrame:
    """(crawl_job_id, url, depth): eligible links within the depth that are not seen yet, each at its least depth."""
    asked = links.where(F.col("is_crawl_eligible") & (F.col("depth") <= max_depth) & F.col("target_normalized_url").isNotNull())
    least = asked.groupBy("crawl_job_id", F.col("target_normalized_url").alias("url")).agg(F.min("depth").alias("depth"))
    return least.join(seen.select("crawl_job_id", "url").distinct(), ["crawl_job_id", "url"], "left_anti")


def job_frontier(links: DataFrame, seen: DataFrame, jobs: DataFrame) -> DataFrame:
    """``next_frontier`` within each job's own limits: its ``max_depth``, and nothing once ``pages_crawled`` has reached ``max_pages``.

    Null limits admit nothing. Links of a large job look its limits up by broadcast.
    """
    limits = jobs.where("pages_crawled < max_pages and max_depth is not null").select(F.col("id").alias("crawl_job_id"), "max_depth")
    asked = links.where("is_crawl_eligible and target_normalized_url is not null").select("crawl_job_id", F.col("target_normalized_url").alias("url"), "depth")
    # once a job and address before any limit is looked up
    least = asked.groupBy("crawl_job_id", "url").agg(F.min("depth").alias("depth"))
    within = keyed_lookup(least, limits, ["crawl_job_id"], "inner").where("depth <= max_depth").drop("max_depth")
    return within.join(seen.select("crawl_job_id", "url").distinct(), ["crawl_job_id", "url"], "left_anti")


@dataclass(frozen=True)
class CrawlResult:
    pages: DataFrame
    links: DataFrame
    errors: DataFrame
    status: str
    rounds: int


PAGE = "url string, normalized_url string, depth int, title string, extracted_text string, content_hash string, raw_html_hash string, status_code int"


def crawl(spark, seed: str, fetch: Callable[[DataFrame], DataFrame], max_pages: int = 100, max_depth: int = 2, same_domain_only: bool = True, rules: DataFrame | None = None) -> CrawlResult:
    """Crawls from a seed, level by level, until the budget of saved pages is used.

    ``fetch`` takes (url) and gives (url, status, content_type, body). A level
    is taken in batches of the budget left, in order; only saved pages use it,
    so failures and duplicates make room. Robots rules apply whenever given.
    """
    scratch = Scratch(spark, "crawl")
    start = canonical_url(seed)
    level = spark.createDataFrame([(start, 0, 0)], "url string, depth int, ord bigint")
    seen = level.select("url")
    pages = links = errors = None
    saved = rounds = 0
    while saved < max_pages and not level.isEmpty():
        batch = level.orderBy("depth", "ord").limit(max_pages - saved)
        batch = scratch.keep(batch)
        level = scratch.keep(level.join(batch.select("url"), "url", "left_anti"))
        may = allowed(batch, rules) if rules is not None else batch
        refused = batch.join(may.select("url"), "url", "left_anti").select("url", F.lit("robots_disallow").alias("error_type"), F.lit(None).cast("int").alias("status_code"))
        got = scratch.keep(may.join(fetch(may.select("url")), "url", "left"))
        kind = failure_kind(F.col("status"), F.col("content_type"), F.octet_length("body"))
        judged = got.withColumn("kind", kind)
        failed = judged.where("kind is not null").select("url", F.col("kind").alias("error_type"), F.col("status").alias("status_code"))
        parsed = judged.where("kind is null").withColumn("p", parse_html(F.col("body"), F.col("url")))
        page = parsed.select("url", normalize_url(F.col("url")).alias("normalized_url"), "depth", F.nullif("p.title", F.lit("")).alias("title"), F.col("p.text").alias("extracted_text"), F.sha2("p.text", 256).alias("content_hash"), F.sha2("body", 256).alias("raw_html_hash"), F.col("status").alias("status_code"), "ord", "p.links")
        first = F.row_number().over(Window.partitionBy("normalized_url").orderBy("ord"))
        page = page.withColumn("first", first).where("first = 1").drop("first")
        if pages is not None:
            page = page.join(pages.select("normalized_url"), "normalized_url", "left_anti")
        page = scratch.keep(page)
        found = page.select(F.col("url").alias("source_url"), "ord", (F.col("depth") + 1).alias("depth"), F.posexplode("links").alias("place", "target_normalized_url"))
        found = scratch.keep(found.withColumn("is_crawl_eligible", eligible(F.col("target_normalized_url"), F.lit(start), F.lit(same_domain_only))))
        fresh = found.where(F.col("is_crawl_eligible") & (F.col("depth") <= max_depth)).groupBy(F.col("target_normalized_url").alias("url")).agg(F.min("depth").alias("depth"), F.min(F.struct("ord", "place")).alias("o"))
        fresh = fresh.join(seen, "url", "left_anti").select("url", "depth", (F.col("o.ord") * 1_000_000 + F.col("o.place")).alias("ord"))
        level = scratch.keep(level.unionByName(fresh))
        seen = scratch.keep(seen.unionByName(fresh.select("url")))
        kept = page.drop("ord", "links")
        pages = kept if pages is None else pages.unionByName(kept)
        out = found.select("source_url", "target_normalized_url", "depth", "is_crawl_eligible")
        links = out if links is None else links.unionByName(out)
        bad = scratch.keep(refused.unionByName(failed))
        errors = bad if errors is None else errors.unionByName(bad)
        saved = pages.count()
        rounds += 1
    return CrawlResult(pages, links, errors, "completed" if saved else "failed", rounds)
