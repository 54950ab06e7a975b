"""The query log and new pages as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.index import live_pages, page_terms, postings_of
from webloom.operators.skew import keyed_lookup
from webloom.schemas import PAGES, SEARCH_QUERIES
from webloom.session import Scratch
from webloom.sources.tables import Tables


def search_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The query log as a file-source stream."""
    return spark.readStream.schema(SEARCH_QUERIES).parquet(folder)


def windowed_searches(log: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, searches, zero_results, mean_ms) per window; rows later than ``late`` are dropped by the watermark."""
    timed = log.where("created_at is not null").withWatermark("created_at", late)
    return timed.groupBy(F.window("created_at", window)).agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("result_count") == 0).alias("zero_results"), F.avg("latency_ms").alias("mean_ms")).select(F.col("window.start").alias("window_start"), "searches", "zero_results", "mean_ms")


def index_batch(tables: Tables, batch: DataFrame) -> None:
    """Adds new pages to the tables ``postings``, ``lengths`` and ``keepers`` as ``build_index`` over all pages would, page by page in order of arrival.

    A page whose content hash was indexed in its job by an earlier batch is no
    more indexed than a copy within the batch. Only the batch's own hashes and
    ids are looked up in the stored tables. A replayed batch adds nothing.
    """
    scratch = Scratch(tables.spark, "batch")
    terms = page_terms(batch.dropDuplicates(["id"]))
    if tables.exists("lengths"):
        terms = terms.join(tables.read("lengths").select("crawl_job_id", "page_id"), ["crawl_job_id", "page_id"], "left_anti")
    live = live_pages(scratch.keep(terms))
    if tables.exists("keepers"):
        known = tables.read("keepers").select("crawl_job_id", "content_hash").distinct().withColumn("__before", F.lit(True))
        live = keyed_lookup(live, known, ["crawl_job_id", "content_hash"])
        again = F.coalesce("__before", F.lit(False))
        live = live.withColumn("live", F.col("live") & ~again).withColumn("token_count", F.when(again, 0).otherwise(F.col("token_count"))).drop("__before")
    live = scratch.keep(live)
    # the lengths come last: they tell which pages are done
    tables.append_absent("postings", postings_of(live), ["crawl_job_id", "page_id", "term"])
    tables.append_absent("keepers", live.where("live and own_count > 0 and content_hash is not null").select("crawl_job_id", "content_hash", "page_id"), ["crawl_job_id", "content_hash"])
    tables.append_absent("lengths", live.select("crawl_job_id", "page_id", "token_count", "live"), ["crawl_job_id", "page_id"])
    scratch.drop(live)


def index_stream(spark: SparkSession, folder: str, tables: Tables, checkpoint: str):
    """A stream that indexes new pages, batch by batch; see ``index_batch``."""
    pages = spark.readStream.schema(PAGES).parquet(folder)
    return pages.writeStream.foreachBatch(lambda batch, _: index_batch(tables, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
