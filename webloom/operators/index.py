"""The inverted index: postings, page lengths, document frequencies."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.config import DEFAULTS
from webloom.functions.text import search_terms
from webloom.operators.skew import keyed_lookup
from webloom.session import Scratch


class Index:
    """``postings`` (crawl_job_id, page_id, term, tf, token_count) of live pages; ``lengths`` (crawl_job_id, page_id, token_count, live) of all pages.

    A posting holds its page's length, so that ranking joins no table of pages.
    ``postings`` may be a function that makes them: it is called once, when
    they are first asked for. ``texts`` (crawl_job_id, page_id, token_count,
    terms, live) are the pages with their terms in order, repeats kept.
    """

    def __init__(self, postings: DataFrame | Callable[[], DataFrame], lengths: DataFrame, texts: DataFrame) -> None:
        self._postings, self.lengths, self.texts = postings, lengths, texts

    @cached_property
    def postings(self) -> DataFrame:
        return self._postings() if callable(self._postings) else self._postings

    def frequencies(self) -> DataFrame:
        """(term, document_frequency) over all jobs."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"))

    def stats(self, by_job: bool = False) -> DataFrame:
        """(n_docs, avg_length) of pages with terms; one row, or one a job."""
        some = self.lengths.where("token_count > 0")
        return (some.groupBy("crawl_job_id") if by_job else some).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_length"))


def page_terms(pages: DataFrame, title_weight: int = DEFAULTS.title_weight) -> DataFrame:
    """(crawl_job_id, page_id, content_hash, terms): a title's terms stand ``title_weight`` times."""
    title, body = search_terms(F.col("title")), search_terms(F.col("extracted_text"))
    return pages.select("crawl_job_id", F.col("id").alias("page_id"), "content_hash", title.alias("t"), body.alias("b")).select("crawl_job_id", "page_id", "content_hash", F.concat("b", *["t"] * title_weight).alias("terms"))


def live_pages(terms: DataFrame) -> DataFrame:
    """Rows of ``page_terms`` with ``own_count``, ``live`` and ``token_count``.

    Among the pages of a job with one content hash, the first (by id) that has
    terms is indexed; later ones are skipped with no terms. A null hash never
    matches another.
    """
    counted = terms.withColumn("own_count", F.size("terms"))
    keepers = counted.where("own_count > 0 and content_hash is not null").groupBy("crawl_job_id", "content_hash").agg(F.min("page_id").alias("keeper"))
    # many copies of one text must not meet in one task: hot hashes are looked up by broadcast
    found = keyed_lookup(counted, keepers, ["crawl_job_id", "content_hash"])
    live = F.col("keeper").isNull() | (F.col("page_id") <= F.col("keeper"))
    return found.withColumn("live", live).withColumn("token_count", F.when(live, F.col("own_count")).otherwise(0)).drop("keeper")


def postings_of(live: DataFrame) -> DataFrame:
    """The postings of ``live_pages``. A page's counts are combined before they are shuffled."""
    words = live.where("live").select("crawl_job_id", "page_id", "token_count", F.explode("terms").alias("term"))
    return words.groupBy("crawl_job_id", "page_id", "token_count", "term").agg(F.count(F.lit(1)).alias("tf")).select("crawl_job_id", "page_id", "term", "tf", "token_count")


def build_index(pages: DataFrame, title_weight: int = DEFAULTS.title_weight) -> Index:
    """The index of all pages, written to the shared folder.

    Each text is made into terms once; what is read later are the terms, the
    lengths and the postings as written, the latter clustered by term so that a
    search reads few row groups.
    """
    scratch = Scratch(pages.sparkSession, "index")
    live = scratch.keep(live_pages(scratch.keep(page_terms(pages, title_weight))))
    return Index(lambda: scratch.keep(postings_of(live).sortWithinPartitions("term")), live.select("crawl_job_id", "page_id", "token_count", "live"), live)


def pages_indexed(index: Index) -> DataFrame:
    """(crawl_job_id, pages_indexed): pages indexed as no copies, with or without terms."""
    return index.lengths.groupBy("crawl_job_id").agg(F.count_if("live").alias("pages_indexed"))
