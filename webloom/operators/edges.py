"""Builders of page-graph edges. All jobs are built in one plan, keyed by job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.config import DEFAULTS
from webloom.functions.urls import parent_url
from webloom.operators.index import Index
from webloom.operators.similar import best_pairs
from webloom.operators.skew import keyed_lookup
from webloom.schemas import EVIDENCE

_KEY = ["crawl_job_id", "source_page_id", "target_page_id", "edge_type"]


# The names of sources and kinds below are fixed values of the stored evidence.


def _evidence(**fields: Column | str) -> Column:
    names = {"source": "string", "child_path": "string", "parent_path": "string", "kind": "string", "content_hash": "string", "similarity": "double", "shared_terms": "array<string>"}
    return F.struct(*[(fields[n] if isinstance(fields.get(n), Column) else F.lit(fields.get(n))).cast(t).alias(n) for n, t in names.items()]).cast(EVIDENCE)


def _page_of_url(pages: DataFrame) -> DataFrame:
    """One page a job and URL: the first by id where a URL was fetched again."""
    return pages.where("normalized_url is not null").groupBy("crawl_job_id", F.col("normalized_url").alias("url")).agg(F.min("id").alias("target_page_id"))


def link_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """An edge from each page to the page of its job that a link's URL names; no loops, once a pair.

    Eligibility and ``target_page_id`` have no say. Popular targets are looked
    up by broadcast, so their links are not gathered in one task.
    """
    asked = links.select("crawl_job_id", "source_page_id", F.col("target_normalized_url").alias("url"))
    found = keyed_lookup(asked, _page_of_url(pages), ["crawl_job_id", "url"], "inner").where("source_page_id <> target_page_id")
    return found.select("crawl_job_id", "source_page_id", "target_page_id").distinct().select("*", F.lit("link").alias("edge_type"), F.lit(1.0).alias("weight"), _evidence(source="direct_internal_link").alias("evidence"))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.when(trimmed == "", F.lit("/")).otherwise(trimmed)


def hierarchy_edges(pages: DataFrame, weight: float = DEFAULTS.hierarchy_weight) -> DataFrame:
    """An edge from the page one path segment up to each page, if the job has it."""
    children = pages.select("crawl_job_id", F.col("id").alias("child"), "normalized_url", parent_url(F.col("normalized_url")).alias("url")).where("url is not null")
    found = keyed_lookup(children, _page_of_url(pages), ["crawl_job_id", "url"], "inner").where("child <> target_page_id")
    evidence = _evidence(child_path=url_path(F.col("normalized_url")), parent_path=url_path(F.col("url")))
    return found.select("crawl_job_id", F.col("target_page_id").alias("source_page_id"), F.col("child").alias("target_page_id"), F.lit("url_hierarchy").alias("edge_type"), F.lit(weight).alias("weight"), evidence.alias("evidence"))


def tfidf(index: Index) -> DataFrame:
    """(crawl_job_id, page_id, term, w, norm, place, before, left): weights of jobs with two pages of terms at least.

    ``place`` orders a page's terms by weight; ties go to the term that came
    first: by the first page with it, then by spelling. ``before`` is the sum of
    the squared weights of the terms before it in that order, ``left`` that of
    the term and of all the page's terms that more pages of the job have.
    """
    postings = index.postings
    docs = postings.select("crawl_job_id", "page_id").distinct().groupBy("crawl_job_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    df = postings.groupBy("crawl_job_id", "term").agg(F.count(F.lit(1)).alias("df"), F.min("page_id").alias("first_page"))
    weighed = postings.join(docs, "crawl_job_id").join(df.hint("merge"), ["crawl_job_id", "term"])
    weighed = weighed.withColumn("w", F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1)))
    page = Window.partitionBy("crawl_job_id", "page_id")
    square = F.col("w") * F.col("w")
    order = page.orderBy(F.desc("w"), "first_page", "term")
    before = F.coalesce(F.sum(square).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    common = page.orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    return weighed.select("crawl_job_id", "page_id", "term", "w", F.sqrt(F.sum(square).over(page)).alias("norm"), F.row_number().over(order).alias("place"), before.alias("before"), F.sum(square).over(common).alias("left"))


def similar_pairs(vectors: DataFrame, min_score: float, important: int = DEFAULTS.important_terms, ordered: bool = False) -> DataFrame:
    """(crawl_job_id, source_page_id, target_page_id, score): pairs of at least that cosine.

    A target counts if it has one of the source's ``important`` first terms;
    ``ordered`` looks from the smaller id only. Which terms are joined is chosen
    by the threshold; either way no pair is lost and the products are exact.

    * High: each page's terms are ordered from the rarest on. Two pages that
      share none of the terms which come before the last ``min_score`` squared
      of their squared norms have a smaller cosine (the rest of one of them is
      too short), so only those are joined, on both sides: terms of many pages
      are in few of these prefixes.
    * Low: those prefixes would be nearly whole pages. The source's heaviest
      terms, ``important`` at most and only until they hold all but
      ``min_score`` squared of its squared norm, meet the targets that have them.
    """
    some = vectors.where("w > 0")
    whole = F.col("norm") * F.col("norm")
    if min_score**2 > 0.5:
        asked = offered = some.where(F.col("left") >= min_score**2 * whole * (1 - 1e-9))
    else:
        asked, offered = some.where((F.col("place") <= important) & (F.col("before") <= (1 - min_score**2) * whole * (1 + 1e-9))), some
    source = asked.select("crawl_job_id", "term", F.col("page_id").alias("source_page_id"))
    target = offered.select("crawl_job_id", "term", F.col("page_id").alias("target_page_id"))
    on = F.col("source_page_id") < F.col("target_page_id") if ordered else F.col("source_page_id") != F.col("target_page_id")
    # a shuffled table of postings is small on disk and large in a hash table: none of these joins may turn into a broadcast
    candidates = source.hint("merge").join(target.hint("merge"), ["crawl_job_id", "term"]).where(on).select("crawl_job_id", "source_page_id", "target_page_id").distinct()
    weight = lambda end, w: some.select("crawl_job_id", F.col("page_id").alias(end), "term", (F.col("w") / F.col("norm")).alias(w), (F.col("place") <= important).alias(f"{w}_important"))
    products = candidates.hint("merge").join(weight("source_page_id", "ws").hint("merge"), ["crawl_job_id", "source_page_id"]).join(weight("target_page_id", "wt").drop("wt_important").hint("merge"), ["crawl_job_id", "target_page_id", "term"])
    summed = products.groupBy("crawl_job_id", "source_page_id", "target_page_id").agg(F.sum(F.col("ws") * F.col("wt")).alias("score"), F.max("ws_important").alias("important"))
    return summed.where((F.col("score") >= min_score) & F.col("important")).drop("important")


def _with_terms(pairs: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """The kept pairs with their shared terms, in order, at most ``limit``."""
    one = vectors.select("crawl_job_id", F.col("page_id").alias("source_page_id"), "term")
    two = vectors.select("crawl_job_id", F.col("page_id").alias("target_page_id"), "term")
    both = pairs.hint("merge").join(one.hint("merge"), ["crawl_job_id", "source_page_id"]).join(two.hint("merge"), ["crawl_job_id", "target_page_id", "term"])
    terms = both.groupBy("crawl_job_id", "source_page_id", "target_page_id").agg(F.slice(F.array_sort(F.collect_set("term")), 1, limit).alias("shared_terms"))
    return pairs.join(terms, ["crawl_job_id", "source_page_id", "target_page_id"])


def similarity_edges(index: Index, top_k: int = DEFAULTS.similarity_top_k, min_score: float = DEFAULTS.similarity_min_score) -> DataFrame:
    """Each page's most similar pages of its job, best ``top_k``, ties by id."""
    told = best_pairs(index.texts, min_score, top_k, DEFAULTS.important_terms, DEFAULTS.shared_terms)
    evidence = _evidence(source="inverted_index_tfidf_cosine", similarity=F.round("score", 6), shared_terms=F.col("shared_terms"))
    return told.select("crawl_job_id", "source_page_id", "target_page_id", F.lit("content_similarity").alias("edge_type"), F.col("score").alias("weight"), evidence.alias("evidence"))


def inbound_counts(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(crawl_job_id, page_id, inbound): links to a page, by id or else by URL; loops count."""
    asked = links.select("crawl_job_id", "target_page_id", F.trim("target_normalized_url").alias("url"))
    named = asked.where("target_page_id is not null").select("crawl_job_id", F.col("target_page_id").alias("page_id"))
    # later fetches of one URL replace earlier ones
    last = pages.groupBy("crawl_job_id", F.col("normalized_url").alias("url")).agg(F.max("id").alias("page_id"))
    met = keyed_lookup(asked.where("target_page_id is null").select("crawl_job_id", "url"), last, ["crawl_job_id", "url"], "inner").select("crawl_job_id", "page_id")
    return named.unionByName(met).groupBy("crawl_job_id", "page_id").agg(F.count(F.lit(1)).alias("inbound"))


def canonical_order(inbound: str = "inbound", title: str = "title", url: str = "normalized_url", fetched: str = "fetched_at", page: str = "id") -> Column:
    """The page that stands for its copies is the least by this: short URL, many links in, a title, a long one, early fetch, small id."""
    name = F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.struct(F.length(url).alias("a"), (-F.coalesce(F.col(inbound), F.lit(0))).alias("b"), (name == "").alias("c"), (-F.length(name)).alias("d"), name.alias("e"), F.col(fetched).isNull().alias("f"), F.col(fetched).alias("g"), F.col(page).alias("h"))


def hash_duplicate_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """An edge of weight 1 from the canonical page to each other page of its job with the same content hash."""
    counted = pages.where("content_hash is not null").join(inbound_counts(links, pages).withColumnRenamed("page_id", "id"), ["crawl_job_id", "id"], "left")
    ordered = counted.select("crawl_job_id", "id", "content_hash", canonical_order().alias("o"))
    # the least of a group is found by partial aggregation; a group of any size never meets in one task
    first = ordered.groupBy("crawl_job_id", "content_hash").agg(F.min_by("id", "o").alias("source_page_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    others = keyed_lookup(ordered.drop("o"), first, ["crawl_job_id", "content_hash"], "inner").where("id <> source_page_id")
    return others.select("crawl_job_id", "source_page_id", F.col("id").alias("target_page_id"), F.lit("near_duplicate").alias("edge_type"), F.lit(1.0).alias("weight"), _evidence(kind="content_hash_match", content_hash=F.col("content_hash")).alias("evidence"))


def similarity_duplicate_edges(index: Index, pages: DataFrame, links: DataFrame, min_similarity: float = DEFAULTS.near_duplicate_min) -> DataFrame:
    """Edges from the canonical to the other page of each pair of very similar pages of different hash."""
    vectors = tfidf(index)
    pairs = similar_pairs(vectors, min_similarity, ordered=True)
    told = _with_terms(pairs, vectors, DEFAULTS.shared_terms)
    counted = pages.join(inbound_counts(links, pages).withColumnRenamed("page_id", "id"), ["crawl_job_id", "id"], "left")
    facts = counted.select("id", "content_hash", canonical_order().alias("o"))
    one, two = (facts.select(F.col("id").alias(k), F.col("content_hash").alias(f"{k}_hash"), F.col("o").alias(f"{k}_o")) for k in ("source_page_id", "target_page_id"))
    found = told.join(one, "source_page_id").join(two, "target_page_id").where("source_page_id_hash is null or target_page_id_hash is null or source_page_id_hash <> target_page_id_hash")
    swap = F.col("target_page_id_o") < F.col("source_page_id_o")
    evidence = _evidence(kind="high_similarity", similarity=F.round("score", 6), shared_terms=F.col("shared_terms"))
    return found.select(
        "crawl_job_id",
        F.when(swap, F.col("target_page_id")).otherwise(F.col("source_page_id")).alias("source_page_id"),
        F.when(swap, F.col("source_page_id")).otherwise(F.col("target_page_id")).alias("target_page_id"),
        F.lit("near_duplicate").alias("edge_type"), F.col("score").alias("weight"), evidence.alias("evidence"),
    )


def new_edges(built: DataFrame, existing: DataFrame) -> DataFrame:
    """Built edges whose (job, source, target, type) is not stored yet: what an idempotent append writes."""
    return built.dropDuplicates(_KEY).join(existing.select(*_KEY).distinct(), _KEY, "left_anti")
