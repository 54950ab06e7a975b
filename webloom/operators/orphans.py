"""References to records that do not exist, or do not exist yet.

A Bloom filter over all parent keys is computed in a scalar subquery and tested
inside the scan's generated code. What it denies is certainly an orphan and is
never shuffled to the parents; only the references it admits are verified by an
exact join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import normalize_url
from webloom.operators.skew import keyed_lookup
from webloom.session import Scratch

#: Bits of the filter per parent key, for 3 % false positives, and the bits it may have in all (64 MB).
BITS_PER_KEY = 8
MAX_BITS = 1 << 29
_CONF = "spark.sql.optimizer.runtime.bloomFilter."


def might_contain(keys: DataFrame, key: str, tested: Column, expected: int) -> Column | None:
    """A column that is false only where ``tested`` (bigint) is certainly not among ``keys``.

    The filter has at most ``MAX_BITS``; None if that is too few for the number
    of keys to deny anything.
    """
    spark = keys.sparkSession
    bits = 1 << max(10, math.ceil(math.log2(max(1, expected) * BITS_PER_KEY)))
    if bits > MAX_BITS:
        if expected * 3 > MAX_BITS:
            return None
        bits = MAX_BITS
    for name, need in (("maxNumBits", bits), ("maxNumItems", expected)):
        if int(spark.conf.get(_CONF + name)) < need:
            spark.conf.set(_CONF + name, str(need))
    jvm = spark._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    built = catalyst.aggregate.BloomFilterAggregate(utils.expression(F.col(key)._jc), utils.expression(F.lit(max(1, expected)).cast("long")._jc), utils.expression(F.lit(bits).cast("long")._jc))
    filled = keys.agg(Column(utils.column(built.toAggregateExpression())).alias("filter")).scalar()
    return Column(utils.column(catalyst.BloomFilterMightContain(utils.expression(filled._jc), utils.expression(tested._jc))))


def _month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def orphan_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(link_id, period, reference): links whose target was not there by the end of the period.

    The period is the month in which the source page was created. A link with
    ``target_page_id`` refers to that page of its own crawl job, whatever its
    URL says. Without it, an eligible link refers to any page of its job that
    has the canonical form of its URL; a URL without canonical form refers to
    no page. Rows delivered twice count once. A link with neither id nor URL,
    one whose source page is unknown or undated, and one without an id of its
    own refers to nothing or has no period, and gives no row. Eligibility null
    means not eligible. A page without ``created_at`` is never there. The
    parents may come in any order and repeat; extra columns are ignored.
    """
    by_id = F.col("target_page_id").isNotNull()
    refs = links.where(F.col("id").isNotNull() & (by_id | (F.col("is_crawl_eligible") & F.col("target_normalized_url").isNotNull()))).select(
        F.col("id").cast("long").alias("link_id"),
        F.col("crawl_job_id").cast("long").alias("job"),
        F.col("source_page_id").cast("long").alias("source"),
        "target_page_id",
        F.when(~by_id, F.col("target_normalized_url")).alias("url"),
    )
    own = pages.select(F.col("id").cast("long").alias("page"), F.col("crawl_job_id").cast("long").alias("job"), "normalized_url", _month(F.col("created_at")).alias("month")).where("month is not null")
    sources = own.groupBy(F.col("page").alias("source")).agg(F.min("month").alias("period"))
    keyed = keyed_lookup(refs, sources, ["source"], "inner").select(
        "link_id",
        "job",
        "period",
        F.when(F.col("target_page_id").isNotNull(), "target_page_id").otherwise("target_normalized_url").alias("reference"),
        F.coalesce(F.concat(F.lit("#"), F.col("target_page_id").cast("long")), normalize_url(F.col("url"))).alias("key"),
    )
    refs = Scratch(links.sparkSession, "orphans").keep(keyed)

    keys = own.select("job", "month", F.explode(F.array(F.concat(F.lit("#"), F.col("page")), F.col("normalized_url"))).alias("key")).where("key is not null and job is not null")
    hashed = lambda: F.xxhash64("job", "key")
    there = might_contain(keys.select(hashed().alias("h")), "h", hashed(), 2 * pages.count())
    if there is None:
        maybe, gone = refs, None
    else:
        refs = refs.withColumn("maybe", F.coalesce(there, F.lit(False)) & F.col("key").isNotNull() & F.col("job").isNotNull())
        gone = refs.where("not maybe").drop("maybe")
        maybe = refs.where("maybe").drop("maybe")
    since = keys.groupBy("job", "key").agg(F.min("month").alias("since"))
    late = keyed_lookup(maybe, since, ["job", "key"]).where("since is null or since > period")
    out = late.select("link_id", "period", "reference")
    if gone is not None:
        out = out.unionByName(gone.select("link_id", "period", "reference"))
    return out.distinct()


def orphan_report(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(table_name, reference, period, orphans): orphan links counted per table, kind of reference and month."""
    return orphan_links(links, pages).groupBy(F.lit("page_links").alias("table_name"), "reference", "period").agg(F.count(F.lit(1)).alias("orphans"))
