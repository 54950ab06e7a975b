"""Dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import failure_host

# Kinds of errors and their labels.
SKIPPED = ("robots_disallow",)
REJECTED = ("not_indexable", "oversized")
SKIP_LABELS = (
    ("robots_disallow", "Robots.txt disallow"),
    ("not_indexable", "Not indexable (MIME / not page-like)"),
    ("oversized", "Oversized response"),
    ("duplicate", "Duplicate URL (same job — not stored as error today)"),
    ("off_domain", "Off-domain (not scheduled — not stored as error today)"),
)
FETCH_KINDS = ("timeout", "connect", "tls", "protocol", "redirect_error", "invalid_url", "parse_error")


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def totals(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: pages, errors, attempts, rates, as each table's one aggregate."""
    p = pages.agg(F.count(F.lit(1)).alias("pages"), F.count("indexed_at").alias("indexed"), F.max("indexed_at").alias("last_indexed"), F.countDistinct("domain").alias("domains"))
    kind = F.col("error_type")
    e = errors.agg(
        F.count(F.lit(1)).alias("errors"),
        F.count_if(kind.isin(*SKIPPED)).alias("skipped"),
        F.count_if(kind.isin(*REJECTED)).alias("policy_rejected"),
        F.countDistinct("normalized_url").alias("failed_urls"),
        F.count_if(F.col("status_code") == 429).alias("rate_limited"),
    )
    attempted = F.col("pages") + F.col("errors")
    return p.crossJoin(F.broadcast(e)).select(
        "*",
        attempted.alias("attempted"),
        F.greatest(F.lit(0), F.col("errors") - F.col("skipped") - F.col("policy_rejected")).alias("fetch_failures"),
        _ratio(F.col("pages"), attempted, 1.0).alias("success_rate"),
        _ratio(F.col("indexed"), F.col("pages"), 1.0).alias("index_coverage"),
    )


def open_work(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: pages fetched and not indexed yet, rows of errors that are skips, and timeouts."""
    p = pages.agg(F.count_if(F.col("fetched_at").isNotNull() & F.col("indexed_at").isNull()).alias("pending"))
    kind = F.col("error_type")
    return p.crossJoin(F.broadcast(errors.agg(F.count_if(kind.isin(*SKIPPED, *REJECTED)).alias("skipped_rows"), F.count_if(kind == "timeout").alias("timeouts"))))


def index_size(postings: DataFrame) -> DataFrame:
    """One row: different terms, and postings. Terms are counted from their partial counts."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("unique_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))


def lengths(pages: DataFrame) -> DataFrame:
    """Mean, median and 95th percentile of lengths in terms over pages indexed with terms."""
    return pages.where("indexed_at is not null and token_count > 0").agg(
        F.avg("token_count").alias("mean_tokens"),
        F.percentile("token_count", 0.5).alias("median_tokens"),
        F.percentile("token_count", 0.95).alias("p95_tokens"),
    )


def fetch_latency(pages: DataFrame) -> DataFrame:
    known = pages.where("fetch_duration_ms is not null")
    return known.agg(F.count(F.lit(1)).alias("fetches"), F.avg("fetch_duration_ms").alias("mean_ms"), F.percentile("fetch_duration_ms", 0.95).alias("p95_ms"))


def job_figures(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs by status, mean duration of finished jobs in seconds (null if none), pages per job."""
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    done = F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()
    j = jobs.agg(F.count(F.lit(1)).alias("jobs"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running", "cancelled")], F.avg(F.when(done, seconds)).alias("mean_seconds"))
    p = pages.agg(F.count(F.lit(1)).alias("pages"))
    return j.crossJoin(F.broadcast(p)).select("jobs", "completed", "failed", "running", "cancelled", F.when(F.col("mean_seconds") != 0, F.col("mean_seconds")).alias("mean_seconds"), _ratio(F.col("pages"), F.col("jobs"), 0.0).alias("pages_per_job"))


def search_figures(queries: DataFrame) -> DataFrame:
    """Searches, those without result, those at the cap of 20, and latencies."""
    return queries.agg(
        F.count(F.lit(1)).alias("searches"),
        F.count_if(F.col("result_count") == 0).alias("zero_results"),
        F.count_if(F.col("result_count") >= 20).alias("at_cap"),
        F.avg("latency_ms").alias("mean_ms"),
        F.percentile("latency_ms", 0.95).alias("p95_ms"),
        F.avg("result_count").alias("mean_results"),
    ).withColumn("zero_rate", _ratio(F.col("zero_results"), F.col("searches"), 0.0))


def top_queries(queries: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent queries as typed; ties by spelling."""
    return queries.groupBy("query").agg(F.count(F.lit(1)).alias("searches")).orderBy(F.desc("searches"), "query").limit(limit)


def recent_without_result(queries: DataFrame, limit: int = 10) -> DataFrame:
    return queries.where("result_count = 0").orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", "query", "latency_ms", "created_at")


def slowest_query(queries: DataFrame) -> DataFrame:
    return queries.where("latency_ms is not null").orderBy(F.desc("latency_ms"), F.desc("id")).limit(1).select("id", "query", "latency_ms")


def largest_page(pages: DataFrame) -> DataFrame:
    return pages.where("indexed_at is not null and token_count > 0").orderBy(F.desc("token_count"), "id").limit(1).select("id", "url", "token_count")


def top_domains(pages: DataFrame, limit: int = 10) -> DataFrame:
    return pages.where("indexed_at is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "domain").limit(limit)


def failures_by_type(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("failures"))


def recent_failures(errors: DataFrame, limit: int = 10) -> DataFrame:
    return errors.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", "url", "error_type", "status_code", "created_at")


def failing_hosts(errors: DataFrame, limit: int = 10) -> DataFrame:
    """Hosts (with port) of failed http(s) addresses, most failures first."""
    host = failure_host(F.col("url"))
    return errors.select(host.alias("host")).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), "host").limit(limit)


def status_histogram(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """(status_code, responses) over pages and errors; each table is counted before the two meet."""
    counts = [t.where("status_code is not null").groupBy("status_code").agg(F.count(F.lit(1)).alias("n")) for t in (pages, errors)]
    return counts[0].unionByName(counts[1]).groupBy("status_code").agg(F.sum("n").alias("responses"))


def status_classes(histogram: DataFrame) -> DataFrame:
    """One row of totals of 2xx to 5xx; other codes are left out."""
    within = lambda k: F.coalesce(F.sum(F.when(F.col("status_code").between(k * 100, k * 100 + 99), F.col("responses"))), F.lit(0)).alias(f"status_{k}xx")
    return histogram.agg(*[within(k) for k in (2, 3, 4, 5)])


def skip_breakdown(errors: DataFrame) -> DataFrame:
    """(place, label, errors): the fixed kinds of skips, zeros too."""
    spark = errors.sparkSession
    labels = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(SKIP_LABELS)], "place int, error_type string, label string")
    counts = errors.where(F.col("error_type").isin([k for k, _ in SKIP_LABELS])).groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))
    return labels.join(F.broadcast(counts), "error_type", "left").select("place", "label", F.coalesce("errors", F.lit(0)).alias("errors"))


def fetch_breakdown(errors: DataFrame) -> DataFrame:
    """(label, errors): rate limits, other HTTP errors, the fixed kinds (zeros too), then all others."""
    spark = errors.sparkSession
    policy = [*SKIPPED, *REJECTED]
    one = errors.agg(F.count_if(F.col("status_code") == 429).alias("limited"), F.count_if(F.col("error_type") == "http_error").alias("http"))
    http = one.select(F.explode(F.array(F.struct(F.lit("HTTP 429 (rate limited)").alias("label"), F.col("limited").alias("errors")), F.struct(F.lit("HTTP error (other status)").alias("label"), F.greatest(F.lit(0), F.col("http") - F.col("limited")).alias("errors")))).alias("x")).select("x.*")
    counts = errors.where(~F.col("error_type").isin(policy) & (F.col("error_type") != "http_error")).groupBy(F.col("error_type").alias("label")).agg(F.count(F.lit(1)).alias("errors"))
    fixed = spark.createDataFrame([(k,) for k in FETCH_KINDS], "label string")
    kinds = fixed.join(F.broadcast(counts), "label", "left").select("label", F.coalesce("errors", F.lit(0)).alias("errors"))
    rest = counts.where(~F.col("label").isin(list(FETCH_KINDS)))
    return http.unionByName(kinds).unionByName(rest)
