"""Crawl jobs: lists, details, states."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.config import DEFAULTS, JOB_STATUSES
from webloom.functions.urls import canonical_url

_CANCELLABLE = ("queued", "pending", "running")


def job_filter(jobs: DataFrame, status: str | None = None, seed: str | None = None) -> DataFrame:
    """Jobs of a status whose seed, as given or canonical, contains a text in any letter case; blanks don't filter."""
    if status is not None:
        if status not in JOB_STATUSES:
            raise ValueError(f"unknown status {status!r}")
        jobs = jobs.where(F.col("status") == status)
    term = (seed or "").strip().lower()
    if term:
        jobs = jobs.where(F.lower("seed_url").contains(term) | F.lower("normalized_seed_url").contains(term))
    return jobs


def list_jobs(jobs: DataFrame, status: str | None = None, seed: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the jobs, newest first, ties by id."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200, offset not negative")
    return job_filter(jobs, status, seed).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def count_jobs(jobs: DataFrame, status: str | None = None, seed: str | None = None) -> DataFrame:
    return job_filter(jobs, status, seed).agg(F.count(F.lit(1)).alias("total"))


def job_details(jobs: DataFrame, links: DataFrame) -> DataFrame:
    """Every job with the number of pages discovered and its progress, 0..1."""
    found = links.where("is_crawl_eligible").groupBy(F.col("crawl_job_id").alias("id")).agg(F.countDistinct("target_normalized_url").alias("pages_discovered"))
    progress = F.least(F.lit(1.0), F.col("pages_crawled") / F.greatest(F.lit(1), F.col("max_pages")))
    return jobs.join(found, "id", "left").select("id", "status", "pages_crawled", "max_pages", F.coalesce("pages_discovered", F.lit(0)).alias("pages_discovered"), progress.alias("progress"))


def list_pages(pages: DataFrame, job: int, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of a job's pages by depth and id, without their texts."""
    columns = ["id", "url", "domain", "title", "status_code", "depth", "fetched_at", "indexed_at", "token_count"]
    return pages.where(F.col("crawl_job_id") == job).select(*columns).orderBy("depth", "id").offset(offset).limit(limit)


def list_errors(errors: DataFrame, job: int, offset: int = 0, limit: int = 100) -> DataFrame:
    return errors.where(F.col("crawl_job_id") == job).select("id", "url", "error_type", "status_code", "retry_count", "created_at").orderBy("created_at", "id").offset(offset).limit(limit)


def create_jobs(spark, seeds: list[str], now: datetime, first_id: int = 1, max_pages: int = 100, max_depth: int = 2, same_domain_only: bool = True) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Queued jobs of the valid seeds, and (seed, reason) of the others; 500 at most."""
    if len(seeds) > 500:
        raise ValueError("at most 500 seeds at once")
    if not 1 <= max_pages <= 10_000 or not 0 <= max_depth <= 10:
        raise ValueError("max_pages must be 1..10000, max_depth 0..10")
    rows, bad = [], []
    for seed in seeds:
        try:
            rows.append((first_id + len(rows), seed, canonical_url(seed), "queued", max_pages, max_depth, same_domain_only, 0, 0, 0, now, None, None, None))
        except ValueError as e:
            bad.append((seed, str(e)))
    from webloom.schemas import CRAWL_JOBS

    return spark.createDataFrame(rows, CRAWL_JOBS), bad


def _set(jobs: DataFrame, chosen, **values) -> DataFrame:
    return jobs.withColumns({k: F.when(chosen, v).otherwise(F.col(k)) for k, v in values.items()})


def cancel_job(jobs: DataFrame, job: int, now: datetime) -> DataFrame:
    """Jobs with one of them cancelled, if it was waiting or running; any other is an error."""
    row = jobs.where(F.col("id") == job).select("status").first()
    if row is None or row[0] not in _CANCELLABLE:
        raise ValueError("only waiting or running jobs can be cancelled")
    return _set(jobs, F.col("id") == job, status=F.lit("cancelled"), finished_at=F.lit(now))


def retry_job(jobs: DataFrame, tables: dict[str, DataFrame], job: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A failed job queued again, and the tables without its rows. Document frequencies are derived, so none drift."""
    row = jobs.where(F.col("id") == job).select("status").first()
    if row is None or row[0] != "failed":
        raise ValueError("only failed jobs can be tried again")
    chosen = F.col("id") == job
    none, zero = F.lit(None), F.lit(0)
    reset = _set(jobs, chosen, status=F.lit("queued"), pages_crawled=zero, pages_indexed=zero, pages_failed=zero, started_at=none, finished_at=none, error_message=none)
    return reset, {name: rows.where(F.col("crawl_job_id") != job) for name, rows in tables.items()}


def finish_job(jobs: DataFrame, job: int, saved: int, now: datetime, error: str | None = None) -> DataFrame:
    """A job completed or failed; one cancelled meanwhile stays so. Messages are cut at 10,000 characters."""
    state = "failed" if error is not None or not saved else "completed"
    chosen = (F.col("id") == job) & (F.col("status") != "cancelled")
    return _set(jobs, chosen, status=F.lit(state), finished_at=F.lit(now), error_message=F.lit(error[:10_000] if error else None))


def recover_jobs(jobs: DataFrame, now: datetime, stale_minutes: int = DEFAULTS.stale_minutes) -> DataFrame:
    """Jobs left running for longer than ``stale_minutes`` are failed; queued ones stay to be run."""
    stale = (F.col("status") == "running") & (F.col("started_at") < F.lit(now - timedelta(minutes=stale_minutes)))
    return _set(jobs, F.coalesce(stale, F.lit(False)), status=F.lit("failed"), finished_at=F.lit(now), error_message=F.lit("The worker stopped while the job was running."))
