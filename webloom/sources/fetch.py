"""Fetched responses: classification, retries, polite fetching."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.config import DEFAULTS
from webloom.functions.urls import host_of

# Content types that are indexed, and those that are plainly not text.
TEXT_TYPES = ("text/html", "application/xhtml+xml", "text/plain", "text/markdown", "text/x-markdown")
BINARY_PREFIXES = ("image/", "audio/", "video/")
BINARY_TYPES = ("application/zip", "application/octet-stream", "application/pdf", "application/x-tar", "application/gzip")
RETRIED_KINDS = ("timeout", "connect", "tls", "protocol")
BACKOFF_SECONDS = (1.0, 3.0, 7.0)


def media_type(content_type: Column) -> Column:
    """A content type without parameters, in lower case; '' for null."""
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def is_binary(media: Column) -> Column:
    out = media.isin(*BINARY_TYPES)
    for prefix in BINARY_PREFIXES:
        out = out | media.startswith(prefix)
    return out


def failure_kind(status: Column, content_type: Column, body_bytes: Column, max_bytes: int = DEFAULTS.max_body_bytes) -> Column:
    """Why a response is no page, in the order the checks apply; null for a page."""
    media = media_type(content_type)
    return (
        F.when(body_bytes > max_bytes, "oversized")
        .when(status.isNull() | (status != 200), "http_error")
        .when(is_binary(media), "not_indexable")
        .when(~media.isin(*TEXT_TYPES), "not_indexable")
    )


def exception_kind(name: Column, message: Column) -> Column:
    """Kind of a failed request by its exception's class and message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    cls = F.lower(F.coalesce(name, F.lit("")))
    tls = low.contains("certificate") | low.contains("ssl")
    return F.when(cls.contains("timeout"), "timeout").when(cls.contains("redirect"), "redirect_error").when(tls, "tls").when(cls.contains("connect"), "connect").otherwise("protocol")


def should_retry(kind: str | None, status: int | None) -> bool:
    """Whether a failed request is tried again: broken transport, 429 and 5xx."""
    return kind in RETRIED_KINDS or status == 429 or (status is not None and 500 <= status < 600)


def with_retries(fetch: Callable[[str], tuple], url: str, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """``fetch`` gives (kind, status, ...); the last answer with the number of retries before it."""
    for n in range(len(BACKOFF_SECONDS) + 1):
        answer = fetch(url)
        if n == len(BACKOFF_SECONDS) or not should_retry(answer[0], answer[1]):
            return (*answer, n)
        sleep(BACKOFF_SECONDS[n])
    raise AssertionError


FETCHED = "url string, kind string, status int, content_type string, body string, retries int"


def fetch_pages(frontier: DataFrame, fetch: Callable[[str], tuple], delay_seconds: float = 1.0, partitions: int = 64) -> DataFrame:
    """``FETCHED`` rows for the frontier's ``url``.

    Addresses of a host stay together, one after the other with a pause, so the
    limit per host holds without shared state. ``fetch`` gives (kind, status,
    content type, body) and is sent to the workers.
    """

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        last: dict[str, float] = {}
        for frame in frames:
            rows = []
            for url, host in zip(frame["url"], frame["host"]):
                wait = last.get(host, 0.0) + delay_seconds - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                rows.append((url, *with_retries(fetch, url)))
            yield pd.DataFrame(rows, columns=["url", "kind", "status", "content_type", "body", "retries"])

    hosted = frontier.select("url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    return hosted.repartition(partitions, "host").sortWithinPartitions("host").mapInPandas(run, FETCHED)
