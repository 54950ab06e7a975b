"""Main bodies of pages: everything outside the maximum-scoring run of lines is site furniture.

The method and its weights are in ``body``; here it runs over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.body import FURNITURE, SAMPLE_PAGES, BodyModel, fit_body_model, sample_pages

_KEPT: dict[str, object] = {}


def broadcast_body(pages: DataFrame, most: int = SAMPLE_PAGES) -> Broadcast:
    """The model, fitted once on the driver to ``most`` pages at most; some hundred KB, whatever the corpus' size."""
    return pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, fit_body_model(sample_pages(pages, most))))


def kept(broadcast: Broadcast) -> object:
    """What was broadcast with a name; a Python worker keeps it, with what it remembers, from task to task."""
    name, value = broadcast.value
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = value
    return _KEPT[name]


def page_columns(pages: DataFrame) -> DataFrame:
    """(id, domain, url, title, text) of pages, as the models read them."""
    return pages.select(F.col("id").cast("long").alias("id"), F.col("domain").cast("string").alias("domain"), F.col("normalized_url").cast("string").alias("url"), F.col("title").cast("string").alias("title"), F.col("extracted_text").cast("string").alias("text"))


def furniture_of(model: BodyModel, domain: str | None, url: str | None, title: str | None, text: str) -> list[int]:
    """Numbers, from 1, of the lines that are not the page's main body."""
    return [i for i, x in enumerate(model.judge(domain, url, title, text), 1) if x.kind == FURNITURE]


def furniture_lines(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, lines): for each page, the numbers of its lines of site furniture.

    Lines are cut at line feeds and numbered from 1; blank lines are never
    listed, nor is the line of the page's title or of the last part of its URL.
    Pages with null or empty text give no row; null titles, URLs and domains are
    unknown ones. One row per input row that has furniture. If the pages sampled
    show no furniture or no paragraphs, nothing can be told apart and no line is
    listed.
    """
    model = broadcast_body(pages, sample)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = kept(model)
        for batch in batches:
            ids, found = [], []
            for page, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if lines := furniture_of(scorer, *rest):
                    ids.append(page)
                    found.append(lines)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["page_id", "lines"])

    return page_columns(pages.where("extracted_text <> ''")).mapInArrow(judge, "page_id bigint, lines array<int>")


def main_bodies(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, body): each page's text without furniture and blank lines; null text gives null."""
    model = broadcast_body(pages, sample)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = kept(model)
        for batch in batches:
            bodies = []
            for domain, url, title, text in zip(*(c.to_pylist() for c in batch.columns[1:])):
                drop = set(furniture_of(scorer, domain, url, title, text)) if text else ()
                bodies.append(None if text is None else "\n".join(x.rstrip("\r") for k, x in enumerate(text.split("\n"), 1) if k not in drop and x.strip()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], ["page_id", "body"])

    return page_columns(pages).mapInArrow(cut, "page_id bigint, body string")
