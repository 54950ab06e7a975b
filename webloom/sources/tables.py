"""Tables as Parquet folders: readers and idempotent writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.session import Scratch


class Tables:
    """The tables of one folder, ``<folder>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table, with its stored or the given schema; columns and filters are pushed down to the files."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def point(self, name: str, **key: object) -> DataFrame:
        """At most one row by key."""
        rows = self.read(name)
        for column, value in key.items():
            rows = rows.where(F.col(column) == value)
        return rows.limit(1)

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(name))

    def append_absent(self, name: str, rows: DataFrame, key: list[str]) -> int:
        """Appends the rows whose key is not stored yet, once each; gives their number. Running it again adds nothing."""
        fresh = rows.dropDuplicates(key)
        if self.exists(name):
            fresh = fresh.join(self.read(name).select(*key).distinct(), key, "left_anti")
        # written elsewhere first: the plan reads the table that it is appended to
        scratch = Scratch(self.spark, "append")
        fresh = scratch.keep(fresh)
        n = fresh.count()
        if n:
            self.append(name, fresh)
        scratch.drop(fresh)
        return n

    def replace_jobs(self, name: str, rows: DataFrame, key: str = "crawl_job_id") -> None:
        """Replaces the partitions of the jobs that occur in ``rows``, and no others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(self.path(name))

    def truncate(self, name: str) -> int:
        """Empties a table; gives the number of rows it had."""
        rows = self.read(name)
        n = rows.count()
        self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(self.path(name))
        return n


def latest_per_key(old: DataFrame, new: DataFrame, key: list[str], created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """An upsert: of each key the last written row, with the first ``created``. Ties go to ``new``."""
    every = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.max_by(F.struct(*[c for c in old.columns if c not in (*key, created)]), F.struct(updated, "__new"))
    merged = every.groupBy(*key).agg(last.alias("r"), F.min(created).alias(created))
    return merged.select(*[F.col(c) if c in (*key, created) else F.col(f"r.{c}").alias(c) for c in old.columns])


def keep_latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def log_search(tables: Tables, query: str, result_count: int, latency_ms: int, now) -> None:
    """Appends one search to the log, its query trimmed; see ``log_searches`` for many."""
    log_searches(tables, [(query, result_count, latency_ms, now)])


def log_searches(tables: Tables, rows: list[tuple]) -> None:
    """Appends searches (query, result_count, latency_ms, created_at) in one file.

    Ids are random and positive, so that writers need not read the table or
    wait for each other; ``created_at`` gives the order.
    """
    spark = tables.spark
    named = [(uuid.uuid4().int >> 65, q.strip(), n, ms, at) for q, n, ms, at in rows]
    tables.append("search_queries", spark.createDataFrame(named, "id bigint, query string, result_count int, latency_ms int, created_at timestamp"))


def reset_search_log(tables: Tables, allowed: bool) -> int:
    """Empties the search log if that is allowed; gives the number of rows it had."""
    if not allowed:
        raise PermissionError("resetting the search log is not enabled")
    return tables.truncate("search_queries")
