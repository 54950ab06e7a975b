"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many keys at most are treated as hot, so at most so many rows are
#: broadcast. Any other key holds less than one in HOT_KEYS of the rows.
HOT_KEYS = 1000


def hot_keys(rows: DataFrame, keys: Sequence[str], limit: int = HOT_KEYS) -> DataFrame:
    """The ``limit`` keys with most rows (and more than one), partially counted before the shuffle."""
    count = rows.where(F.expr(" and ".join(f"`{k}` is not null" for k in keys))).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return count.where("__n > 1").orderBy(F.desc("__n"), *keys).limit(limit).select(*keys)


def keyed_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined (left or inner) with ``table``, which has one row per key.

    Rows of the heaviest keys meet a broadcast of at most ``HOT_KEYS`` table
    rows and are not shuffled; the others join by shuffle. Rows with a null key
    match nothing and take no part in the shuffle. ``table`` must not share
    other column names with ``rows``. ``hot`` may name the heavy keys.
    """
    keys = list(keys)
    hot = (hot_keys(rows, keys) if hot is None else hot.select(*keys)).withColumn("__hot", F.lit(True))
    some = F.expr(" and ".join(f"`{k}` is not null" for k in keys))
    marked = rows.where(some).join(F.broadcast(hot), keys, "left")
    few = table.join(F.broadcast(hot.drop("__hot")), keys, "left_semi")
    heavy = marked.where("__hot").join(F.broadcast(few), keys, how)
    rest = marked.where("__hot is null").join(table, keys, how)
    out = heavy.unionByName(rest).drop("__hot")
    if how == "left":
        extra = [f for f in table.schema.fields if f.name not in keys]
        none = rows.where(~some).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
        out = out.unionByName(none)
    return out
