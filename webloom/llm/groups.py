"""Pairwise matches consolidated into groups by randomised contraction.

Every vertex hooks to the neighbour (or itself) that comes first in a fresh
random order of the round; edges are relabelled with the hooks and
deduplicated, which removes at least a constant share of the vertices in
expectation, whatever the graph's shape. When no edge is left the hooks of all
rounds are composed, last to first, and each vertex gets the label of its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.skew import HOT_KEYS, keyed_lookup
from webloom.session import Scratch

#: Vertices of at least so many edges are joined by broadcast, at most ``HOT_KEYS`` of them.
HEAVY_DEGREE = 200_000


def _contract(edges: DataFrame, seed: int) -> DataFrame:
    """(v, rep, degree): the first of v's closed neighbourhood in the round's order."""
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("id"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(order("b")).alias("first"), F.count(F.lit(1)).alias("degree"))
    return best.select(F.col("a").alias("v"), F.least("first", order("a")).getField("id").alias("rep"), "degree")


def _relabel(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    """Edges between the hooks' targets, once each, loops left out."""
    # a key with fewer rows than this fits a task with ease, so nothing needs to be treated as hot
    skewed = (hooks.agg(F.max("degree")).first()[0] or 0) >= HEAVY_DEGREE
    heavy = hooks.where(F.col("degree") >= HEAVY_DEGREE).orderBy(F.desc("degree"), "v").limit(HOT_KEYS)
    for end in ("a", "b"):
        table = hooks.select(F.col("v").alias(end), F.col("rep").alias("__rep"))
        edges = keyed_lookup(edges, table, [end], "inner", heavy.select(F.col("v").alias(end))) if skewed else edges.join(table, end)
        edges = edges.drop(end).withColumnRenamed("__rep", end)
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _follow(labels: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """``labels`` joined with one row per ``rep``; targets with many followers don't gather in one task."""
    top = labels.groupBy("rep").count().agg(F.max("count")).first()[0] or 0
    return keyed_lookup(labels, table, ["rep"], how) if top >= HEAVY_DEGREE else labels.join(table, "rep", how)


def consolidate_pairs(pairs: DataFrame, left: str, right: str, seed: int = 1, max_rounds: int = 200) -> DataFrame:
    """(group_id, page_id): one row per id that is paired with another id.

    ``group_id`` is the smallest id of the group. Pairs may repeat and come in
    either direction; a pair with a null end, or of an id with itself, joins
    nothing and makes no member. No pairs give no rows. Other columns of
    ``pairs`` are ignored, whatever their names. Contraction takes O(log n)
    expected rounds; ``max_rounds`` only guards against an endless loop and
    raises, it never cuts a result short.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = scratch.keep(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), a.alias("x"), b.alias("y")).where("x is not null and y is not null and a <> b").select("a", "b").distinct())
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        if len(hooks) == max_rounds:
            raise RuntimeError("contraction did not end")
        hooks.append(scratch.keep(_contract(edges, seed + len(hooks))))
        smaller = scratch.keep(_relabel(edges, hooks[-1]))
        scratch.drop(edges)
        edges = smaller
    scratch.drop(edges)
    if not hooks:
        return spark.createDataFrame([], "group_id bigint, page_id bigint")

    labels = hooks[-1].select("v", "rep")
    for earlier in reversed(hooks[:-1]):
        table = labels.select(F.col("v").alias("rep"), F.col("rep").alias("__final"))
        labels = _follow(earlier.select("v", "rep"), table, "left").select("v", F.coalesce("__final", "rep").alias("rep"))
        labels = scratch.keep(labels)
    smallest = labels.groupBy("rep").agg(F.min("v").alias("group_id"))
    return _follow(labels, smallest, "inner").select("group_id", F.col("v").alias("page_id"))


def near_duplicate_groups(edges: DataFrame, edge_type: str = "near_duplicate") -> DataFrame:
    """Groups of the pages linked by edges of one type; see ``consolidate_pairs``."""
    return consolidate_pairs(edges.where(F.col("edge_type") == edge_type), "source_page_id", "target_page_id")
