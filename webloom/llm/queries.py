"""Registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import furniture, groups, leakage, packing, residue, spam, splitting, templates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.repeated_lines(_table(spark, sf_dir, "pages")).select("page_id", "line_no")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.near_duplicate_groups(_table(spark, sf_dir, "page_graph_edges"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.furniture_lines(_table(spark, sf_dir, "pages")).select("page_id", F.explode("lines").alias("line_no"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_pages(_table(spark, sf_dir, "pages")).select("page_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "page_links")).select("page_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(_table(spark, sf_dir, "documents")).where("piece_no = 1").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p3_found, p4_found, p6_found, p7_containers, p8_found, p9_found, p9_pieces)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2_SQL,
        "p8_found": P8_SQL,
    }


P2_SQL = """
with recursive e as (
    select distinct source_page_id as a, target_page_id as b from page_graph_edges
    where edge_type = 'near_duplicate' and source_page_id <> target_page_id
), s as (select a, b from e union select b, a from e),
reach as (select a as v, a as m from s union select s.b, r.m from reach r join s on s.a = r.v where r.m < s.b)
select min(m) as group_id, v as page_id from reach group by v
"""

P8_SQL = r"""
with words as (
    select 'd' as kind, doc_id as id, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}]+') as w from documents
    union all select 'i', item_id, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[\p{L}\p{N}]+') from benchmark
), runs as (select kind, id, array_to_string(w[k:k + 12], ' ') as run from (select *, unnest(generate_series(1, len(w) - 12)) as k from words where len(w) >= 13))
select distinct d.id as doc_id, i.id as item_id from runs d join runs i on i.kind = 'i' and d.kind = 'd' and d.run = i.run
"""
