"""A readable selection of a subgraph's nodes and edges."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The similarity floor of dense graphs, and the order of edge types.
DENSE = ((500, 0.35), (300, 0.28))
TYPE_RANK = {"link": 0, "url_hierarchy": 1, "content_similarity": 2, "near_duplicate": 3}
FORCED = {("link", "url_hierarchy"): 2, ("content_similarity", "near_duplicate"): 1}


def similarity_floor(edges: int) -> float:
    """The least weight of a shown similarity edge, by the number of edges."""
    return next((floor for most, floor in DENSE if edges > most), 0.0)


def type_rank(edge_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])[edge_type], F.lit(4))


def shown_edges(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...], floor: float = 0.0, total: int = 0) -> DataFrame:
    """Edges of the chosen types and weights between shown nodes; no loops."""
    least = F.when(F.col("edge_type") == "content_similarity", F.greatest(F.lit(floor), F.lit(similarity_floor(total)))).otherwise(F.lit(floor))
    kept = edges.where(F.col("edge_type").isin(*types) & (F.col("weight") >= least) & (F.col("source_page_id") != F.col("target_page_id")))
    for end in ("source_page_id", "target_page_id"):
        kept = kept.join(F.broadcast(nodes.select(F.col("page_id").alias(end))), end, "left_semi")
    return kept


def forced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bridges from related pages to matches that are always drawn: two structural ones each, and one of similarity."""
    roles = lambda end: F.broadcast(nodes.select(F.col("page_id").alias(end), F.col("role").alias(f"{end}_role")))
    both = edges.join(roles("source_page_id"), "source_page_id").join(roles("target_page_id"), "target_page_id")
    s, t = F.col("source_page_id_role"), F.col("target_page_id_role")
    match, related = F.lit("query_match"), F.lit("related_neighbor")
    bridge = both.where(((s == match) & (t == related)) | ((s == related) & (t == match))).withColumn("related", F.when(s == match, F.col("target_page_id")).otherwise(F.col("source_page_id")))
    parts = []
    for types, most in FORCED.items():
        order = [F.desc("weight"), "id"] if most == 1 else [type_rank(F.col("edge_type")), F.desc("weight"), "id"]
        place = F.row_number().over(Window.partitionBy("related").orderBy(*order))
        parts.append(bridge.where(F.col("edge_type").isin(*types)).withColumn("place", place).where(F.col("place") <= most).select("id"))
    return parts[0].unionByName(parts[1]).distinct()


def pruned_edges(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Ids of the drawn edges: the forced ones, then by type, weight and id while both ends have fewer than ``most``.

    Whether an edge is drawn depends on all before it, so this part is
    sequential. Nodes are at most 500 (see ``reachable``), which bounds the task.
    """
    order = edges.join(F.broadcast(forced_edges(edges, nodes).withColumn("forced", F.lit(True))), "id", "left").select("id", "source_page_id", "target_page_id", "weight", F.coalesce("forced", F.lit(False)).alias("forced"), type_rank(F.col("edge_type")).alias("rank"), F.lit(0).alias("one"))

    def greedy(pdf):
        pdf = pdf.sort_values(["forced", "rank", "weight", "id"], ascending=[False, True, False, True])
        degree: Counter = Counter()
        keep = []
        for forced, a, b in zip(pdf["forced"], pdf["source_page_id"], pdf["target_page_id"]):
            ok = bool(forced) or (degree[a] < most and degree[b] < most)
            if ok:
                degree[a] += 1
                degree[b] += 1
            keep.append(ok)
        return pdf.loc[keep, ["id"]]

    return order.groupBy("one").applyInPandas(greedy, "id bigint")


def curated_nodes(ranked: DataFrame, matches: DataFrame, related: int = 20) -> DataFrame:
    """The matches and the first related pages of ``ranked_related``."""
    return matches.select("page_id", "role").unionByName(ranked.where(F.col("place") <= related).select("page_id", "role"))


def page_order(nodes: DataFrame) -> DataFrame:
    """Nodes in list order: matches, related pages, duplicates; best score first."""
    rank = F.when(F.col("role") == "query_match", 0).when(F.col("role") == "related_neighbor", 1).otherwise(2)
    return nodes.orderBy(rank, F.desc(F.coalesce("score", F.lit(-1.0))), "page_id")


def drawn_summary(nodes: int, shown_nodes: int, edges: int, drawn: int) -> dict[str, float]:
    """Counts before and after, and the share of edges drawn."""
    return {"nodes": nodes, "shown_nodes": shown_nodes, "edges": edges, "drawn_edges": drawn, "drawn_percent": round(100 * drawn / edges) if edges else 100}
