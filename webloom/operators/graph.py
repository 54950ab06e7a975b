"""Metrics and walks of the page graph."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.config import DEFAULTS, EXPLORED_TYPES, RANKED_TYPES
from webloom.operators.skew import keyed_lookup
from webloom.session import Scratch


def ranked_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(crawl_job_id, u, v, weight): link and hierarchy edges between different pages of one job."""
    e = edges.where(F.col("edge_type").isin(*RANKED_TYPES) & (F.col("source_page_id") != F.col("target_page_id"))).select("crawl_job_id", F.col("source_page_id").alias("u"), F.col("target_page_id").alias("v"), "weight")
    for end in ("u", "v"):
        e = e.join(pages.select("crawl_job_id", F.col("id").alias(end)), ["crawl_job_id", end], "left_semi")
    return e


def degrees(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(crawl_job_id, page_id, in_degree, out_degree) of every page: edge rows in and out, each type for itself."""
    e = ranked_edges(edges, pages)
    ends = e.select("crawl_job_id", F.col("u").alias("page_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select("crawl_job_id", F.col("v").alias("page_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counted = ends.groupBy("crawl_job_id", "page_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return pages.select("crawl_job_id", F.col("id").alias("page_id")).join(counted, ["crawl_job_id", "page_id"], "left").select("crawl_job_id", "page_id", F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"))


#: Jobs of so many pages and edges, at most, are ranked in one task each: it holds four numbers of each row.
RANKED_IN_ONE_TASK = 1_000_000


def _ranks_of_job(damping: float, rounds: int, tolerance: float):
    """Power iteration over the rows of one job: (u, null, null) for pages, (u, v, p) for moves."""

    def ranks(pdf):
        import numpy as np
        import pandas as pd

        nodes = np.sort(pdf.loc[pdf["v"].isna(), "u"].to_numpy())
        moves = pdf[pdf["v"].notna()]
        source, target = np.searchsorted(nodes, moves["u"].to_numpy()), np.searchsorted(nodes, moves["v"].to_numpy(dtype="int64"))
        share, n = moves["p"].to_numpy(), len(nodes)
        still = np.ones(n, dtype=bool)
        still[source] = False
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            flow = np.bincount(target, weights=share * rank[source], minlength=n)
            fresh = (1 - damping) / n + damping * flow + damping * rank[still].sum() / n
            moved, rank = np.abs(fresh - rank).max(), fresh
            if moved < tolerance:
                break
        return pd.DataFrame({"crawl_job_id": pdf["crawl_job_id"].iloc[0], "page_id": nodes, "pagerank": rank})

    return ranks


def pagerank(
    edges: DataFrame, pages: DataFrame, damping: float = DEFAULTS.damping, rounds: int = DEFAULTS.pagerank_rounds, tolerance: float = DEFAULTS.pagerank_tolerance, one_task: int = RANKED_IN_ONE_TASK
) -> DataFrame:
    """(crawl_job_id, page_id, pagerank): weighted, each job for itself.

    Parallel edges add up, negative weights count as 0; pages without outgoing
    weight spread theirs evenly. A job ends when none of its ranks moves by
    ``tolerance`` or after ``rounds``. Jobs of at most ``one_task`` pages and
    edges are ranked in a task each; for larger ones the ranks are written to
    the shared folder in every round, which cuts the lineage.
    """
    scratch = Scratch(pages.sparkSession, "pagerank")
    merged = ranked_edges(edges, pages).groupBy("crawl_job_id", "u", "v").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("w")).where("w > 0")
    total = merged.groupBy("crawl_job_id", "u").agg(F.sum("w").alias("total"))
    moves = scratch.keep(merged.join(total, ["crawl_job_id", "u"]).select("crawl_job_id", "u", "v", (F.col("w") / F.col("total")).alias("p")))
    nodes = scratch.keep(pages.where("crawl_job_id is not null and id is not null").select("crawl_job_id", F.col("id").alias("page_id")).distinct())
    rows = nodes.select("crawl_job_id", F.col("page_id").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("p")).unionByName(moves)
    big = rows.groupBy("crawl_job_id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > one_task).select("crawl_job_id")
    small = rows.join(big, "crawl_job_id", "left_anti").groupBy("crawl_job_id").applyInPandas(_ranks_of_job(damping, rounds, tolerance), "crawl_job_id bigint, page_id bigint, pagerank double")
    if big.isEmpty():
        return small
    moves, nodes = moves.join(big, "crawl_job_id", "left_semi"), nodes.join(big, "crawl_job_id", "left_semi")
    size = nodes.groupBy("crawl_job_id").agg(F.count(F.lit(1)).alias("n"))
    spreads = moves.select("crawl_job_id", F.col("u").alias("page_id")).distinct().withColumn("spreads", F.lit(True))
    nodes = keyed_lookup(nodes, size, ["crawl_job_id"], "inner").join(spreads, ["crawl_job_id", "page_id"], "left")
    nodes = scratch.keep(nodes.select("crawl_job_id", "page_id", "n", F.coalesce("spreads", F.lit(False)).alias("spreads")))
    ranks = nodes.withColumn("pagerank", 1.0 / F.col("n"))
    kept = None
    for _ in range(rounds):
        # the ranks are read three times, so each round is written: a longer lazy chain would triple with every round
        dangling = ranks.groupBy("crawl_job_id").agg(F.coalesce(F.sum(F.when(~F.col("spreads"), F.col("pagerank"))), F.lit(0.0)).alias("dangling"))
        flows = moves.join(ranks.select("crawl_job_id", F.col("page_id").alias("u"), "pagerank"), ["crawl_job_id", "u"]).groupBy("crawl_job_id", F.col("v").alias("page_id")).agg(F.sum(F.col("p") * F.col("pagerank")).alias("flow"))
        joined = keyed_lookup(ranks.withColumnRenamed("pagerank", "old"), dangling, ["crawl_job_id"], "inner").join(flows, ["crawl_job_id", "page_id"], "left")
        rank = (1 - damping) / F.col("n") + damping * F.coalesce("flow", F.lit(0.0)) + damping * F.col("dangling") / F.col("n")
        written = scratch.keep(joined.select("crawl_job_id", "page_id", "n", "spreads", rank.alias("pagerank"), "old"))
        scratch.drop(kept)
        kept = written
        ranks = written.drop("old")
        moved = written.agg(F.max(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
        if moved is None or moved < tolerance:
            break
    return small.unionByName(ranks.select("crawl_job_id", "page_id", "pagerank"))


def _components_of_job(pdf):
    """Smallest linked ids over the rows of one job: (u, null) for pages, (u, v) for edges."""
    import numpy as np
    import pandas as pd

    nodes = np.sort(pdf.loc[pdf["v"].isna(), "u"].to_numpy())
    pairs = pdf[pdf["v"].notna()]
    parent = list(range(len(nodes)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(np.searchsorted(nodes, pairs["u"].to_numpy()).tolist(), np.searchsorted(nodes, pairs["v"].to_numpy(dtype="int64")).tolist()):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"crawl_job_id": pdf["crawl_job_id"].iloc[0], "page_id": nodes, "cluster_id": nodes[[top(x) for x in range(len(nodes))]] if len(nodes) else nodes})


def components(edges: DataFrame, pages: DataFrame, one_task: int = RANKED_IN_ONE_TASK) -> DataFrame:
    """(crawl_job_id, page_id, cluster_id): weakly connected pages share their smallest id; lone pages have their own.

    Jobs of at most ``one_task`` pages and edges are joined up in a task each.
    In larger ones smallest labels spread along edges and jump to their label's
    label, so that long chains take few rounds.
    """
    scratch = Scratch(pages.sparkSession, "components")
    e = scratch.keep(ranked_edges(edges, pages).select("crawl_job_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = scratch.keep(pages.where("crawl_job_id is not null and id is not null").select("crawl_job_id", F.col("id").alias("page_id")).distinct())
    rows = nodes.select("crawl_job_id", F.col("page_id").alias("u"), F.lit(None).cast("long").alias("v")).unionByName(e)
    big = rows.groupBy("crawl_job_id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > one_task).select("crawl_job_id")
    small = rows.join(big, "crawl_job_id", "left_anti").groupBy("crawl_job_id").applyInPandas(_components_of_job, "crawl_job_id bigint, page_id bigint, cluster_id bigint")
    if big.isEmpty():
        return small
    e = e.join(big, "crawl_job_id", "left_semi")
    both = scratch.keep(e.unionByName(e.select("crawl_job_id", F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = scratch.keep(nodes.join(big, "crawl_job_id", "left_semi").select("crawl_job_id", "page_id", F.col("page_id").alias("label")))
    while True:
        near = both.join(labels.select("crawl_job_id", F.col("page_id").alias("v"), "label"), ["crawl_job_id", "v"]).groupBy("crawl_job_id", F.col("u").alias("page_id")).agg(F.min("label").alias("near"))
        spread = labels.join(near, ["crawl_job_id", "page_id"], "left").select("crawl_job_id", "page_id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = spread.select("crawl_job_id", F.col("page_id").alias("label"), F.col("label").alias("jumped"))
        # a giant component is one label: its pages look it up by broadcast
        fresh = scratch.keep(keyed_lookup(spread, jump, ["crawl_job_id", "label"], "inner").select("crawl_job_id", "page_id", "old", F.col("jumped").alias("label")))
        changed = not fresh.where("label <> old").isEmpty()
        scratch.drop(labels)
        labels = fresh
        if not changed:
            return small.unionByName(labels.select("crawl_job_id", "page_id", F.col("label").alias("cluster_id")))


def shortest_path_shares(nodes: list[int], neighbors: dict[int, list[int]]) -> dict[int, float]:
    """Unweighted, undirected betweenness, each pair counted once."""
    score = dict.fromkeys(nodes, 0.0)
    for start in nodes:
        paths, distance = defaultdict(float), {start: 0}
        paths[start] = 1.0
        order, queue = [], deque([start])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in neighbors.get(v, ()):
                if w not in distance:
                    distance[w] = distance[v] + 1
                    queue.append(w)
                if distance[w] == distance[v] + 1:
                    paths[w] += paths[v]
        share = defaultdict(float)
        for w in reversed(order):
            for v in neighbors.get(w, ()):
                if distance.get(v, -1) == distance[w] - 1:
                    share[v] += paths[v] / paths[w] * (1.0 + share[w])
            if w != start:
                score[w] += share[w]
    return {v: s / 2.0 for v, s in score.items()}


def betweenness(edges: DataFrame, pages: DataFrame, max_pages: int = DEFAULTS.betweenness_max_pages) -> DataFrame:
    """(crawl_job_id, page_id, betweenness); null for jobs of more than ``max_pages`` pages, so a task holds a bounded graph."""
    size = pages.groupBy("crawl_job_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = pages.select("crawl_job_id", F.col("id").alias("u")).join(size, "crawl_job_id")
    small = nodes.where(F.col("n") <= max_pages).select("crawl_job_id", "u", F.lit(None).cast("long").alias("v"))
    pairs = ranked_edges(edges, pages).select("crawl_job_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(size.where(F.col("n") <= max_pages), "crawl_job_id", "left_semi")

    def paths(pdf):
        import pandas as pd

        ids = sorted(pdf.loc[pdf["v"].isna(), "u"].astype("int64"))
        near = defaultdict(list)
        for u, v in pdf.loc[pdf["v"].notna(), ["u", "v"]].astype("int64").itertuples(index=False):
            near[u].append(v)
            near[v].append(u)
        shares = shortest_path_shares(ids, near)
        return pd.DataFrame({"crawl_job_id": pdf["crawl_job_id"].iloc[0], "page_id": ids, "betweenness": [shares[i] for i in ids]})

    got = small.unionByName(pairs).groupBy("crawl_job_id").applyInPandas(paths, "crawl_job_id bigint, page_id bigint, betweenness double")
    none = nodes.where(F.col("n") > max_pages).select("crawl_job_id", F.col("u").alias("page_id"), F.lit(None).cast("double").alias("betweenness"))
    return got.unionByName(none)


def graph_metrics(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page's degrees, rank, betweenness and cluster."""
    key = ["crawl_job_id", "page_id"]
    return degrees(edges, pages).join(pagerank(edges, pages), key).join(betweenness(edges, pages), key, "left").join(components(edges, pages), key)


def undirected(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(crawl_job_id, a, b): different ends of each edge, both ways."""
    e = edges.where("source_page_id <> target_page_id")
    if types is not None:
        e = e.where(F.col("edge_type").isin(*types))
    e = e.select("crawl_job_id", F.col("source_page_id").alias("a"), F.col("target_page_id").alias("b"))
    return e.unionByName(e.select("crawl_job_id", F.col("b").alias("a"), F.col("a").alias("b")))


def reachable(edges: DataFrame, pages: DataFrame, seeds: list[int], crawl_job_id: int, radius: int, max_nodes: int, types: tuple[str, ...] | None = None) -> list[tuple[int, int]]:
    """(page_id, depth), sorted: pages within ``radius`` hops of the seeds, at most ``max_nodes`` (500).

    Each hop admits new pages by ascending id until the cap. The driver holds
    no more than the cap; a hop is one scan of the job's edges against a
    literal frontier.
    """
    if not 0 <= radius <= 50 or not 1 <= max_nodes <= 500:
        raise ValueError("radius must be 0..50, max_nodes 1..500")
    near = undirected(edges, types).where(F.col("crawl_job_id") == crawl_job_id)
    own = pages.where(F.col("crawl_job_id") == crawl_job_id).select(F.col("id").alias("b"))
    seen = {s: 0 for s in list(dict.fromkeys(seeds))[:max_nodes]}
    frontier = list(seen)
    for depth in range(1, radius + 1):
        room = max_nodes - len(seen)
        if room <= 0 or not frontier:
            break
        # of all new pages only the first few by id can be admitted
        step = near.where(F.col("a").isin(frontier)).select("b").where(~F.col("b").isin(list(seen))).distinct().join(own, "b", "left_semi").orderBy("b").limit(room)
        frontier = [r[0] for r in step.collect()]
        seen.update(dict.fromkeys(frontier, depth))
    return sorted(seen.items())


def explored(edges: DataFrame, pages: DataFrame, seeds: list[int], crawl_job_id: int, radius: int = 1, max_nodes: int = 100) -> list[tuple[int, int]]:
    """``reachable`` from ordered seeds along the kinds of edges that explore."""
    return reachable(edges, pages, seeds, crawl_job_id, radius, max_nodes, EXPLORED_TYPES)


def induced_edges(edges: DataFrame, nodes: list[int], crawl_job_id: int) -> DataFrame:
    """The job's edges with both ends among the nodes, by source, target and type."""
    return edges.where((F.col("crawl_job_id") == crawl_job_id) & F.col("source_page_id").isin(nodes) & F.col("target_page_id").isin(nodes)).orderBy("source_page_id", "target_page_id", "edge_type", "id")


def subgraph_nodes(pages: DataFrame, metrics: DataFrame, depths: list[tuple[int, int]]) -> DataFrame:
    """The reached pages with depth and, where known, degrees, rank and cluster."""
    spark = pages.sparkSession
    reached = spark.createDataFrame(depths, "page_id bigint, hops int")
    return F.broadcast(reached).join(pages.select(F.col("id").alias("page_id"), "url", "title", "domain"), "page_id").join(metrics.drop("crawl_job_id"), "page_id", "left").orderBy("page_id")


def graph_stats(edges: DataFrame, pages: DataFrame, clusters: DataFrame) -> DataFrame:
    """(crawl_job_id, pages, edges, edge_types, clusters, largest_cluster) of every job with pages."""
    types = edges.groupBy("crawl_job_id", "edge_type").agg(F.count(F.lit(1)).alias("n")).groupBy("crawl_job_id").agg(F.sum("n").alias("edges"), F.array_sort(F.collect_list(F.struct("edge_type", "n"))).alias("edge_types"))
    sizes = clusters.groupBy("crawl_job_id", "cluster_id").agg(F.count(F.lit(1)).alias("n")).groupBy("crawl_job_id").agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest_cluster"))
    return pages.groupBy("crawl_job_id").agg(F.count(F.lit(1)).alias("pages")).join(types, "crawl_job_id", "left").join(sizes, "crawl_job_id", "left")


def clusters_page(clusters: DataFrame, crawl_job_id: int, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """One page of a job's cluster rows by cluster and page, and the total."""
    own = clusters.where(F.col("crawl_job_id") == crawl_job_id)
    return own.orderBy("cluster_id", "page_id").offset(offset).limit(limit), own.agg(F.count(F.lit(1)).alias("total"))


def best_job(ranked: DataFrame, jobs: DataFrame) -> DataFrame:
    """(crawl_job_id, total_score, hits): the job with the highest total of the ranked pool; ties by hits, then newest, then id."""
    pooled = ranked.groupBy("crawl_job_id").agg(F.sum("score").alias("total_score"), F.count(F.lit(1)).alias("hits"))
    known = pooled.join(jobs.select(F.col("id").alias("crawl_job_id"), "created_at"), "crawl_job_id")
    return known.orderBy(F.desc("total_score"), F.desc("hits"), F.desc_nulls_last("created_at"), F.desc("crawl_job_id")).limit(1).drop("created_at")


def graph_query(index, pages: DataFrame, edges: DataFrame, jobs: DataFrame, query: str, crawl_job_id: int | None = None, radius: int = 1, max_nodes: int = 100, max_seed_pages: int = 10) -> DataFrame:
    """Pages around a query's best matches: (page_id, crawl_job_id, hops, role, score).

    Roles: query_match for seeds, duplicate for near-duplicates of a seed,
    related_neighbor for the others. Without a job the best one is chosen.
    """
    from webloom.operators.search import ranked_pages

    spark = pages.sparkSession
    empty = "page_id bigint, crawl_job_id bigint, hops int, role string, score double"
    pool = ranked_pages(index, query, crawl_job_id, DEFAULTS.query_pool)
    if crawl_job_id is None:
        job = best_job(pool, jobs).first()
        if job is None:
            return spark.createDataFrame([], empty)
        crawl_job_id = job["crawl_job_id"]
    hits = pool.where(F.col("crawl_job_id") == crawl_job_id).orderBy(F.desc("score"), "page_id").limit(max_seed_pages).collect()
    if not hits:
        return spark.createDataFrame([], empty)
    scores = {r["page_id"]: r["score"] for r in hits}
    depths = explored(edges, pages, list(scores), crawl_job_id, radius, max_nodes)
    nodes = [p for p, _ in depths]
    near = undirected(edges, ("near_duplicate",)).where((F.col("crawl_job_id") == crawl_job_id) & F.col("a").isin(list(scores)) & F.col("b").isin(nodes)).select("b").distinct().collect()
    copies = {r[0] for r in near}
    role = lambda p: "query_match" if p in scores else "duplicate" if p in copies else "related_neighbor"
    return spark.createDataFrame([(p, crawl_job_id, d, role(p), scores.get(p)) for p, d in depths], empty)


def ranked_related(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Related nodes in order: depth, heaviest edge to a match, rank, id."""
    matches = nodes.where("role = 'query_match'").select("page_id")
    near = undirected_weights(edges).join(F.broadcast(matches.withColumnRenamed("page_id", "a")), "a", "left_semi").groupBy(F.col("b").alias("page_id")).agg(F.max("weight").alias("to_match"))
    order = Window.orderBy("hops", F.desc(F.coalesce("to_match", F.lit(0.0))), F.desc_nulls_last("pagerank"), "page_id")
    return nodes.where("role <> 'query_match'").join(near, "page_id", "left").withColumn("place", F.row_number().over(order))


def undirected_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight) both ways, the heaviest edge of any type."""
    e = edges.where("source_page_id <> target_page_id").groupBy(F.least("source_page_id", "target_page_id").alias("a"), F.greatest("source_page_id", "target_page_id").alias("b")).agg(F.max("weight").alias("weight"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
