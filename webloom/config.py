"""Settings of the engine. The defaults are fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    k1: float = 1.5
    b: float = 0.75
    title_weight: int = 3
    snippet_chars: int = 200
    snippet_lead: int = 40
    important_terms: int = 20
    shared_terms: int = 40
    similarity_top_k: int = 10
    similarity_min_score: float = 0.15
    near_duplicate_min: float = 0.92
    hierarchy_weight: float = 0.9
    damping: float = 0.85
    pagerank_rounds: int = 500
    pagerank_tolerance: float = 1e-12
    betweenness_max_pages: int = 500
    rerank_seeds: int = 15
    rerank_candidates: int = 200
    rerank_pool: int = 5000
    query_pool: int = 50
    weight_bm25: float = 1.0
    weight_pagerank: float = 0.12
    weight_neighbors: float = 0.18
    weight_duplicates: float = 0.25
    max_body_bytes: int = 5_242_880
    stale_minutes: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.rerank_seeds <= self.rerank_candidates <= 2000:
            raise ValueError("seeds must be at most the candidates, and those at most 2000")
        if not 0 <= self.similarity_min_score <= 1 or not 0 <= self.near_duplicate_min <= 1:
            raise ValueError("similarities lie between 0 and 1")


DEFAULTS = Settings()

# Kinds of edges, those that explore, those that carry rank, and their order of importance.
EDGE_TYPES = ("link", "content_similarity", "url_hierarchy", "shared_terms", "near_duplicate", "co_ranked", "manual")
EXPLORED_TYPES = ("link", "url_hierarchy", "content_similarity")
RANKED_TYPES = ("link", "url_hierarchy")
EDGE_PRIORITY = {"near_duplicate": 0, "link": 1, "url_hierarchy": 2, "content_similarity": 3, "semantic_similarity": 4, "co_ranked": 5, "shared_terms": 6, "manual": 7}
JOB_STATUSES = ("queued", "pending", "running", "completed", "failed", "cancelled")
