"""Table schemas."""

from __future__ import annotations

CRAWL_JOBS = "id bigint, seed_url string, normalized_seed_url string, status string, max_pages int, max_depth int, same_domain_only boolean, pages_crawled int, pages_indexed int, pages_failed int, created_at timestamp, started_at timestamp, finished_at timestamp, error_message string"
PAGES = "id bigint, crawl_job_id bigint, url string, normalized_url string, domain string, title string, raw_html_hash string, content_hash string, extracted_text string, status_code int, depth int, fetched_at timestamp, indexed_at timestamp, token_count int, fetch_duration_ms int, created_at timestamp"
PAGE_LINKS = "id bigint, crawl_job_id bigint, source_page_id bigint, target_normalized_url string, target_page_id bigint, depth int, is_crawl_eligible boolean"
CRAWL_ERRORS = "id bigint, crawl_job_id bigint, url string, final_url string, normalized_url string, error_type string, error_message string, status_code int, content_type string, retry_count int, fetch_duration_ms int, created_at timestamp, updated_at timestamp"
TERMS = "id bigint, term string, document_frequency bigint"
INVERTED_INDEX = "term string, page_id bigint, crawl_job_id bigint, term_frequency bigint"
EVIDENCE = "struct<source: string, child_path: string, parent_path: string, kind: string, content_hash: string, similarity: double, shared_terms: array<string>>"
EDGES = f"crawl_job_id bigint, source_page_id bigint, target_page_id bigint, edge_type string, weight double, evidence {EVIDENCE}"
PAGE_GRAPH_CLUSTERS = "crawl_job_id bigint, page_id bigint, cluster_id bigint, cluster_label string"
PAGE_GRAPH_METRICS = "crawl_job_id bigint, page_id bigint, pagerank double, in_degree bigint, out_degree bigint, betweenness double, closeness double"
SEARCH_QUERIES = "id bigint, query string, result_count int, latency_ms int, created_at timestamp"
PAGE_GRAPH_EDGES = "id bigint, crawl_job_id bigint, source_page_id bigint, target_page_id bigint, edge_type string, weight double, evidence string, created_at timestamp, updated_at timestamp"
