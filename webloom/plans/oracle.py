"""SQL counterparts of the registered queries, for an independent engine."""

from __future__ import annotations

QUERY, WORDS, JOB = "crawler index crawler budget", "query index cache", 1

# Words that are no search terms, stated anew so that the SQL stands by itself.
_STOP_WORDS = (
    "a an and are as at be but by for from has have he her hers him his i if in into is it its me my not of on or our ours she so "
    "that the their theirs them then there these they this those to too us was we were what when where which who will with you your yours"
)
_STOP = "(" + ",".join(f"'{w}'" for w in _STOP_WORDS.split()) + ")"


def _fold(c: str) -> str:
    return f"replace(replace(lower(nfc_normalize(coalesce({c}, ''))), 'ß', 'ss'), 'ſ', 's')"


def _terms(c: str, min_len: int = 2, numbers: bool = False, stop: tuple[str, ...] = ()) -> str:
    words = f"string_split(regexp_replace({_fold(c)}, '[^0-9a-z]+', ' ', 'g'), ' ')"
    extra = "".join(f" and x <> '{w}'" for w in stop)
    digits = "" if numbers else " and not regexp_full_match(x, '[0-9]*')"
    return f"list_filter({words}, lambda x: length(x) >= {min_len} and x not in {_STOP}{extra}{digits})"


_PAGES = f"""
toks as (select id as page_id, crawl_job_id, content_hash, list_concat(list_concat({_terms('extracted_text')}, {_terms('title')}), list_concat({_terms('title')}, {_terms('title')})) as terms from pages),
cnt as (select *, len(terms) as own_count from toks),
keep as (select crawl_job_id, content_hash, min(page_id) as keeper from cnt where own_count > 0 and content_hash is not null group by all),
live as (select c.*, (k.keeper is null or c.page_id <= k.keeper) as live from cnt c left join keep k on c.crawl_job_id = k.crawl_job_id and c.content_hash = k.content_hash),
lens as (select crawl_job_id, page_id, case when live then own_count else 0 end as token_count, live from live),
post as (select crawl_job_id, page_id, term, count(*) as tf from (select crawl_job_id, page_id, unnest(terms) as term from live where live) group by all)
"""


def _asked(query: str) -> str:
    from collections import Counter

    rows = ", ".join(f"('{w}', {n})" for w, n in sorted(Counter(query.split()).items()))
    return f"asked as (select * from (values {rows}) v(term, times))"


def _bm25(query: str, job: int | None) -> str:
    scope = f"where crawl_job_id = {job}" if job is not None else "where true"
    return f"""{_PAGES}, {_asked(query)},
st as (select count(*) as n, coalesce(avg(token_count), 0) as avgdl from lens {scope} and token_count > 0),
hit as (select p.* from post p join asked a on a.term = p.term {scope}),
df as (select term, count(*) as df from hit group by term),
sc as (select h.page_id, h.crawl_job_id, h.term, a.times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l.token_count / avgdl)) as s
       from hit h join df using (term) join asked a using (term) join lens l on l.page_id = h.page_id cross join st where l.token_count > 0 and ln(1 + (n - df + 0.5) / (df + 0.5)) > 0),
ranked as (select page_id, crawl_job_id, sum(s) as score, string_agg(term, ' ' order by term) as matched_terms from sc group by all)"""


_HITS = f"{_bm25(WORDS, JOB)}, hits as (select page_id, rank from (select page_id, row_number() over (order by score desc, page_id) as rank from ranked) where rank <= 100)"

_RANKED_EDGES = """
re as (select e.crawl_job_id, e.source_page_id as u, e.target_page_id as v, e.weight from page_graph_edges e
       join pages a on a.id = e.source_page_id and a.crawl_job_id = e.crawl_job_id
       join pages b on b.id = e.target_page_id and b.crawl_job_id = e.crawl_job_id
       where e.edge_type in ('link', 'url_hierarchy') and e.source_page_id <> e.target_page_id)"""

_BOTH = "both_ as (select crawl_job_id, u as a, v as b from re union select crawl_job_id, v, u from re)"
_CLUSTERS = f"""{_RANKED_EDGES}, {_BOTH},
reach(crawl_job_id, page_id, m) as (select crawl_job_id, id, id from pages union select r.crawl_job_id, b.b, r.m from reach r join both_ b on b.crawl_job_id = r.crawl_job_id and b.a = r.page_id where r.m < b.b),
clusters as (select crawl_job_id, page_id, min(m) as cluster_id from reach group by all)"""


def _pagerank(only: str = "") -> str:
    return f"""{_RANKED_EDGES},
mg as (select crawl_job_id, u, v, sum(greatest(weight, 0)) as w from re group by all having sum(greatest(weight, 0)) > 0),
mv as (select m.crawl_job_id, u, v, w / t.total as p from mg m join (select crawl_job_id, u, sum(w) as total from mg group by all) t using (crawl_job_id, u)),
nd as (select p.crawl_job_id, p.id as page_id, s.n, exists (select 1 from mv where mv.crawl_job_id = p.crawl_job_id and mv.u = p.id) as spreads
       from pages p join (select crawl_job_id, count(*) as n from pages group by all) s using (crawl_job_id) {only}),
pr(k, crawl_job_id, page_id, n, spreads, r) as (
  select 0, crawl_job_id, page_id, n, spreads, 1.0::double / n from nd
  union all
  select c.k + 1, c.crawl_job_id, c.page_id, c.n, c.spreads,
    0.15 / c.n + 0.85 * coalesce(f.flow, 0) + 0.85 * coalesce(d.dangling, 0) / c.n
  from pr c
  left join (select q.crawl_job_id, mv.v, sum(mv.p * q.r) as flow from pr q join mv on mv.crawl_job_id = q.crawl_job_id and mv.u = q.page_id group by all) f on f.crawl_job_id = c.crawl_job_id and f.v = c.page_id
  left join (select crawl_job_id, sum(r) as dangling from pr where not spreads group by all) d on d.crawl_job_id = c.crawl_job_id
  where c.k < 200)"""


_DEGREES = f"""{_RANKED_EDGES},
deg as (select p.crawl_job_id, p.id as page_id, (select count(*) from re where re.v = p.id and re.crawl_job_id = p.crawl_job_id) as in_degree, (select count(*) from re where re.u = p.id and re.crawl_job_id = p.crawl_job_id) as out_degree from pages p)"""

_TFIDF = f"""{_PAGES},
dn as (select crawl_job_id, count(distinct page_id) as n from post group by all having count(distinct page_id) >= 2),
tdf as (select crawl_job_id, term, count(*) as df, min(page_id) as first_page from post group by all),
w as (select p.crawl_job_id, p.page_id, p.term, tf * ln((n + 1) / (df + 1)) as w, first_page from post p join dn using (crawl_job_id) join tdf using (crawl_job_id, term)),
nrm as (select crawl_job_id, page_id, sqrt(sum(w * w)) as norm from w group by all),
imp as (select crawl_job_id, page_id, term from w qualify row_number() over (partition by crawl_job_id, page_id order by w desc, first_page, term) <= 20)"""


def _pairs(on: str, least: float) -> str:
    return f"""cand as (select distinct i.crawl_job_id, i.page_id as s, t.page_id as t from imp i join w t on t.crawl_job_id = i.crawl_job_id and t.term = i.term and {on}),
prs as (select c.crawl_job_id, c.s, c.t, sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)) as score, count(*) as shared
        from cand c join w a on a.crawl_job_id = c.crawl_job_id and a.page_id = c.s join w b on b.crawl_job_id = c.crawl_job_id and b.page_id = c.t and b.term = a.term
        join nrm na on na.crawl_job_id = c.crawl_job_id and na.page_id = c.s join nrm nb on nb.crawl_job_id = c.crawl_job_id and nb.page_id = c.t
        where na.norm > 0 and nb.norm > 0 group by all having sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)) >= {least})"""


_INBOUND = """lastp as (select crawl_job_id, normalized_url as url, max(id) as page_id from pages group by all),
inb as (select crawl_job_id, page_id, count(*) as inbound from (
   select crawl_job_id, target_page_id as page_id from page_links where target_page_id is not null
   union all select l.crawl_job_id, p.page_id from page_links l join lastp p on p.crawl_job_id = l.crawl_job_id and p.url = trim(l.target_normalized_url) where l.target_page_id is null) group by all),
ord as (select p.*, row_number() over (order by length(normalized_url), -coalesce(inbound, 0), trim(coalesce(title, '')) = '', -length(trim(coalesce(title, ''))), trim(coalesce(title, '')), fetched_at is null, fetched_at nulls first, id) as o
        from pages p left join inb i on i.crawl_job_id = p.crawl_job_id and i.page_id = p.id)"""

_CANON = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({u}, '#.*$', ''), '[?].*$', ''), ':443(/|$)', '\1'), '/+$', '')"""
_HOST = r"lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#:]+)', 1))"


def _canonical(u: str) -> str:
    """Canonical form of https addresses with plain paths and parameters."""
    path = rf"regexp_extract({u}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
    kept = rf"list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^utm_(source|medium|campaign|term|content)=')))"
    return rf"""'https://' || {_HOST.format(u=u)} || case when rtrim({path}, '/') = '' then '/' else rtrim({path}, '/') end || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end"""


_PARENT = r"""case when regexp_replace({p}, '/+$', '') = '' then null else 'https://' || {h} || coalesce(nullif(regexp_replace(regexp_replace({p}, '/+$', ''), '/[^/]*$', ''), ''), '/') end""".format(
    p=r"regexp_extract(normalized_url, '^https://[^/?#]+([^?#]*)', 1)", h=r"regexp_extract(normalized_url, '^https://([^/?#]+)', 1)"
)
_PATH = r"coalesce(nullif(regexp_replace(regexp_extract({u}, '^https://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/')"

_CENTER = f"""und as (select source_page_id as a, target_page_id as b from page_graph_edges where crawl_job_id = {JOB} and source_page_id <> target_page_id
  union all select target_page_id, source_page_id from page_graph_edges where crawl_job_id = {JOB} and source_page_id <> target_page_id),
ctr as (select a from und join pages p on p.id = und.a and p.crawl_job_id = {JOB} group by a order by count(*) desc, a limit 1),
h1 as (select distinct b from und join ctr using (a) join pages p on p.id = b and p.crawl_job_id = {JOB}),
h2 as (select distinct u.b from und u join h1 on h1.b = u.a join pages p on p.id = u.b and p.crawl_job_id = {JOB}),
reached as (select page_id, min(hops) as hops from (select a as page_id, 0 as hops from ctr union all select b, 1 from h1 union all select b, 2 from h2) group by 1)"""

SQL: dict[str, str] = {
    "tokenize_pages": f"with x as (select id, {_terms('extracted_text')} as terms from pages) select id, len(terms) as n_terms, array_to_string(terms, ' ') as terms from x",
    "tokenize_documents": f"with x as (select doc_id, {_terms('text', 3, True, ('cache',))} as terms from documents) select doc_id, len(terms) as n_terms, md5(array_to_string(terms, ' ')) as terms_md5 from x",
    "index_postings": f"with {_PAGES} select * from post",
    "term_df": f"with {_PAGES} select term, count(*) as document_frequency from post group by term",
    "page_lengths": f"with {_PAGES} select crawl_job_id, page_id, token_count::int as token_count, live from lens",
    "dedupe_first_per_hash": f"with {_PAGES} select crawl_job_id, page_id, content_hash from live where not live",
    "corpus_stats": f"with {_PAGES} select crawl_job_id, count(*) as n_docs, round(avg(token_count), 6) as avg_length from lens where token_count > 0 group by crawl_job_id",
    "pages_indexed_by_job": f"with {_PAGES} select crawl_job_id, count(*) filter (where live) as pages_indexed from lens group by crawl_job_id",
    "bm25_scoped": f"with {_bm25(QUERY, JOB)} select page_id, crawl_job_id, round(score, 6) as score, matched_terms from ranked",
    "bm25_global": f"with {_bm25(QUERY, None)} select page_id, crawl_job_id, round(score, 6) as score, matched_terms from ranked",
    "search_global_top": f"""with {_bm25(QUERY, None)}, pool as (select * from ranked order by score desc, page_id limit 100),
        one as (select pool.*, p.url from pool join pages p on p.id = pool.page_id qualify row_number() over (partition by url order by score desc, page_id) = 1)
        select row_number() over (order by score desc, page_id)::int as rank, page_id, url, matched_terms from one order by score desc, page_id limit 20""",
    "related_neighbors": f"""with {_HITS},
        bw as (select source_page_id as page_id, target_page_id as other_id, edge_type, weight, id from page_graph_edges where crawl_job_id = {JOB} and source_page_id <> target_page_id
               union all select target_page_id, source_page_id, edge_type, weight, id from page_graph_edges where crawl_job_id = {JOB} and source_page_id <> target_page_id),
        pk as (select b.*, row_number() over (partition by page_id, other_id order by case edge_type when 'near_duplicate' then 0 when 'link' then 1 when 'url_hierarchy' then 2 when 'content_similarity' then 3 when 'semantic_similarity' then 4 when 'co_ranked' then 5 when 'shared_terms' then 6 when 'manual' then 7 else 99 end, -weight, id) as k
               from bw b where page_id in (select page_id from hits)),
        pr as (select page_id, other_id, max(edge_type) filter (where k = 1) as edge_type, max(weight) filter (where k = 1) as weight from pk group by all),
        al as (select p.page_id, p.other_id, string_agg(distinct k.edge_type, ',' order by k.edge_type) as also from pr p join pk k on k.page_id = p.page_id and k.other_id = p.other_id and k.edge_type <> p.edge_type group by all)
        select p.page_id, p.other_id, p.edge_type, round(p.weight, 6) as weight, coalesce(al.also, '') as also_related_by, row_number() over (partition by p.page_id order by p.weight desc, p.other_id) as place
        from pr p left join al on al.page_id = p.page_id and al.other_id = p.other_id qualify row_number() over (partition by p.page_id order by p.weight desc, p.other_id) <= 3""",
    "duplicate_variants": f"""with {_HITS}, nd as (select source_page_id as a, target_page_id as b from page_graph_edges where crawl_job_id = {JOB} and edge_type = 'near_duplicate' and source_page_id <> target_page_id),
        bw as (select a, b from nd union select b, a from nd)
        select h.page_id, arg_min(o.page_id, o.rank) as canonical_id from bw join hits h on h.page_id = bw.a join hits o on o.page_id = bw.b where o.rank < h.rank group by h.page_id""",
    "duplicate_collapse": f"""with {_HITS}, nd as (select source_page_id as a, target_page_id as b from page_graph_edges where crawl_job_id = {JOB} and edge_type = 'near_duplicate' and source_page_id <> target_page_id),
        bw as (select a, b from nd union select b, a from nd),
        va as (select h.page_id, any_value(h.rank) as rank, arg_min(o.page_id, o.rank) as canonical_id from bw join hits h on h.page_id = bw.a join hits o on o.page_id = bw.b where o.rank < h.rank group by h.page_id)
        select h.rank, h.page_id, coalesce((select string_agg(v.page_id::varchar, ',' order by v.rank) from va v where v.canonical_id = h.page_id), '') as variants from hits h where h.page_id not in (select page_id from va)""",
    "normalize_urls": "select id, normalized_url as canonical from pages",
    "normalize_link_urls": f"select distinct target_normalized_url, {_canonical('target_normalized_url')} as canonical from page_links",
    "url_parts": f"select id, {_HOST.format(u='normalized_url')} as host, {_PARENT} as parent, {_PATH.format(u='normalized_url')} as path from pages",
    "extract_html": r"""select id, trim(coalesce(title, '')) as title,
        md5(trim(regexp_replace(trim(coalesce(title, '')) || ' ' || coalesce(extracted_text, '') || ' self x', '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{85}\x{2028}\x{2029}\x{1680}]+', ' ', 'g'))) as text_md5, normalized_url as links from pages where url is not null""",
    "link_edges": """with first_ as (select crawl_job_id, normalized_url, min(id) as id from pages where normalized_url is not null group by all)
        select distinct l.crawl_job_id, l.source_page_id, p.id as target_page_id, 'link' as edge_type, 1.0::double as weight from page_links l join first_ p on p.crawl_job_id = l.crawl_job_id and p.normalized_url = l.target_normalized_url where l.source_page_id <> p.id""",
    "url_hierarchy_edges": f"""with first_ as (select crawl_job_id, normalized_url, min(id) as id from pages where normalized_url is not null group by all),
        ch as (select crawl_job_id, id, normalized_url, {_PARENT} as parent from pages)
        select c.crawl_job_id, p.id as source_page_id, c.id as target_page_id, 0.9::double as weight, {_PATH.format(u='c.normalized_url')} as child_path, {_PATH.format(u='c.parent')} as parent_path from ch c join first_ p on p.crawl_job_id = c.crawl_job_id and p.normalized_url = c.parent where p.id <> c.id""",
    "url_hierarchy_site_tree": f"""with nr as (select n_nationkey, lower(n_name) as n, replace(lower(r_name), ' ', '-') as r, r_regionkey from nation join region on r_regionkey = n_regionkey),
        tree as (select 1::bigint as id, 'https://shop.example/' as normalized_url union all select 10 + r_regionkey, 'https://shop.example/' || replace(lower(r_name), ' ', '-') from region
          union all select 100 + n_nationkey, 'https://shop.example/' || r || '/' || n from nr union all select 1000 + c_custkey, 'https://shop.example/' || r || '/' || n || '/' || c_custkey from customer join nr on n_nationkey = c_nationkey),
        ch as (select id, normalized_url, {_PARENT} as parent from tree)
        select p.id as source_page_id, c.id as target_page_id, 0.9::double as weight, {_PATH.format(u='c.normalized_url')} as child_path, {_PATH.format(u='c.parent')} as parent_path from ch c join tree p on p.normalized_url = c.parent""",
    "content_similarity_edges": f"""with {_TFIDF}, {_pairs('i.page_id <> t.page_id', 0.15)}
        select crawl_job_id, s as source_page_id, t as target_page_id, round(score, 6) as weight, least(shared, 40) as n_shared from prs qualify row_number() over (partition by crawl_job_id, s order by score desc, t) <= 10""",
    "near_duplicate_hash_edges": f"""with {_INBOUND}, f as (select crawl_job_id, content_hash, arg_min(id, o) as c from ord where content_hash is not null group by all having count(*) > 1)
        select p.crawl_job_id, f.c as source_page_id, p.id as target_page_id, 'near_duplicate' as edge_type, 1.0::double as weight from pages p join f on f.crawl_job_id = p.crawl_job_id and f.content_hash = p.content_hash where p.id <> f.c""",
    "near_duplicate_similarity_edges": f"""with {_INBOUND}, {_TFIDF}, {_pairs('i.page_id < t.page_id', 0.92)}
        select x.crawl_job_id, case when b.o < a.o then x.t else x.s end as source_page_id, case when b.o < a.o then x.s else x.t end as target_page_id, 'near_duplicate' as edge_type, round(score, 6) as weight
        from prs x join ord a on a.id = x.s join ord b on b.id = x.t where a.content_hash is null or b.content_hash is null or a.content_hash <> b.content_hash""",
    "edge_insert_if_absent": """with first_ as (select crawl_job_id, normalized_url, min(id) as id from pages where normalized_url is not null group by all)
        select distinct l.crawl_job_id, l.source_page_id, p.id as target_page_id, 'link' as edge_type from page_links l join first_ p on p.crawl_job_id = l.crawl_job_id and p.normalized_url = l.target_normalized_url
        where l.source_page_id <> p.id and not exists (select 1 from page_graph_edges e where e.crawl_job_id = l.crawl_job_id and e.source_page_id = l.source_page_id and e.target_page_id = p.id and e.edge_type = 'link')""",
    "edge_reason": r"""with x as (select id, edge_type as t, weight, case when json_type(evidence) = 'OBJECT' then evidence end as ev from page_graph_edges),
        y as (select *, printf('%.3f', (ev->>'$.similarity')::double) as sim, (select string_agg(s, ', ' order by s) from (select distinct unnest(from_json(ev->'$.shared_terms', '["VARCHAR"]')) as s order by s limit 5)) as terms,
          case when weight is null then 'unknown' else regexp_replace(regexp_replace(printf('%.4g', weight), '(\.[0-9]*?)0+$', '\1'), '\.$', '') end as strength from x)
        select id, case when t = 'link' then 'Direct link between these pages.'
          when t = 'url_hierarchy' then 'Same URL hierarchy. One page appears to be a parent or child of the other.' || case when ev->>'$.parent_path' is not null and ev->>'$.child_path' is not null then ' Paths: parent ' || (ev->>'$.parent_path') || ' → child ' || (ev->>'$.child_path') || '.' else '' end
          when t = 'content_similarity' then 'Similar page content' || coalesce(' (similarity ' || sim || ')', '') || '.' || case when coalesce(terms, '') <> '' then ' Shared terms: ' || terms || '.' else '' end
          when t = 'near_duplicate' and ev->>'$.kind' = 'content_hash_match' then 'Near duplicate. These pages have the same extracted content hash.'
          when t = 'near_duplicate' and ev->>'$.kind' = 'high_similarity' then 'Near duplicate. Very high content similarity' || coalesce(' (similarity ' || sim || ')', '') || '.'
          else 'Related by ' || t || ' with strength ' || strength || '.' end as reason from y""",
    "graph_degrees": f"with {_DEGREES} select crawl_job_id, page_id, in_degree, out_degree from deg",
    "graph_pagerank": f"with recursive {_pagerank()} select crawl_job_id, page_id, round(r, 9) as pagerank from pr where k = 200",
    "graph_wcc": f"with recursive {_CLUSTERS} select * from clusters",
    "bfs_bounded": f"with {_CENTER} select page_id, hops::int as hops from reached",
    "induced_subgraph": f"with {_CENTER} select id, source_page_id, target_page_id, edge_type from page_graph_edges where crawl_job_id = {JOB} and source_page_id in (select page_id from reached) and target_page_id in (select page_id from reached)",
    "graph_stats": f"""with recursive {_CLUSTERS},
        et as (select crawl_job_id, sum(n)::bigint as edges, string_agg(edge_type || '=' || n, ',' order by edge_type) as edge_types from (select crawl_job_id, edge_type, count(*) as n from page_graph_edges group by all) group by crawl_job_id),
        cs as (select crawl_job_id, count(*) as clusters, max(n) as largest_cluster from (select crawl_job_id, cluster_id, count(*) as n from clusters group by all) group by crawl_job_id)
        select p.crawl_job_id, count(*) as pages, any_value(et.edges) as edges, any_value(et.edge_types) as edge_types, any_value(cs.clusters) as clusters, any_value(cs.largest_cluster) as largest_cluster from pages p left join et using (crawl_job_id) left join cs using (crawl_job_id) group by p.crawl_job_id""",
    "clusters_page": f"with recursive {_CLUSTERS} select page_id, cluster_id from clusters where crawl_job_id = {JOB} order by cluster_id, page_id limit 50 offset 5",
    "graph_query_best_job": f"""with {_bm25(QUERY, None)}, pool as (select * from ranked order by score desc, page_id limit 50)
        select p.crawl_job_id, round(sum(score), 6) as total_score, count(*) as hits from pool p join crawl_jobs j on j.id = p.crawl_job_id group by p.crawl_job_id, j.created_at order by sum(score) desc, count(*) desc, j.created_at desc nulls last, p.crawl_job_id desc limit 1""",
    "health_orphans": f"select id as page_id, url from pages p where crawl_job_id = {JOB} and not exists (select 1 from page_graph_edges e where e.crawl_job_id = {JOB} and (e.source_page_id = p.id or e.target_page_id = p.id))",
    "health_duplicate_clusters": f"""with e as (select *, row_number() over (partition by source_page_id order by weight, target_page_id, id) as k, count(*) over (partition by source_page_id) as copies from page_graph_edges where crawl_job_id = {JOB} and edge_type = 'near_duplicate')
        select source_page_id as canonical_id, any_value(copies) as copies, string_agg(target_page_id::varchar, ',' order by k) filter (where k <= 12) as neighbors from e group by source_page_id order by 2 desc, 1 limit 20""",
    "health_hubs": f"with {_DEGREES} select d.page_id, p.url, d.out_degree as value from deg d join pages p on p.id = d.page_id where d.crawl_job_id = {JOB} order by out_degree desc, d.page_id limit 15",
    "health_top_pagerank": f"with recursive {_pagerank(f'where p.crawl_job_id = {JOB}')} select page_id, p.url, round(r, 9) as value from pr join pages p on p.id = pr.page_id where k = 200 and pr.crawl_job_id = {JOB} order by r desc, page_id limit 15",
    "health_most_linked": f"select e.target_page_id as page_id, p.url, count(*) as links from page_graph_edges e join pages p on p.id = e.target_page_id and p.crawl_job_id = {JOB} where e.crawl_job_id = {JOB} and edge_type = 'link' group by all order by links desc, page_id limit 15",
    "health_clusters_large": f"""with recursive {_CLUSTERS}, big as (select cluster_id, count(*) as size, min(page_id) as smallest_page from clusters where crawl_job_id = {JOB} group by cluster_id order by size desc, cluster_id limit 12),
        few as (select c.cluster_id, p.url, row_number() over (partition by c.cluster_id order by c.page_id) as k from clusters c join pages p on p.id = c.page_id where c.crawl_job_id = {JOB})
        select b.cluster_id, b.size, b.smallest_page, (select string_agg(url, ' ' order by k) from few f where f.cluster_id = b.cluster_id and k <= 4) as sample_urls from big b""",
    "health_clusters_small": f"with recursive {_CLUSTERS} select cluster_id, count(*) as size from clusters where crawl_job_id = {JOB} group by cluster_id having count(*) <= 3 order by size, cluster_id limit 15",
    "stats_totals": """with p as (select count(*) as pages, count(indexed_at) as indexed, count(distinct domain) as domains, max(indexed_at) as last_indexed from pages),
        e as (select count(*) as errors, count(*) filter (where error_type = 'robots_disallow') as skipped, count(*) filter (where error_type in ('not_indexable', 'oversized')) as policy_rejected, count(distinct normalized_url) as failed_urls, count(*) filter (where status_code = 429) as rate_limited from crawl_errors)
        select pages, indexed, domains, errors, skipped, policy_rejected, failed_urls, rate_limited, pages + errors as attempted, greatest(0, errors - skipped - policy_rejected) as fetch_failures, round(pages / (pages + errors), 9) as success_rate, round(indexed / pages, 9) as index_coverage, last_indexed from p, e""",
    "stats_lengths": "select round(avg(token_count), 6) as mean_tokens, quantile_cont(token_count, 0.5) as median_tokens, round(quantile_cont(token_count, 0.95), 6) as p95_tokens from pages where indexed_at is not null and token_count > 0",
    "stats_fetch_latency": "select count(*) as fetches, round(avg(fetch_duration_ms), 6) as mean_ms, round(quantile_cont(fetch_duration_ms, 0.95), 6) as p95_ms from pages where fetch_duration_ms is not null",
    "stats_jobs": """select count(*) as jobs, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'running') as running, count(*) filter (where status = 'cancelled') as cancelled,
        round(avg(epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 3) as mean_seconds, round((select count(*) from pages) / count(*), 6) as pages_per_job from crawl_jobs""",
    "stats_searches": "select count(*) as searches, count(*) filter (where result_count = 0) as zero_results, count(*) filter (where result_count >= 20) as at_cap, round(avg(latency_ms), 6) as mean_ms, round(quantile_cont(latency_ms, 0.95), 6) as p95_ms, round(avg(result_count), 6) as mean_results, round(count(*) filter (where result_count = 0) / count(*), 6) as zero_rate from search_queries",
    "stats_top_queries": "select query, count(*) as searches from search_queries group by query order by searches desc, query limit 10",
    "stats_recent_zero": "select id, query, latency_ms, created_at from search_queries where result_count = 0 order by created_at desc, id desc limit 10",
    "stats_slowest_query": "select id, query, latency_ms from search_queries where latency_ms is not null order by latency_ms desc, id desc limit 1",
    "stats_largest_page": "select id, url, token_count from pages where indexed_at is not null and token_count > 0 order by token_count desc, id limit 1",
    "stats_top_domains": "select domain, count(*) as pages from pages where indexed_at is not null group by domain order by pages desc, domain limit 10",
    "stats_failures_by_type": "select error_type, count(*) as failures from crawl_errors group by error_type",
    "stats_recent_failed": "select id, url, error_type, status_code, created_at from crawl_errors order by created_at desc, id desc limit 10",
    "stats_failure_domains": "select lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)) as host, count(*) as failures from crawl_errors where regexp_matches(url, '(?i)^https?://[^/?#]') group by 1 order by failures desc, host limit 10",
    "stats_http_status": "select status_code, count(*) as responses from (select status_code from pages union all select status_code from crawl_errors) where status_code is not null group by status_code",
    "stats_http_classes": "select count(*) filter (where s between 200 and 299) as status_2xx, count(*) filter (where s between 300 and 399) as status_3xx, count(*) filter (where s between 400 and 499) as status_4xx, count(*) filter (where s between 500 and 599) as status_5xx from (select status_code as s from pages union all select status_code from crawl_errors)",
    "stats_skip_breakdown": """with l(error_type, label) as (values ('robots_disallow', 'Robots.txt disallow'), ('not_indexable', 'Not indexable (MIME / not page-like)'), ('oversized', 'Oversized response'), ('duplicate', 'Duplicate URL (same job — not stored as error today)'), ('off_domain', 'Off-domain (not scheduled — not stored as error today)'))
        select label, (select count(*) from crawl_errors e where e.error_type = l.error_type) as errors from l""",
    "stats_fetch_breakdown": """with c as (select error_type, count(*) as n from crawl_errors where error_type not in ('robots_disallow', 'not_indexable', 'oversized') group by error_type),
        r as (select count(*) as n from crawl_errors where status_code = 429), k(error_type) as (values ('timeout'), ('connect'), ('tls'), ('protocol'), ('redirect_error'), ('invalid_url'), ('parse_error'))
        select 'HTTP 429 (rate limited)' as label, n as errors from r union all select 'HTTP error (other status)', greatest(0, coalesce((select n from c where error_type = 'http_error'), 0) - (select n from r))
        union all select k.error_type, coalesce(c.n, 0) from k left join c using (error_type) union all select error_type, n from c where error_type <> 'http_error' and error_type not in (select error_type from k)""",
    "jobs_list": "select id, seed_url, status, created_at from crawl_jobs where status = 'completed' and (seed_url ilike '%docs%' or normalized_seed_url ilike '%docs%') order by created_at desc, id desc limit 50",
    "jobs_count": "select count(*) as total from crawl_jobs where status = 'completed' and (seed_url ilike '%example%' or normalized_seed_url ilike '%example%')",
    "job_details": "select j.id, j.status, coalesce(d.n, 0) as pages_discovered, round(least(1, pages_crawled / greatest(1, max_pages)), 9)::double as progress from crawl_jobs j left join (select crawl_job_id, count(distinct target_normalized_url) as n from page_links where is_crawl_eligible group by 1) d on d.crawl_job_id = j.id",
    "pages_page": f"select id, url, depth, status_code from pages where crawl_job_id = {JOB} order by depth, id limit 50 offset 10",
    "errors_page": f"select id, url, error_type, retry_count from crawl_errors where crawl_job_id = {JOB} order by created_at, id limit 50",
    "query_log_page": "select id, query, result_count from search_queries order by created_at desc, id desc limit 25 offset 5",
    "fetch_classify": """with x as (select id, status_code, lower(trim(split_part(coalesce(content_type, ''), ';', 1))) as media from crawl_errors)
        select id, media, case when status_code is null or status_code <> 200 then 'http_error' when media not in ('text/html', 'application/xhtml+xml', 'text/plain', 'text/markdown', 'text/x-markdown') then 'not_indexable' end as kind from x""",
    "robots_filter": "select id from pages where not (regexp_matches(normalized_url, '^https://docs[.]') and regexp_extract(normalized_url, '^https://[^/?#]+([^?#]*)', 1) like '/notes/%')",
    "frontier_round": "select crawl_job_id, target_normalized_url as url, min(depth) as depth from page_links l where is_crawl_eligible and depth <= 3 and not exists (select 1 from pages p where p.crawl_job_id = l.crawl_job_id and p.normalized_url = l.target_normalized_url) group by all",
    "frontier_eligibility": f"select distinct l.id, {_HOST.format(u='l.target_normalized_url')} <> '' and (not j.same_domain_only or {_HOST.format(u='l.target_normalized_url')} = {_HOST.format(u='j.normalized_seed_url')}) as eligible from page_links l join crawl_jobs j on j.id = l.crawl_job_id",
    "seed_lists": "select id, case when seed_url = normalized_seed_url then seed_url else seed_url || '|' || normalized_seed_url end as seeds from crawl_jobs",
    "stale_jobs": "select id, case when status = 'running' and started_at < timestamp '2024-12-31 23:50:00' then 'failed' else status end as status from crawl_jobs",
}

_JOB_PAGERANK = _pagerank(f"where p.crawl_job_id = {JOB}")

_NODES = f"""{_bm25(WORDS, JOB)}, seed as (select page_id from ranked order by score desc, page_id limit 10),
        nx as (select source_page_id as a, target_page_id as b from page_graph_edges where crawl_job_id = {JOB} and edge_type in ('link', 'url_hierarchy', 'content_similarity') and source_page_id <> target_page_id
               union select target_page_id, source_page_id from page_graph_edges where crawl_job_id = {JOB} and edge_type in ('link', 'url_hierarchy', 'content_similarity') and source_page_id <> target_page_id),
        own as (select id from pages where crawl_job_id = {JOB}),
        h1 as (select b as page_id from (select distinct b from nx where a in (select page_id from seed) and b in (select id from own) and b not in (select page_id from seed)) qualify row_number() over (order by b) <= 100 - (select count(*) from seed)),
        s1 as (select page_id, 0 as hops from seed union all select page_id, 1 from h1),
        h2 as (select b as page_id from (select distinct b from nx where a in (select page_id from h1) and b in (select id from own) and b not in (select page_id from s1)) qualify row_number() over (order by b) <= 100 - (select count(*) from s1)),
        every as (select * from s1 union all select page_id, 2 from h2),
        nd as (select source_page_id as a, target_page_id as b from page_graph_edges where crawl_job_id = {JOB} and edge_type = 'near_duplicate' and source_page_id <> target_page_id),
        nodes as (select page_id, hops, case when page_id in (select page_id from seed) then 'query_match'
          when page_id in (select b from nd where a in (select page_id from seed) union all select a from nd where b in (select page_id from seed)) then 'duplicate' else 'related_neighbor' end as role from every)"""

SQL |= {
    "stats_open_work": "select (select count(*) from pages where fetched_at is not null and indexed_at is null) as pending, count(*) filter (where error_type in ('robots_disallow', 'not_indexable', 'oversized')) as skipped_rows, count(*) filter (where error_type = 'timeout') as timeouts from crawl_errors",
    "stats_index_size": f"with {_PAGES} select count(distinct term) as unique_terms, count(*) as postings from post",
    "frontier_of_jobs": """with least_ as (select crawl_job_id, target_normalized_url as url, min(depth) as depth from page_links where is_crawl_eligible and target_normalized_url is not null group by all)
        select l.crawl_job_id, l.url, l.depth from least_ l join crawl_jobs j on j.id = l.crawl_job_id and j.pages_crawled < j.max_pages and l.depth <= j.max_depth
        where not exists (select 1 from pages p where p.crawl_job_id = l.crawl_job_id and p.normalized_url = l.url)""",
    "health_authorities": f"""with recursive {_JOB_PAGERANK},
        ind as (select p.id as page_id, (select count(*) from re where re.v = p.id and re.crawl_job_id = {JOB}) as n from pages p where p.crawl_job_id = {JOB}),
        both_ as ((select 0 as l, row_number() over (order by n desc, page_id) as k, page_id from ind) union all (select 1, row_number() over (order by r desc, page_id), page_id from pr where k = 200 and crawl_job_id = {JOB})),
        once as (select page_id, min(l * 1000 + k) as o from both_ where k <= 15 group by page_id)
        select row_number() over (order by o) as rank, o.page_id, p.url from once o join pages p on p.id = o.page_id qualify row_number() over (order by o) <= 15""",
    "graph_query_nodes": f"with {_NODES} select page_id, hops::int as hops, role from nodes",
    "curate_forced_edges": f"""with {_NODES},
        shown as (select e.* from page_graph_edges e, (select count(*) as n from page_graph_edges where crawl_job_id = {JOB}) t where crawl_job_id = {JOB} and source_page_id <> target_page_id
          and edge_type in ('link', 'url_hierarchy', 'content_similarity', 'near_duplicate') and weight >= case when edge_type <> 'content_similarity' then 0 when n > 500 then 0.35 when n > 300 then 0.28 else 0 end),
        br as (select s.id, s.edge_type, s.weight, case when a.role = 'query_match' then s.target_page_id else s.source_page_id end as related from shown s join nodes a on a.page_id = s.source_page_id join nodes b on b.page_id = s.target_page_id
          where (a.role = 'query_match' and b.role = 'related_neighbor') or (a.role = 'related_neighbor' and b.role = 'query_match'))
        select id from (select id from br where edge_type in ('link', 'url_hierarchy') qualify row_number() over (partition by related order by case edge_type when 'link' then 0 else 1 end, weight desc, id) <= 2)
        union select id from (select id from br where edge_type in ('content_similarity', 'near_duplicate') qualify row_number() over (partition by related order by weight desc, id) <= 1)""",
    "rerank_graph": f"""with recursive {_JOB_PAGERANK}, {_bm25(WORDS, JOB)},
        pool as (select page_id, score, row_number() over (order by score desc, page_id) as place from ranked qualify row_number() over (order by score desc, page_id) <= 600),
        own as (select source_page_id as s, target_page_id as t, edge_type, weight from page_graph_edges where crawl_job_id = {JOB} and source_page_id <> target_page_id),
        ends as (select s as a, t as b, weight from own union all select t, s, weight from own),
        there as (select id as page_id, content_hash from pages where crawl_job_id = {JOB}),
        wide as (select page_id from pool where place <= 200 union select b from ends where a in (select page_id from pool where place <= 200) and b in (select page_id from there)),
        kept as (select w.page_id, coalesce(score, 0) as bm25, coalesce(place <= 15, false) as seed from wide w left join pool using (page_id)
                 qualify row_number() over (order by coalesce(place <= 15, false) desc, score is not null desc, score desc nulls last, page_id desc) <= 200),
        sup as (select h.b as page_id, sum(h.w * ln(1 + greatest(k.bm25, 1e-9))) as support from (select a, b, max(weight) as w from ends group by a, b) h join kept k on k.page_id = h.a and k.seed where h.b in (select page_id from kept) group by h.b),
        cp as (select case when x.bm25 < y.bm25 then o.s when y.bm25 < x.bm25 then o.t else greatest(o.s, o.t) end as page_id, case when x.bm25 = y.bm25 then o.weight / 2 else o.weight end as penalty
               from own o join kept x on x.page_id = o.s join kept y on y.page_id = o.t where edge_type = 'near_duplicate'),
        hp as (select k.page_id, 1.0::double as penalty from kept k join there using (page_id) where content_hash is not null qualify row_number() over (partition by content_hash order by bm25 desc, k.page_id) > 1),
        pen as (select page_id, sum(penalty) as penalty from (select * from cp union all select * from hp) group by page_id),
        f as (select k.page_id, k.bm25, p.r as pagerank, coalesce(s.support, 0) as support, coalesce(n.penalty, 0) as penalty from kept k left join sup s using (page_id) left join pen n using (page_id) left join (select page_id, r from pr where k = 200) p using (page_id)),
        z as (select *, min(bm25) over () as b0, max(bm25) over () as b1, min(pagerank) over () as r0, max(pagerank) over () as r1, min(support) over () as s0, max(support) over () as s1, min(penalty) over () as p0, max(penalty) over () as p1 from f),
        n as (select page_id, bm25, penalty, case when b1 > b0 then (bm25 - b0) / (b1 - b0) else 0 end as bm25_norm, coalesce(case when r1 > r0 then (pagerank - r0) / (r1 - r0) else 0 end, 0) as pagerank_norm,
                case when s1 > s0 then (support - s0) / (s1 - s0) else 0 end as support_norm, case when p1 > p0 then (penalty - p0) / (p1 - p0) else 0 end as penalty_norm from z),
        e as (select *, bm25_norm + 0.12 * pagerank_norm + 0.18 * support_norm - 0.25 * penalty_norm as final_score from n)
        select page_id, round(final_score, 6) as final_score, round(bm25, 6) as bm25, round(bm25_norm, 6) as bm25_norm, round(pagerank_norm, 6) as pagerank_norm, round(support_norm, 6) as support_norm, round(penalty, 6) as penalty, round(penalty_norm, 6) as penalty_norm
        from e order by e.final_score desc, page_id limit 20""",
}

_ORPHANS = f"""l as (select distinct l.id as link_id, l.crawl_job_id as job, strftime(s.created_at, '%Y-%m') as period, l.target_page_id as tid, case when l.target_page_id is null then {_canonical('l.target_normalized_url')} end as u
        from page_links l join pages s on s.id = l.source_page_id where l.target_page_id is not null or (l.is_crawl_eligible and l.target_normalized_url is not null)),
    since_id as (select crawl_job_id as job, id, min(strftime(created_at, '%Y-%m')) as m from pages group by all),
    since_url as (select crawl_job_id as job, normalized_url as u, min(strftime(created_at, '%Y-%m')) as m from pages group by all),
    orphan as (select l.link_id, l.period, case when tid is null then 'target_normalized_url' else 'target_page_id' end as reference from l
        left join since_id i on i.job = l.job and i.id = l.tid left join since_url n on l.tid is null and n.job = l.job and n.u = l.u
        where coalesce(case when tid is null then n.m else i.m end, '9999-99') > l.period)"""
SQL["p5_found"] = f"with {_ORPHANS} select link_id, period from orphan"
SQL["p5_report"] = f"with {_ORPHANS} select 'page_links' as table_name, reference, period, count(*) as orphans from orphan group by all"
