"""One-line explanations of edges and scores. The sentences are fixed values: readers of the stored data know them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(value: Column, digits: int = 4) -> Column:
    """A number with so many significant digits and no trailing zeros, like C's %g, for magnitudes from 1e-4 to 1e4."""
    v = value.cast("double")
    places = F.greatest(F.lit(0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))).cast("int"))
    # rounding half to even on the binary value: format_string works on the exact decimal expansion
    text = F.coalesce(*[F.when(places == p, F.format_string(f"%.{p}f", v)) for p in range(digits + 4)])
    trimmed = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(v == 0, F.lit("0")).when(v.isNotNull(), trimmed)


def edge_reason(edge_type: Column, evidence: Column, weight: Column) -> Column:
    """Why two pages are related, from an edge's type, JSON evidence and weight.

    Evidence that is no object counts as none. Numbers show three decimals, at
    most five shared terms are named, in order.
    """
    kind = F.coalesce(F.when(F.trim(edge_type) != "", F.trim(edge_type)), F.lit("unknown"))
    get = lambda k: F.get_json_object(evidence, f"$.{k}")
    strength = F.coalesce(significant(weight), F.lit("unknown"))
    fallback = F.concat(F.lit("Related by "), kind, F.lit(" with strength "), strength, F.lit("."))
    number = lambda c: F.coalesce(F.format_string("%.3f", c.try_cast("double")), c)

    def shown(c: Column) -> Column:
        return F.when(c.isNotNull(), number(c))

    def listed(c: Column) -> Column:
        terms = F.from_json(c, "array<string>")
        return F.array_join(F.slice(F.array_sort(F.array_distinct(F.filter(terms, lambda t: t.isNotNull() & (F.trim(t) != "")))), 1, 5), ", ")

    base = F.lit("Same URL hierarchy. One page appears to be a parent or child of the other.")
    hierarchy = (
        F.when(get("parent_path").isNotNull() & get("child_path").isNotNull(), F.concat(base, F.lit(" Paths: parent "), get("parent_path"), F.lit(" → child "), get("child_path"), F.lit(".")))
        .when(F.coalesce(get("parent_url"), get("parent_normalized")).isNotNull() & F.coalesce(get("child_url"), get("child_normalized")).isNotNull(), F.concat(base, F.lit(" URLs: "), F.coalesce(get("parent_url"), get("parent_normalized")), F.lit(" → "), F.coalesce(get("child_url"), get("child_normalized")), F.lit(".")))
        .otherwise(base)
    )
    similarity = shown(get("similarity"))
    terms = listed(get("shared_terms"))
    some = F.coalesce(terms != "", F.lit(False))
    similar = F.concat(
        F.lit("Similar page content"),
        F.when(similarity.isNotNull(), F.concat(F.lit(" (similarity "), similarity, F.lit(")"))).otherwise(F.lit("")),
        F.lit("."),
        F.when(some, F.concat(F.lit(" Shared terms: "), terms, F.lit("."))).otherwise(F.lit("")),
    )
    near = (
        F.when(get("kind") == "content_hash_match", F.lit("Near duplicate. These pages have the same extracted content hash."))
        .when(get("kind") == "high_similarity", F.concat(F.lit("Near duplicate. Very high content similarity"), F.when(similarity.isNotNull(), F.concat(F.lit(" (similarity "), similarity, F.lit(")"))).otherwise(F.lit("")), F.lit(".")))
        .otherwise(fallback)
    )
    score = shown(F.coalesce(get("similarity"), get("score")))
    signals = listed(F.coalesce(get("shared_terms"), get("terms")))
    overlapping = F.coalesce(signals != "", F.lit(False))
    semantic = F.when(
        score.isNotNull() | overlapping,
        F.concat(
            F.lit("Semantic similarity"),
            F.when(score.isNotNull(), F.concat(F.lit(" (score "), score, F.lit(")"))).otherwise(F.lit("")),
            F.lit("."),
            F.when(overlapping, F.concat(F.lit(" Overlapping signals: "), signals, F.lit("."))).otherwise(F.lit("")),
        ),
    ).otherwise(fallback)
    return (
        F.when(kind == "link", F.lit("Direct link between these pages."))
        .when(kind == "url_hierarchy", hierarchy)
        .when(kind == "content_similarity", similar)
        .when(kind == "near_duplicate", near)
        .when(kind == "semantic_similarity", semantic)
        .otherwise(fallback)
    )


def score_reason(final: Column, bm25: Column, pagerank: Column, neighbors: Column, duplicates: Column, raw: Column) -> Column:
    """How a reranked score is made up."""
    return F.format_string("final=%.4f = 1.0×bm25_norm(%.3f) + 0.12×PR_norm(%.3f) + 0.18×neighbor_norm(%.3f) − 0.25×dup_norm(%.3f) [raw BM25 %.4f]", final, bm25, pagerank, neighbors, duplicates, raw)


def score_parts(reason: Column) -> Column:
    """(factors, raw): the addends of a score's explanation and its note, taken apart again."""
    return F.struct(F.regexp_extract_all(reason, F.lit(r"([0-9.]+×\w+\([0-9.\-]+\))"), 1).alias("factors"), F.regexp_extract(reason, r"\[(.*)\]", 1).alias("raw"))
