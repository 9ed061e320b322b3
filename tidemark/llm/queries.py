"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import garbled, leaks, mixture, near_duplicates, neighbours, pairs, truncation
from tidemark.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(load(spark, d, "unified_knowledge"), "id", "content")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups_of_all(load(spark, d, "unified_knowledge"), "id", "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.broken_values(load(spark, d, "interaction_log"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.broken_rates(load(spark, d, "interaction_log"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_entries(load(spark, d, "knowledge_embeddings"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(load(spark, d, "interaction_log"), load(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(p8_found(spark, d), load(spark, d, "eval_items"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.draw_mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))[1]


def p9_draws(spark: SparkSession, d: str) -> DataFrame:
    return mixture.draw_mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled_documents(load(spark, d, "documents"))


def queries() -> dict:
    found = (
        p1_found, p1_groups, p5_found, p5_rates, p6_found, p7_found, p8_found, p8_items, p9_shares, p9_draws, p10_found,
    )
    return {f.__name__: f for f in found}


_RUNS = r"regexp_extract_all(regexp_replace(lower(content), '([\x{4E00}-\x{9FFF}]+)', ' \1 ', 'g'), '[\p{L}\p{N}]+')"
_SETS = rf"""sets AS (SELECT id, list_distinct(flatten(list_transform({_RUNS}, lambda r: CASE WHEN regexp_matches(r, '^[\x{{4E00}}-\x{{9FFF}}]') AND length(r) > 1
  THEN [substr(r, i, 2) for i in range(1, length(r))] ELSE [r] END))) AS t FROM unified_knowledge WHERE content IS NOT NULL)"""
_WORDS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w))"


def _grams(key: str, table: str) -> str:
    """SQL: every run of 12 words as one text, with the key of its row."""
    return (
        f"(SELECT {key}, unnest([array_to_string(w[i:i + 11], ' ') for i in range(1, len(w) - 10)]) AS g "
        f"FROM (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12)"
    )


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_SETS} SELECT a.id AS id_a, b.id AS id_b FROM sets a JOIN sets b ON a.id < b.id AND len(a.t) > 0 AND len(b.t) > 0 AND 10 * least(len(a.t), len(b.t)) >= 8 * greatest(len(a.t), len(b.t))
WHERE 18 * len(list_intersect(a.t, b.t)) >= 8 * (len(a.t) + len(b.t))""",
        "p1_groups": f"""WITH RECURSIVE {_SETS}, e AS (SELECT a.id AS x, b.id AS y FROM sets a JOIN sets b ON a.id <> b.id AND len(a.t) > 0 AND len(b.t) > 0 AND 10 * least(len(a.t), len(b.t)) >= 8 * greatest(len(a.t), len(b.t))
 WHERE 18 * len(list_intersect(a.t, b.t)) >= 8 * (len(a.t) + len(b.t))), reach(id, r) AS (SELECT id, id FROM unified_knowledge UNION SELECT reach.id, e.y FROM reach JOIN e ON e.x = reach.r),
g AS (SELECT id, min(r) AS group_id FROM reach GROUP BY 1), n AS (SELECT x, count(*) AS links FROM e GROUP BY 1), c AS (SELECT id, CASE WHEN len(t) > 0 THEN count(*) OVER (PARTITION BY array_to_string(list_sort(t), ' ')) ELSE 1 END AS copies FROM sets)
SELECT g.id, g.group_id, coalesce(c.copies, 1) AS copies, coalesce(n.links, 0) AS links FROM g LEFT JOIN n ON n.x = g.id LEFT JOIN c ON c.id = g.id""",
        "p6_found": """WITH v AS (SELECT entry_id AS id, embed_dim AS d, embedding::DOUBLE[] AS e FROM knowledge_embeddings WHERE len(embedding) = embed_dim AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.d = b.d AND a.id <> b.id),
r AS (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS p FROM s) SELECT DISTINCT least(x, y) AS entry_a, greatest(x, y) AS entry_b FROM r WHERE p <= 5 AND c >= 0.9""",
        "p8_found": f"""SELECT DISTINCT d.doc_id, i.item_id FROM {_grams('doc_id', 'documents')} d JOIN {_grams('item_id', 'eval_items')} i ON i.g = d.g""",
        "p8_items": f"""WITH l AS (SELECT DISTINCT d.doc_id, i.item_id FROM {_grams('doc_id', 'documents')} d JOIN {_grams('item_id', 'eval_items')} i ON i.g = d.g)
SELECT e.item_id, e.suite, count(l.doc_id) AS n_documents FROM (SELECT DISTINCT item_id, suite FROM eval_items) e LEFT JOIN l ON l.item_id = e.item_id GROUP BY 1, 2""",
    }
