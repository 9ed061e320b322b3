"""Queries p2 to p4 (hot keys, references, instants) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import hot_keys, instants, references
from tidemark.session import materialise
from tidemark.sources.tables import load

TIME_FIELDS = ["first_seen", "last_accessed", "event_time"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.heavy_keys(load(spark, d, "entity_relations"))


def p2_profiles(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.name_profiles(load(spark, d, "entity_relations"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    knowledge, versions = load(spark, d, "unified_knowledge"), load(spark, d, "knowledge_versions")
    refs = materialise(references.all_references(
        knowledge, versions, load(spark, d, "feedback_log"), load(spark, d, "interaction_log")
    ), "references")
    return refs, references.orphan_references(refs, knowledge, versions.filter(F.col("status") == "deleted"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d)[1]


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(*_references(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.normalise_times(load(spark, d, "unified_knowledge"), load(spark, d, "client_clocks"), TIME_FIELDS)


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per client and field: non-null values and how many denote an instant."""
    rows = load(spark, d, "unified_knowledge").select(
        F.coalesce(instants.client_of(F.col("source_session_id")), F.lit("none")).alias("client"), "id", *TIME_FIELDS
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("v")) for f in TIME_FIELDS]))
    values = rows.select("id", "client", pairs.alias("p")).select("id", "client", "p.field_name", "p.v")
    found = p4_found(spark, d).select(F.col("knowledge_id").alias("id"), "field_name", F.lit(1).alias("ok"))
    return values.join(found, ["id", "field_name"], "left").groupBy("client", "field_name").agg(
        F.count("v").alias("n_values"), F.count("ok").alias("n_instants")
    )


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_profiles, p3_found, p3_report, p4_found, p4_coverage)}


_NAME = "lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_SIDES = f"""sides AS (
  SELECT 'entity_a' AS side, {_NAME.format(c='entity_a')} AS k, {_NAME.format(c='entity_b')} AS o, weight, hit_count, first_seen, last_seen FROM entity_relations
  UNION ALL
  SELECT 'entity_b', {_NAME.format(c='entity_b')}, {_NAME.format(c='entity_a')}, weight, hit_count, first_seen, last_seen FROM entity_relations)"""

_REFS = """refs AS (
  SELECT 'feedback_log' AS table_name, id AS row_id, knowledge_id AS target_id, created_at AS t FROM feedback_log
  UNION ALL SELECT 'knowledge_versions', id, knowledge_id, created_at FROM knowledge_versions
  UNION ALL SELECT 'unified_knowledge', id, replaced_by, updated_at FROM unified_knowledge
  UNION ALL SELECT 'interaction_log', i.id, TRY_CAST(json_extract_string(e.value, '$.id') AS BIGINT), i.created_at
    FROM interaction_log i, json_each(CASE WHEN json_valid(i.knowledge_used) THEN i.knowledge_used ELSE '[]' END) e),
 found AS (
  SELECT DISTINCT r.table_name, strftime(r.t, '%Y-%m') AS ref_month, r.row_id, r.target_id,
    CASE WHEN k.id IS NOT NULL THEN CASE WHEN k.created_at > r.t THEN 'late' END
         WHEN v.knowledge_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
  FROM refs r LEFT JOIN unified_knowledge k ON k.id = r.target_id
  LEFT JOIN (SELECT DISTINCT knowledge_id FROM knowledge_versions WHERE status = 'deleted') v ON v.knowledge_id = r.target_id
  WHERE r.target_id IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""WITH {_SIDES}
SELECT side, k AS entity_key FROM sides WHERE k IS NOT NULL AND k <> '' GROUP BY side, k
HAVING count(*) >= 0.01 * (SELECT count(*) FROM entity_relations)""",
        "p2_profiles": f"""WITH {_SIDES},
named AS (SELECT side, k AS entity_key, nullif(o, '') AS o, weight, hit_count, first_seen, last_seen FROM sides WHERE k IS NOT NULL AND k <> ''),
tops AS (SELECT side, entity_key, o, row_number() OVER (PARTITION BY side, entity_key ORDER BY count(*) DESC, o) AS r FROM named WHERE o IS NOT NULL GROUP BY side, entity_key, o),
sums AS (SELECT side, entity_key, count(*) AS edges, round(coalesce(sum(weight), 0), 6) AS weight_sum, CAST(coalesce(sum(hit_count), 0) AS BIGINT) AS hits,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(DISTINCT o) AS partners, quantile_disc(weight, 0.5) AS median_weight FROM named GROUP BY side, entity_key)
SELECT s.side, s.entity_key, s.edges, s.weight_sum, s.hits, s.first_seen, s.last_seen, s.partners, t.o AS top_partner, s.median_weight
FROM sums s LEFT JOIN tops t ON t.side = s.side AND t.entity_key = s.entity_key AND t.r = 1""",
        "p3_found": f"WITH {_REFS} SELECT table_name, ref_month, row_id, target_id, state FROM found WHERE state IS NOT NULL",
        "p3_report": f"""WITH {_REFS}
SELECT table_name, ref_month, count(*) AS n_references, count(*) FILTER (WHERE state = 'missing') AS n_missing,
  count(*) FILTER (WHERE state = 'deleted') AS n_deleted, count(*) FILTER (WHERE state = 'late') AS n_late
FROM found GROUP BY table_name, ref_month""",
    }
