"""The table catalogue: declared schemas, Parquet readers, schema-tolerant loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "bool": T.BooleanType(), "ts": T.TimestampType(), "floats": T.ArrayType(T.FloatType()),
}


def _schema(spec: str) -> T.StructType:
    parts = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in parts])


#: Declared columns of every table of the store.
SCHEMAS: dict[str, T.StructType] = {
    "unified_knowledge": _schema(
        "id:long content:string domain_scores:string layer:string positive_feedback:long negative_feedback:long "
        "match_hash:string first_seen:string last_accessed:string last_query_domain:string active_summary:string "
        "total_corrections:long last_corrected_at:ts sleep_time_processed:bool consolidated_from:string "
        "source_session_id:string source_snippet:string replaced_by:long replaces:long status:string user_id:string "
        "created_at:ts updated_at:ts valid_from:ts valid_to:ts event_time:string"
    ),
    "knowledge_versions": _schema(
        "id:long knowledge_id:long content:string active_summary:string status:string change_reason:string "
        "source_session_id:string source_snippet:string user_id:string created_at:ts"
    ),
    "feedback_log": _schema(
        "id:long knowledge_id:long feedback_type:string source:string session_id:string user_id:string created_at:ts"
    ),
    "interaction_log": _schema(
        "id:long session_id:string user_id:string user_query:string model_response:string knowledge_used:string "
        "correction_of:string event_time:ts created_at:ts"
    ),
    "knowledge_embeddings": _schema("entry_id:long embedding:floats embed_dim:int updated_at:ts"),
    "entity_relations": _schema(
        "id:long source_entry:long target_entry:long entity_a:string entity_b:string relation_type:string "
        "weight:double first_seen:ts last_seen:ts hit_count:long"
    ),
    "knowledge_beliefs": _schema(
        "knowledge_id:long belief_type:string confidence:double evidence_positive:long evidence_negative:long "
        "encounter_count:long last_reinforced_at:ts last_corrected_at:ts promoted_at:ts demoted_at:ts "
        "created_at:ts updated_at:ts"
    ),
    "constitution_log": _schema(
        "id:long rule:string domain:string action:string allowed:bool reason:string knowledge_id:long "
        "user_id:string created_at:ts"
    ),
    "model_versions": _schema(
        "id:long model_name:string provider:string switched_from:string switched_at:ts domain_accuracy:string "
        "notes:string"
    ),
    "user_fingerprints": _schema(
        "fingerprint:string user_id:string platform:string hostname:string first_seen:ts last_seen:ts hit_count:long"
    ),
    "knowledge_conflicts": _schema("id:long knowledge_id:long other_id:long reason:string created_at:ts"),
    "client_clocks": _schema("client:string tz_name:string date_order:string"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``{sf_dir}/{name}.parquet``; columns and filters chosen later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalogue without rows, for stores that never wrote it."""
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring an older snapshot to the declared schema: absent columns become null, known
    columns are cast, columns outside the catalogue are dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in SCHEMAS[name].fields
        ]
    )
