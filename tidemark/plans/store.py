"""Queries over the memory store: scans, filters, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scores, text
from tidemark.operators import composite, graph, lifecycle, mining, retrieval
from tidemark.plans.registry import Registry
from tidemark.sources.snapshots import json_lines
from tidemark.sources.tables import SCHEMAS, load

R = Registry()
query = R.query
#: The fixed clock of all rules about age.
AS_OF = "2025-10-01 00:00:00"
USER = "u0001"


def _now():
    return F.to_timestamp(F.lit(AS_OF))


# ---- scans, filters, projections ----

@query("SELECT id, layer, user_id, created_at FROM unified_knowledge WHERE status = 'active' AND user_id IN ('u0001', 'default')")
def scan_visible(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.visible(load(spark, d, "unified_knowledge"), USER).select("id", "layer", "user_id", "created_at")


@query("SELECT id, content, layer, status FROM unified_knowledge WHERE id = 101")
def point_lookup(spark, d):
    return load(spark, d, "unified_knowledge").filter(F.col("id") == 101).select("id", "content", "layer", "status")


@query("""SELECT k.id, k.match_hash FROM unified_knowledge k JOIN (SELECT match_hash, user_id FROM unified_knowledge WHERE match_hash IS NOT NULL AND status = 'active'
  GROUP BY match_hash, user_id HAVING count(*) > 1) g ON g.match_hash = k.match_hash AND g.user_id = k.user_id WHERE k.status = 'active'""")
def equal_hashes(spark, d):
    active = load(spark, d, "unified_knowledge").filter((F.col("status") == "active") & F.col("match_hash").isNotNull())
    twice = active.groupBy("match_hash", "user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return active.join(twice, ["match_hash", "user_id"]).select("id", "match_hash")


@query("""SELECT id, positive_feedback - 2 * negative_feedback AS weight FROM unified_knowledge
WHERE status = 'active' AND (contains(lower(content), 'incident') OR contains(lower(content), 'storage')) ORDER BY weight DESC, created_at DESC, id LIMIT 20""")
def like_search(spark, d):
    active = load(spark, d, "unified_knowledge").filter(F.col("status") == "active")
    return retrieval.like_search(active, "Incident storage", 20).select("id", "weight")


@query("""SELECT id, status, created_at FROM unified_knowledge WHERE status IN ('active', 'superseded') AND (created_at IS NULL OR created_at <= TIMESTAMP '2024-09-01 00:00:00')
AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-09-01 00:00:00') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-09-01 00:00:00')""")
def snapshot_at(spark, d):
    at = F.to_timestamp(F.lit("2024-09-01 00:00:00"))
    return retrieval.snapshot_at(load(spark, d, "unified_knowledge"), at).select("id", "status", "created_at")


@query("""SELECT layer, count(*) FILTER (WHERE updated_at < TIMESTAMP '2025-10-01' - INTERVAL 30 DAY) AS idle_30, count(*) FILTER (WHERE updated_at < TIMESTAMP '2025-10-01' - INTERVAL 180 DAY) AS idle_180,
count(*) FILTER (WHERE updated_at < TIMESTAMP '2025-10-01' - INTERVAL 48 HOUR) AS idle_48h FROM unified_knowledge WHERE status = 'active' GROUP BY layer""")
def idle_by_layer(spark, d):
    old = lambda days: F.count_if(F.col("updated_at") < _now() - F.make_dt_interval(F.lit(days)))
    return load(spark, d, "unified_knowledge").filter(F.col("status") == "active").groupBy("layer").agg(
        old(30).alias("idle_30"), old(180).alias("idle_180"), old(2).alias("idle_48h")
    )


@query("""SELECT id, positive_feedback - 2 * negative_feedback AS weight, CASE WHEN positive_feedback - 2 * negative_feedback >= 8 THEN 'high' WHEN positive_feedback - 2 * negative_feedback >= 5 THEN 'raised'
WHEN positive_feedback - 2 * negative_feedback <= -5 THEN 'lowest' WHEN positive_feedback - 2 * negative_feedback <= -3 THEN 'low' ELSE 'plain' END AS band, negative_feedback > positive_feedback + 3 AS overloaded FROM unified_knowledge""")
def weight_bands(spark, d):
    w = F.col("weight")
    band = F.when(w >= 8, "high").when(w >= 5, "raised").when(w <= -5, "lowest").when(w <= -3, "low").otherwise("plain")
    return load(spark, d, "unified_knowledge").select(
        "id", scores.weight(F.col("positive_feedback"), F.col("negative_feedback")).alias("weight"),
        (F.col("negative_feedback") > F.col("positive_feedback") + 3).alias("overloaded"),
    ).withColumn("band", band)


@query("""SELECT coalesce(source_session_id, 'unknown') AS session, substr(content, 1, 100) AS beginning, CASE WHEN active_summary IS NULL OR active_summary = '' THEN 'model:x' ELSE active_summary || ' | model:x' END AS tagged
FROM unified_knowledge WHERE length(trim(content)) > 20""")
def tagged_projection(spark, d):
    s = F.col("active_summary")
    return load(spark, d, "unified_knowledge").filter(F.length(F.trim("content")) > 20).select(
        F.coalesce("source_session_id", F.lit("unknown")).alias("session"), F.substring("content", 1, 100).alias("beginning"),
        F.when(s.isNull() | (s == ""), "model:x").otherwise(F.concat(s, F.lit(" | model:x"))).alias("tagged"),
    )


@query("""SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM unified_knowledge GROUP BY 1""")
def rows_per_day(spark, d):
    return load(spark, d, "unified_knowledge").groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, created_at FROM unified_knowledge ORDER BY created_at DESC, id LIMIT 50 OFFSET 100""")
def page_of_rows(spark, d):
    return load(spark, d, "unified_knowledge").orderBy(F.col("created_at").desc(), "id").offset(100).limit(50).select("id", "created_at")


_COLUMNS = [f.name for f in SCHEMAS["unified_knowledge"].fields]


@query("SELECT id, to_json({" + ", ".join(f"'{c}': CAST({c} AS VARCHAR)" for c in _COLUMNS) + "}) AS json FROM unified_knowledge")
def export_lines(spark, d):
    rows = load(spark, d, "unified_knowledge")
    return json_lines(rows.select(*[F.col(c).cast("string").alias(c) for c in _COLUMNS]), ["id"]).withColumn("id", F.col("id").cast("long"))


# ---- joins ----

@query("""SELECT k.id, e.embed_dim, len(e.embedding) AS n FROM knowledge_embeddings e JOIN unified_knowledge k ON k.id = e.entry_id WHERE k.status = 'active'""")
def embeddings_of_active(spark, d):
    k = load(spark, d, "unified_knowledge").filter(F.col("status") == "active").select("id")
    e = load(spark, d, "knowledge_embeddings").select(F.col("entry_id").alias("id"), "embed_dim", F.array_size("embedding").alias("n"))
    return k.join(e, "id").select("id", "embed_dim", "n")


@query("""SELECT f.id AS feedback_id, k.id AS knowledge_id, f.created_at, substr(k.content, 1, 80) AS beginning
FROM (SELECT DISTINCT * FROM feedback_log WHERE feedback_type = 'system_conflict') f JOIN unified_knowledge k ON k.id = f.knowledge_id ORDER BY f.created_at DESC, f.id DESC LIMIT 5""")
def newest_conflicts(spark, d):
    f = load(spark, d, "feedback_log").filter(F.col("feedback_type") == "system_conflict").distinct()
    k = load(spark, d, "unified_knowledge").select(F.col("id").alias("knowledge_id"), F.substring("content", 1, 80).alias("beginning"))
    return f.join(k, "knowledge_id").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(5).select(
        F.col("id").alias("feedback_id"), "knowledge_id", "created_at", "beginning"
    )


@query("""SELECT v.id AS version_id, v.knowledge_id FROM (SELECT DISTINCT id, knowledge_id FROM knowledge_versions WHERE knowledge_id IS NOT NULL) v WHERE NOT EXISTS (SELECT 1 FROM unified_knowledge k WHERE k.id = v.knowledge_id)""")
def versions_without_memory(spark, d):
    v = load(spark, d, "knowledge_versions").filter(F.col("knowledge_id").isNotNull()).select(F.col("id").alias("version_id"), "knowledge_id").distinct()
    return v.join(load(spark, d, "unified_knowledge").select(F.col("id").alias("knowledge_id")), "knowledge_id", "left_anti")


@query("""SELECT k.id FROM unified_knowledge k WHERE k.id IN (SELECT knowledge_id FROM feedback_log WHERE feedback_type = 'correction')""")
def corrected_memories(spark, d):
    f = load(spark, d, "feedback_log").filter(F.col("feedback_type") == "correction").select(F.col("knowledge_id").alias("id"))
    return load(spark, d, "unified_knowledge").select("id").join(f, "id", "left_semi")


@query("""WITH t(term) AS (VALUES ('Brontell'), ('Quillbase'), ('journal'), ('工作流'), ('migration')),
hits AS (SELECT t.term, k.id, k.positive_feedback, row_number() OVER (PARTITION BY t.term ORDER BY k.positive_feedback DESC, k.id) AS place FROM t JOIN unified_knowledge k ON contains(lower(k.content), lower(t.term)))
SELECT term, id, place FROM hits WHERE place <= 3""")
def best_mentions(spark, d):
    terms = spark.createDataFrame([(t,) for t in ("Brontell", "Quillbase", "journal", "工作流", "migration")], "term string")
    docs = load(spark, d, "unified_knowledge")
    hits = graph.mentions(docs, terms, F.col("id"), F.col("content")).join(docs.select("id", "positive_feedback"), "id")
    return retrieval.top(hits, 3, [F.col("positive_feedback").desc(), F.col("id")], "term").select("term", "id", "place")


@query("""WITH RECURSIVE ok AS (SELECT DISTINCT id, TRY_CAST(correction_of AS BIGINT) AS parent FROM interaction_log), links AS (SELECT a.id, CASE WHEN b.id IS NOT NULL AND a.parent <> a.id THEN a.parent END AS parent FROM ok a LEFT JOIN (SELECT DISTINCT id FROM interaction_log) b ON b.id = a.parent),
walk AS (SELECT id, id AS here, 0 AS depth FROM links UNION ALL SELECT w.id, l.parent, w.depth + 1 FROM walk w JOIN links l ON l.id = w.here WHERE l.parent IS NOT NULL)
SELECT id, arg_max(here, depth) AS root, CAST(max(depth) AS INTEGER) AS depth FROM walk GROUP BY id""")
def correction_roots(spark, d):
    log = load(spark, d, "interaction_log").select("id", F.col("correction_of").try_cast("bigint").alias("parent")).distinct()
    return lifecycle.chain_roots(log, "id", "parent")


@query("""SELECT a.id, b.id AS newer_id, b.created_at AS newer_at FROM unified_knowledge a LEFT JOIN unified_knowledge b ON b.id = a.replaced_by WHERE a.replaced_by IS NOT NULL""")
def replacements(spark, d):
    k = load(spark, d, "unified_knowledge")
    newer = k.select(F.col("id").alias("newer_id"), F.col("created_at").alias("newer_at"))
    old = k.filter(F.col("replaced_by").isNotNull()).select("id", "replaced_by")
    return old.join(newer, old["replaced_by"] == newer["newer_id"], "left").select("id", "newer_id", "newer_at")


@query("""WITH g AS (SELECT lower(regexp_replace(entity_a, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS a, lower(regexp_replace(entity_b, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS b, relation_type FROM entity_relations)
SELECT a AS entity_a, b AS entity_b, relation_type, count(*) AS hit_count, least(5.0, 1 + 0.5 * (count(*) - 1))::DOUBLE AS weight FROM g WHERE a <> '' AND b <> '' GROUP BY 1, 2, 3""")
def accumulated_edges(spark, d):
    return graph.accumulate(load(spark, d, "entity_relations"))


@query("""WITH g AS (SELECT lower(regexp_replace(entity_a, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS a, lower(regexp_replace(entity_b, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS b, relation_type FROM entity_relations),
e AS (SELECT a, b, relation_type, least(5.0, 1 + 0.5 * (count(*) - 1)) AS weight FROM g WHERE a <> '' AND b <> '' GROUP BY 1, 2, 3),
m AS (SELECT a AS node, b AS nxt, relation_type, weight FROM e UNION ALL SELECT b, a, relation_type, weight FROM e),
h1 AS (SELECT nxt AS node, relation_type, max(weight) AS weight, 1 AS depth FROM m WHERE node = '调度中心' GROUP BY 1, 2),
h2 AS (SELECT m.nxt AS node, m.relation_type, max(m.weight) AS weight, 2 AS depth FROM m WHERE m.node IN (SELECT node FROM h1) GROUP BY 1, 2)
SELECT node, relation_type, CAST(min(depth) AS INTEGER) AS depth, max(weight)::DOUBLE AS weight FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE node <> '调度中心' GROUP BY 1, 2""")
def graph_neighbourhood(spark, d):
    edges = graph.accumulate(load(spark, d, "entity_relations"))
    return graph.traverse(edges, spark.createDataFrame([("调度中心",)], "node string"), 2, 0.5)


@query("""SELECT split_part(session_id, '-', 1) AS client, arg_max(user_id, (n, user_id)) AS top_user, CAST(max(n) AS BIGINT) AS n FROM (SELECT session_id, user_id, count(*) OVER (PARTITION BY split_part(session_id, '-', 1), user_id) AS n FROM (SELECT DISTINCT id, session_id, user_id FROM interaction_log WHERE session_id IS NOT NULL AND user_id IS NOT NULL)) GROUP BY 1""")
def top_user_per_client(spark, d):
    log = load(spark, d, "interaction_log").filter(F.col("session_id").isNotNull() & F.col("user_id").isNotNull()).select("id", "session_id", "user_id").distinct()
    n = log.groupBy(F.substring_index("session_id", "-", 1).alias("client"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("client").agg(F.max_by("user_id", F.struct("n", "user_id")).alias("top_user"), F.max("n").alias("n"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders""")
def validity_intervals(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(order).alias("valid_to"))


@query("""SELECT c.c_custkey, n.n_name, r.r_name, count(o.o_orderkey) AS n_orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3""")
def customer_totals(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, "c_custkey", "left").select(
        "c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total")
    )


# ---- aggregates ----

@query("""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE layer = 'instant') AS instant, count(*) FILTER (WHERE layer = 'candidate') AS candidate, count(*) FILTER (WHERE layer = 'consolidated') AS consolidated FROM unified_knowledge GROUP BY user_id""")
def layer_counts(spark, d):
    return load(spark, d, "unified_knowledge").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("layer") == x).alias(x) for x in ("instant", "candidate", "consolidated")]
    )


@query("""SELECT coalesce(split_part(source_session_id, '-', 1), 'unknown') AS source, coalesce(last_query_domain, 'none') AS domain, count(*) AS n, max(created_at) AS newest FROM unified_knowledge GROUP BY 1, 2""")
def rows_per_source(spark, d):
    return load(spark, d, "unified_knowledge").groupBy(
        F.coalesce(F.substring_index("source_session_id", "-", 1), F.lit("unknown")).alias("source"),
        F.coalesce("last_query_domain", F.lit("none")).alias("domain"),
    ).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2025-06-01') AS on_day, CAST(min(created_at) AS DATE) AS first_day, date_diff('day', CAST(min(created_at) AS DATE), DATE '2025-10-01') + 1 AS days_active FROM unified_knowledge GROUP BY user_id""")
def activity_per_user(spark, d):
    first = F.to_date(F.min("created_at"))
    return load(spark, d, "unified_knowledge").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.to_date("created_at") == F.lit("2025-06-01").cast("date")).alias("on_day"),
        first.alias("first_day"), (F.datediff(F.to_date(F.lit("2025-10-01")), first) + 1).cast("long").alias("days_active"),
    )


@query("""SELECT knowledge_id, count(*) FILTER (WHERE feedback_type IN ('explicit_positive', 'correction')) AS positive, count(*) FILTER (WHERE feedback_type = 'explicit_negative') AS negative, count(*) FILTER (WHERE feedback_type = 'system_conflict') AS conflicts, max(created_at) AS newest
FROM (SELECT DISTINCT * FROM feedback_log WHERE knowledge_id IS NOT NULL) GROUP BY knowledge_id""")
def feedback_counters(spark, d):
    f = load(spark, d, "feedback_log").filter(F.col("knowledge_id").isNotNull()).distinct()
    kind = F.col("feedback_type")
    return f.groupBy("knowledge_id").agg(
        F.count_if(kind.isin("explicit_positive", "correction")).alias("positive"), F.count_if(kind == "explicit_negative").alias("negative"),
        F.count_if(kind == "system_conflict").alias("conflicts"), F.max("created_at").alias("newest"),
    )


@query("""SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY event_type""")
def mean_per_type(spark, d):
    return load(spark, d, "events").filter(F.col("ts") >= F.to_timestamp(F.lit("2024-01-05"))).groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n")
    )


@query("""WITH l AS (SELECT DISTINCT id, user_id, correction_of, created_at FROM interaction_log) SELECT user_id, count(*) AS total, count(correction_of) AS corrections, round(count(correction_of) / count(*), 3) AS rate, min(created_at) AS first_at, max(created_at) AS last_at, arg_min(id, (created_at, id)) AS first_id FROM l GROUP BY user_id""")
def audit_per_user(spark, d):
    log = load(spark, d, "interaction_log").select("id", "user_id", "correction_of", "created_at").distinct()
    return log.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count("correction_of").alias("corrections"),
        F.round(F.count("correction_of") / F.count(F.lit(1)), 3).alias("rate"), F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"), F.min_by("id", F.struct("created_at", "id")).alias("first_id"),
    )


_USED = """log AS (SELECT DISTINCT id, user_query, knowledge_used, correction_of FROM interaction_log),
items AS (SELECT l.id, l.correction_of IS NOT NULL AS fix, TRY_CAST(json_extract_string(e.value, '$.id') AS BIGINT) AS kid FROM log l, json_each(CASE WHEN json_valid(l.knowledge_used) THEN l.knowledge_used ELSE '[]' END) e)"""


@query(f"""WITH {_USED} SELECT kid AS knowledge_id, count(*) AS used, count(*) FILTER (WHERE fix) AS corrected FROM items WHERE kid IS NOT NULL GROUP BY kid""")
def usage_counts(spark, d):
    return mining.usage(mining.distinct_log(load(spark, d, "interaction_log")))


@query(f"""WITH {_USED}, u AS (SELECT kid, count(*) AS n, count(*) FILTER (WHERE fix) AS c FROM items WHERE kid IS NOT NULL GROUP BY kid),
q AS (SELECT k.id, coalesce(u.n, 0) AS n_used, coalesce(u.c, 0) AS n_corrected, round(CASE WHEN coalesce(u.n, 0) > 0 THEN u.c / u.n ELSE 0 END, 3) AS rate,
  round(coalesce(u.n, 0) * (1 - CASE WHEN coalesce(u.n, 0) > 0 THEN u.c / u.n ELSE 0 END) + k.positive_feedback - 2 * k.negative_feedback, 2) AS score FROM unified_knowledge k LEFT JOIN u ON u.kid = k.id WHERE k.status = 'active')
SELECT *, CASE WHEN rate > 0.3 AND n_used >= 3 THEN 'high_risk' WHEN rate > 0.1 AND n_used >= 5 THEN 'watch' WHEN score > 5 THEN 'good' ELSE 'normal' END AS flag FROM q""")
def quality_scores(spark, d):
    return mining.quality(load(spark, d, "unified_knowledge"), mining.usage(mining.distinct_log(load(spark, d, "interaction_log"))))


@query(f"""WITH {_USED}, w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(user_query), '([\\x{{4E00}}-\\x{{9FFF}}]{{2,}}|[a-z0-9_]{{2,}})')) AS word FROM log),
k AS (SELECT w.* FROM w JOIN log ON log.id = w.id AND log.correction_of IS NULL WHERE length(word) BETWEEN 2 AND 6 AND word NOT IN ('一个','这个','那个','什么','怎么','如何','可以','需要','没有','不是','就是','还是','因为','所以','但是','而且')),
t AS (SELECT word, kid, count(*) AS together FROM k JOIN (SELECT DISTINCT id, kid FROM items WHERE kid IS NOT NULL) i ON i.id = k.id GROUP BY 1, 2), s AS (SELECT word, sum(together) AS total FROM t GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY together DESC, kid) AS p FROM t WHERE together >= 3)
SELECT r.word, r.kid AS knowledge_id, r.together, CAST(s.total AS BIGINT) AS total, round(r.together / s.total, 2) AS confidence FROM r JOIN s ON s.word = r.word JOIN unified_knowledge u ON u.id = r.kid WHERE r.p <= 3 AND round(r.together / s.total, 2) >= 0.05""")
def word_patterns(spark, d):
    log, known = mining.distinct_log(load(spark, d, "interaction_log")), load(spark, d, "unified_knowledge")
    return mining.cooccurrence(log, known, least=0.05)


@query("""SELECT substr(user_query, 1, 20) AS beginning, count(*) AS n FROM (SELECT DISTINCT id, user_query FROM interaction_log) WHERE length(user_query) >= 4 GROUP BY 1 ORDER BY n DESC, beginning LIMIT 20""")
def query_coverage(spark, d):
    log = load(spark, d, "interaction_log").select("id", "user_query").distinct().filter(F.length("user_query") >= 4)
    return log.groupBy(F.substring("user_query", 1, 20).alias("beginning")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "beginning").limit(20)


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(sum(value) / count(*), 6) AS mean, list_sort(list(value))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50,
list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95, list_sort(list(value))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS p99, count(*) FILTER (WHERE value <= 0.1) AS upto_0_1, count(*) FILTER (WHERE value <= 0.5) AS upto_0_5, count(*) FILTER (WHERE value <= 1) AS upto_1, count(*) FILTER (WHERE value <= 5) AS upto_5, count(*) FILTER (WHERE value <= 10) AS upto_10 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def value_histogram(spark, d):
    return mining.histogram(load(spark, d, "events"), "event_type", "value")


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, grouping(event_type, CAST(ts AS DATE)) AS level FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))""")
def rollup_by_day(spark, d):
    e = load(spark, d, "events").select("event_type", F.to_date("ts").alias("day"))
    return e.rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("""SELECT count(DISTINCT entity_a) AS a, count(DISTINCT entity_b) AS b, count(DISTINCT relation_type) AS kinds FROM entity_relations""")
def distinct_names(spark, d):
    return load(spark, d, "entity_relations").agg(F.count_distinct("entity_a").alias("a"), F.count_distinct("entity_b").alias("b"), F.count_distinct("relation_type").alias("kinds"))


_SCORES = " ".join(f"WHEN m.{x} = m.top AND m.top > 0 THEN '{x}'" for x in scores.DOMAINS)
_MAP = ", ".join(f"coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(domain_scores) THEN domain_scores END, '$.{x}') AS DOUBLE), 0) AS {x}" for x in scores.DOMAINS)


@query(f"""WITH p AS (SELECT id, {_MAP} FROM unified_knowledge), m AS (SELECT *, greatest({', '.join(scores.DOMAINS)}) AS top FROM p) SELECT id, CASE {_SCORES} END AS domain FROM m""")
def leading_domain(spark, d):
    m = scores.score_map(F.col("domain_scores"))
    return load(spark, d, "unified_knowledge").select("id", scores.top_domain(m).alias("domain"))


@query(f"""WITH p AS (SELECT id, positive_feedback - 2 * negative_feedback AS weight, {_MAP} FROM unified_knowledge WHERE status = 'active'), l AS ({' UNION ALL '.join(f"SELECT id, weight, '{x}' AS domain, {x} AS score FROM p" for x in scores.DOMAINS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY weight DESC, id) AS place FROM l WHERE score > 0) SELECT domain, id, weight, place FROM r WHERE place <= 20""")
def domain_views(spark, d):
    rows = load(spark, d, "unified_knowledge").filter(F.col("status") == "active").select(
        "id", scores.weight(F.col("positive_feedback"), F.col("negative_feedback")).alias("weight"),
        F.explode(scores.score_map(F.col("domain_scores"))).alias("domain", "score"),
    ).filter((F.col("score") > 0) & F.col("domain").isin(scores.DOMAINS))
    return retrieval.top(rows, 20, [F.col("weight").desc(), F.col("id")], "domain").select("domain", "id", "weight", "place")


# ---- windows ----

@query("""WITH r AS (SELECT id, content, row_number() OVER (PARTITION BY substr(content, 1, 60) ORDER BY id) AS p FROM unified_knowledge) SELECT id FROM r WHERE p = 1""")
def first_per_prefix(spark, d):
    return retrieval.first_per_prefix(load(spark, d, "unified_knowledge").select("id", "content"), "content", [F.col("id")]).select("id")


@query("""WITH v AS (SELECT DISTINCT id, knowledge_id, status, created_at FROM knowledge_versions WHERE knowledge_id IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY knowledge_id ORDER BY created_at DESC, id DESC) AS place, count(*) OVER (PARTITION BY knowledge_id) AS n_versions FROM v""")
def version_history(spark, d):
    return lifecycle.numbered_history(load(spark, d, "knowledge_versions"))


@query("""WITH b AS (SELECT user_id, id, length(content) // 4 AS cost, sum(length(content) // 4) OVER (PARTITION BY user_id ORDER BY positive_feedback - 2 * negative_feedback DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM unified_knowledge WHERE status = 'active') SELECT user_id, id, cost, CAST(running AS BIGINT) AS running FROM b WHERE running <= 2000""")
def context_budget(spark, d):
    rows = load(spark, d, "unified_knowledge").filter(F.col("status") == "active").select(
        "user_id", "id", text.token_estimate(F.col("content")).alias("cost"), scores.weight(F.col("positive_feedback"), F.col("negative_feedback")).alias("w")
    )
    return retrieval.within_budget(rows, "user_id", [F.col("w").desc(), F.col("id")], F.col("cost"), 2000).select("user_id", "id", "cost", "running")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) >= 2 AS over FROM events""")
def rate_windows(spark, d):
    from tidemark.streaming.folds import rate_windows as windows

    return windows(load(spark, d, "events"), "ts", "user_id", "event_id", 3600, 2)


@query("""SELECT event_id, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS writes FROM events""")
def recent_writes(spark, d):
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return load(spark, d, "events").select("event_id", F.count_if(F.col("event_type").isin("purchase", "signup")).over(last).alias("writes"))


@query("""WITH l AS (SELECT DISTINCT id, session_id, event_time FROM interaction_log WHERE session_id IS NOT NULL) SELECT id, lead(id) OVER (PARTITION BY session_id ORDER BY event_time, id) AS next_id, lag(id) OVER (PARTITION BY session_id ORDER BY event_time, id) AS prior_id FROM l""")
def neighbouring_turns(spark, d):
    log = load(spark, d, "interaction_log").filter(F.col("session_id").isNotNull()).select("id", "session_id", "event_time").distinct()
    order = Window.partitionBy("session_id").orderBy("event_time", "id")
    return log.select("id", F.lead("id").over(order).alias("next_id"), F.lag("id").over(order).alias("prior_id"))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, d):
    from tidemark.streaming.folds import tumbling

    return tumbling(load(spark, d, "events"), "ts", "event_type", "value", "6 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, no""")
def session_windows(spark, d):
    from tidemark.streaming.folds import sessions

    return sessions(load(spark, d, "events"), "ts", "user_id", "4 hours")


# ---- sets, upserts, folds ----

@query("""SELECT knowledge_id FROM feedback_log WHERE knowledge_id IS NOT NULL INTERSECT SELECT knowledge_id FROM knowledge_versions EXCEPT SELECT replaced_by FROM unified_knowledge""")
def discussed_and_versioned(spark, d):
    f = load(spark, d, "feedback_log").filter(F.col("knowledge_id").isNotNull()).select("knowledge_id")
    v = load(spark, d, "knowledge_versions").select("knowledge_id")
    r = load(spark, d, "unified_knowledge").select(F.col("replaced_by").alias("knowledge_id"))
    return f.intersect(v).exceptAll(r.distinct()).distinct()


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45""")
def union_of_keys(spark, d):
    o = load(spark, d, "orders").filter(F.col("o_orderdate") >= F.to_timestamp(F.lit("1995-01-01"))).select("o_orderkey")
    return o.union(load(spark, d, "lineitem").filter(F.col("l_quantity") > 45).select("l_orderkey")).distinct()


@query("""SELECT DISTINCT k.id FROM (SELECT DISTINCT knowledge_id AS id FROM knowledge_versions WHERE knowledge_id IS NOT NULL) k WHERE k.id NOT IN (SELECT id FROM unified_knowledge)""")
def absent_memories(spark, d):
    v = load(spark, d, "knowledge_versions").filter(F.col("knowledge_id").isNotNull()).select(F.col("knowledge_id").alias("id")).distinct()
    return lifecycle.insert_absent(load(spark, d, "unified_knowledge"), v, ["id"])


@query("""SELECT id, 'archived' AS status FROM unified_knowledge WHERE updated_at < TIMESTAMP '2025-10-01' - INTERVAL 180 DAY AND layer = 'consolidated' AND status = 'active' UNION ALL SELECT id, status FROM unified_knowledge WHERE NOT coalesce(updated_at < TIMESTAMP '2025-10-01' - INTERVAL 180 DAY AND layer = 'consolidated' AND status = 'active', false)""")
def state_after_archiving(spark, d):
    state = load(spark, d, "unified_knowledge").select("id", "status", "layer", "updated_at")
    old = (F.col("updated_at") < _now() - F.make_dt_interval(F.lit(180))) & (F.col("layer") == "consolidated") & (F.col("status") == "active")
    changes = state.filter(old).withColumn("status", F.lit("archived"))
    return lifecycle.upsert(state, changes, ["id"]).select("id", "status")


@query("""SELECT id, CASE WHEN user_id = 'u0001' THEN 'forgotten_u0001' ELSE user_id END AS user_id, CASE WHEN user_id = 'u0001' THEN '[REDACTED]' ELSE content END AS content FROM unified_knowledge""")
def redacted_store(spark, d):
    return lifecycle.redact(load(spark, d, "unified_knowledge").select("id", "user_id", "content"), USER, ["content"])


_STEP = "CASE feedback_type WHEN 'explicit_positive' THEN 0.10 WHEN 'explicit_negative' THEN -0.30 WHEN 'correction' THEN -0.30 WHEN 'system_conflict' THEN -0.15 END"


@query(f"""WITH RECURSIVE f AS (SELECT DISTINCT id, knowledge_id, created_at, {_STEP}::DOUBLE AS step FROM feedback_log WHERE knowledge_id IS NOT NULL AND {_STEP} IS NOT NULL), o AS (SELECT knowledge_id, step, row_number() OVER (PARTITION BY knowledge_id ORDER BY created_at, id) AS n FROM f),
w AS (SELECT knowledge_id, CAST(0 AS BIGINT) AS n, 0.40::DOUBLE AS c FROM (SELECT DISTINCT knowledge_id FROM o) UNION ALL SELECT w.knowledge_id, o.n, greatest(0.0, least(1.0, w.c + o.step)) FROM w JOIN o ON o.knowledge_id = w.knowledge_id AND o.n = w.n + 1)
SELECT knowledge_id, max(n) AS events, round(arg_max(c, n), 6) AS confidence FROM w GROUP BY knowledge_id""")
def confidence_fold(spark, d):
    f = load(spark, d, "feedback_log").select("id", "knowledge_id", "feedback_type", "created_at").distinct()
    return lifecycle.confidence(
        f.withColumn("week", F.date_trunc("week", "created_at")), "knowledge_id", "feedback_type", ["created_at", "id"], "week"
    )


@query("""SELECT id, CASE WHEN status = 'conflict' THEN 'superseded' WHEN positive_feedback - 2 * negative_feedback <= -20 AND status = 'active' THEN 'superseded' ELSE status END AS status, CASE WHEN positive_feedback - 2 * negative_feedback <= -20 AND status = 'active' THEN id + 1000000000 ELSE replaced_by END AS replaced_by, replaces, content FROM unified_knowledge
UNION ALL SELECT id + 1000000000, 'active', NULL, id, content || ' (revised)' FROM unified_knowledge WHERE positive_feedback - 2 * negative_feedback <= -20 AND status = 'active'""")
def superseded_state(spark, d):
    state = load(spark, d, "unified_knowledge")
    bad = (scores.weight(F.col("positive_feedback"), F.col("negative_feedback")) <= -20) & (F.col("status") == "active")
    changes = state.filter(bad).select("id", (F.col("id") + 1_000_000_000).alias("new_id"), F.concat("content", F.lit(" (revised)")).alias("content"))
    return composite.superseded(state, changes, F.lit("2025-10-01 00:00:00").cast("timestamp_ntz")).select("id", "status", "replaced_by", "replaces", "content")


@query("""WITH h AS (SELECT k.id, count(*) AS n FROM (SELECT DISTINCT id, knowledge_id FROM feedback_log) f JOIN unified_knowledge k ON k.id = f.knowledge_id GROUP BY k.id)
SELECT k.id, round(coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(k.domain_scores) THEN k.domain_scores END, '$.rule') AS DOUBLE), 0) + coalesce(h.n, 0), 6) AS rule FROM unified_knowledge k LEFT JOIN h ON h.id = k.id""")
def domain_hits(spark, d):
    hits = load(spark, d, "feedback_log").filter(F.col("knowledge_id").isNotNull()).select("id", F.col("knowledge_id")).distinct()
    hits = hits.select(F.col("knowledge_id").alias("id"), F.lit("rule").alias("domain"))
    rows = composite.domain_hits(load(spark, d, "unified_knowledge"), hits)
    return rows.select("id", F.round(F.coalesce(F.try_element_at("scores", F.lit("rule")), F.lit(0.0)), 6).alias("rule"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
