"""Queries of the write path, beliefs, maintenance, mining reports, audits and sessions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import patterns, scores, text
from tidemark.operators import beliefs, composite, identity, lifecycle, mining, retrieval, upkeep, writing
from tidemark.plans.language import _COMP, _NEG, _RELATIVE, _STOP, _index, _tokens
from tidemark.plans.registry import Registry
from tidemark.session import materialise
from tidemark.sources.tables import load

R = Registry()
query = R.query
#: The fixed clock of all rules about age.
AS_OF, DAY = "2025-10-01 00:00:00", datetime.date(2025, 10, 1)
_NOW = f"TIMESTAMP '{AS_OF}'"


def _now():
    return F.to_timestamp(F.lit(AS_OF)).cast("timestamp_ntz")


# ---- marks of texts ----

@query(rf"""WITH l AS (SELECT *, lower(content) AS low, length(content) AS n FROM unified_knowledge),
s AS (SELECT k.id, arg_max(e.key, (TRY_CAST(e.value AS DOUBLE), -CAST(e.id AS BIGINT))) AS first FROM unified_knowledge k, json_each(CASE WHEN json_valid(domain_scores) AND json_type(CASE WHEN json_valid(domain_scores) THEN domain_scores END) = 'OBJECT' THEN domain_scores ELSE '{{}}' END) e GROUP BY k.id)
SELECT l.id, substr(sha256(lower(regexp_replace(trim(content), '\s+', ' ', 'g'))), 1, 16) AS hash, CASE WHEN regexp_matches(low, '我|偏好|喜欢|习惯|用') THEN CASE WHEN n < 40 THEN 'identity' ELSE 'behavior' END
 WHEN regexp_matches(low, '应该|必须|不能|可以|要') THEN CASE WHEN n < 60 THEN 'rule' ELSE 'workflow' END WHEN regexp_matches(low, '股票|仓位|止损|买入|卖出|策略') THEN 'strategy' ELSE 'raw_fact' END AS domain,
 coalesce(s.first, CASE WHEN regexp_matches(content, '代码|函数|bug|编程') THEN 'workflow' WHEN regexp_matches(content, '喜欢|偏好|风格|习惯') THEN 'behavior' ELSE 'raw_fact' END) AS asked_domain,
 CASE layer WHEN 'instant' THEN 0.40 WHEN 'candidate' THEN 0.70 WHEN 'consolidated' THEN 0.90 END::DOUBLE AS confidence, hour(created_at) + 8 BETWEEN 9 AND 15 AS trading, regexp_matches(content, '{_RELATIVE}') AS relative,
 substr(content, 1, 500) AS beginning FROM l LEFT JOIN s ON s.id = l.id""")
def text_marks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return load(spark, d, "unified_knowledge").select(
        "id", text.plain_hash(c).alias("hash"), scores.text_domain(c).alias("domain"), scores.question_domain(c, F.col("domain_scores")).alias("asked_domain"),
        scores.layer_confidence(F.col("layer")).alias("confidence"), scores.in_trading_hours(F.col("created_at")).alias("trading"),
        patterns.has_relative_time(c).alias("relative"), F.substring(c, 1, 500).alias("beginning"),
    )


_SEG = r"""flatten(list_transform(regexp_extract_all(content, '([\x{4E00}-\x{9FFF}]+|[A-Za-z0-9._-]+)'), lambda r: CASE WHEN regexp_matches(r, '^[\x{4E00}-\x{9FFF}]') THEN list_concat([substr(r, i, 1) for i in range(1, length(r) + 1)], [substr(r, i, 2) for i in range(1, length(r))]) ELSE [r] END))"""


@query(f"SELECT id, array_to_string({_SEG}, ' ') AS segments FROM unified_knowledge")
def segmented_texts(spark, d):
    return load(spark, d, "unified_knowledge").select("id", F.array_join(text.segments(F.col("content")), " ").alias("segments"))


@query(rf"""WITH w AS (SELECT id, content, created_at, lower(regexp_extract(content, '{_RELATIVE}', 1)) AS w, CAST(created_at AS DATE) AS day FROM unified_knowledge),
r AS (SELECT *, CASE WHEN w = 'yesterday' THEN day - 1 WHEN w = 'today' THEN day WHEN w = 'tomorrow' THEN day + 1 WHEN w LIKE 'last%' THEN day - 7 WHEN w LIKE 'next%' THEN day + 7 END AS to_ FROM w)
SELECT id, CASE WHEN to_ IS NULL THEN content ELSE CASE WHEN strpos(content, w) > 0 THEN substr(content, 1, strpos(content, w) - 1) || strftime(to_, '%d %B %Y') || substr(content, strpos(content, w) + length(w)) ELSE content END
 || ' [context: session date was ' || strftime(day, '%-d %B %Y') || ', so ''' || w || ''' = ' || strftime(to_, '%d %B %Y') || ']' END AS content FROM r""")
def annotated_contents(spark, d):
    return load(spark, d, "unified_knowledge").select("id", patterns.annotate_relative(F.col("content"), F.to_date("created_at")).alias("content"))


# ---- write path ----

def _incoming(spark, d):
    """Distinct contents of the history as a batch of new texts."""
    return load(spark, d, "knowledge_versions").select((F.col("id") + 1_000_000_000).alias("id"), "user_id", "content").distinct()


_PROBES = f"""n AS (SELECT DISTINCT id + 1000000000 AS id, user_id, content FROM knowledge_versions), t AS (SELECT id, user_id, {_tokens('content')} AS ts FROM n WHERE length(trim(content)) >= 8),
w AS (SELECT id, user_id, unnest(ts) AS word, generate_subscripts(ts, 1) AS pos FROM t), c AS (SELECT id, user_id, word, count(*) AS n, min(pos) AS f FROM w WHERE word NOT IN ({_STOP}) AND (length(word) >= 2 OR regexp_matches(word, '^[\\x{{4E00}}-\\x{{9FFF}}]$')) GROUP BY 1, 2, 3),
probes AS (SELECT * FROM (SELECT id AS new_id, user_id, word AS term, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS probe FROM c) WHERE probe <= 3),
docs AS (SELECT id, status, coalesce(user_id, '') AS owner, lower(content) AS low, {_index('content')} AS terms FROM unified_knowledge), stats AS (SELECT count(*) AS n, avg(len(terms)) AS al FROM docs),
occ AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM docs), tf AS (SELECT id, dl, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM probes) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
part AS (SELECT tf.id, tf.term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al)) AS part FROM tf JOIN df ON df.term = tf.term, stats),
f1 AS (SELECT * FROM (SELECT p.new_id, p.probe, x.id AS old_id, row_number() OVER (PARTITION BY p.new_id, p.probe ORDER BY x.part DESC, x.id) AS place FROM probes p JOIN part x ON x.term = p.term JOIN docs k ON k.id = x.id AND k.status = 'active' AND k.owner IN (p.user_id, 'default')) WHERE place <= 10),
f2 AS (SELECT * FROM (SELECT p.new_id, p.probe, k.id AS old_id, row_number() OVER (PARTITION BY p.new_id, p.probe ORDER BY k.id) AS place FROM probes p JOIN docs k ON contains(k.low, p.term) AND k.status = 'active' AND k.owner IN (p.user_id, 'default')
  WHERE length(p.term) >= 2 AND p.new_id NOT IN (SELECT new_id FROM f1)) WHERE place <= 10), f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2),
z AS (SELECT new_id, probe, count(*) AS n FROM f GROUP BY 1, 2), b AS (SELECT new_id, probe, coalesce(sum(n) OVER (PARTITION BY new_id ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
SELECT f.new_id, f.old_id, CAST(min(f.probe * 100 + f.place) AS INTEGER) AS rank FROM f JOIN b ON b.new_id = f.new_id AND b.probe = f.probe WHERE b.before < 5 GROUP BY 1, 2"""


_PAIRS = _PROBES[:_PROBES.rindex("SELECT f.new_id")].rstrip() + ", pairs AS (" + _PROBES[_PROBES.rindex("SELECT f.new_id"):] + ")"


def _domain(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({c}), '我|偏好|喜欢|习惯|用') THEN CASE WHEN length({c}) < 40 THEN 'identity' ELSE 'behavior' END "
        f"WHEN regexp_matches(lower({c}), '应该|必须|不能|可以|要') THEN CASE WHEN length({c}) < 60 THEN 'rule' ELSE 'workflow' END "
        f"WHEN regexp_matches(lower({c}), '股票|仓位|止损|买入|卖出|策略') THEN 'strategy' ELSE 'raw_fact' END"
    )


def _hash(c: str) -> str:
    return rf"substr(sha256(lower(trim(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')))), 1, 16)"


# every candidate is three steps, in the order of the rules; a step is taken if it is better than what was taken before
_TARGETS = f"""{_PAIRS}, x AS (SELECT p.new_id, p.old_id, p.rank, {_domain('n.content')} = {_domain('k.content')} AS same, list_distinct({_tokens('n.content')}) AS a, list_distinct({_tokens('k.content')}) AS b, regexp_matches(lower(n.content), '{_COMP}') AS adds
  FROM pairs p JOIN n ON n.id = p.new_id JOIN unified_knowledge k ON k.id = p.old_id WHERE k.status = 'active'),
y AS (SELECT *, len(list_intersect(a, b)) AS sh, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END AS sim FROM x),
ev AS (SELECT new_id, rank, old_id, 1 AS step, 'contradict' AS action, same AND sim > 0.40 AND sh >= 3 AND list_has_any(a, {_NEG}) AND NOT list_has_any(b, {_NEG}) AS holds, sim FROM y
  UNION ALL SELECT new_id, rank, old_id, 2, 'fuzzy_dup', same AND (sim > 0.60 OR (len(a) > 0 AND sh / len(a) > 0.90) OR (len(b) > 0 AND sh / len(b) > 0.90)), sim FROM y
  UNION ALL SELECT new_id, rank, old_id, 3, 'complement', same AND sim BETWEEN 0.40 AND 0.85 AND adds, sim FROM y),
ls AS (SELECT new_id, list({{'score': sim::DOUBLE, 'id': old_id, 'action': action, 'holds': holds}} ORDER BY rank, old_id, step) AS l FROM ev GROUP BY new_id),
best AS (SELECT new_id, list_reduce(list_prepend({{'score': 0::DOUBLE, 'id': NULL::BIGINT, 'action': 'new', 'holds': true}}, l), lambda s, e: CASE WHEN e.holds AND e.score > s.score AND NOT (e.action = 'fuzzy_dup' AND s.action = 'contradict') THEN e ELSE s END) AS s FROM ls),
ex AS (SELECT {_hash('content')} AS h, user_id, min(id) AS id FROM unified_knowledge WHERE status = 'active' GROUP BY 1, 2),
targets AS (SELECT n.id AS new_id, CASE WHEN ex.id IS NOT NULL THEN 'exact_dup' ELSE coalesce(best.s.action, 'new') END AS action, CASE WHEN ex.id IS NOT NULL THEN ex.id ELSE best.s.id END AS target_id,
  round(CASE WHEN ex.id IS NOT NULL THEN 1 ELSE coalesce(best.s.score, 0) END, 3)::DOUBLE AS similarity FROM n LEFT JOIN ex ON ex.h = {_hash('n.content')} AND ex.user_id = n.user_id LEFT JOIN best ON best.new_id = n.id WHERE trim(n.content) <> '')"""


@query(f"WITH {_PROBES}")
def merge_candidates(spark, d):
    return writing.candidates(_incoming(spark, d), load(spark, d, "unified_knowledge")).withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {_TARGETS} SELECT * FROM targets")
def merge_targets(spark, d):
    """How each text of a batch is taken in; equal to a plain loop in the tests."""
    store, new = load(spark, d, "unified_knowledge"), _incoming(spark, d)
    return writing.merge_targets(new, store, writing.candidates(new, store))


@query(f"""WITH {_TARGETS}, into_ AS (SELECT t.target_id AS id, arg_min(n.content, t.new_id) AS new, min(t.new_id) AS new_id FROM targets t JOIN n ON n.id = t.new_id WHERE t.action IN ('fuzzy_dup', 'complement') GROUP BY 1),
mm AS (SELECT k.*, i.new, list_distinct({_tokens('k.content')}) AS a, list_distinct({_tokens("coalesce(i.new, '')")}) AS b FROM unified_knowledge k LEFT JOIN into_ i ON i.id = k.id),
cc AS (SELECT *, CASE WHEN new IS NULL THEN content WHEN len(a) = 0 OR len(b) = 0 THEN new WHEN len(list_intersect(a, b)) / greatest(len(a), len(b)) > 0.9 OR (len(list_intersect(a, b)) / len(b) > 0.85 AND length(content) > length(new) * 1.5) THEN content ELSE content || ' § ' || new END AS body FROM mm)
SELECT id, body AS content, CASE WHEN new IS NULL THEN match_hash ELSE {_hash('body')} END AS match_hash, layer, status, user_id FROM cc
UNION ALL SELECT t.new_id, trim(n.content), {_hash('n.content')}, 'instant', 'active', n.user_id FROM targets t JOIN n ON n.id = t.new_id WHERE t.action <> 'exact_dup' AND t.new_id NOT IN (SELECT new_id FROM into_)""")
def state_after_writing(spark, d):
    store, new = load(spark, d, "unified_knowledge"), _incoming(spark, d)
    targets = materialise(writing.merge_targets(new, store, writing.candidates(new, store)), "targets")
    return writing.written(store, new, targets, _now())[0].select("id", "content", "match_hash", "layer", "status", "user_id")


@query("""SELECT id, session_id, user_id, substr(coalesce(user_query, ''), 1, 500) AS user_query, substr(coalesce(model_response, ''), 1, 2000) AS model_response, coalesce(event_time, created_at) AS event_time
FROM (SELECT DISTINCT * FROM interaction_log) l WHERE correction_of IS NULL OR EXISTS (SELECT 1 FROM interaction_log p WHERE CAST(p.id AS VARCHAR) = l.correction_of)""")
def logged_turns(spark, d):
    log = load(spark, d, "interaction_log").distinct()
    return writing.logged(log, log).select("id", "session_id", "user_id", "user_query", "model_response", "event_time")


def _note_rows(spark, d, status):
    """Structured notes with one metric, as they are read from texts: one per order line."""
    l = load(spark, d, "lineitem").filter(F.col("l_linestatus") == status)  # noqa: E741
    note = F.format_string("产品: %d\nPE: %s\n条件: %s", "l_partkey", F.col("l_quantity").cast("string"), "l_returnflag")
    rows = l.select((F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), note.alias("content"))
    return writing.metric_values(rows)


_VALUES = "SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id, l_partkey AS entity, 'PE' AS metric, l_quantity AS value, l_returnflag AS condition FROM lineitem WHERE l_linestatus = "


@query(f"""WITH new AS ({_VALUES}'O'), old AS ({_VALUES}'F'), m AS (SELECT n.id AS new_id, o.id AS other_id, n.entity, n.metric, n.value, o.value AS v FROM new n JOIN old o ON o.entity = n.entity AND o.metric = n.metric AND abs(o.value - n.value) >= 0.01 AND o.condition = n.condition)
SELECT new_id, count(*) AS n_conflicts, min(other_id) AS other_id, CAST(arg_min(entity, other_id) AS VARCHAR) AS entity, arg_min(metric, other_id) AS metric, arg_min(value, (other_id, value, v)) AS value, arg_min(v, (other_id, value, v)) AS other_value FROM m GROUP BY new_id""")
def metric_conflicts(spark, d):
    """New values of a metric against all known ones of the same subject."""
    return writing.metric_conflicts(_note_rows(spark, d, "O"), _note_rows(spark, d, "F"))


@query(f"""WITH v AS ({_VALUES}'F'), c AS (SELECT metric, condition, value, count(*) AS n FROM v GROUP BY 1, 2, 3), s AS (SELECT a.metric, a.condition, a.value, sum(b.n) AS k FROM c a JOIN c b ON b.metric = a.metric AND b.condition = a.condition AND abs(b.value - a.value) >= 0.01 GROUP BY 1, 2, 3)
SELECT v.id, v.metric, CAST(sum(s.k) AS BIGINT) AS n_conflicts FROM v JOIN s ON s.metric = v.metric AND s.condition = v.condition AND s.value = v.value GROUP BY 1, 2 HAVING sum(s.k) > 0""")
def layer_conflicts(spark, d):
    return writing.layer_conflicts(_note_rows(spark, d, "F").select("id", "metric", "value", "condition"))


@query("""SELECT p_partkey AS id, p_brand AS entity, count(*) OVER (PARTITION BY p_brand) - 1 AS peers FROM part QUALIFY peers > 0""")
def same_entity_rows(spark, d):
    p = load(spark, d, "part")
    return upkeep.same_entity_rows(p.select(F.col("p_partkey").alias("id"), F.format_string("产品: %s\nPE: %d\n", "p_brand", "p_size").alias("content")))


@query("""SELECT p_brand AS entity, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3""")
def repeated_entities(spark, d):
    return upkeep.repeated_entities(load(spark, d, "part").select(F.format_string("产品: %s\nPE: %d\n", "p_brand", "p_size").alias("content")))


@query("""WITH h AS (SELECT list_sort(list_filter(['分析','查询','搜索','计算','生成','预测','诊断','报告','监控','对比','评估','汇总'], lambda w: contains(content, w))) AS hits FROM (SELECT text AS content FROM documents WHERE text IS NOT NULL))
SELECT array_to_string(hits, '+') AS pattern, count(*) AS n FROM h WHERE len(hits) >= 2 GROUP BY 1 HAVING count(*) >= 3""")
def work_combinations(spark, d):
    return upkeep.work_combinations(load(spark, d, "documents").select(F.col("text").alias("content")))


# ---- beliefs ----

_STEP = "CASE feedback_type WHEN 'encounter' THEN 3 WHEN 'explicit_positive' THEN 2 WHEN 'explicit_negative' THEN -6 WHEN 'correction' THEN -6 WHEN 'system_conflict' THEN -3 END"
_LEVELS = f"""f AS (SELECT DISTINCT id, knowledge_id, created_at, {_STEP} AS step FROM feedback_log WHERE knowledge_id IS NOT NULL AND {_STEP} IS NOT NULL), o AS (SELECT knowledge_id, step, row_number() OVER (PARTITION BY knowledge_id ORDER BY created_at NULLS FIRST, id) AS n FROM f),
w AS (SELECT knowledge_id, CAST(0 AS BIGINT) AS n, 8 AS c, 'observation' AS t FROM (SELECT DISTINCT knowledge_id FROM o) UNION ALL SELECT w.knowledge_id, o.n, greatest(0, least(20, w.c + o.step)),
 CASE WHEN w.t = 'observation' AND w.c + o.step >= 14 THEN 'belief' WHEN w.t = 'belief' AND w.c + o.step >= 18 THEN 'fact' WHEN w.t = 'belief' AND w.c + o.step < 10 THEN 'observation' WHEN w.t = 'fact' AND w.c + o.step < 14 THEN 'belief' ELSE w.t END FROM w JOIN o ON o.knowledge_id = w.knowledge_id AND o.n = w.n + 1),
levels AS (SELECT knowledge_id, max(n) AS events, round(arg_max(c, n) * 0.05, 6)::DOUBLE AS confidence, arg_max(t, n) AS belief_type FROM w GROUP BY knowledge_id)"""


def _beliefs(spark, d):
    f = load(spark, d, "feedback_log").select("id", "knowledge_id", "feedback_type", "created_at").distinct()
    return beliefs.fold(f, "knowledge_id", "feedback_type", ["created_at", "id"])


@query(f"WITH RECURSIVE {_LEVELS} SELECT * FROM levels")
def belief_levels(spark, d):
    return _beliefs(spark, d)


@query(f"""WITH RECURSIVE {_LEVELS} SELECT count(*) FILTER (WHERE belief_type = 'observation') AS observations, count(*) FILTER (WHERE belief_type = 'belief') AS beliefs, count(*) FILTER (WHERE belief_type = 'fact') AS facts, count(*) AS total, round(avg(confidence), 3) AS average_confidence FROM levels""")
def belief_stats(spark, d):
    return beliefs.stats(_beliefs(spark, d))


_FADED = f"""faded AS (SELECT l.knowledge_id, CASE WHEN i.id IS NOT NULL THEN round(greatest(0, l.confidence - 0.05), 6) ELSE l.confidence END AS confidence, l.belief_type AS t, i.id IS NOT NULL AS decayed FROM levels l
 LEFT JOIN (SELECT id FROM unified_knowledge WHERE updated_at < {_NOW} - INTERVAL 48 HOUR) i ON i.id = l.knowledge_id AND l.belief_type <> 'fact'),
moved AS (SELECT knowledge_id, confidence, decayed, t AS before, CASE WHEN NOT decayed THEN t WHEN t = 'observation' AND confidence >= 0.70 THEN 'belief' WHEN t = 'belief' AND confidence >= 0.90 THEN 'fact' WHEN t = 'belief' AND confidence < 0.50 THEN 'observation' ELSE t END AS belief_type FROM faded)"""


@query(f"WITH RECURSIVE {_LEVELS}, {_FADED} SELECT knowledge_id, confidence, belief_type, decayed FROM moved")
def decayed_beliefs(spark, d):
    return beliefs.decayed(_beliefs(spark, d), load(spark, d, "unified_knowledge"), _now())


@query(f"WITH RECURSIVE {_LEVELS} SELECT k.id FROM levels l JOIN unified_knowledge k ON k.id = l.knowledge_id WHERE k.status = 'active' AND l.belief_type = 'observation' AND l.confidence < 0.30")
def weak_beliefs(spark, d):
    return beliefs.archived_by_belief(_beliefs(spark, d), load(spark, d, "unified_knowledge"))


# ---- maintenance ----

_AGED = f"""aged AS (SELECT *, layer = 'candidate' AND w >= 8 AND status = 'active' AS p, layer IN ('candidate', 'consolidated') AND w <= -5 AND status = 'active' AS g FROM (SELECT *, positive_feedback - 2 * negative_feedback AS w FROM unified_knowledge
 WHERE NOT coalesce(layer = 'instant' AND status = 'active' AND updated_at < {_NOW} - INTERVAL 30 DAY, false))),
a2 AS (SELECT *, NOT g AND NOT p AND layer = 'consolidated' AND status = 'active' AND coalesce(updated_at < {_NOW} - INTERVAL 180 DAY, false) AS a FROM aged),
a3 AS (SELECT *, NOT g AND NOT a AND status = 'active' AND CASE WHEN p THEN 'consolidated' ELSE layer END = 'consolidated' AND coalesce(active_summary, '') = '' AS s FROM a2)"""
_SUMMARY = """CASE WHEN trim(split_part(content, '§', 1)) <> '' AND contains(content, '§') THEN CASE WHEN length(trim(split_part(content, '§', 1))) <= 200 THEN trim(split_part(content, '§', 1)) ELSE substr(trim(split_part(content, '§', 1)), 1, 197) || '...' END
 WHEN trim(split_part(content, chr(10), 1)) <> '' THEN CASE WHEN length(trim(split_part(content, chr(10), 1))) <= 200 THEN trim(split_part(content, chr(10), 1)) ELSE substr(trim(split_part(content, chr(10), 1)), 1, 197) || '...' END ELSE substr(content, 1, 200) END"""
_RUN = f"""{_LEVELS}, {_AGED}, levels2 AS (SELECT * FROM levels WHERE knowledge_id IN (SELECT id FROM a3)), {_FADED.replace('FROM levels l', 'FROM levels2 l')},
kept AS (SELECT a3.id, a3.content, a3.p, a3.g, a3.a, a3.s, CASE WHEN m.decayed AND m.before <> m.belief_type THEN CASE m.belief_type WHEN 'observation' THEN 'instant' WHEN 'belief' THEN 'candidate' ELSE 'consolidated' END WHEN a3.p THEN 'consolidated' ELSE a3.layer END AS layer,
 coalesce(a3.status = 'active' AND NOT a3.g AND NOT a3.a AND m.belief_type = 'observation' AND m.confidence < 0.30, false) AS weak, CASE WHEN a3.g THEN 'superseded' WHEN a3.a THEN 'archived' ELSE a3.status END AS st, CASE WHEN a3.s THEN {_SUMMARY} ELSE a3.active_summary END AS active_summary FROM a3 LEFT JOIN moved m ON m.knowledge_id = a3.id),
done AS (SELECT id, content, layer, CASE WHEN weak THEN 'archived' ELSE st END AS status, active_summary, p, g, a, s, weak FROM kept),
work AS (SELECT array_to_string(hits, '+') AS pattern, count(*) AS n FROM (SELECT list_sort(list_filter(['分析','查询','搜索','计算','生成','预测','诊断','报告','监控','对比','评估','汇总'], lambda w: contains(content, w))) AS hits FROM done WHERE status = 'active' AND layer = 'instant') WHERE len(hits) >= 2 GROUP BY 1 HAVING count(*) >= 3)"""


def _consolidated(spark, d):
    return upkeep.consolidate(load(spark, d, "unified_knowledge"), _beliefs(spark, d), _now())


@query(f"""WITH RECURSIVE {_RUN} SELECT content, layer, status, active_summary FROM done UNION ALL SELECT '涌现技能: ' || pattern || chr(10) || '次数: ' || n, 'consolidated', 'active', NULL FROM work""")
def consolidated_state(spark, d):
    return _consolidated(spark, d)["state"].select("content", "layer", "status", "active_summary")


@query(f"""WITH RECURSIVE {_RUN}, n AS (SELECT 'cleaned' AS action, (SELECT count(*) FROM unified_knowledge) - (SELECT count(*) FROM a3) AS n UNION ALL SELECT 'promoted', count(*) FILTER (WHERE p) FROM done UNION ALL SELECT 'superseded', count(*) FILTER (WHERE g) FROM done UNION ALL SELECT 'archived', count(*) FILTER (WHERE a) FROM done
 UNION ALL SELECT 'summarised', count(*) FILTER (WHERE s) FROM done UNION ALL SELECT 'decayed', count(*) FILTER (WHERE decayed) FROM moved UNION ALL SELECT 'archived_by_belief', count(*) FILTER (WHERE weak) FROM done UNION ALL SELECT 'skills', count(*) FROM work) SELECT action, n FROM n WHERE n > 0""")
def consolidation_actions(spark, d):
    return _consolidated(spark, d)["actions"]


@query(f"""WITH RECURSIVE {_RUN} SELECT v.knowledge_id, v.change_reason, v.layer_after FROM (SELECT k.id AS knowledge_id, 'upkeep' AS change_reason, d.layer AS layer_after FROM unified_knowledge k JOIN done d ON d.id = k.id WHERE k.layer <> d.layer OR k.status <> d.status) v""")
def versions_of_upkeep(spark, d):
    before = load(spark, d, "unified_knowledge")
    after = _consolidated(spark, d)["state"]
    rows = writing.versioned(before, after, F.lit("upkeep"), _now())
    return rows.join(after.select(F.col("id").alias("knowledge_id"), F.col("layer").alias("layer_after")), "knowledge_id").select("knowledge_id", "change_reason", "layer_after")


# ---- mining and audits ----

_USED = """log AS (SELECT DISTINCT id, user_id, user_query, knowledge_used, correction_of, created_at FROM interaction_log),
items AS (SELECT l.id, l.user_id, l.created_at, l.correction_of IS NOT NULL AS fix, TRY_CAST(json_extract_string(e.value, '$.id') AS BIGINT) AS kid FROM log l, json_each(CASE WHEN json_valid(l.knowledge_used) THEN l.knowledge_used ELSE '[]' END) e)"""
_DOMAINS = ", ".join(f"'{x}'" for x in ("identity", "workflow", "behavior", "strategy", "rule", "raw_fact"))
_SCORED = f"""scored AS (SELECT k.id, x.d AS domain FROM unified_knowledge k, (SELECT unnest([{_DOMAINS}]) AS d) x WHERE TRY_CAST(json_extract_string(CASE WHEN json_valid(k.domain_scores) THEN k.domain_scores END, '$.' || x.d) AS DOUBLE) > 0)"""


@query(f"""SELECT id, layer, date_diff('day', CAST(updated_at AS DATE), DATE '2025-10-01')::INTEGER AS days, CASE WHEN layer = 'consolidated' AND date_diff('day', CAST(updated_at AS DATE), DATE '2025-10-01') > 90 THEN 'review' WHEN layer = 'consolidated' THEN 'watch' ELSE 'demote' END AS advice
FROM unified_knowledge WHERE status = 'active' AND layer <> 'instant' AND updated_at < {_NOW} - INTERVAL 60 DAY AND (layer = 'candidate' OR date_diff('day', CAST(updated_at AS DATE), DATE '2025-10-01') > 60)""")
def stale_knowledge(spark, d):
    return mining.stale(load(spark, d, "unified_knowledge"), _now())


def _accuracy_sql(where: str = "true") -> str:
    return f"""SELECT domain, count(*) AS total, count(*) FILTER (WHERE fix) AS errors, 1 - count(*) FILTER (WHERE fix) / count(*) AS a FROM (SELECT DISTINCT i.id, i.fix, s.domain FROM items i JOIN scored s ON s.id = i.kid WHERE {where}) GROUP BY 1"""


@query(f"""WITH {_USED}, {_SCORED}, g AS ({_accuracy_sql()}) SELECT domain, total, errors, round(a, 3) AS accuracy, CASE WHEN a > 0.9 AND total >= 5 THEN 'high' WHEN a > 0.7 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def domain_accuracy(spark, d):
    return mining.domain_accuracy(mining.distinct_log(load(spark, d, "interaction_log")), load(spark, d, "unified_knowledge"))


@query("""SELECT count(*) AS total, count(correction_of) AS corrected, round(1 - count(correction_of) / count(*), 3) AS accuracy FROM (SELECT DISTINCT id, correction_of FROM interaction_log)""")
def overall_accuracy(spark, d):
    return mining.overall_accuracy(mining.distinct_log(load(spark, d, "interaction_log")))


_CUT = "TIMESTAMP '2024-10-01'"
_DRIFT = f"""WITH {_USED}, {_SCORED}, a AS ({_accuracy_sql(f'i.created_at < {_CUT}')}), b AS ({_accuracy_sql(f'i.created_at >= {_CUT}')}), j AS (SELECT coalesce(a.domain, b.domain) AS domain, coalesce(round(a.a, 3), 0) AS before, coalesce(round(b.a, 3), 0) AS after FROM a FULL JOIN b ON b.domain = a.domain),
c AS (SELECT *, round(abs(after - before), 6) AS change, round(abs(after - before), 6) > 0.1 AS drifted FROM j)"""


def _drift(spark, d):
    log, known, cut = mining.distinct_log(load(spark, d, "interaction_log")), load(spark, d, "unified_knowledge"), F.to_timestamp(F.lit("2024-10-01"))
    part = lambda rows: mining.domain_accuracy(rows, known).select("domain", "accuracy")
    return mining.drift(part(log.filter(F.col("created_at") < cut)), part(log.filter(F.col("created_at") >= cut)), ["domain"], "accuracy")


@query(f"{_DRIFT} SELECT * FROM c")
def drift_by_domain(spark, d):
    return _drift(spark, d)


@query(f"{_DRIFT} SELECT max(change) AS most, count(*) FILTER (WHERE drifted) AS n_drifted FROM c")
def largest_drift(spark, d):
    return mining.largest_drift(_drift(spark, d))


_QUALITY = f"""{_USED}, u AS (SELECT kid, count(*) AS n, count(*) FILTER (WHERE fix) AS c FROM items WHERE kid IS NOT NULL GROUP BY kid),
q AS (SELECT k.id, coalesce(u.n, 0) AS n_used, coalesce(u.c, 0) AS n_corrected, round(CASE WHEN coalesce(u.n, 0) > 0 THEN u.c / u.n ELSE 0 END, 3) AS rate,
  round(coalesce(u.n, 0) * (1 - CASE WHEN coalesce(u.n, 0) > 0 THEN u.c / u.n ELSE 0 END) + k.positive_feedback - 2 * k.negative_feedback, 2) AS score FROM unified_knowledge k LEFT JOIN u ON u.kid = k.id WHERE k.status = 'active'),
qf AS (SELECT *, CASE WHEN rate > 0.3 AND n_used >= 3 THEN 'high_risk' WHEN rate > 0.1 AND n_used >= 5 THEN 'watch' WHEN score > 5 THEN 'good' ELSE 'normal' END AS flag FROM q)"""


def _quality(spark, d):
    return mining.quality(load(spark, d, "unified_knowledge"), mining.usage(mining.distinct_log(load(spark, d, "interaction_log"))))


@query(f"WITH {_QUALITY} SELECT * FROM qf ORDER BY score DESC, id LIMIT 10")
def best_memories(spark, d):
    return mining.top_quality(_quality(spark, d))


@query(rf"""WITH {_QUALITY}, w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(user_query), '([\x{{4E00}}-\x{{9FFF}}]{{2,}}|[a-z0-9_]{{2,}})')) AS word FROM log WHERE correction_of IS NULL),
k AS (SELECT * FROM w WHERE length(word) BETWEEN 2 AND 6 AND word NOT IN ('一个','这个','那个','什么','怎么','如何','可以','需要','没有','不是','就是','还是','因为','所以','但是','而且')),
t AS (SELECT word, kid, count(*) AS together FROM k JOIN (SELECT DISTINCT id, kid FROM items WHERE kid IS NOT NULL) i ON i.id = k.id GROUP BY 1, 2), s AS (SELECT word, sum(together) AS total FROM t GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY together DESC, kid) AS p FROM t WHERE together >= 3), pt AS (SELECT r.word FROM r JOIN s ON s.word = r.word JOIN unified_knowledge u ON u.id = r.kid WHERE r.p <= 3 AND round(r.together / s.total, 2) >= 0.5),
st AS (SELECT id FROM unified_knowledge WHERE status = 'active' AND layer <> 'instant' AND updated_at < {_NOW} - INTERVAL 60 DAY AND (layer = 'candidate' OR date_diff('day', CAST(updated_at AS DATE), DATE '2025-10-01') > 60))
SELECT count(*) AS active, count(*) FILTER (WHERE flag = 'good') AS good, count(*) FILTER (WHERE flag = 'watch') AS watch, count(*) FILTER (WHERE flag = 'high_risk') AS high_risk, (SELECT count(*) FROM pt) AS patterns, (SELECT count(*) FROM st) AS stale FROM qf""")
def mining_report(spark, d):
    known, log = load(spark, d, "unified_knowledge"), mining.distinct_log(load(spark, d, "interaction_log"))
    return mining.report(_quality(spark, d), mining.cooccurrence(log, known), mining.stale(known, _now()))


@query(f"""WITH {_USED}, l AS (SELECT id, user_id, created_at FROM log WHERE knowledge_used <> '[]' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 100),
c AS (SELECT i.user_id, i.kid AS knowledge_id, count(*) AS n FROM items i JOIN l ON l.id = i.id WHERE i.kid IS NOT NULL GROUP BY 1, 2) SELECT user_id, knowledge_id, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, knowledge_id) <= 10""")
def most_used_per_user(spark, d):
    """The memories used most in the newest answers of each user."""
    from tidemark.operators.references import used_ids

    log = mining.distinct_log(load(spark, d, "interaction_log")).filter(F.col("knowledge_used") != "[]")
    newest = retrieval.top(log, 100, [F.col("created_at").desc(), F.col("id").desc()], "user_id")
    used = used_ids(newest, keep=["user_id"]).filter(F.col("target_id").isNotNull()).groupBy("user_id", F.col("target_id").alias("knowledge_id")).agg(F.count(F.lit(1)).alias("n"))
    return retrieval.top(used, 10, [F.col("n").desc(), F.col("knowledge_id")], "user_id").select("user_id", "knowledge_id", "n")


@query("""WITH l AS (SELECT DISTINCT id, user_id, correction_of, created_at, event_time FROM interaction_log WHERE event_time IS NULL OR event_time <= TIMESTAMP '2024-09-01'),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time NULLS FIRST, created_at NULLS FIRST, id) AS n FROM l) SELECT user_id, count(*) AS interactions, count(correction_of) AS corrections, round(count(correction_of) / count(*), 3) AS rate, arg_min(id, n) AS first_id, arg_max(id, n) AS last_id FROM f WHERE n <= 200 GROUP BY user_id""")
def audit_snapshot(spark, d):
    """What each user's log held at a time: its first 200 turns."""
    log = load(spark, d, "interaction_log").select("id", "user_id", "correction_of", "created_at", "event_time").distinct()
    log = log.filter(F.col("event_time").isNull() | (F.col("event_time") <= F.to_timestamp(F.lit("2024-09-01"))))
    order = [F.col("event_time").asc_nulls_first(), F.col("created_at").asc_nulls_first(), F.col("id")]
    first = retrieval.top(log, 200, order, "user_id")
    return first.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("interactions"), F.count("correction_of").alias("corrections"), F.round(F.count("correction_of") / F.count(F.lit(1)), 3).alias("rate"),
        F.min_by("id", "place").alias("first_id"), F.max_by("id", "place").alias("last_id"),
    )


@query("""WITH a AS (SELECT f.id, f.knowledge_id, f.source, f.created_at, substr(k.content, 1, 100) AS content FROM (SELECT DISTINCT id, knowledge_id, source, created_at FROM feedback_log WHERE feedback_type = 'system_conflict') f JOIN unified_knowledge k ON k.id = f.knowledge_id WHERE k.status = 'active' ORDER BY f.created_at DESC, f.id DESC LIMIT 5),
m AS (SELECT * FROM unified_knowledge WHERE status = 'active' AND user_id IN ('u0001', 'default')), b AS (SELECT * FROM m WHERE layer = 'consolidated' AND negative_feedback > positive_feedback + 3 ORDER BY id LIMIT 3)
SELECT 'conflict' AS kind, knowledge_id, source AS detail, content FROM a UNION ALL SELECT 'instant_pileup', NULL, count(*) || ' rows wait', NULL FROM m WHERE layer = 'instant' HAVING count(*) > 10 UNION ALL SELECT 'negative_overload', id, negative_feedback || ' against ' || positive_feedback, substr(content, 1, 80) FROM b""")
def alerts(spark, d):
    return composite.alerts(load(spark, d, "unified_knowledge"), load(spark, d, "feedback_log"), "u0001")


@query("""SELECT count(*) FILTER (WHERE status = 'active') AS total, count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2025-10-01') AS on_day, date_diff('day', min(CAST(created_at AS DATE)), DATE '2025-10-01') + 1 AS days_active,
(SELECT count(*) FROM knowledge_versions WHERE change_reason IN ('merge', 'dedup')) AS merges, (SELECT count(DISTINCT id) FROM feedback_log WHERE feedback_type = 'system_conflict') AS conflicts FROM unified_knowledge WHERE user_id IN ('u0001', 'default')""")
def cold_start(spark, d):
    return composite.cold_start(load(spark, d, "unified_knowledge"), load(spark, d, "knowledge_versions"), load(spark, d, "feedback_log"), "u0001", DAY)


_VIEW = ", ".join(f"coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(domain_scores) THEN domain_scores END, '$.{x}') AS DOUBLE), 0) AS {x}" for x in scores.DOMAINS)


@query(f"""WITH p AS (SELECT id, positive_feedback AS pf, negative_feedback AS nf, {_VIEW} FROM unified_knowledge WHERE status = 'active'), l AS ({' UNION ALL '.join(f"SELECT id, pf, nf, '{x}' AS domain, {x} AS score FROM p" for x in scores.DOMAINS)}),
r AS (SELECT * FROM l WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY pf - 2 * nf, id) <= 20) SELECT domain, count(*) FILTER (WHERE nf > pf) AS n FROM r GROUP BY 1 HAVING n > 3""")
def rejected_views(spark, d):
    """Domains whose least confirmed rows are mostly rejected."""
    rows = load(spark, d, "unified_knowledge").filter(F.col("status") == "active").select(
        "id", "positive_feedback", "negative_feedback", F.explode(scores.score_map(F.col("domain_scores"))).alias("domain", "score")
    ).filter((F.col("score") > 0) & F.col("domain").isin(scores.DOMAINS))
    return composite.rejected_views(retrieval.top(rows, 20, [scores.weight(F.col("positive_feedback"), F.col("negative_feedback")), F.col("id")], "domain"))


# ---- sessions ----

@query("""WITH s AS (SELECT session_id, split_part(session_id, '-', 1) AS platform, substr(split_part(session_id, '-', 2), 1, 2) AS hostname FROM interaction_log WHERE session_id IS NOT NULL),
k AS (SELECT substr(sha256(session_id || '|' || platform || '|' || hostname), 1, 16) AS fingerprint, platform, hostname, min(user_id) AS user_id, count(*) AS hits FROM (SELECT session_id, split_part(session_id, '-', 1) AS platform, substr(split_part(session_id, '-', 2), 1, 2) AS hostname, user_id FROM feedback_log WHERE session_id IS NOT NULL AND user_id IS NOT NULL) GROUP BY session_id, platform, hostname),
h AS (SELECT platform, hostname, arg_min(user_id, (-hits, user_id)) AS theirs FROM k WHERE hostname <> '' GROUP BY 1, 2), b AS (SELECT substr(sha256(session_id || '|' || platform || '|' || hostname), 1, 16) AS fingerprint, platform, hostname, count(*) AS n FROM s GROUP BY session_id, platform, hostname)
SELECT b.fingerprint, b.platform, b.hostname, b.n, coalesce(k.user_id, h.theirs, 'anon_' || substr(sha256(CASE WHEN b.hostname <> '' THEN 'host|' || b.hostname || '|' || b.platform ELSE b.fingerprint END), 1, 8)) AS user_id, CASE WHEN k.user_id IS NOT NULL THEN 'session' WHEN h.theirs IS NOT NULL THEN 'host' ELSE 'new' END AS how
FROM b LEFT JOIN k ON k.fingerprint = b.fingerprint LEFT JOIN h ON h.platform = b.platform AND h.hostname = b.hostname""")
def session_users(spark, d):
    """Users of the log's sessions, known from the sessions of the feedback; the first two digits
    of a session stand for its host."""
    def sessions(name, *more):
        rows = load(spark, d, name).filter(F.col("session_id").isNotNull())
        return rows.select("session_id", F.substring_index("session_id", "-", 1).alias("platform"), F.substring(F.split_part("session_id", F.lit("-"), F.lit(2)), 1, 2).alias("hostname"), *more)

    known = identity.marked(sessions("feedback_log", "user_id").filter(F.col("user_id").isNotNull())).groupBy("fingerprint", "platform", "hostname").agg(
        F.min("user_id").alias("user_id"), F.count(F.lit(1)).alias("hit_count")
    )
    return identity.resolved(sessions("interaction_log"), known)


@query("""SELECT id, 'unified_knowledge' AS table_name, CASE WHEN user_id = 'u0001' THEN 'forgotten_u0001' ELSE user_id END AS user_id, CASE WHEN user_id = 'u0001' THEN '[REDACTED]' ELSE content END AS body FROM unified_knowledge UNION ALL
SELECT DISTINCT id, 'interaction_log', CASE WHEN user_id = 'u0001' THEN 'forgotten_u0001' ELSE user_id END, CASE WHEN user_id = 'u0001' AND user_query IS NOT NULL THEN '[REDACTED]' ELSE user_query END FROM interaction_log""")
def forgotten_user(spark, d):
    tables = lifecycle.forgotten("u0001", load(spark, d, "unified_knowledge"), load(spark, d, "interaction_log"))
    part = lambda name, c: tables[name].select("id", F.lit(name).alias("table_name"), "user_id", F.col(c).alias("body"))
    return part("unified_knowledge", "content").unionByName(part("interaction_log", "user_query").distinct())


@query("""WITH l AS (SELECT DISTINCT id, session_id, user_id, created_at FROM interaction_log) SELECT l.id, l.session_id, k.id AS memory_id FROM l ASOF JOIN (SELECT id, user_id, created_at FROM unified_knowledge WHERE created_at IS NOT NULL AND user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, created_at ORDER BY id DESC) = 1) k ON k.user_id = l.user_id AND k.created_at <= l.created_at""")
def newest_memory_at_turn(spark, d):
    """As-of join: the newest memory of the user at each turn."""
    log = load(spark, d, "interaction_log").select("id", "session_id", "user_id", "created_at").distinct()
    known = load(spark, d, "unified_knowledge").filter(F.col("user_id").isNotNull() & F.col("created_at").isNotNull()).select("id", "user_id", "created_at")
    return lifecycle.as_of(log, known, "user_id", "created_at", "id").filter(F.col("as_of_id").isNotNull()).select("id", "session_id", F.col("as_of_id").alias("memory_id"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
