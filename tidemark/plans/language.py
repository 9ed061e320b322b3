"""Queries of text, search, vector and pattern functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import patterns, scores, text
from tidemark.operators import composite, graph, lifecycle, mining, retrieval
from tidemark.plans.registry import Registry
from tidemark.session import work_folder
from tidemark.sources.index import TextIndex
from tidemark.sources.tables import load

R = Registry()
query = R.query
#: SQL pattern of relative times.
_RELATIVE = r"(?i)\b(yesterday|today|tomorrow|last\s+\w+|next\s+\w+|this\s+\w+|ago)\b"
#: A batch of searches.
SEARCHES = [(1, "nightly job of the storage team"), (2, "reviews before the migration"), (3, "压缩 索引 告警"), (4, "cluster.idle_pipeline")]

_LOW = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PAIRS = r"flatten(list_transform(regexp_extract_all({c}, '([\x{{4E00}}-\x{{9FFF}}]{{2,}})'), lambda r: [substr(r, i, 2) for i in range(1, length(r))]))"


_TOKENS = r"""flatten(list_transform(regexp_extract_all(lower({c}), '([\p{{L}}\p{{N}}]+)'), lambda r: CASE WHEN regexp_matches(r, '[\x{{4E00}}-\x{{9FFF}}]') THEN [substr(r, i, 1) for i in range(1, length(r) + 1)] ELSE [r] END))"""


def _resolved(c: str, day: str) -> str:
    """SQL: the text ``c`` with its first relative time word as a date."""
    w = f"lower(regexp_extract({c}, '{_RELATIVE}', 1))"
    date = (
        f"CASE WHEN {w} = 'yesterday' THEN {day} - 1 WHEN {w} = 'today' THEN {day} WHEN {w} = 'tomorrow' THEN {day} + 1 "
        f"WHEN {w} LIKE 'last%week%' THEN {day} - 7 WHEN {w} LIKE 'next%week%' THEN {day} + 7 WHEN {w} LIKE 'last%month%' THEN CAST({day} - INTERVAL 1 MONTH AS DATE) "
        f"WHEN {w} LIKE 'next%month%' THEN CAST({day} + INTERVAL 1 MONTH AS DATE) WHEN {w} LIKE 'last%' AND regexp_matches({w}, 'summer|winter|spring|fall|autumn') THEN CAST({day} - INTERVAL 3 MONTH AS DATE) "
        f"WHEN {w} LIKE 'next%' THEN {day} + 7 END"
    )
    at = f"strpos(lower({c}), {w})"
    return f"CASE WHEN {w} <> '' AND ({date}) IS NOT NULL THEN substr({c}, 1, {at} - 1) || strftime({date}, '%-d %B %Y') || substr({c}, {at} + length({w})) ELSE {c} END"


def _index(column: str) -> str:
    low = _LOW.format(c=column)
    parts = ("([\\x{4E00}-\\x{9FFF}])", None, "([a-z0-9]+)", "([a-z0-9]+(?:[._-]+[a-z0-9]+)+)")
    return "flatten([" + ", ".join(_PAIRS.format(c=low) if p is None else f"regexp_extract_all({low}, '{p}')" for p in parts) + "])"


def _tokens(column: str) -> str:
    return _TOKENS.format(c=column)


def _asked(searches: list[tuple[int, str]]) -> str:
    """SQL: asked(query_id, term), the terms of the searches by the rule of the index."""
    texts, low = ", ".join(f"({q}, '{t}')" for q, t in searches), _LOW.format(c="words")
    runs = f"regexp_extract_all({low}, '([a-z0-9]+(?:[._-]+[a-z0-9]+)*)')"
    every = f"list_distinct(flatten([{runs}, {_PAIRS.format(c=low)}, regexp_extract_all({low}, '([\\x{{4E00}}-\\x{{9FFF}}])')]))"
    return f"""asked AS (SELECT query_id, unnest(CASE WHEN len(list_filter(t, lambda x: length(x) > 1)) > 0 THEN list_filter(t, lambda x: length(x) > 1) ELSE t END) AS term
FROM (SELECT query_id, {every} AS t FROM (VALUES {texts}) v(query_id, words)))"""


def _bm25(searches: list[tuple[int, str]]) -> str:
    return f"""{_asked(searches)}, docs AS (SELECT id, status, user_id, {_index('content')} AS terms FROM unified_knowledge),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS al FROM docs), occ AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM docs),
tf AS (SELECT id, dl, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, al FROM df, stats),
sc AS (SELECT a.query_id, t.id, round(sum(i.idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.dl / i.al))), 6) AS score, count(*) AS k FROM tf t JOIN idf i ON i.term = t.term JOIN asked a ON a.term = t.term GROUP BY 1, 2)"""


_BM25 = _bm25(SEARCHES)
_SEEN = "SELECT id FROM unified_knowledge WHERE status = 'active' AND user_id IN ('u0001', 'default')"


@query(f"""WITH {_BM25}, v AS (SELECT sc.query_id, sc.id, sc.score, row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.score DESC, sc.id) AS place FROM sc JOIN docs d ON d.id = sc.id WHERE d.status = 'active') SELECT * FROM v WHERE place <= 10""")
def full_text_search(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "unified_knowledge")
    active = docs.filter(F.col("status") == "active").select("id")
    return retrieval.top(retrieval.bm25(docs, SEARCHES, "id", "content").join(active, "id"), 10, [F.col("score").desc(), F.col("id")]).select("query_id", "id", "score", "place")


@query(f"""WITH {_BM25}, v AS (SELECT sc.query_id, sc.id, sc.score, row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.score DESC, sc.id) AS place FROM sc JOIN docs d ON d.id = sc.id WHERE d.status = 'active') SELECT * FROM v WHERE place <= 10""")
def stored_index_search(spark, d):
    """The same searches over a stored index, which is built where it does not fit the table."""
    docs = load(spark, d, "unified_knowledge")
    kept = TextIndex(spark, work_folder(spark) + "/index-" + d.strip("/").replace("/", "-"))
    kept.ensure(docs)
    hits = retrieval.bm25(docs, SEARCHES, "id", "content", stored=kept.stored())
    return retrieval.top(hits.join(docs.filter(F.col("status") == "active").select("id"), "id"), 10, [F.col("score").desc(), F.col("id")]).select("query_id", "id", "score", "place")


#: Searches for rows with all terms.
_ALL_OF = [(1, "storage team"), (2, "migration"), (3, "索引 告警"), (4, "nightly job writes rows")]


@query(f"""WITH {_bm25(_ALL_OF)}, need AS (SELECT query_id, count(*) AS k FROM asked GROUP BY 1), v AS (SELECT sc.query_id, sc.id, sc.score FROM sc JOIN need ON need.query_id = sc.query_id AND need.k = sc.k JOIN unified_knowledge d ON d.id = sc.id WHERE d.status = 'active'
AND (d.valid_from IS NULL OR d.valid_from <= TIMESTAMP '2025-01-01') AND (d.valid_to IS NULL OR d.valid_to > TIMESTAMP '2025-01-01')) SELECT * FROM v""")
def search_at_time(spark, d):
    docs = load(spark, d, "unified_knowledge")
    valid = docs.filter((F.col("status") == "active") & retrieval.valid_at(F.to_timestamp(F.lit("2025-01-01")))).select("id")
    return retrieval.bm25(docs, _ALL_OF, "id", "content", all_terms=True).join(valid, "id").select("query_id", "id", "score")


@query(f"""WITH {_BM25}, f AS (SELECT id, score FROM sc WHERE query_id = 1), l AS (SELECT id, 0.3 AS score FROM unified_knowledge WHERE contains(lower(content), 'storage team')),
u AS (SELECT id, 'fts' AS source, score, 0 AS r FROM f UNION ALL SELECT id, 'like', score, 1 FROM l) SELECT id, arg_min(source, r) AS source, arg_min(score, r)::DOUBLE AS score FROM u GROUP BY id""")
def merged_branches(spark, d):
    docs = load(spark, d, "unified_knowledge")
    fts = retrieval.bm25(docs, SEARCHES[:1], "id", "content")
    like = docs.filter(F.lower("content").contains("storage team")).select("id", F.lit(0.3).alias("score"))
    return retrieval.merge_branches([("fts", fts), ("like", like)])


_USABLE = """v AS (SELECT entry_id AS id, embed_dim AS d, embedding::DOUBLE[] AS e FROM knowledge_embeddings WHERE len(embedding) = embed_dim AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


def _usable(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "knowledge_embeddings").filter(F.col("embed_dim") == F.size("embedding"))
    return v.filter(F.forall("embedding", lambda x: F.abs(x) < float("inf")) & F.exists("embedding", lambda x: x != 0))


def _first_vector(usable: DataFrame) -> list[float]:
    first = usable.filter(F.col("embed_dim") == 64).orderBy("entry_id").select("embedding").first()
    return list(first[0]) if first else [1.0] * 64


@query(f"""WITH {_USABLE}, q AS (SELECT e FROM v WHERE d = 64 ORDER BY id LIMIT 1), seen AS ({_SEEN})
SELECT v.id, round(list_cosine_similarity(v.e, q.e), 6) AS similarity FROM v JOIN seen ON seen.id = v.id, q WHERE v.d = 64 ORDER BY similarity DESC, id LIMIT 10""")
def vector_search(spark, d):
    usable = _usable(spark, d)
    seen = retrieval.visible(load(spark, d, "unified_knowledge"), "u0001").select(F.col("id").alias("entry_id"))
    return retrieval.nearest_exact(usable.join(seen, "entry_id"), _first_vector(usable), 10, "entry_id", "embedding")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q.e::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q.e::DOUBLE[], q.e::DOUBLE[]))), 6) AS similarity
FROM embeddings, q ORDER BY similarity DESC, id LIMIT 10""")
def nearest_vectors(spark, d):
    v = load(spark, d, "embeddings")
    first = v.filter(F.col("vec_id") == 0).select("embedding").first()
    return retrieval.nearest_exact(v, list(first[0]), 10, "vec_id", "embedding")


@query("""SELECT id, round(coalesce(nullif(positive_feedback / 100.0, 0), 0.5) + 0.05 * (positive_feedback - 2 * negative_feedback) + CASE layer WHEN 'consolidated' THEN 0.10 WHEN 'candidate' THEN 0.05 ELSE 0 END, 4) AS rerank FROM unified_knowledge""")
def rerank_scores(spark, d):
    return load(spark, d, "unified_knowledge").select("id", scores.rerank_score(
        F.col("positive_feedback") / 100.0, F.col("positive_feedback"), F.col("negative_feedback"), F.col("layer")
    ).alias("rerank"))


@query(r"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS normal, substr(sha256(lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')))), 1, 16) AS hash FROM documents""")
def normal_forms(spark, d):
    return load(spark, d, "documents").select(
        "doc_id", text.normal_form(F.col("text")).alias("normal"), text.content_hash(F.col("text")).alias("hash")
    )


@query(f"""SELECT id, len({_index('content')}) AS n_terms, array_to_string({_index('content')}, ' ') AS terms FROM unified_knowledge""")
def index_terms(spark, d):
    terms = text.index_terms(F.col("content"))
    return load(spark, d, "unified_knowledge").select("id", F.size(terms).cast("long").alias("n_terms"), F.array_join(terms, " ").alias("terms"))


_SETS = f"(SELECT v.id AS vid, list_distinct({_tokens('v.content')}) AS a, list_distinct({_tokens('k.content')}) AS b, v.content AS vc, k.content AS kc FROM (SELECT DISTINCT id, knowledge_id, content FROM knowledge_versions) v JOIN unified_knowledge k ON k.id = v.knowledge_id WHERE v.content IS NOT NULL AND k.content IS NOT NULL)"


@query(f"""SELECT vid AS version_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS jaccard, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 6) AS containment FROM {_SETS}""")
def version_overlap(spark, d):
    v = load(spark, d, "knowledge_versions").select(F.col("id").alias("version_id"), "knowledge_id", F.col("content").alias("vc")).distinct()
    k = load(spark, d, "unified_knowledge").select(F.col("id").alias("knowledge_id"), F.col("content").alias("kc"))
    rows = v.join(k, "knowledge_id").filter(F.col("vc").isNotNull() & F.col("kc").isNotNull()).select(
        "version_id", text.token_set(F.col("vc")).alias("a"), text.token_set(F.col("kc")).alias("b")
    )
    return rows.select("version_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(text.containment(F.col("a"), F.col("b")), 6).alias("containment"))


_NEG = "['不', '不是', '不要', '不能', '没有', '不会', '不对', 'not', 'no', 'don', 'doesn', 'isn', 'aren', 'won', '避免', '禁止', '拒绝', '反对', '否定']"
_COMP = "另外|还有|此外|同时|另一方面|also|besides|furthermore|moreover|不过|但是|然而|虽然"


@query(f"""SELECT id, list_has_any({_tokens('user_query')}, {_NEG}) AS negated, regexp_matches(lower(user_query), '{_COMP}') AS complements FROM (SELECT DISTINCT id, user_query FROM interaction_log WHERE user_query IS NOT NULL)""")
def negations(spark, d):
    log = load(spark, d, "interaction_log").select("id", "user_query").filter(F.col("user_query").isNotNull()).distinct()
    return log.select("id", text.has_negation(F.col("user_query")).alias("negated"), text.has_complement(F.col("user_query")).alias("complements"))


@query("""WITH s AS (SELECT doc_id, text, trim(split_part(text, '§', 1)) AS a, trim(split_part(text, chr(10), 1)) AS l FROM documents)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' WHEN contains(text, '§') AND a <> '' THEN CASE WHEN length(a) <= 200 THEN a ELSE substr(a, 1, 197) || '...' END WHEN l <> '' THEN CASE WHEN length(l) <= 200 THEN l ELSE substr(l, 1, 197) || '...' END ELSE substr(text, 1, 200) END AS summary FROM s""")
def summaries(spark, d):
    return load(spark, d, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


_STOP = "'的', '了', '是', '在', '有', '和', '就', '不', '也', '都', '这', '那', '对', '被', '把', 'the', 'a', 'an', 'is', 'are', 'it', 'this', 'that', 'to', 'for', 'with', 'on', 'at', 'by'"


@query(f"""WITH t AS (SELECT id, {_tokens('content')} AS ts FROM unified_knowledge), w AS (SELECT id, unnest(ts) AS word, unnest(range(1, len(ts) + 1)) AS pos FROM t), c AS (SELECT id, word, count(*) AS n, min(pos) AS f FROM w WHERE word NOT IN ({_STOP}) AND (length(word) >= 2 OR regexp_matches(word, '^[\\x{{4E00}}-\\x{{9FFF}}]$')) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS place FROM c) SELECT id, word, n, place FROM r WHERE place <= 5""")
def document_keywords(spark, d):
    return mining.keywords(load(spark, d, "unified_knowledge"), "id", text.tokens(F.col("content")), text.STOP_WORDS)


_CTX_FORMS = [
    r"忽略\s*(上面|以上|以下|之前)?\s*(所有)?\s*(的)?\s*(指令|指示|规则|设定|内容)", r"(ignore|disregard|forget)\s+(all\s+)?(previous|above|prior)?\s*(instructions?|prompts?|rules?|system)",
    r"你现在(是|扮演|变成|成为).{0,15}(另一个|别的|其他).{0,15}(助手|ai|模型)", r"(system|developer|user)\s*[:：]\s*(role|instruction|task)",
    r"base64.{0,20}(decode|解码)", r"不要(告诉|提及|提到).{0,15}(系统|system)",
]
_IN_FORMS = [
    r"\b(union\s+(all\s+)?select)\b", r"\bselect\s+\*\s+from\b", r"\b(insert\s+into|delete\s+from|drop\s+table|alter\s+table)\b", r"\bupdate\b\s+\w+\s+set\b",
    r"(--|;|/\*|\*/)", r"(\b(or|and)\b\s+\d+\s*=\s*\d+)", r"(''|\"|\\)", r"(<script[^>]*>)", r"(javascript:)", r"(on\w+\s*=)",
]


def _threats(column: str, forms: list[str]) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches({column}, '(?i){p}') THEN {i} END" for i, p in enumerate(forms))
    return f"len(list_filter(list_value({hits}), lambda x: x IS NOT NULL))"


@query(f"""SELECT id, {_threats('user_query', _IN_FORMS)} AS n_threats FROM (SELECT DISTINCT id, user_query FROM interaction_log WHERE user_query IS NOT NULL)""")
def input_threats(spark, d):
    log = load(spark, d, "interaction_log").select("id", "user_query").filter(F.col("user_query").isNotNull()).distinct()
    return log.select("id", F.size(patterns.threats(F.col("user_query"), "input")).cast("long").alias("n_threats"))


@query(f"""SELECT id, {_threats('content', _CTX_FORMS)} AS n_threats FROM unified_knowledge WHERE content IS NOT NULL""")
def threat_scan(spark, d):
    return load(spark, d, "unified_knowledge").filter(F.col("content").isNotNull()).select(
        "id", F.size(patterns.threats(F.col("content"))).cast("long").alias("n_threats")
    )


@query("""WITH h AS (SELECT id, user_id, substr(sha256(lower(trim(regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')))), 1, 16) AS match_hash FROM unified_knowledge WHERE trim(content) <> '') SELECT match_hash, user_id, min(id) AS id, count(*) AS encounters FROM h GROUP BY 1, 2""")
def ingest_dedup(spark, d):
    return lifecycle.ingest(load(spark, d, "unified_knowledge"))


def _version_pairs(spark, d):
    v = load(spark, d, "knowledge_versions").select(F.col("id").alias("version_id"), "knowledge_id", F.col("content").alias("old")).distinct()
    k = load(spark, d, "unified_knowledge").select(F.col("id").alias("knowledge_id"), F.col("content").alias("new"))
    return v.join(k, "knowledge_id").filter(F.col("old").isNotNull() & F.col("new").isNotNull())


_SETS2 = rf"""p AS (SELECT v.id AS version_id, v.content AS old, k.content AS new, list_distinct({_tokens('v.content')}) AS a, list_distinct({_tokens('k.content')}) AS b FROM (SELECT DISTINCT id, knowledge_id, content FROM knowledge_versions) v
 JOIN unified_knowledge k ON k.id = v.knowledge_id WHERE v.content IS NOT NULL AND k.content IS NOT NULL), s AS (SELECT *, len(list_intersect(a, b)) AS sh, len(list_distinct(list_concat(a, b))) AS un FROM p),
q AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN sh / un ELSE 0 END AS sim, greatest(CASE WHEN len(a) > 0 THEN sh / len(a) ELSE 0 END, CASE WHEN len(b) > 0 THEN sh / len(b) ELSE 0 END) AS cover FROM s),
h AS (SELECT *, substr(sha256(lower(trim(regexp_replace(regexp_replace(old, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')))), 1, 16) = substr(sha256(lower(trim(regexp_replace(regexp_replace(new, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')))), 1, 16) AS same FROM q),
m AS (SELECT *, CASE WHEN same THEN 'exact_dup' WHEN sim > 0.40 AND sh >= 3 AND list_has_any(b, {_NEG}) AND NOT list_has_any(a, {_NEG}) THEN 'contradict' WHEN sim > 0.60 OR cover > 0.90 THEN 'fuzzy_dup'
 WHEN sim BETWEEN 0.40 AND 0.85 AND regexp_matches(lower(new), '{_COMP}') THEN 'complement' ELSE 'new' END AS act FROM h)"""


@query(f"""WITH {_SETS2} SELECT version_id, act AS merge_action, CASE WHEN act NOT IN ('fuzzy_dup', 'complement') OR len(a) = 0 OR len(b) = 0 THEN new
 WHEN sh / greatest(len(a), len(b)) > 0.9 OR (sh / len(b) > 0.85 AND length(old) > length(new) * 1.5) THEN old ELSE old || ' § ' || new END AS merged_text FROM m""")
def merge_actions(spark, d):
    return lifecycle.merge_pairs(_version_pairs(spark, d), "old", "new").select("version_id", "merge_action", "merged_text")


@query()
def entities_of_documents(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.posexplode(patterns.entities(F.col("text"))).alias("place", "entity"))
    return docs.select("doc_id", "place", "entity", patterns.core_entity(F.col("entity")).alias("core"))


@query()
def entity_pair_counts(spark, d):
    """How many memories name two entities, with the relation they name first."""
    docs = load(spark, d, "unified_knowledge").filter(F.length("content") > 20).select(F.lower("content").alias("low"), "content")
    rows = docs.withColumn("held", patterns.relation_keywords(F.col("low"))).withColumn("p", F.explode(patterns.entity_pairs(F.col("content"))))
    named = rows.select(
        F.col("p.a").alias("entity_a"), F.col("p.b").alias("entity_b"),
        patterns.relation(F.col("low"), F.col("held"), F.lower("p.a"), F.lower("p.b")).alias("relation_type"),
    )
    return named.groupBy("entity_a", "entity_b", "relation_type").agg(F.count(F.lit(1)).alias("n"))


_KEPT = [
    (r"(?:我|我们|本人)(?:喜欢|偏好|倾向于|习惯|常用|使用|用|做|想要|需要|关注|看好|做)\s*(.{4,60})", "identity"), (r"(?:我是|我是一个|我是位|我是个)\s*(.{4,60})", "identity"),
    (r"我(?:住在|工作在|毕业于|来自)\s*(.{4,60})", "identity"), (r"(?:应该|必须|一定|得|要)\s*(.{4,80})", "rule"), (r"(?:不能|不可以|不要|禁止|避免|别)\s*(.{4,80})", "rule"),
    (r"(?:每次|总是|永远|从不)\s*(.{4,60})", "rule"), (r"(?:先用|再|然后|接着|最后)(?:\s*用|使用|调|执行)?\s*(.{4,60})", "workflow"), (r"(?:用|使用|通过|借助)\s*(.{4,40})(?:来|做|实现|完成|分析|处理)", "workflow"),
    (r"((?:成本|成本价|买入|建仓)(?:价|价格|成本)?[是为：:\s]*\d+\.?\d*)", "raw_fact"), (r"((?:目前|当前|现|现在)(?:持仓|持有|仓位|持股)\s*\d+)", "raw_fact"),
    (r"((?:止损|止盈|目标价)[是为：:\s]*\d+\.?\d*)", "strategy"), (r"((?:RSI|MACD|KDJ|MA[0-9]+|BOLL|量比|换手).{2,30})", "strategy"), (r"((?:主力|北向|资金|净流入|净流出).{2,30})", "strategy"),
]
_EVERY = "flatten([" + ", ".join(f"list_transform(regexp_extract_all(user_query, '{p}', 1), lambda c: {{'c': trim(c), 'd': '{d}'}})" for p, d in _KEPT) + "])"


@query(rf"""WITH q AS (SELECT DISTINCT id, user_query FROM interaction_log WHERE length(user_query) >= 6), u AS (SELECT id, unnest({_EVERY}) AS s, generate_subscripts({_EVERY}, 1) AS pos FROM q),
b AS (SELECT id, pos, regexp_replace(s.c, '^[，。,．\s]+|[，。,．\s]+$', '', 'g') AS content, s.d AS domain FROM u WHERE length(s.c) >= 4)
SELECT id, content, domain FROM b QUALIFY row_number() OVER (PARTITION BY id, substr(lower(content), 1, 40) ORDER BY pos) = 1""")
def kept_statements(spark, d):
    log = load(spark, d, "interaction_log").select("id", "user_query").filter(F.col("user_query").isNotNull()).distinct()
    return log.select("id", F.explode(patterns.statements(F.col("user_query"))).alias("s")).select("id", "s.content", "s.domain")


@query(r"""SELECT id, regexp_matches(user_query, '(?:不对|错了|不是|不对的|搞错了|说错了|错了错了)|(?:其实|实际上|真实情况是|正确是|应该说)|不(?:是|该|能)\s*.{2,10}(?:而是|应该)') AS correction FROM (SELECT DISTINCT id, user_query FROM interaction_log WHERE user_query IS NOT NULL)""")
def corrections(spark, d):
    log = load(spark, d, "interaction_log").select("id", "user_query").filter(F.col("user_query").isNotNull()).distinct()
    return log.select("id", patterns.is_correction(F.col("user_query")).alias("correction"))


@query(f"""SELECT id, {_resolved("content", "CAST(created_at AS DATE)")} AS content FROM unified_knowledge""")
def dated_contents(spark, d):
    rows = load(spark, d, "unified_knowledge").select("id", "content", F.to_date("created_at").alias("day"))
    return rows.select("id", patterns.resolve_relative(F.col("content"), F.col("day")).alias("content"))


@query("""SELECT p_partkey AS id, p_brand AS entity, 'PE' AS metric, CAST(p_retailprice AS DOUBLE) AS value, p_type AS condition FROM part UNION ALL SELECT p_partkey, p_brand, '净利润', CAST(p_size AS DOUBLE), p_type FROM part""")
def note_metrics(spark, d):
    """Metrics read back from structured notes, written here from the parts table."""
    p = load(spark, d, "part")
    note = F.format_string("产品: %s\nPE：%s%%，净利润 %d\n条件：%s\n", "p_brand", F.col("p_retailprice").cast("decimal(18,2)").cast("string"), "p_size", "p_type")
    return p.select(F.col("p_partkey").alias("id"), F.explode(patterns.metrics(note)).alias("m")).select("id", "m.*")


QUESTION = "Why did the storage team not move Quillbase before the review"
_VARIANTS = [
    (0, QUESTION), (1, QUESTION.replace("Why", "why")), (2, QUESTION.replace("Why", "reason")), (3, QUESTION.replace("Why", "because")),
    (100, "Why date time when"), (101, "Quillbase date time when"), (200, "Why did the storage team move Quillbase before the review"),
]


@query(f"""WITH {_bm25(_VARIANTS)}, seen AS ({_SEEN}), r AS (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sc.id) AS p FROM sc JOIN seen ON seen.id = sc.id),
own AS (SELECT id, max(score) AS score FROM r WHERE query_id < 100 AND p <= 20 GROUP BY id), head AS (SELECT id FROM own ORDER BY score DESC, id LIMIT 10),
timed AS (SELECT count(*) > 0 AS yes FROM head h JOIN unified_knowledge k ON k.id = h.id WHERE regexp_matches(k.content, '{_RELATIVE}')),
more AS (SELECT id, 0.3 AS score FROM r, timed WHERE query_id BETWEEN 100 AND 199 AND p <= 5 AND timed.yes UNION ALL SELECT id, 0.3 FROM r WHERE query_id = 200 AND p <= 10)
SELECT id, max(score)::DOUBLE AS score FROM (SELECT * FROM own UNION ALL SELECT * FROM more WHERE id NOT IN (SELECT id FROM own)) GROUP BY id ORDER BY score DESC, id LIMIT 30""")
def enhanced_search(spark, d):
    docs = load(spark, d, "unified_knowledge")
    return composite.enhanced(docs, QUESTION, 10, retrieval.visible(docs, "u0001"))


_GRAPH = r"""g AS (SELECT lower(regexp_replace(entity_a, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS a, lower(regexp_replace(entity_b, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS b, relation_type FROM entity_relations),
e AS (SELECT a, b, relation_type, least(5.0, 1 + 0.5 * (count(*) - 1)) AS w FROM g WHERE a <> '' AND b <> '' GROUP BY 1, 2, 3), m AS (SELECT a AS node, b AS nxt, relation_type, w FROM e UNION ALL SELECT b, a, relation_type, w FROM e),
h1 AS (SELECT nxt AS node, relation_type, max(w) AS w, 1 AS depth FROM m WHERE node IN ('which', 'lumifold') GROUP BY 1, 2), h2 AS (SELECT m.nxt AS node, m.relation_type, max(m.w) AS w, 2 AS depth FROM m WHERE m.node IN (SELECT node FROM h1) GROUP BY 1, 2),
t AS (SELECT node, relation_type, min(depth) AS depth, max(w) AS w FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE node NOT IN ('which', 'lumifold') GROUP BY 1, 2 ORDER BY depth, w DESC, node, relation_type LIMIT 50),
nodes AS (SELECT node, max(w / depth) AS s FROM t GROUP BY node)"""


@query(f"""WITH {_GRAPH}, seen AS (SELECT * FROM unified_knowledge WHERE id IN ({_SEEN})), hits AS (SELECT k.id, n.node, n.s FROM seen k JOIN nodes n ON contains(lower(k.content), n.node))
SELECT id, max(s)::DOUBLE AS score, array_to_string(list_sort(list_distinct(list(node))), '|') AS paths FROM hits GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def graph_search(spark, d):
    seen, edges = retrieval.visible(load(spark, d, "unified_knowledge"), "u0001"), graph.accumulate(load(spark, d, "entity_relations"))
    found = composite.by_graph(seen, edges, ["Which", "Lumifold"]).orderBy(F.col("score").desc(), "id").limit(20)
    return found.withColumn("paths", F.array_join("paths", "|"))


@query(f"""WITH {_USABLE}, q AS (SELECT e FROM v WHERE d = 64 ORDER BY id LIMIT 1), seen AS (SELECT * FROM unified_knowledge WHERE id IN ({_SEEN})),
near AS (SELECT v.id, 'vector' AS source, round(list_cosine_similarity(v.e, q.e), 6) AS score, 0 AS r FROM v JOIN seen ON seen.id = v.id, q WHERE v.d = 64 ORDER BY score DESC, v.id LIMIT 20),
{_GRAPH}, linked AS (SELECT k.id, 'graph' AS source, max(n.s) AS score, 1 AS r FROM seen k JOIN nodes n ON contains(lower(k.content), n.node) GROUP BY k.id ORDER BY score DESC, id LIMIT 20),
both_ AS (SELECT * FROM near UNION ALL SELECT * FROM linked), one AS (SELECT id, arg_min(source, r) AS source, arg_min(score, r) AS score FROM both_ GROUP BY id),
s AS (SELECT o.id, o.source, round(coalesce(nullif(o.score, 0), 0.5) + 0.05 * (k.positive_feedback - 2 * k.negative_feedback) + CASE k.layer WHEN 'consolidated' THEN 0.10 WHEN 'candidate' THEN 0.05 ELSE 0 END, 4) AS rerank FROM one o JOIN seen k ON k.id = o.id)
SELECT id, source, rerank::DOUBLE AS rerank, row_number() OVER (ORDER BY rerank DESC, id) AS place FROM s ORDER BY rerank DESC, id LIMIT 10""")
def hybrid_search(spark, d):
    usable, edges = _usable(spark, d), graph.accumulate(load(spark, d, "entity_relations"))
    same = usable.filter(F.col("embed_dim") == 64)
    return composite.hybrid(load(spark, d, "unified_knowledge"), same, edges, "Which review did Lumifold block", _first_vector(usable), "u0001", 10)


@query(f"""WITH {_bm25([(1, SEARCHES[0][1])])}, h AS (SELECT sc.id, sc.score, {_resolved("k.content", "DATE '2023-05-08'")} AS content FROM sc JOIN unified_knowledge k ON k.id = sc.id WHERE k.content IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY substr(content, 1, 60) ORDER BY score DESC, id) AS p FROM h), o AS (SELECT id, score, content, length(content) // 4 AS cost FROM f WHERE p = 1),
u AS (SELECT *, row_number() OVER w AS place, coalesce(sum(cost) OVER (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM o WINDOW w AS (ORDER BY score DESC, id)),
k AS (SELECT place, CASE WHEN used + cost > 2000 THEN substr(content, 1, CAST(8000 - used AS BIGINT)) || '...' ELSE content END AS body FROM u WHERE used + cost <= 2000 OR 8000 - used > 40)
SELECT 'Session dates:' || chr(10) || '  Session 1: 1:56 pm on 8 May, 2023' || chr(10) || chr(10) || '[NOTE: This question asks about something that did NOT happen]' || chr(10) || string_agg('[' || place || '] ' || body, chr(10) ORDER BY place) AS context FROM k""")
def context_text(spark, d):
    docs = load(spark, d, "unified_knowledge")
    hits = retrieval.bm25(docs, SEARCHES[:1], "id", "content").join(docs.select("id", "content"), "id")
    return composite.context(hits, [F.col("score").desc(), F.col("id")], 2_000, "What did we never do", ["1:56 pm on 8 May, 2023"])


@query("""WITH seen AS (SELECT id, content, positive_feedback - 2 * negative_feedback AS w FROM unified_knowledge WHERE status = 'active' AND user_id IN ('u0001', 'default') AND content IS NOT NULL
  AND TRY_CAST(json_extract_string(CASE WHEN json_valid(domain_scores) THEN domain_scores END, '$.identity') AS DOUBLE) > 0 ORDER BY w DESC, id LIMIT 20),
r AS (SELECT *, row_number() OVER (ORDER BY w DESC, id) AS n, sum(length(content) + 3) OVER (ORDER BY w DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM seen),
b AS (SELECT string_agg(content, chr(10) || '§' || chr(10) ORDER BY n) AS body FROM r WHERE upto <= 2200)
SELECT coalesce(repeat('═', 46) || chr(10) || 'MEMORY [' || least(100, length(body) * 100 // 2200) || '% — ' || format('{:,}', length(body)) || '/2,200 chars]' || chr(10) || repeat('═', 46) || chr(10) || body, '') AS block FROM b""")
def prompt_text(spark, d):
    return composite.prompt_block(retrieval.visible(load(spark, d, "unified_knowledge"), "u0001"))


@query("SELECT doc_id, 64 AS dim, 1.0 AS norm FROM documents WHERE regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}]') UNION ALL SELECT doc_id, 64, 0.0 FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}]')")
def embedded_documents(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    rows = composite.embedded(docs, "text", composite.HashingEmbedder(64))
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(scores.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


def queries() -> dict:
    return R.queries


def oracle_sql() -> dict[str, str]:
    return R.sql
