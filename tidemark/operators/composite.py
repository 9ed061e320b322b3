"""Searches made of several branches, context and prompt texts, alerts, and changes of state that
touch several rows at once.

Defined cases: a query that names nothing has no graph branch; a search that finds nothing is
empty; null contents are found by no search and give no line; ties go to the smaller id.
"""

from __future__ import annotations

import datetime
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.functions import patterns, scores, text
from tidemark.operators import graph, retrieval
from tidemark.plugins import Embedder, HashingEmbedder, Scorer  # noqa: F401
from tidemark.session import materialise

# Words that widen a question.
SYNONYMS = {
    "what": "what which", "when": "when date time", "where": "where location place", "who": "who person",
    "how long": "how long duration years months", "how many": "how many number count", "why": "why reason because",
    "relationship": "relationship dating married single", "work": "work job career profession",
    "school": "school education college university class", "support group": "support group meeting therapy",
    "go to": "go to went to attended visited", "planning": "planning planning going to will",
    "identity": "identity identify transgender LGBTQ",
}
# Capitalised names; day, month and year of a session; limits of the searches.
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
SESSION_DAY = r"(\d{1,2})\s+(January|February|March|April|May|June|July|August|September|October|November|December),?\s+(\d{4})"
MOST_VARIANTS, HOP_NAMES, HOP_ROWS, HOP_SCORE, LOOKED_AT = 4, 2, 5, 0.3, 10
LEAST_WEIGHT, MOST_NODES, QUERY_NAMES = 0.3, 50, 3
# What a context says before its lines, and without any.
DATES_HEAD, DATE_LINE = "Session dates:\n", "  Session {}: {}\n"
NEGATION_NOTE, NO_CONTEXT = "[NOTE: This question asks about something that did NOT happen]\n", "[No relevant context found.]"
MONTHS = [datetime.date(2000, m, 1).strftime("%B") for m in range(1, 13)]


def embedded(rows: DataFrame, column: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """``rows`` with a vector of ``column``."""
    @pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embedder.embed(values.fillna("").tolist()), np.float32)))

    return rows.withColumn(out, run(F.col(column)))


def top_words(query: str, most: int) -> list[str]:
    """The most frequent words of a query that are no stop words, ties in their order."""
    words = re.findall(r"[一-鿿]|[^\W_一-鿿]+", query.lower())
    counted = Counter(w for w in words if w not in text.STOP_WORDS and (len(w) > 1 or "一" <= w <= "鿿"))
    return [w for w, _ in counted.most_common(most)]


def variants(query: str) -> list[str]:
    """The query; the query with its first widened word replaced by each of the words for it; its
    names; its words.  Four at most."""
    out = [query]
    word = next((k for k in SYNONYMS if k in query.lower()), None)
    for other in SYNONYMS[word].split() if word else ():
        out.append(re.sub(rf"\b{word}\b", other, query, flags=re.I))
    out += [" ".join(re.findall(NAME, query)), " ".join(top_words(query, 8))]
    return list(dict.fromkeys(v for v in out if v))[:MOST_VARIANTS]


def without_negation(query: str) -> str | None:
    """A negated query without its negations, None for any other."""
    if not re.search(patterns.NEGATED_QUERY, query):
        return None
    return " ".join(re.sub(patterns.NEGATED_QUERY, " ", query).split())


def query_names(query: str) -> list[str]:
    """Entities of a query, in order."""
    found = [m for form in (r'"([^"]{2,60})"', r"\b([A-Z][A-Za-z0-9_/-]{2,40})\b") for m in re.findall(form, query)]
    return [n for n in dict.fromkeys(found) if n.lower() not in patterns.NO_ENTITIES]


def _best(hits: DataFrame, within: DataFrame | None, k: int) -> DataFrame:
    """The best ``k`` per query of the ids of ``within`` (id)."""
    hits = hits if within is None else hits.join(within.select("id"), "id", "left_semi")
    return retrieval.top(hits, k, [F.col("score").desc(), F.col("id")])


def _asked_for_time(docs: DataFrame, found: DataFrame) -> bool:
    """Whether one of the first rows found speaks of a relative time."""
    first = found.orderBy(F.col("score").desc(), "id").limit(LOOKED_AT)
    return bool(docs.select("id", "content").join(F.broadcast(first), "id").filter(patterns.has_relative_time(F.col("content"))).limit(1).count())


def _hops(query: str) -> list[tuple[int, str]]:
    return [(100 + i, f"{n} date time when") for i, n in enumerate(query_names(query)[:HOP_NAMES])]


def enhanced(docs: DataFrame, query: str, k: int, within: DataFrame | None = None) -> DataFrame:
    """(id, score): best score of the first ``2 * k`` rows of each variant of the query; rows of
    dated questions about its names where a relative time was found, and of a negated query
    without its negations, score ``HOP_SCORE``.  The best ``3 * k`` of the ids of ``within`` (id) if
    given; statistics count all rows."""
    plain = without_negation(query)
    asked = list(enumerate(variants(query)))
    hits = retrieval.bm25(docs, asked + _hops(query) + ([(200, plain)] if plain else []), "id", "content")
    own = _best(hits.filter(F.col("query_id") < 100), within, 2 * k).groupBy("id").agg(F.max("score").alias("score"))
    parts = [own]
    if _hops(query) and _asked_for_time(docs, own):
        parts.append(_best(hits.filter(F.col("query_id").between(100, 199)), within, HOP_ROWS).select("id", F.lit(HOP_SCORE).alias("score")))
    if plain:
        parts.append(_best(hits.filter(F.col("query_id") == 200), within, k).select("id", F.lit(HOP_SCORE).alias("score")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part.join(own, "id", "left_anti"))
    return every.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "id").limit(3 * k)


def by_graph(docs: DataFrame, edges: DataFrame, names: list[str], depth: int = 2, least: float = LEAST_WEIGHT, nodes: int = MOST_NODES) -> DataFrame:
    """(id, score, paths): documents that mention a node reached from the names, with the greatest
    weight over depth, and the nodes."""
    start = docs.sparkSession.createDataFrame([(n,) for n in names] or [(None,)], "node string")
    best = materialise(graph.nearest_nodes(graph.traverse(edges, start, depth, least), nodes).groupBy("node").agg(
        F.max(F.col("weight") / F.col("depth")).alias("s")
    ).withColumnRenamed("node", "term"), "nodes")
    return graph.mentions(docs, best, F.col("id"), F.col("content")).join(F.broadcast(best), "term").groupBy("id").agg(
        F.max("s").alias("score"), F.sort_array(F.collect_set("term")).alias("paths")
    )


def full_text(docs: DataFrame, query: str, user: str, k: int) -> DataFrame:
    """(id, source, score): the best ``k`` visible rows of a query; where no row holds a term of it,
    ``2 * k`` rows that hold a fragment of it."""
    seen = retrieval.visible(docs, user)
    hits = _best(retrieval.bm25(docs, [(0, query)], "id", "content"), seen, k).select("id", F.lit("fts").alias("source"), "score")
    if hits.limit(1).count():
        return hits
    return retrieval.like_search(seen, query, 2 * k).select("id", F.lit("like").alias("source"), F.lit(0.0).alias("score"))


def reranked(rows: DataFrame, docs: DataFrame, k: int, question: str = "", scorer: Scorer | None = None) -> DataFrame:
    """(id, source, rerank, place): the best ``k`` of ``rows`` (id, source, score) by score, feedback
    and layer.  A ``scorer`` of (question, text) pairs has 0.7 of the score before the boosts."""
    joined = rows.join(docs.select("id", "content", "positive_feedback", "negative_feedback", "layer"), "id")
    base = F.col("score")
    if scorer is not None:
        @pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series(scorer.score(question, texts.fillna("").tolist()))

        base = 0.3 * F.coalesce(F.when(base != 0, base), F.lit(0.5)) + 0.7 * score(F.col("content"))
    ranked = joined.select("id", "source", scores.rerank_score(base, F.col("positive_feedback"), F.col("negative_feedback"), F.col("layer")).alias("rerank"))
    best = ranked.orderBy(F.col("rerank").desc(), "id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("rerank").desc(), "id")))  # k rows


def hybrid(
    docs: DataFrame, vectors: DataFrame, edges: DataFrame, query: str, vector: list[float], user: str, k: int,
    scorer: Scorer | None = None,
) -> DataFrame:
    """(id, source, rerank, place): vector and graph branches over what the user may see and, if
    they have fewer than ``k`` rows, the full text, its variants, dated questions about its names
    and the query without its negations; every id once, from the first branch that has it."""
    seen = retrieval.visible(docs, user)
    near = retrieval.nearest_exact(vectors.join(seen.select(F.col("id").alias("entry_id")), "entry_id"), vector, 2 * k, "entry_id", "embedding")
    linked = by_graph(seen, edges, query_names(query)[:QUERY_NAMES]).orderBy(F.col("score").desc(), "id").limit(2 * k)
    branches = [("vector", near.withColumnRenamed("similarity", "score")), ("graph", linked)]
    first = materialise(retrieval.merge_branches(branches), "branches")
    if first.limit(k).count() < k:
        words = full_text(docs, query, user, k)
        plain = without_negation(query)
        more = [(i, v) for i, v in enumerate(variants(query)) if v != query] + _hops(query) + ([(200, plain)] if plain else [])
        branches.append(("fts", words))
        if more:
            hits = retrieval.bm25(docs, more, "id", "content")
            branches.append(("expanded", _best(hits.filter(F.col("query_id") < 100), seen, k).groupBy("id").agg(F.max("score").alias("score"))))
            if _hops(query) and _asked_for_time(docs, words):
                hop = _best(hits.filter(F.col("query_id").between(100, 199)), seen, HOP_ROWS)
                branches.append(("multi_hop", hop.groupBy("id").agg(F.max("score").alias("score"))))
            if plain:
                branches.append(("negation_hop", _best(hits.filter(F.col("query_id") == 200), seen, k).select("id", "score")))
        first = retrieval.merge_branches(branches)
    return reranked(first, seen, k, query, scorer)


def session_day(dates: list[str]) -> datetime.date | None:
    """The day of the first session date that names one."""
    for date in dates:
        m = re.search(SESSION_DAY, date)
        if m:
            return datetime.date(int(m[3]), MONTHS.index(m[2]) + 1, int(m[1]))
    return None


def context(
    rows: DataFrame, order: list[Column], budget: int = 2_000, question: str = "", dates: list[str] | None = None
) -> DataFrame:
    """(context): the rows as numbered lines after a head with the session dates, times resolved
    against the first of them; equal beginnings once, the best first, within the token budget."""
    day = session_day(dates or [])
    few = rows.filter(F.col("content").isNotNull())
    if day:
        few = few.withColumn("content", patterns.resolve_relative(F.col("content"), F.lit(day)))
    few = retrieval.first_per_prefix(few, "content", order).withColumn("_all", F.lit(0))
    lines = retrieval.cut_to_budget(few, "_all", order, "content", budget)  # one list by its nature
    head = DATES_HEAD + "".join(DATE_LINE.format(i + 1, d) for i, d in enumerate(dates)) + "\n" if dates else ""
    if re.search(patterns.NEGATED_QUERY, question):
        head += NEGATION_NOTE
    line = F.struct("place", F.concat(F.lit("["), F.col("place"), F.lit("] "), F.col("body")).alias("t"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n")
    empty = F.lit(NO_CONTEXT)
    return lines.agg(F.when(F.count(F.lit(1)) > 0, F.concat(F.lit(head), listed)).otherwise(empty).alias("context"))


def cold_start(knowledge: DataFrame, versions: DataFrame, feedback: DataFrame, user: str, today: datetime.date) -> DataFrame:
    """One row: (total, on_day, days_active, merges, conflicts) of what a user sees."""
    mine = knowledge.filter(F.col("user_id").isin(user, "default"))
    own = mine.agg(
        F.count_if(F.col("status") == "active").alias("total"), F.count_if(F.to_date("created_at") == F.lit(today)).alias("on_day"),
        F.coalesce(F.datediff(F.lit(today), F.to_date(F.min("created_at"))) + 1, F.lit(0)).cast("long").alias("days_active"),
    )
    merges = versions.agg(F.count_if(F.col("change_reason").isin("merge", "dedup")).alias("merges"))
    conflicts = feedback.filter(F.col("feedback_type") == "system_conflict").agg(F.count_distinct("id").alias("conflicts"))
    return own.join(F.broadcast(merges)).join(F.broadcast(conflicts))  # one row each


def prompt_block(rows: DataFrame, stats: DataFrame | None = None, limit: int = 2_200, title: str = "MEMORY", most: int = 20) -> DataFrame:
    """(block): the first ``most`` identity rows of ``rows`` by weight, texts with injected
    instructions redacted, within ``limit`` characters, under a head with the share of it; before
    it a line for a user's first 30 days from ``stats`` (see ``cold_start``)."""
    weight = scores.weight(F.col("positive_feedback"), F.col("negative_feedback"))
    told = F.try_element_at(scores.score_map(F.col("domain_scores")), F.lit("identity")) > 0
    best = rows.filter(told & F.col("content").isNotNull()).select("id", "content", weight.alias("w")).orderBy(F.col("w").desc(), "id").limit(most)
    held = patterns.threats(F.col("content"))
    line = F.when(F.size(held) > 0, F.concat(F.lit("[BLOCKED: potential injection ("), F.array_join(held, ", "), F.lit("). Content redacted.]"))).otherwise(F.col("content"))
    order = Window.orderBy(F.col("w").desc(), "id")  # at most ``most`` rows
    lines = best.withColumn("line", line).withColumn("n", F.row_number().over(order)).withColumn(
        "upto", F.sum(F.length("line") + 3).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).filter(F.col("upto") <= limit)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    body = lines.agg(F.array_join(listed, "\n§\n").alias("body"))
    share = F.least(F.lit(100), F.floor(F.length("body") * 100 / limit))
    bar = "═" * 46
    head = F.concat(F.lit(f"{bar}\n{title} ["), share, F.lit("% — "), F.format_number(F.length("body"), 0), F.lit(f"/{limit:,} chars]\n{bar}\n"))
    block = body.select(F.when(F.col("body") != "", F.concat(head, "body")).otherwise("").alias("block"))
    if stats is None:
        return block
    day, total = F.col("days_active"), F.col("total")
    some = lambda c, t: F.when(F.col(c) > 0, F.format_string(t, F.col(c))).otherwise("")
    first = F.concat(
        F.format_string("[Day %d] %d rows kept", day, total), some("on_day", ", %d today"), some("merges", ", %d merges"),
        some("conflicts", ", %d open conflicts"), F.lit("."), F.when(day <= 7, " Still learning.").otherwise(""),
    )
    first = stats.select(F.when(day.between(1, 30) & (total > 0), F.concat(first, F.lit("\n\n"))).otherwise("").alias("first"))
    return block.join(F.broadcast(first)).select(F.concat("first", "block").alias("block"))


def alerts(knowledge: DataFrame, feedback: DataFrame, user: str, newest: int = 5, pile: int = 10, most: int = 3) -> DataFrame:
    """(kind, knowledge_id, detail, content): the newest conflicts of active rows, a pile of more
    than ``pile`` new rows, and ``most`` consolidated rows that are mostly rejected."""
    active = knowledge.filter(F.col("status") == "active")
    split = feedback.filter(F.col("feedback_type") == "system_conflict").select("id", "knowledge_id", "source", "created_at").distinct()
    split = split.join(active.select(F.col("id").alias("knowledge_id"), F.substring("content", 1, 100).alias("content")), "knowledge_id").orderBy(
        F.col("created_at").desc(), F.col("id").desc()
    ).limit(newest).select(F.lit("conflict").alias("kind"), "knowledge_id", F.col("source").alias("detail"), "content")
    mine, nothing = retrieval.visible(knowledge, user), F.lit(None)
    piles = mine.filter(F.col("layer") == "instant").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > pile).select(
        F.lit("instant_pileup").alias("kind"), nothing.cast("long").alias("knowledge_id"), F.format_string("%d rows wait", "n").alias("detail"), nothing.cast("string").alias("content")
    )
    p, n = F.col("positive_feedback"), F.col("negative_feedback")
    bad = mine.filter((F.col("layer") == "consolidated") & (n > p + 3)).orderBy("id").limit(most).select(
        F.lit("negative_overload").alias("kind"), F.col("id").alias("knowledge_id"), F.format_string("%d against %d", n, p).alias("detail"), F.substring("content", 1, 80).alias("content")
    )
    return split.unionByName(piles).unionByName(bad)


def rejected_views(views: DataFrame, most: int = 3) -> DataFrame:
    """(domain, n) of domain views (domain, positive_feedback, negative_feedback) with more than
    ``most`` rows that are rejected more than confirmed."""
    return views.groupBy("domain").agg(F.count_if(F.col("negative_feedback") > F.col("positive_feedback")).alias("n")).filter(F.col("n") > most)


def superseded(state: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """``state`` after facts were replaced: ``changes`` has (id, new_id, content).  The old row
    is closed at ``at``, the new one takes over layer, scores and user and points back."""
    old = state.join(changes.select("id", "new_id"), "id", "left")
    gone = F.col("new_id").isNotNull()
    closed = old.withColumns({
        "status": F.when(gone, "superseded").otherwise(F.col("status")), "valid_to": F.when(gone, at).otherwise(F.col("valid_to")),
        "replaced_by": F.coalesce("new_id", "replaced_by"),
    }).select(*state.columns)
    fresh = state.drop("content").join(changes, "id").withColumns({
        "replaces": F.col("id"), "id": F.col("new_id"), "status": F.lit("active"), "valid_from": at,
        "valid_to": F.lit(None).cast(state.schema["valid_to"].dataType), "replaced_by": F.lit(None).cast("long"),
    })
    return closed.unionByName(fresh.select(*state.columns))


def domain_hits(knowledge: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, scores): score maps with the counted hits (id, domain) added."""
    counted = hits.groupBy("id", "domain").agg(F.count(F.lit(1)).cast("double").alias("n"))
    maps = counted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("domain", "n"))).alias("more"))
    now = scores.score_map(F.col("domain_scores"))
    none = F.create_map().cast("map<string,double>")
    return knowledge.select("id", "domain_scores").join(maps, "id", "left").select("id", scores.added(now, F.coalesce("more", none)).alias("scores"))
