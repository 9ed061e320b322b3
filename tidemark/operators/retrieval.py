"""Ranked retrieval: BM25 over postings, substring fallback, temporal predicates, vector
top-k, merging of branches, budgets.

Searches take a table of queries (query_id, text), so a batch of searches is one plan.  The
documents' terms come from stored postings (``sources.index``) or are read from the texts once;
either way they are reduced to the terms of the queries before anything is shuffled, and corpus
statistics count all rows.

Defined cases: a query without terms finds nothing; null texts have no terms and count as
documents; ties go to the smaller id; repeated ids count as often as they stand there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import cosine, weight
from tidemark.functions.text import asked_terms, index_terms, like_fragments
from tidemark.operators.hot_keys import running_sum
from tidemark.session import materialise

K1, B = 1.2, 0.75
#: Distinct terms of a batch of queries up to which they are looked for inside the documents'
#: arrays, and rows of a table up to which it is sent to all tasks.
MOST_TERMS, MOST_SENT = 10_000, 200_000


def visible(rows: DataFrame, user: str) -> DataFrame:
    """Active rows of a user and shared ones."""
    return rows.filter((F.col("status") == "active") & F.col("user_id").isin(user, "default"))


def valid_at(at: Column) -> Column:
    """Half-open validity: from <= at < to, open where null."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def snapshot_at(rows: DataFrame, at: Column, time: str = "created_at") -> DataFrame:
    """Rows that were known (``time``, open where null) and valid at a time, superseded ones included."""
    known = F.col(time).isNull() | (F.col(time) <= at)
    return rows.filter(F.col("status").isin("active", "superseded") & known & valid_at(at))


def sent(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``rows`` with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term, tf, len) of all terms of all documents."""
    terms = docs.select(F.col(key).alias("id"), index_terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    return terms.select("id", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("id", "len", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, term) of a table of queries (query_id, text)."""
    return queries.select("query_id", F.explode(asked_terms(F.coalesce("text", F.lit("")))).alias("term"))


def as_queries(docs: DataFrame, queries: DataFrame | Sequence[tuple[int, str]]) -> DataFrame:
    """A table of queries; a list of (query_id, text) becomes one."""
    if isinstance(queries, DataFrame):
        return queries
    return docs.sparkSession.createDataFrame([(int(q), t) for q, t in queries], "query_id int, text string")


def _hits(docs: DataFrame, terms: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(hits (id, len, term, tf) of ``terms`` (term), statistics (n, avg_len)), from one pass over the texts."""
    every = docs.select(F.col(key).alias("id"), index_terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    few = [r.term for r in terms.limit(MOST_TERMS + 1).collect()]
    if len(few) <= MOST_TERMS:
        every = every.select("id", F.size("terms").alias("len"), F.filter("terms", lambda t: t.isin(few)).alias("terms"))
    else:
        every = every.withColumn("len", F.size("terms"))
    every = materialise(every, "terms")
    hits = every.filter(F.size("terms") > 0).select("id", "len", F.explode("terms").alias("term"))
    if len(few) > MOST_TERMS:
        hits = hits.join(sent(terms), "term", "left_semi")
    return hits.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), every.agg(
        F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")
    )


def term_scores(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, term, part): what each term adds to the score of a document; document frequencies
    count ``hits``, so those have to be all hits of their terms."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(ratio > 0, ratio).otherwise(1e-6)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weights = df.join(F.broadcast(stats)).select("term", idf.alias("idf"), "avg_len")  # statistics are one row
    return hits.join(weights, "term").select("id", "term", part.alias("part"))


def bm25(
    docs: DataFrame, queries: DataFrame | Sequence[tuple[int, str]], key: str, text: str, all_terms: bool = False,
    stored: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(query_id, id, score) of all documents that hold a term of the query, or every term of
    it with ``all_terms``.  Statistics count all rows of ``docs``.  ``stored`` has the postings and
    statistics of an index, so that no text is read."""
    table = materialise(asked(as_queries(docs, queries)), "asked")
    terms = table.select("term").distinct()
    if stored:
        hits, stats = stored[0].join(sent(terms), "term", "left_semi"), stored[1]
    else:
        hits, stats = _hits(docs, terms, key, text)
    scored = term_scores(hits, stats).join(sent(table), "term").groupBy("query_id", "id").agg(
        F.sum("part").alias("score"), F.count(F.lit(1)).alias("n_terms")
    )
    if all_terms:
        sizes = table.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
        scored = scored.join(sent(sizes), "query_id").filter(F.col("n_terms") == F.col("needed"))
    return scored.select("query_id", "id", F.round("score", 6).alias("score"))


def top(scored: DataFrame, k: int, by: list[Column], group: str = "query_id", place: str = "place") -> DataFrame:
    """The first ``k`` rows per group; the limit is pushed below the shuffle."""
    order = Window.partitionBy(group).orderBy(*by)
    return scored.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= k)


def like_search(docs: DataFrame, query: str, k: int, text: str = "content") -> DataFrame:
    """Rows that hold any fragment of the query, by feedback weight, then newest."""
    hit = F.lit(False)
    for fragment in like_fragments(query):
        hit = hit | F.lower(text).contains(fragment.lower())
    return docs.filter(hit).withColumn("weight", weight(F.col("positive_feedback"), F.col("negative_feedback"))).orderBy(
        F.col("weight").desc(), F.col("created_at").desc(), "id"
    ).limit(k)


def nearest_exact(vectors: DataFrame, query: list[float], k: int, key: str, column: str) -> DataFrame:
    """The ``k`` vectors most similar to one query vector, exact, one pass and a top-k."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(key).alias("id"), F.round(cosine(F.col(column), target), 6).alias("similarity"))
    return scored.filter(F.col("similarity").isNotNull() & ~F.isnan("similarity")).orderBy(F.col("similarity").desc(), "id").limit(k)


def merge_branches(branches: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, source, score): every id once, from the first branch that has it."""
    every = None
    for i, (name, rows) in enumerate(branches):
        part = rows.select("id", F.lit(name).alias("source"), F.col("score").cast("double").alias("score"), F.lit(i).alias("rank"))
        every = part if every is None else every.unionByName(part)
    best = F.min(F.struct("rank", (-F.col("score")).alias("s"), "source"))
    return every.groupBy("id").agg(best.alias("b")).select("id", F.col("b.source").alias("source"), (-F.col("b.s")).alias("score"))


def within_budget(rows: DataFrame, group: str, order: list[Column], cost: Column, budget: float) -> DataFrame:
    """Rows whose running cost per group, in order, stays within the budget."""
    return running_sum(rows, [group], order, cost, "running").filter(F.col("running") <= budget)


def first_per_prefix(rows: DataFrame, text: str, order: list[Column], chars: int = 60) -> DataFrame:
    """The first row of every equal beginning of ``chars`` characters."""
    same = Window.partitionBy(F.substring(F.col(text), 1, chars)).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") == 1).drop("_r")


def cut_to_budget(rows: DataFrame, group: str, order: list[Column], text: str, budget: int, least: int = 40) -> DataFrame:
    """(rows, place, body): per group, texts in order, each costing a quarter of its characters.
    What would pass ``budget`` is cut to the characters of four times the budget that the costs
    so far leave, and dots are put behind it; the list ends where no more than ``least`` are left."""
    cost = F.floor(F.length(text) / 4)
    per = Window.partitionBy(group).orderBy(*order)
    used = F.coalesce(F.sum(cost).over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over, left = F.col("_used") + cost > budget, F.lit(4 * budget) - F.col("_used")
    # the costs before a row never shrink, so all rows after the end are left out by the same rule
    kept = rows.withColumns({"place": F.row_number().over(per), "_used": used}).filter(~over | (left > least))
    body = F.when(over, F.concat(F.substring(F.col(text), F.lit(1), left.cast("int")), F.lit("..."))).otherwise(F.col(text))
    return kept.withColumn("body", body).drop("_used")


def in_given_order(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """``rows`` of the keys of ``order`` (key, place), with their place."""
    return rows.join(sent(order), key)
