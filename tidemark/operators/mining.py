"""Usage mining over the interaction log: counters, quality, co-occurrence, coverage, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import score_map
from tidemark.operators.hot_keys import ranked_values
from tidemark.operators.references import used_ids
from tidemark.session import materialise

# Function words that are no keywords of a question.
QUERY_STOP_WORDS = [
    "一个", "这个", "那个", "什么", "怎么", "如何", "可以", "需要", "没有", "不是", "就是", "还是", "因为", "所以", "但是", "而且",
    "的", "了", "在", "是", "有", "和", "与",
]


def distinct_log(log: DataFrame) -> DataFrame:
    """The log without redelivered rows."""
    return log.dropDuplicates(["id"])


def usage(log: DataFrame) -> DataFrame:
    """(knowledge_id, used, corrected): how often each memory was used in an answer, and in
    answers that correct another."""
    items = used_ids(log, keep=["correction_of"]).filter(F.col("target_id").isNotNull())
    return items.groupBy(F.col("target_id").alias("knowledge_id")).agg(
        F.count(F.lit(1)).alias("used"), F.count("correction_of").alias("corrected")
    )


def quality(knowledge: DataFrame, used: DataFrame) -> DataFrame:
    """Per active memory: usage, correction rate, quality score and a flag."""
    u, c = F.coalesce("used", F.lit(0)), F.coalesce("corrected", F.lit(0))
    rate = F.when(u > 0, c / u).otherwise(0.0)
    score = u * (1 - rate) + F.col("positive_feedback") - 2 * F.col("negative_feedback")
    flag = F.when((F.col("rate") > 0.3) & (F.col("n_used") >= 3), "high_risk").when(
        (F.col("rate") > 0.1) & (F.col("n_used") >= 5), "watch"
    ).when(F.col("score") > 5, "good").otherwise("normal")
    rows = knowledge.filter(F.col("status") == "active").join(used, knowledge["id"] == used["knowledge_id"], "left")
    return rows.select("id", u.alias("n_used"), c.alias("n_corrected"), F.round(rate, 3).alias("rate"), F.round(score, 2).alias("score")).withColumn("flag", flag)


def query_words(text: Column) -> Column:
    """Distinct words of a question of two to six characters that are no function words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\x{4E00}-\x{9FFF}]{2,}|[a-z0-9_]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w).between(2, 6) & ~w.isin(QUERY_STOP_WORDS)))


def cooccurrence(log: DataFrame, known: DataFrame | None = None, support: int = 3, most: int = 3, least: float = 0.5) -> DataFrame:
    """(word, knowledge_id, together, total, confidence): memories used in at least
    ``support`` answers to questions with a word and in at least a share ``least`` of the
    word's uses, the ``most`` frequent per word.  Answers that correct another do not count, nor
    memories that are not in ``known`` (id).  Words and memories stand in one row of the log, so
    it is read once and joined with nothing."""
    items = used_ids(log.filter(F.col("correction_of").isNull()), keep=["user_query"]).filter(F.col("target_id").isNotNull())
    pairs = items.select("id", F.col("target_id").alias("knowledge_id"), "user_query").dropDuplicates(["id", "knowledge_id"])
    together = pairs.select("knowledge_id", F.explode(query_words(F.col("user_query"))).alias("word")).groupBy("word", "knowledge_id").agg(
        F.count(F.lit(1)).alias("together")
    )
    total = together.groupBy("word").agg(F.sum("together").alias("total"))
    frequent = together.filter(F.col("together") >= support)
    order = Window.partitionBy("word").orderBy(F.col("together").desc(), "knowledge_id")
    ranked = frequent.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    if known is not None:
        ranked = ranked.join(known.select(F.col("id").alias("knowledge_id")), "knowledge_id", "left_semi")
    return ranked.join(total, "word").withColumn("confidence", F.round(F.col("together") / F.col("total"), 2)).filter(
        F.col("confidence") >= least
    ).select("word", "knowledge_id", "together", "total", "confidence")


def stale(knowledge: DataFrame, at: Column, seen: str = "updated_at", days: int = 60) -> DataFrame:
    """(id, layer, days, advice): active rows past the instant layer that were not seen for
    ``days``: consolidated ones to review after 90 and to watch after 60, candidates to demote."""
    n = F.datediff(at, F.col(seen))
    old = knowledge.filter((F.col("status") == "active") & (F.col("layer") != "instant") & (F.col(seen) < at - F.make_dt_interval(days=F.lit(days))))
    advice = F.when((F.col("layer") == "consolidated") & (n > 90), "review").when((F.col("layer") == "consolidated") & (n > 60), "watch").when(
        (F.col("layer") == "candidate") & (n > 30), "demote"
    )
    return old.select("id", "layer", n.alias("days"), advice.alias("advice")).filter(F.col("advice").isNotNull())


def domain_accuracy(log: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(domain, total, errors, accuracy, confidence): per domain the answers that used a memory
    scored for it, and how many of them correct another."""
    domains = knowledge.select(F.col("id").alias("target_id"), F.explode(score_map(F.col("domain_scores"))).alias("domain", "s")).filter(F.col("s") > 0)
    items = used_ids(log, keep=["correction_of"]).filter(F.col("target_id").isNotNull())
    # one memory may be in a third of all answers: pairs are made distinct after the join only
    rows = items.join(domains.select("target_id", "domain"), "target_id").select("id", "domain", F.col("correction_of").isNotNull().alias("fix")).distinct()
    sums = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("total"), F.count_if("fix").alias("errors"))
    right = 1 - F.col("errors") / F.col("total")
    label = F.when((right > 0.9) & (F.col("total") >= 5), "high").when(right > 0.7, "medium").otherwise("low")
    return sums.select("domain", "total", "errors", F.round(right, 3).alias("accuracy"), label.alias("confidence"))


def overall_accuracy(log: DataFrame) -> DataFrame:
    """One row: (total, corrected, accuracy)."""
    n, fixed = F.count(F.lit(1)), F.count("correction_of")
    return log.agg(n.alias("total"), fixed.alias("corrected"), F.when(n > 0, F.round(1 - fixed / n, 3)).otherwise(0.0).alias("accuracy"))


def report(scored: DataFrame, patterns: DataFrame, old: DataFrame) -> DataFrame:
    """One row of counts: rows by flag of ``quality``, patterns, stale rows."""
    flag = F.col("flag")
    counts = scored.agg(
        F.count(F.lit(1)).alias("active"), F.count_if(flag == "good").alias("good"), F.count_if(flag == "watch").alias("watch"),
        F.count_if(flag == "high_risk").alias("high_risk"),
    )
    number = lambda rows, name: F.broadcast(rows.agg(F.count(F.lit(1)).alias(name)))
    return counts.join(number(patterns, "patterns")).join(number(old, "stale"))  # one row each


def top_quality(scored: DataFrame, most: int = 10) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), "id").limit(most)


def keywords(docs: DataFrame, key: str, tokens: Column, stop: list[str], most: int = 5) -> DataFrame:
    """(key, word, n, place): the most frequent tokens per document, ties by first position."""
    words = docs.select(key, F.posexplode(tokens).alias("at", "word")).filter(
        ~F.col("word").isin(stop) & ((F.length("word") >= 2) | F.col("word").rlike(r"^[\x{4E00}-\x{9FFF}]$"))
    )
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), "first_at")
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("first_at")


def drift(before: DataFrame, after: DataFrame, keys: list[str], value: str, limit: float = 0.1) -> DataFrame:
    """Full outer comparison of a value by key, absent ones 0, with a flag beyond ``limit``."""
    joined = before.withColumnRenamed(value, "_a").join(after.withColumnRenamed(value, "_b"), keys, "full_outer")
    a, b = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return joined.select(*keys, a.alias("before"), b.alias("after"), F.round(F.abs(b - a), 6).alias("change")).withColumn(
        "drifted", F.col("change") > limit
    )


def largest_drift(changes: DataFrame) -> DataFrame:
    """One row: (most, n_drifted) of the changes that ``drift`` found."""
    return changes.agg(F.coalesce(F.max("change"), F.lit(0.0)).alias("most"), F.count_if("drifted").alias("n_drifted"))


def histogram(rows: DataFrame, group: str, value: str, edges: tuple[float, ...] = (0.1, 0.5, 1, 5, 10)) -> DataFrame:
    """Per group: count, sum, min, max, mean, the values at indexes floor(n * q) for q of 0.5, 0.95
    and 0.99, and how many values are at most each of ``edges``.  Values are compressed to distinct
    ones and ranked over range partitions, so a group is never one task's list."""
    named = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    counted = materialise(named.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")), "value-counts")
    sums = counted.groupBy("g").agg(
        F.sum("c").alias("n"), F.round(F.sum(F.col("v") * F.col("c")), 4).alias("total"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"),
        *[F.sum(F.when(F.col("v") <= e, F.col("c")).otherwise(0)).alias(f"upto_{str(e).replace('.', '_')}") for e in edges],
    )
    placed = ranked_values(counted, ["g"], "v", "c")
    # a null group is one, too
    for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        index = F.least(F.floor(F.col("all_c") * q), F.col("all_c") - 1)
        hit = placed.filter(F.col("upto") > index).groupBy("g").agg(F.min("v").alias(name)).withColumnRenamed("g", "h")
        sums = sums.join(hit, F.col("g").eqNullSafe(F.col("h")), "left").drop("h")
    return sums.withColumnRenamed("g", group)
