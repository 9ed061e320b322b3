"""State as pure functions: ingest dedup, counters, histories, folds, chains, upserts.

Every change of state is a function of tables, for Parquet has no update in place: the next
state is written as a new version (``sources.snapshots``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import NEGATIONS, containment, content_hash, has_complement, jaccard, merged, token_set
from tidemark.session import materialise

# Change of confidence per event.
CONFIDENCE_STEPS = {"encounter": 0.15, "explicit_positive": 0.10, "explicit_negative": -0.30, "correction": -0.30, "system_conflict": -0.15}
START_CONFIDENCE = 0.40
# Limits of the merge rules.
FUZZY, COVERED, RELATED, CLOSE, LEAST_SHARED = 0.60, 0.90, 0.40, 0.85, 3


def ingest(rows: DataFrame, user: str = "user_id", text: str = "content", key: str = "id") -> DataFrame:
    """(match_hash, user, id, encounters): the first row of every equal normal form per user
    stands for all of them; blank contents are not taken."""
    hashed = rows.filter(F.trim(F.col(text)) != "").select(key, user, content_hash(F.col(text)).alias("match_hash"))
    return hashed.groupBy("match_hash", user).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("encounters"))


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key ``existing`` does not have."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``state`` with rows of ``changes`` in place of those with the same key, new ones added."""
    kept = state.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes.select(*state.columns))


def merge_action(old: Column, new: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """How a new text relates to an old one: exact_dup, contradict, fuzzy_dup, complement, new; ``a``
    and ``b`` are their token sets where they are known."""
    a, b = token_set(old) if a is None else a, token_set(new) if b is None else b
    sim, cover = jaccard(a, b), F.greatest(containment(a, b), containment(b, a))
    shared = F.size(F.array_intersect(a, b))
    negates = lambda s: F.arrays_overlap(s, F.array(*map(F.lit, NEGATIONS)))
    return (
        F.when(content_hash(old) == content_hash(new), "exact_dup")
        .when((sim > RELATED) & (shared >= LEAST_SHARED) & negates(b) & ~negates(a), "contradict")
        .when((sim > FUZZY) | (cover > COVERED), "fuzzy_dup")
        .when((sim >= RELATED) & (sim <= CLOSE) & has_complement(new), "complement")
        .otherwise("new")
    )


def merge_pairs(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with merge_action and merged_text, the text after following the action."""
    # token sets are written once: as expressions they would be computed for every use
    sets = materialise(pairs.withColumns({"_a": token_set(F.col(old)), "_b": token_set(F.col(new))}), "pair-sets")
    a, b = F.col("_a"), F.col("_b")
    out = sets.withColumn("merge_action", merge_action(F.col(old), F.col(new), a, b))
    joined = F.col("merge_action").isin("fuzzy_dup", "complement")
    return out.withColumn("merged_text", F.when(joined, merged(F.col(old), F.col(new), a, b)).otherwise(F.col(new))).drop("_a", "_b")


def confidence(events: DataFrame, key: str, kind: str, order: list[str], blocks: str) -> DataFrame:
    """(key, events, confidence): the confidence after all events in order, held in [0, 1] at
    every step.

    A clamped addition is a function min(hi, max(lo, x + d)), and following one by another is
    again one.  So events fold to one such function per (key, block) first, blocks being
    pieces of time, and the few blocks of a key fold afterwards: a key with a third of all
    events is not one task's list."""
    steps = F.create_map(*[F.lit(x) for p in CONFIDENCE_STEPS.items() for x in p])
    typed = events.select(key, blocks, *order, F.try_element_at(steps, F.col(kind)).alias("d")).filter(
        F.col("d").isNotNull() & F.col(key).isNotNull()
    )
    item = F.struct(*order, F.col("d"))
    per_block = typed.groupBy(key, blocks).agg(F.sort_array(F.collect_list(item)).alias("items"))
    unit = F.struct(F.lit(0.0).alias("d"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"))
    hold = lambda x, lo, hi: F.least(F.greatest(x, lo), hi)

    def then(f: Column, g_d: Column, g_lo: Column, g_hi: Column) -> Column:
        return F.struct(
            (f["d"] + g_d).alias("d"), hold(f["lo"] + g_d, g_lo, g_hi).alias("lo"), hold(f["hi"] + g_d, g_lo, g_hi).alias("hi")
        )

    folded = per_block.select(
        key, blocks, F.size("items").alias("n"),
        F.aggregate("items", unit, lambda f, e: then(f, e["d"], F.lit(0.0), F.lit(1.0))).alias("f"),
    )
    whole = folded.groupBy(key).agg(F.sum("n").alias("events"), F.sort_array(F.collect_list(F.struct(blocks, "f"))).alias("fs"))
    last = F.aggregate("fs", unit, lambda f, b: then(f, b["f"]["d"], b["f"]["lo"], b["f"]["hi"]))
    return whole.select(key, "events", last.alias("f")).select(
        key, "events", F.round(hold(F.lit(START_CONFIDENCE) + F.col("f.d"), F.col("f.lo"), F.col("f.hi")), 6).alias("confidence")
    )


def chain_roots(rows: DataFrame, key: str, parent: str, rounds: int = 64) -> DataFrame:
    """(key, root, depth) by pointer jumping: every round doubles how far a row looks, so a
    chain of n takes log2(n) joins.  A parent that does not exist ends the chain before it.  Rows
    on a cycle, or on a chain that runs into one, have a null root and depth; a chain that does
    not end after ``rounds`` rounds raises."""
    known = rows.select(F.col(key).alias("k")).distinct()
    links = rows.select(F.col(key).alias("k"), F.col(parent).alias("p")).filter(F.col("p").isNotNull() & (F.col("p") != F.col("k")))
    links = links.groupBy("k").agg(F.min("p").alias("p")).join(known.withColumnRenamed("k", "p"), "p", "left_semi")
    state = materialise(known.join(links, "k", "left").select("k", F.coalesce("p", "k").alias("root"), F.col("p").isNotNull().cast("long").alias("depth")), "chain")
    n = known.count()
    for _ in range(rounds):
        up = state.select(F.col("k").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        state = materialise(state.join(up, "root").select("k", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "chain")
        # a chain has fewer steps than there are rows; what has gone further walks in a circle
        ends = state.filter((F.col("k") == F.col("root")) & (F.col("depth") == 0)).select(F.col("k").alias("root"))
        moving = state.filter(F.col("depth") <= n).join(ends, "root", "left_anti")
        if moving.limit(1).count() == 0:
            break
    else:
        raise RuntimeError("chains did not end; raise rounds")
    circling = F.col("depth") > n
    return state.select(
        F.col("k").alias(key), F.when(~circling, F.col("root")).alias("root"), F.when(~circling, F.col("depth").cast("int")).alias("depth")
    )


def redact(rows: DataFrame, user: str, columns: list[str], mark: str = "[REDACTED]") -> DataFrame:
    """``rows`` with the texts of a user replaced and the user renamed."""
    mine = F.col("user_id") == user
    out = rows.withColumns({c: F.when(mine & F.col(c).isNotNull(), F.lit(mark)).otherwise(F.col(c)) for c in columns})
    return out.withColumn("user_id", F.when(mine, F.lit(f"forgotten_{user}")).otherwise(F.col("user_id")))


def forgotten(
    user: str, knowledge: DataFrame, log: DataFrame, fingerprints: DataFrame | None = None, beliefs: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All tables after a user is forgotten: texts replaced and the user renamed in the store and
    the log, fingerprints of the user and beliefs of the user's memories deleted."""
    out = {
        "unified_knowledge": redact(knowledge, user, [c for c in ("content", "active_summary", "source_snippet") if c in knowledge.columns]),
        "interaction_log": redact(log, user, [c for c in ("user_query", "model_response", "knowledge_used") if c in log.columns]),
    }
    if fingerprints is not None:
        out["user_fingerprints"] = fingerprints.filter(F.coalesce(F.col("user_id") != user, F.lit(True)))
    if beliefs is not None:
        own = knowledge.filter(F.col("user_id") == user).select(F.col("id").alias("knowledge_id"))
        out["knowledge_beliefs"] = beliefs.join(own, "knowledge_id", "left_anti")
    return out


def numbered_history(versions: DataFrame) -> DataFrame:
    """Distinct history rows with their place, newest first, and the number of versions."""
    per = Window.partitionBy("knowledge_id")
    rows = versions.filter(F.col("knowledge_id").isNotNull()).select("id", "knowledge_id", "status", "created_at").distinct()
    return rows.withColumns({
        "place": F.row_number().over(per.orderBy(F.col("created_at").desc(), F.col("id").desc())), "n_versions": F.count(F.lit(1)).over(per),
    })


def as_of(rows: DataFrame, known: DataFrame, group: str, time: str, key: str, span: str = "month") -> DataFrame:
    """``rows`` with ``as_of_<key>``: the newest row of ``known`` of the same group at or before its
    time, the greatest key on equal times.

    Both sides are cut into spans of time; inside a span a window looks back over the rows of
    both, and where it finds nothing the newest known row of the spans before it counts, one row
    per group and span.  A group with a third of all rows is spread over its spans."""
    cell = F.date_trunc(span, F.col(time).cast("timestamp")).alias("_span")
    item = F.struct(F.col(time).alias("t"), F.col(key).alias("k"))
    left = rows.withColumn("_span", cell)
    right = known.select(group, time, F.col(key).alias("_k"), cell)
    both = left.withColumns({"_k": F.lit(None).cast(known.schema[key].dataType), "_side": F.lit(1)}).unionByName(
        right.withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    inside = Window.partitionBy(group, "_span").orderBy(time, "_side", "_k").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_in", F.last("_k", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)
    last = known.select(group, cell, item.alias("i")).groupBy(group, "_span").agg(F.max("i").alias("i"))
    ends = left.select(group, "_span").distinct().withColumn("i", F.lit(None).cast(last.schema["i"].dataType)).unionByName(last).groupBy(group, "_span").agg(F.max("i").alias("i"))
    earlier = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one row per span
    before = ends.select(group, "_span", F.max("i").over(earlier)["k"].alias("_before"))
    return seen.join(before, [group, "_span"], "left").withColumn(f"as_of_{key}", F.coalesce("_in", "_before")).drop("_in", "_before", "_k", "_side", "_span")
