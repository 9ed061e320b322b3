"""Writing as set operations: what a batch of new texts merges with, what it contradicts, and the
rows that logs and histories get.

Defined cases: blank texts are not written; texts of fewer than ``SHORTEST`` characters merge with
nothing; a text without keywords is new; ties go to the candidate met first, then the smaller id;
notes without a subject or metric contradict nothing; null contents count as blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import patterns, scores, text
from tidemark.operators import graph, mining, retrieval
from tidemark.operators.lifecycle import CLOSE, COVERED, FUZZY, LEAST_SHARED, RELATED
from tidemark.session import materialise

# Shortest text that merges; keywords probed, rows per probe, rows after which
# probing ends; least cosine of complements; tolerance of metrics; lengths of logged texts.
SHORTEST, PROBES, PROBE_ROWS, ENOUGH = 8, 3, 10, 5
LEAST_COSINE, TOLERANCE = 0.50, 0.01
LOGGED_QUESTION, LOGGED_ANSWER, LOGGED_CONTENT = 500, 2_000, 200


# ---- what new texts merge with ----

def probes(new: DataFrame) -> DataFrame:
    """(new_id, user_id, probe, term): the first keywords of new texts (id, user_id, content)."""
    long_enough = new.filter(F.length(F.trim("content")) >= SHORTEST).withColumnRenamed("id", "new_id")
    words = mining.keywords(long_enough, "new_id", text.tokens(F.col("content")), text.STOP_WORDS, PROBES)
    return words.join(new.select(F.col("id").alias("new_id"), "user_id"), "new_id").select(
        "new_id", "user_id", F.col("place").alias("probe"), F.col("word").alias("term")
    )


def candidates(new: DataFrame, store: DataFrame, stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(new_id, old_id, rank): per new text the best rows of its user and of all users for its
    first keywords, until there are enough.

    What a keyword finds depends on the keyword and the user alone, so the best rows are kept per
    (term, user) before new texts come in: a keyword that a third of them share is looked up once.
    Texts whose keywords the index does not know look for them as substrings."""
    asked = materialise(probes(new), "probes")
    terms = asked.select("term").distinct()
    hits, stats = (
        (stored[0].join(retrieval.sent(terms), "term", "left_semi"), stored[1]) if stored else retrieval._hits(store, terms, "id", "content")
    )
    active = store.filter(F.col("status") == "active").select("id", F.col("user_id").alias("owner"))
    owned = retrieval.term_scores(hits, stats).join(active, "id")
    best = materialise(_first_rows(owned, F.col("part").desc()), "probe-rows")
    found = _per_probe(asked, best)
    # the keywords of texts that found nothing, as substrings
    lost = asked.join(found.select("new_id").distinct(), "new_id", "left_anti").filter(F.length("term") >= 2)
    lost = materialise(lost, "lost-probes")
    if lost.limit(1).count():
        held = graph.mentions(store, lost.select("term").distinct(), F.col("id"), F.col("content"))
        rows = held.join(active, "id").withColumn("part", F.lit(0.0))
        found = found.unionByName(_per_probe(lost, _first_rows(rows, F.col("part"))))
    ahead = Window.partitionBy("new_id").orderBy("probe")
    sizes = found.groupBy("new_id", "probe").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).filter(F.col("before") < ENOUGH)
    return found.join(sizes.select("new_id", "probe"), ["new_id", "probe"]).groupBy("new_id", "old_id").agg(
        F.min(F.col("probe") * 100 + F.col("place")).alias("rank")
    ).filter(F.col("old_id") != F.col("new_id"))


def _first_rows(rows: DataFrame, order: Column) -> DataFrame:
    """The first rows of every (term, owner)."""
    per = Window.partitionBy("term", "owner").orderBy(order, "id")
    return rows.withColumn("r", F.row_number().over(per)).filter(F.col("r") <= PROBE_ROWS).select("term", "owner", "id", "part")


def _per_probe(asked: DataFrame, best: DataFrame) -> DataFrame:
    """(new_id, probe, old_id, place): the first rows of each probe among its user's and common rows."""
    owners = F.explode(F.array_distinct(F.array(F.coalesce("user_id", F.lit("default")), F.lit("default")))).alias("owner")
    pairs = asked.select("new_id", "probe", "term", owners).join(best, ["term", "owner"])
    per = Window.partitionBy("new_id", "probe").orderBy(F.col("part").desc(), "id")
    return pairs.withColumn("place", F.row_number().over(per)).filter(F.col("place") <= PROBE_ROWS).select(
        "new_id", "probe", F.col("id").alias("old_id"), "place"
    )


def _weighed(state: Column, c: Column) -> Column:
    """One candidate after the others: the action of the best one so far."""
    sim, same = c["sim"], c["same_domain"]
    keep = lambda s: F.struct(s["score"].alias("score"), s["id"].alias("id"), s["action"].alias("action"))

    def take(s: Column, holds: Column, score: Column, action: str) -> Column:
        better = F.struct(score.alias("score"), c["id"].alias("id"), F.lit(action).alias("action"))
        return F.when(holds & (score > s["score"]), better).otherwise(keep(s))

    opposed = same & (sim > RELATED) & (c["shared"] >= LEAST_SHARED) & c["new_negated"] & ~c["old_negated"]
    state = take(state, opposed, sim, "contradict")
    state = take(state, same & ((sim > FUZZY) | (c["cover"] > COVERED)) & (state["action"] != "contradict"), sim, "fuzzy_dup")
    state = take(state, same & sim.between(RELATED, CLOSE) & c["adds"], sim, "complement")
    near = c["cosine"] >= LEAST_COSINE
    return take(state, (state["action"] == "new") & (sim < RELATED) & c["adds"] & F.coalesce(near, F.lit(False)), F.coalesce(c["cosine"], F.lit(0.0)), "complement")


def _traits(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, hashes of the distinct tokens, domain, whether it negates, whether it adds) of texts."""
    marks = F.array(*[F.xxhash64(F.lit(w)) for w in text.NEGATIONS])
    hashed = F.array_distinct(F.transform(text.tokens(F.coalesce("content", F.lit(""))), lambda t: F.xxhash64(t)))
    return rows.select(
        key, hashed.alias(name), scores.text_domain(F.col("content")).alias(f"{name}_domain"), text.has_complement(F.col("content")).alias(f"{name}_adds"),
    ).withColumn(f"{name}_negated", F.arrays_overlap(name, marks))


def merge_targets(new: DataFrame, store: DataFrame, pairs: DataFrame, cosines: DataFrame | None = None) -> DataFrame:
    """(new_id, action, target_id, similarity): how each new text (id, user_id, content) is taken
    in: ``exact_dup`` of the active row of equal normal form of its user, else the best of its
    candidates ``pairs`` (new_id, old_id, rank): contradict, fuzzy_dup, complement or new.
    ``cosines`` (new_id, old_id, cosine) lets texts complement one another by their vectors."""
    fresh = new.filter(F.trim("content") != "").select(F.col("id").alias("new_id"), "user_id", F.col("content").alias("new"))
    active = store.filter(F.col("status") == "active")
    equal = active.select(text.content_hash(F.col("content")).alias("h"), "user_id", "id").groupBy("h", "user_id").agg(F.min("id").alias("exact"))
    same = fresh.withColumn("h", text.content_hash(F.col("new"))).join(equal, ["h", "user_id"], "left").select("new_id", "exact")
    # what the rules ask of a text is read once, not once per pair
    mine = materialise(_traits(fresh.select("new_id", F.col("new").alias("content")), "new_id", "a"), "new-traits")
    theirs = materialise(_traits(active.select(F.col("id").alias("old_id"), "content"), "old_id", "b"), "old-traits")
    rows = pairs.join(mine, "new_id").join(theirs, "old_id")
    rows = rows.join(cosines, ["new_id", "old_id"], "left") if cosines is not None else rows.withColumn("cosine", F.lit(None).cast("double"))
    rows = rows.withColumn("shared", F.size(F.array_intersect("a", "b")))
    n, m, both = F.size("a"), F.size("b"), F.col("shared")
    part = lambda size: F.when(size > 0, both / size).otherwise(0.0)
    item = F.struct(
        "rank", F.col("old_id").alias("id"), F.when((n > 0) & (m > 0), both / (n + m - both)).otherwise(0.0).alias("sim"),
        F.greatest(part(n), part(m)).alias("cover"), "shared", (F.col("a_domain") == F.col("b_domain")).alias("same_domain"),
        F.col("a_negated").alias("new_negated"), F.col("b_negated").alias("old_negated"), F.col("a_adds").alias("adds"), "cosine",
    )
    # at most PROBES * PROBE_ROWS candidates per text
    listed = rows.groupBy("new_id").agg(F.sort_array(F.collect_list(item)).alias("cs"))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("id"), F.lit("new").alias("action"))
    judged = listed.select("new_id", F.aggregate("cs", none, _weighed).alias("best"))
    exact = F.col("exact").isNotNull()
    return fresh.join(same, "new_id").join(judged, "new_id", "left").select(
        "new_id", F.when(exact, "exact_dup").otherwise(F.coalesce("best.action", F.lit("new"))).alias("action"),
        F.when(exact, F.col("exact")).otherwise(F.col("best.id")).alias("target_id"),
        F.round(F.when(exact, 1.0).otherwise(F.coalesce("best.score", F.lit(0.0))), 3).alias("similarity"),
    )


def written(store: DataFrame, new: DataFrame, targets: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, versions, conflicts) after a batch: fuzzy and complementary texts go into their
    target, exact ones only touch it, all others become rows of the instant layer.  ``versions``
    has the rows before they changed, ``conflicts`` (knowledge_id, other_id) the contradictions.
    Where several texts meet one target, the one of the smallest id goes in, the others are written."""
    joined = targets.join(new.select(F.col("id").alias("new_id"), "user_id", F.col("content").alias("new")), "new_id")
    merging = joined.filter(F.col("action").isin("fuzzy_dup", "complement"))
    first = merging.groupBy(F.col("target_id").alias("id")).agg(F.min_by("new", "new_id").alias("new"), F.min("new_id").alias("new_id"))
    touched = joined.filter(F.col("action") == "exact_dup").select(F.col("target_id").alias("id"), F.lit(True).alias("touched")).distinct()
    base = store.join(first, "id", "left").join(touched, "id", "left")
    into, seen = F.col("new").isNotNull(), F.coalesce("touched", F.lit(False))
    body = F.when(into, text.merged(F.col("content"), F.col("new"))).otherwise(F.col("content"))
    changed = base.withColumns({
        "content": body, "match_hash": F.when(into, text.content_hash(body)).otherwise(F.col("match_hash")),
        "updated_at": F.when(into | seen, at).otherwise(F.col("updated_at")),
    }).select(*store.columns)
    versions = base.filter(into | seen).select(
        F.col("id").alias("knowledge_id"), "content", "active_summary", "status",
        F.when(into, "merge").otherwise("re-encountered").alias("change_reason"), "user_id", at.alias("created_at"),
    )
    taken = first.select("new_id").unionByName(joined.filter(F.col("action") == "exact_dup").select("new_id"))
    rest = joined.join(taken, "new_id", "left_anti")
    values = {
        "id": F.col("new_id"), "content": F.trim("new"), "match_hash": text.content_hash(F.col("new")), "user_id": F.col("user_id"),
        "domain_scores": F.to_json(scores.empty_scores()), "layer": F.lit("instant"), "status": F.lit("active"),
        "positive_feedback": F.lit(0), "negative_feedback": F.lit(0), "created_at": at, "updated_at": at, "valid_from": at,
    }
    added = rest.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in store.schema.fields
    ])
    conflicts = joined.filter(F.col("action") == "contradict").select(F.col("new_id").alias("knowledge_id"), F.col("target_id").alias("other_id"))
    return changed.unionByName(added), versions, conflicts


# ---- metrics that disagree ----

def metric_values(rows: DataFrame, *keep: str) -> DataFrame:
    """(id, keep, entity, metric, value, condition) of the structured notes among ``rows`` (id, content)."""
    return rows.select("id", *keep, F.explode(patterns.metrics(F.col("content"))).alias("m")).select("id", *keep, "m.*")


def metric_conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(new_id, n_conflicts, other_id, entity, metric, value, other_value): per new row the number
    of existing values of its (entity, metric) that differ by the tolerance under a condition that
    can hold with its own, and the conflict with the smallest id.  Both have (id, entity, metric,
    value, condition); existing values are compressed to distinct ones first."""
    known = existing.groupBy("entity", "metric", "condition", "value").agg(F.min("id").alias("other_id"), F.count(F.lit(1)).alias("n"))
    known = known.select("entity", "metric", F.col("condition").alias("c"), F.col("value").alias("v"), "other_id", "n")
    met = new.join(known, ["entity", "metric"]).filter(
        (F.abs(F.col("value") - F.col("v")) >= TOLERANCE) & patterns.conditions_overlap(F.col("condition"), F.col("c"))
    )
    first = F.min(F.struct("other_id", "entity", "metric", "value", "v"))
    return met.groupBy(F.col("id").alias("new_id")).agg(F.sum("n").alias("n_conflicts"), first.alias("f")).select(
        "new_id", "n_conflicts", "f.other_id", "f.entity", "f.metric", "f.value", F.col("f.v").alias("other_value")
    )


def settled_conflicts(conflicts: DataFrame, store: DataFrame) -> DataFrame:
    """(new_id, superseded_id, new_status): a new row as well confirmed as the old one replaces it,
    else it waits as a conflict itself."""
    plus = lambda key: store.select(F.col("id").alias(key), F.col("positive_feedback").alias(f"plus_{key}"))
    joined = conflicts.select("new_id", "other_id").join(plus("new_id"), "new_id", "left").join(plus("other_id"), "other_id", "left")
    wins = F.coalesce("plus_new_id", F.lit(0)) >= F.coalesce("plus_other_id", F.lit(0))
    return joined.select("new_id", F.when(wins, F.col("other_id")).alias("superseded_id"), F.when(wins, "active").otherwise("conflict").alias("new_status"))


def layer_conflicts(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(id, metric, n_conflicts): per row and metric the number of other rows whose value differs
    by the tolerance under a condition that can hold with its own.  Rows have (id, metric, value,
    condition) and, to be compared within it, further ``keys``.

    No pairs are formed: all values of conditions that can hold together are counted, less those
    within the tolerance, which lie in the same or a neighbouring cell of that width.  A row's own
    values are taken off at the end."""
    keys = ["metric", *(keys or [])]
    cell = F.floor(F.col("value") / TOLERANCE)
    fine = materialise(rows.groupBy(*keys, "condition", "value").agg(F.count(F.lit(1)).alias("n")), "metric-values")
    sums = fine.groupBy(*keys, "condition").agg(F.sum("n").alias("n"))
    other = sums.select(*keys, F.col("condition").alias("c"), F.col("n").alias("all_n"))
    linked = sums.select(*keys, "condition").join(other, keys).filter(patterns.conditions_overlap(F.col("condition"), F.col("c")))
    totals = linked.groupBy(*keys, "condition").agg(F.sum("all_n").alias("all_n"))
    around = fine.select(*keys, F.col("condition").alias("c"), F.col("value").alias("v"), F.col("n").alias("m"), F.explode(
        F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = fine.withColumn("cell", cell).join(linked.select(*keys, "condition", "c"), [*keys, "condition"]).join(
        around, [*keys, "c", "cell"]
    ).filter(F.abs(F.col("value") - F.col("v")) < TOLERANCE).groupBy(*keys, "condition", "value").agg(F.sum("m").alias("close_n"))
    counted = rows.join(totals, [*keys, "condition"]).join(near, [*keys, "condition", "value"])
    # pairs of values of one row are no conflict between rows
    mine = rows.select(*keys, F.col("id"), F.col("condition").alias("c"), F.col("value").alias("v"))
    own = rows.join(mine, ["id", *keys]).filter(
        patterns.conditions_overlap(F.col("condition"), F.col("c")) & (F.abs(F.col("value") - F.col("v")) >= TOLERANCE)
    ).groupBy("id", *keys).agg(F.count(F.lit(1)).alias("own_n"))
    return counted.groupBy("id", *keys).agg(F.sum(F.col("all_n") - F.col("close_n")).alias("k")).join(own, ["id", *keys], "left").select(
        "id", *keys, (F.col("k") - F.coalesce("own_n", F.lit(0))).alias("n_conflicts")
    ).filter(F.col("n_conflicts") > 0)


# ---- logs and histories ----

def logged(turns: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Rows of the interaction log from ``turns`` (id, session_id, user_id, user_query,
    model_response, knowledge_used, correction_of, event_time, created_at): texts cut to their
    fields' lengths, the contents of the used rows as well.  A turn that corrects another takes over
    what that one used; one that corrects a row that does not exist is not logged."""
    cut = turns.withColumns({
        "user_query": F.substring(F.coalesce("user_query", F.lit("")), 1, LOGGED_QUESTION),
        "model_response": F.substring(F.coalesce("model_response", F.lit("")), 1, LOGGED_ANSWER),
        "event_time": F.coalesce("event_time", "created_at"),
    })
    item = "struct<id:bigint,content:string,layer:string,source:string,score:double>"
    used = F.from_json("knowledge_used", f"array<{item}>")
    short = F.transform(F.filter(used, lambda k: k["id"].isNotNull()), lambda k: F.struct(
        k["id"].alias("id"), F.substring(F.coalesce(k["content"], F.lit("")), 1, LOGGED_CONTENT).alias("content"),
        F.coalesce(k["layer"], F.lit("")).alias("layer"), F.coalesce(k["source"], F.lit("")).alias("source"),
        F.round(F.coalesce(k["score"], F.lit(0.0)), 3).alias("score"),
    ))
    own = cut.filter(F.col("correction_of").isNull()).withColumn("knowledge_used", F.to_json(F.coalesce(short, F.array().cast(f"array<{item}>"))))
    if parents is None:
        return own
    earlier = parents.select(F.col("id").try_cast("string").alias("correction_of"), F.col("knowledge_used").alias("_used")).dropDuplicates(["correction_of"])
    fixes = cut.filter(F.col("correction_of").isNotNull()).drop("knowledge_used").join(earlier, "correction_of")
    return own.unionByName(fixes.withColumnRenamed("_used", "knowledge_used").select(*own.columns))


def versioned(before: DataFrame, after: DataFrame, reason: Column, at: Column) -> DataFrame:
    """History rows (knowledge_id, content, active_summary, status, change_reason, user_id,
    created_at) of all rows of ``before`` whose content, status or layer ``after`` has changed."""
    later = after.select("id", *[F.col(c).alias(f"_{c}") for c in ("content", "status", "layer")])
    differs = ~(F.col("content").eqNullSafe(F.col("_content")) & F.col("status").eqNullSafe(F.col("_status")) & F.col("layer").eqNullSafe(F.col("_layer")))
    return before.join(later, "id").filter(differs).select(
        F.col("id").alias("knowledge_id"), "content", "active_summary", "status", reason.alias("change_reason"), "user_id", at.alias("created_at")
    )


def touched(store: DataFrame, hits: DataFrame, at: Column, column: str = "updated_at") -> DataFrame:
    """``store`` with the time of the rows that a search returned."""
    ids = hits.select("id", F.lit(True).alias("_hit")).distinct()
    return store.join(ids, "id", "left").withColumn(column, F.when(F.col("_hit"), at).otherwise(F.col(column))).select(*store.columns)
