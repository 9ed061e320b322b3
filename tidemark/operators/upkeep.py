"""Maintenance of a store as one function of its tables: what goes, moves or is derived, in order.

Every stage is a column expression or a join on the state left by the stage before; the state is
written once where rows are added.  Defined cases: null times are never old; a pattern or
combination that has a row already gets no second one; a run that changes nothing reports
``no_op``; empty tables report the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import patterns, scores, text
from tidemark.operators import beliefs as belief
from tidemark.operators import writing
from tidemark.session import materialise

# Ages in days, weights, least support, words of work, heads and scores of derived rows.
STALE_DAYS, ARCHIVE_DAYS, PROMOTED_FROM, REJECTED_TO, SUPPORT = 30, 180, 8, -5, 3
WORK_WORDS = ["分析", "查询", "搜索", "计算", "生成", "预测", "诊断", "报告", "监控", "对比", "评估", "汇总"]
PATTERN_HEAD, SKILL_HEAD = "重复模式: ", "涌现技能: "
PATTERN_SCORES, SKILL_SCORES = '{"pattern": 8, "raw_fact": 3}', '{"workflow": 10, "pattern": 5}'


def first_entity(content: Column) -> Column:
    """Subject of a structured note with metrics, null for any other text."""
    return F.get(F.transform(patterns.metrics(content), lambda m: m["entity"]), F.lit(0))


def same_entity_rows(rows: DataFrame) -> DataFrame:
    """(id, entity, peers): rows (id, content) whose entity other rows have, too, with their number."""
    named = rows.select("id", first_entity(F.col("content")).alias("entity")).filter(F.col("entity").isNotNull())
    sizes = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return named.join(sizes, "entity").select("id", "entity", (F.col("n") - 1).alias("peers"))


def repeated_entities(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, n) of entities that at least ``support`` rows are about."""
    return rows.select(first_entity(F.col("content")).alias("entity")).filter(F.col("entity").isNotNull()).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= support)


def work_combinations(rows: DataFrame, words: list[str] | None = None, support: int = SUPPORT, least: int = 2) -> DataFrame:
    """(pattern, n): sets of at least ``least`` words of work that at least ``support`` rows hold
    exactly, joined by plus signs."""
    held = F.array_sort(F.filter(F.array(*map(F.lit, words or WORK_WORDS)), lambda w: F.col("content").contains(w)))
    return rows.select(held.alias("held")).filter(F.size("held") >= least).groupBy(F.array_join("held", "+").alias("pattern")).agg(
        F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= support)


def without_row(found: DataFrame, name: str, head: str, rows: DataFrame) -> DataFrame:
    """``found`` without those whose ``name`` after ``head`` a row of ``rows`` (content) holds: the
    name is read from the derived rows, so no two tables are compared by substrings."""
    have = rows.filter(F.col("content").contains(head)).select(
        F.explode(F.regexp_extract_all("content", F.lit(head + r"([^\n]*)"), F.lit(1))).alias(name)
    ).distinct()
    return found.join(have, name, "left_anti")


def _derived(found: DataFrame, name: str, head: str, domain_scores: str, columns: list, user: str, at: Column, first_id: Column) -> DataFrame:
    content = F.concat(F.lit(head), F.col(name), F.lit("\n次数: "), F.col("n").cast("string"))
    values = {
        "id": first_id, "content": content, "domain_scores": F.lit(domain_scores), "layer": F.lit("consolidated"), "status": F.lit("active"),
        "match_hash": text.content_hash(content), "user_id": F.lit(user), "created_at": at, "updated_at": at, "valid_from": at,
        "positive_feedback": F.lit(0), "negative_feedback": F.lit(0),
    }
    return found.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])


def aged(state: DataFrame, at: Column, user: str | None = None, seen: str = "updated_at") -> DataFrame:
    """``state`` with a column ``done`` naming the first stages that apply to each row: cleaned (to be
    deleted), promoted, superseded, archived, summarised; layer, status and summary follow."""
    mine = F.lit(True) if user is None else F.col("user_id").isin(user, "default")
    live = mine & (F.col("status") == "active")
    old = lambda days: F.col(seen) < at - F.make_dt_interval(days=F.lit(days))
    w, layer = scores.weight(F.col("positive_feedback"), F.col("negative_feedback")), F.col("layer")
    yes = lambda c: F.coalesce(c, F.lit(False))
    cleaned = yes(live & (layer == "instant") & old(STALE_DAYS))
    promoted = yes(live & (layer == "candidate") & (w >= PROMOTED_FROM))
    gone = yes(live & layer.isin("candidate", "consolidated") & (w <= REJECTED_TO))
    marked = state.withColumns({"_c": cleaned, "_p": promoted, "_g": gone})
    now = F.when(F.col("_p"), "consolidated").otherwise(F.col("layer"))
    # a row just promoted was touched by that, so it is not archived in the same run
    stale = yes(live & ~F.col("_g") & ~F.col("_p") & (layer == "consolidated") & old(ARCHIVE_DAYS))
    marked = marked.withColumn("_a", stale)
    bare = yes(live & ~F.col("_g") & ~F.col("_a") & (now == "consolidated") & (F.coalesce("active_summary", F.lit("")) == ""))
    marked = marked.withColumn("_s", bare)
    names = {"_c": "cleaned", "_p": "promoted", "_g": "superseded", "_a": "archived", "_s": "summarised"}
    done = F.array_compact(F.array(*[F.when(F.col(c), name) for c, name in names.items()]))
    return marked.withColumns({
        "done": done, "layer": now,
        "status": F.when(F.col("_g"), "superseded").when(F.col("_a"), "archived").otherwise(F.col("status")),
        "active_summary": F.when(F.col("_s"), text.summary(F.col("content"))).otherwise(F.col("active_summary")),
        "updated_at": F.when(F.col("_p") | F.col("_g") | F.col("_a"), at).otherwise(F.col("updated_at")),
    }).drop(*names)


def consolidate(
    state: DataFrame, beliefs: DataFrame, at: Column, user: str | None = None, risky: DataFrame | None = None, seen: str = "updated_at"
) -> dict[str, DataFrame]:
    """One maintenance run over ``state`` and ``beliefs``.  Returns the tables ``state``, ``beliefs``
    (without those of deleted rows), ``conflicts`` (id, metric, n_conflicts) and ``actions``
    (action, n).  ``risky`` (id) are rows to demote, as ``mining.quality`` finds them; without ``user``
    the rows of all users are one store."""
    columns = state.columns
    after = materialise(aged(state, at, user, seen), "aged")
    kept = after.filter(~F.array_contains("done", "cleaned"))
    # beliefs: decay by what was last seen before this run, then archive
    old_seen = state.select("id", "status", F.col(seen).alias("updated_at"))
    alive = kept.select(F.col("id").alias("knowledge_id"))
    faded = materialise(belief.decayed(beliefs.join(alive, "knowledge_id", "left_semi"), old_seen.join(kept.select("id"), "id", "left_semi"), at), "faded")
    moved = faded.join(beliefs.select("knowledge_id", F.col("belief_type").alias("before")), "knowledge_id").filter(
        F.col("decayed") & (F.col("before") != F.col("belief_type"))
    ).select(F.col("knowledge_id").alias("id"), belief.layer_of(F.col("belief_type")).alias("to"))
    weak = belief.archived_by_belief(faded, kept).withColumn("weak", F.lit(True))
    kept = kept.join(moved, "id", "left").join(weak, "id", "left").withColumns({
        "layer": F.coalesce("to", "layer"), "status": F.when(F.col("weak"), "archived").otherwise(F.col("status")),
    })
    mine = F.lit(True) if user is None else F.col("user_id").isin(user, "default")
    live = kept.filter(mine & (F.col("status") == "active"))
    peers = same_entity_rows(live.filter((F.col("layer") == "instant") & ~F.coalesce("sleep_time_processed", F.lit(False))))
    peers = materialise(peers, "peers")
    kept = kept.join(peers.select("id", F.lit(True).alias("_peer")), "id", "left").withColumn(
        "sleep_time_processed", F.coalesce("_peer", "sleep_time_processed")
    )
    if risky is not None:
        hit = risky.select("id", F.lit(True).alias("_risk")).distinct()
        down = F.coalesce("_risk", F.lit(False)) & (F.col("status") == "active")
        kept = kept.join(hit, "id", "left").withColumn("_down", down).withColumns({
            "status": F.when(F.col("_down") & (F.col("layer") != "consolidated"), "superseded").otherwise(F.col("status")),
            "layer": F.when(F.col("_down") & (F.col("layer") == "consolidated"), "candidate").otherwise(F.col("layer")),
        })
    else:
        kept = kept.withColumn("_down", F.lit(False))
    kept = materialise(kept.select(*columns, "done", "weak", "_down"), "kept")
    live = kept.filter(mine & (F.col("status") == "active"))
    entities = materialise(without_row(repeated_entities(live), "entity", PATTERN_HEAD, live.filter(F.col("layer") == "consolidated")), "entities")
    work = materialise(without_row(work_combinations(live.filter(F.col("layer") == "instant")), "pattern", SKILL_HEAD, live), "work")
    top, owner = int(kept.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]), user or "default"
    # few rows by their nature; ids are hashes of the names where a counter would need one task
    fresh_id = lambda name: F.lit(top) + 1 + F.pmod(F.xxhash64(name), F.lit(1 << 40))
    grown = kept.select(*columns).unionByName(
        _derived(entities, "entity", PATTERN_HEAD, PATTERN_SCORES, state.schema.fields, owner, at, fresh_id("entity"))
    ).unionByName(_derived(work, "pattern", SKILL_HEAD, SKILL_SCORES, state.schema.fields, owner, at, fresh_id("pattern")))
    held = writing.metric_values(live.filter(F.col("layer").isin("candidate", "consolidated")))
    conflicts = materialise(writing.layer_conflicts(held.select("id", "metric", "value", "condition")), "layer-conflicts")
    one = lambda rows, name, n=F.count(F.lit(1)): rows.agg(n.alias("n")).select(F.lit(name).alias("action"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    actions = after.select(F.explode("done").alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    for part in (
        one(faded.filter("decayed"), "decayed"), one(weak, "archived_by_belief"), one(peers, "same_entity"), one(entities, "patterns"),
        one(work, "skills"), one(conflicts, "layer_conflicts", F.sum("n_conflicts") / 2), one(kept.filter("_down"), "demoted"),
    ):
        actions = actions.unionByName(part)
    actions = materialise(actions.filter(F.col("n") > 0), "actions")
    nothing = state.sparkSession.createDataFrame([("no_op", 0)], "action string, n long")
    return {
        "state": grown, "beliefs": faded.drop("decayed"), "conflicts": conflicts, "actions": actions if actions.limit(1).count() else nothing,
    }


def skill_notes(work: DataFrame) -> DataFrame:
    """(name, body): a Markdown note for every combination of work (pattern, n)."""
    body = F.concat(F.lit("# "), F.regexp_replace("pattern", r"\+", "、"), F.lit("\n\nrows: "), F.col("n").cast("string"), F.lit("\n"))
    return work.select(F.concat(F.lit("emergent-"), F.regexp_replace(F.lower("pattern"), r"\+", "-")).alias("name"), body.alias("body"))
