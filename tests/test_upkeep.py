import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import beliefs, identity, lifecycle, mining, upkeep
from tidemark.operators.lifecycle import CONFIDENCE_STEPS

STORE = "id long, content string, layer string, status string, user_id string, positive_feedback long, negative_feedback long, match_hash string, domain_scores string, active_summary string, sleep_time_processed boolean, created_at timestamp, updated_at timestamp, valid_from timestamp"
BELIEFS = "knowledge_id long, confidence double, belief_type string"


def row(i, content="text", layer="instant", status="active", plus=0, minus=0, updated=None, summary=None, user="default"):
    return (i, content, layer, status, user, plus, minus, None, "{}", summary, False, updated, updated, None)


def test_belief_fold_equals_a_plain_loop(spark, at):
    rng = random.Random(1)
    kinds = [*CONFIDENCE_STEPS, "explicit_positive", "encounter", "unknown", None]
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(kinds), rng.choice([None, *[at(f"2024-0{m}-{d:02d}") for m in (1, 2, 3) for d in range(1, 28)]])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, kind string, t timestamp")
    got = {r.k: (r.events, r.confidence, r.belief_type) for r in beliefs.fold(df, "k", "kind", ["t", "id"]).collect()}
    want = {}
    for i, k, kind, t in sorted(rows, key=lambda r: (r[3] is not None, r[3], r[0])):
        if k is None or kind not in CONFIDENCE_STEPS:
            continue
        n, level, kind_ = want.get(k, (0, 0.40, "observation"))
        level = round(min(1.0, max(0.0, level + CONFIDENCE_STEPS[kind])), 6)
        kind_ = {"observation": "belief" if level >= 0.7 else kind_, "belief": "fact" if level >= 0.9 else "observation" if level < 0.5 else kind_, "fact": "belief" if level < 0.7 else kind_}[kind_]
        want[k] = (n + 1, level, kind_)
    assert got == want
    assert beliefs.fold(df.limit(0), "k", "kind", ["t", "id"]).count() == 0


def test_promotion_and_stats(spark):
    rows = spark.createDataFrame([(1, 0.5, "observation"), (2, 0.5, "belief")], BELIEFS)
    up = beliefs.promoted(rows, spark.createDataFrame([(1,)], "knowledge_id long"))
    assert {tuple(r) for r in up.collect()} == {(1, 0.9, "fact"), (2, 0.5, "belief")}
    assert tuple(beliefs.stats(up).first()) == (0, 1, 1, 2, 0.7)
    assert tuple(beliefs.stats(up.limit(0)).first()) == (0, 0, 0, 0, 0.0)


def test_a_maintenance_run(spark, at):
    old, now = at("2024-01-01"), at("2025-01-01")
    rows = [
        row(1, updated=old), row(2, layer="candidate", plus=9, updated=old), row(3, layer="consolidated", minus=3, updated=now),
        row(4, layer="consolidated", updated=old, summary="s"), row(5, "first line\nmore", "consolidated", updated=now), row(6, updated=None),
        row(7, "策略: 动量\nPE: 1.0\n", updated=now), row(8, "策略: 动量\nPE: 2.0\n", updated=now), row(9, "策略: 动量\nPE: 2.0\n", "candidate", updated=now),
        row(10, "策略: 反转\nPE: 2.0\n", "consolidated", updated=now, summary="s"),
        *[row(20 + i, "分析 查询 的报告", updated=now) for i in range(3)], row(30, layer="consolidated", updated=now, summary="s"), row(31, updated=now, status="archived"),
    ]
    state = spark.createDataFrame(rows, STORE)
    known = spark.createDataFrame([(1, 0.9, "fact"), (2, 0.72, "belief"), (4, 0.5, "belief"), (30, 0.28, "observation")], BELIEFS)
    out = upkeep.consolidate(state, known, F.lit("2025-01-02").cast("timestamp"), risky=spark.createDataFrame([(6,), (10,), (31,)], "id long"))
    got = {r.id: r for r in out["state"].collect()}
    assert 1 not in got and got[2].layer == "consolidated" and got[3].status == "superseded" and got[4].status == "archived" and got[4].layer == "instant"
    assert got[5].active_summary == "first line" and got[6].status == "superseded" and got[7].sleep_time_processed and got[8].sleep_time_processed
    assert got[30].status == "archived" and got[10].layer == "candidate" and got[31].status == "archived"
    derived = sorted(r.content for r in got.values() if r.id > 31)
    assert derived == ["涌现技能: 分析+报告+查询\n次数: 3", "重复模式: 动量\n次数: 3"]
    assert {r.knowledge_id: (r.confidence, r.belief_type) for r in out["beliefs"].collect()} == {2: (0.67, "belief"), 4: (0.45, "observation"), 30: (0.28, "observation")}
    actions = {r.action: r.n for r in out["actions"].collect()}
    assert actions == {"cleaned": 1, "promoted": 1, "superseded": 1, "archived": 1, "summarised": 3, "decayed": 2, "archived_by_belief": 1, "same_entity": 2, "patterns": 1, "skills": 1, "demoted": 2} | {"summarised": actions["summarised"]}
    # derived rows are not derived again
    again = upkeep.consolidate(out["state"], out["beliefs"], F.lit("2025-01-02").cast("timestamp"))
    assert not {"patterns", "skills"} & {r.action for r in again["actions"].collect()}


def test_nothing_to_do(spark):
    out = upkeep.consolidate(spark.createDataFrame([], STORE), spark.createDataFrame([], BELIEFS), F.lit("2025-01-02").cast("timestamp"))
    assert [tuple(r) for r in out["actions"].collect()] == [("no_op", 0)] and out["state"].count() == 0


def test_sessions_find_their_users(spark, at):
    known = spark.createDataFrame([("f1", "ann", "cli", "h1", 5), ("f2", "bob", "cli", "h1", 5), ("f3", "eve", "web", "h1", 9), ("f4", "zed", "cli", "", 99)], "fingerprint string, user_id string, platform string, hostname string, hit_count long")
    sessions = spark.createDataFrame([("s1", "cli", "h1"), ("s1", "cli", "h1"), ("s2", "cli", "h9"), ("s3", "cli", "h9"), ("s4", None, None)], "session_id string, platform string, hostname string")
    got = identity.resolved(sessions, known).collect()
    by = {(r.hostname, r.n): r for r in got}
    assert by["h1", 2].user_id == "ann" and by["h1", 2].how == "host" and len({r.user_id for r in got if r.hostname == "h9"}) == 1 and by["", 1].how == "new"
    full = known.withColumns({"first_seen": F.lit(None).cast("timestamp"), "last_seen": F.lit(None).cast("timestamp")})
    later = identity.remembered(full, identity.resolved(sessions, known), F.lit("2024-01-01").cast("timestamp"))
    assert later.count() == 8 and all(r.how == "session" for r in identity.resolved(sessions, later).collect())


def test_chains_and_cycles(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, None), (7, 8), (8, 7)], "id long, up long")
    got = {r.id: (r.root, r.depth) for r in lifecycle.chain_roots(rows, "id", "up").collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (None, None), 5: (6, 1), 6: (6, 0), 7: (None, None), 8: (None, None)}
    with pytest.raises(RuntimeError):
        lifecycle.chain_roots(spark.createDataFrame([(i, i + 1) for i in range(20)], "id long, up long"), "id", "up", rounds=1)


def test_as_of_join(spark, at):
    rows = [(i, ["a", "b", None][i % 3], at(f"2024-0{1 + i % 6}-{1 + i % 27:02d}")) for i in range(40)]
    known = [(100 + i, ["a", "b"][i % 2], at(f"2024-0{1 + i % 5}-{1 + (3 * i) % 27:02d}")) for i in range(20)]
    schema = "id long, g string, t timestamp"
    got = {r.id: r.as_of_id for r in lifecycle.as_of(spark.createDataFrame(rows, schema), spark.createDataFrame(known, schema), "g", "t", "id").collect()}
    want = {i: max(((kt, k) for k, kg, kt in known if kg == g and kt <= t), default=(None, None))[1] for i, g, t in rows}
    assert got == want


def test_histogram_of_null_groups_and_ties(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 1, 2, 9)] + [(None, 0.05), ("b", None)], "g string, v double")
    got = {r.g: r for r in mining.histogram(rows, "g", "v").collect()}
    assert (got["a"].p50, got["a"].p95, got["a"].upto_1, got["a"].n) == (2.0, 9.0, 2, 4) and got[None].p99 == 0.05 and "b" not in got
