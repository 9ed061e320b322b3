import random

from pyspark.sql import functions as F

from tidemark.operators import graph, lifecycle, mining, retrieval
from tidemark.sources.snapshots import VersionedTable
from tidemark.sources.tables import SCHEMAS, conform, empty


def test_confidence_equals_a_plain_fold(spark, at):
    rng = random.Random(1)
    kinds = [*lifecycle.CONFIDENCE_STEPS, "unknown", None]
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(kinds), at(f"2024-01-{rng.randint(1, 28):02d}")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long, kind string, t timestamp").withColumn("b", F.date_trunc("week", "t"))
    got = {r.k: r.confidence for r in lifecycle.confidence(df, "k", "kind", ["t", "id"], "b").collect()}
    want = {}
    for i, k, kind, t in sorted(rows, key=lambda r: (r[3], r[0])):
        if k is not None and kind in lifecycle.CONFIDENCE_STEPS:
            want[k] = min(1.0, max(0.0, want.get(k, 0.40) + lifecycle.CONFIDENCE_STEPS[kind]))
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_chains_end_at_missing_parents(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 6)], "id long, up long")
    got = {r.id: (r.root, r.depth) for r in lifecycle.chain_roots(rows, "id", "up").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (6, 0)}


def test_merge_actions(spark):
    pairs = [("keep the cache warm", "keep the cache warm"), ("keep the big cache warm today", "not keep the big cache warm"), ("a b c d e", "a b c d f g x y"), ("one two", "three four")]
    rows = spark.createDataFrame(pairs, "old string, new string")
    got = {(r.old, r.new): r.merge_action for r in lifecycle.merge_pairs(rows, "old", "new").collect()}
    assert [got[p] for p in pairs] == ["exact_dup", "contradict", "new", "new"]


def test_traversal_is_undirected_and_bounded(spark):
    sightings = [("A", "B", "r")] * 3 + [("C", "B", "r")] * 3 + [("C", "D", "r")] * 3 + [("A", "Z", "r"), (None, "A", "r"), (" a ", "B", "r")]
    edges = graph.accumulate(spark.createDataFrame(sightings, "entity_a string, entity_b string, relation_type string"))
    got = {r.node: (r.depth, r.weight) for r in graph.traverse(edges, spark.createDataFrame([("a",)], "node string"), 2, 1.5).collect()}
    assert got == {"b": (1, 2.5), "c": (2, 2.0)}


def test_mentions_are_substrings(spark):
    docs = [(1, "我们的工作流程"), (2, "pre-Migration_plan of ÄRZTE"), (3, "migrations"), (4, None), (5, ""), (6, "workflow 工作 流"), (7, "a%b aXb"), (7, "a%b again"), (8, "aaab")]
    names = ["工作流", "migration", "Migration", "ärzte", "a%b", "aab", "流", "n_p", "", None, "absent"]
    d = spark.createDataFrame(docs, "id long, content string")
    t = spark.createDataFrame([(n,) for n in names], "term string")
    want = sorted({(n, i) for i, c in docs for n in names if n and c and n.lower() in c.lower()})
    for size in (2_000_000, 5):
        assert sorted(tuple(r) for r in graph.mentions(d, t, F.col("id"), F.col("content"), size).collect()) == want
    assert ("工作流", 1) in want and ("migration", 2) in want and ("n_p", 2) in want
    assert graph.mentions(d, t.limit(0), F.col("id"), F.col("content")).count() == 0


def test_search_without_hits_and_with_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "red door door"), (4, "blue door")], "id long, content string")
    got = retrieval.bm25(docs, [(1, "door red"), (2, "nothing"), (3, "")], "id", "content").collect()
    assert {(r.query_id, r.id) for r in got} == {(1, 3), (1, 4)}
    both = retrieval.bm25(docs, [(1, "door red")], "id", "content", all_terms=True).collect()
    assert [r.id for r in both] == [3]


def test_branches_keep_the_first(spark):
    a = spark.createDataFrame([(1, 0.5), (1, 0.7)], "id long, score double")
    b = spark.createDataFrame([(1, 9.0), (2, 0.1)], "id long, score double")
    got = {r.id: (r.source, r.score) for r in retrieval.merge_branches([("a", a), ("b", b)]).collect()}
    assert got == {1: ("a", 0.7), 2: ("b", 0.1)}


def test_drift_and_histogram(spark):
    old, new = (spark.createDataFrame(rows, "k string, v double") for rows in ([("a", 0.5), ("b", 0.2)], [("a", 0.55), ("c", 0.4)]))
    got = {r.k: r.drifted for r in mining.drift(old, new, ["k"], "v").collect()}
    assert got == {"a": False, "b": True, "c": True}
    rows = spark.createDataFrame([("x", float(i)) for i in range(100)] + [("x", None)], "g string, v double")
    h = mining.histogram(rows, "g", "v").first()
    assert (h.n, h.p50, h.p95, h.p99, h.most) == (100, 50.0, 95.0, 99.0, 99.0)


def test_versions_and_schemas(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.write(spark.range(3)) == 1 and table.write(spark.range(5)) == 2
    assert table.read(1).count() == 3 and table.read().count() == 5 and table.last_intact() == 2
    old = spark.createDataFrame([(1, "x", 7)], "id int, content string, other int")
    assert conform(old, "unified_knowledge").schema.fieldNames() == SCHEMAS["unified_knowledge"].fieldNames()
    assert empty(spark, "feedback_log").count() == 0
