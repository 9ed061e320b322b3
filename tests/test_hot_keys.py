import collections
import random

from tidemark.operators import hot_keys

SCHEMA = (
    "id long, entity_a string, entity_b string, relation_type string, weight double, first_seen timestamp, "
    "last_seen timestamp, hit_count long, side string, n int"
)


def edges(spark, rows):
    return spark.createDataFrame([(i, a, b, "x", w, None, None, h, "clash", 1) for i, (a, b, w, h) in enumerate(rows)], SCHEMA)


def test_share_counts_rows_without_name_and_variants(spark):
    rows = [(" Hot ", "x", 1.0, 1)] * 2 + [("HOT", None, 1.0, 1)] + [(None, "y", 1.0, 1)] * 47 + [("  ", "", 1.0, 1)] * 50
    found = {tuple(r) for r in hot_keys.heavy_keys(edges(spark, rows), 0.03).collect()}
    assert found == {("entity_a", "hot"), ("entity_b", "y")}


def test_empty_table(spark):
    none = edges(spark, [])
    assert hot_keys.heavy_keys(none).count() == 0 and hot_keys.name_profiles(none).count() == 0


def test_profiles_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hub", "hub", "a", "b", None]), rng.choice(["p", "q", "r", None]), rng.choice([1.0, 1.5, 2.0, None]), rng.choice([1, 2, None])) for _ in range(400)]
    got = {(r.side, r.entity_key): r for r in hot_keys.name_profiles(edges(spark, rows)).collect()}
    by = collections.defaultdict(list)
    for a, b, w, h in rows:
        if a:
            by["entity_a", a].append((b, w, h))
        if b:
            by["entity_b", b].append((a, w, h))
    assert set(got) == set(by)
    for key, items in by.items():
        r, weights = got[key], sorted(w for _, w, _ in items if w is not None)
        others = collections.Counter(o for o, _, _ in items if o)
        assert r.edges == len(items) and r.hits == sum(h or 0 for *_, h in items) and r.partners == len(others)
        assert abs(r.weight_sum - sum(weights)) < 1e-9
        assert r.top_partner == min(others, key=lambda o: (-others[o], o))
        assert r.median_weight == weights[(len(weights) + 1) // 2 - 1]


def test_running_sums_of_hot_and_null_keys(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.hot_keys import running_sum

    rows = [("hot" if i % 3 else None, i % 7, i) for i in range(200)] + [("cold", 1, 900)]
    df = spark.createDataFrame(rows, "k string, w long, id long").repartition(8)
    got = {r.id: r.upto for r in running_sum(df, ["k"], [F.col("w").desc(), F.col("id")], F.col("id") + 1, "upto").collect()}
    want, sums = {}, {}
    for k, w, i in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])):
        sums[k] = sums.get(k, 0) + i + 1
        want[i] = sums[k]
    assert got == want
