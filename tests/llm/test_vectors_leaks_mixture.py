import numpy as np
import pytest

from tidemark.llm import leaks, mixture, neighbours


def brute_top(rows, k=5, floor=0.9):
    out = set()
    by_dim = {}
    for i, v in rows:
        by_dim.setdefault(len(v), []).append((i, np.asarray(v, np.float32).astype(float)))
    for items in by_dim.values():
        ids = [i for i, _ in items]
        m = np.stack([v / np.linalg.norm(v) for _, v in items])
        s = np.round(m @ m.T, 6)
        for a, i in enumerate(ids):
            order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
            out |= {(min(i, ids[b]), max(i, ids[b])) for b in order if s[a, b] >= floor}
    return out


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(60):
        centre = rng.normal(size=(64 if c % 4 else 24))
        for j in range(rng.integers(1, 12)):
            rows.append((int(len(rows)), (centre + 0.25 * rng.normal(size=len(centre))).tolist()))
    rows += [(1000 + i, rows[0][1]) for i in range(9)]
    bad = [(2000, None, 64), (2001, [], 0), (2002, [0.0] * 64, 64), (2003, [float("nan")] * 64, 64), (2004, [1.0] * 60, 64), (2005, [1.0] * 64, None), (2006, [float("inf")] * 64, 64)]
    df = spark.createDataFrame([(i, v, len(v), "c") for i, v in rows] + [(*b, "c") for b in bad], "entry_id long, embedding array<float>, embed_dim int, id string")
    got = {tuple(r) for r in neighbours.similar_entries(df).collect()}
    want = brute_top(rows)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    assert neighbours.similar_entries(df.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, len(v)) for i, v in rows], "entry_id long, embedding array<float>, embed_dim int")


def test_tight_cluster_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    rows = [(i, (centre + 0.2 * rng.normal(size=64) if i % 3 == 0 else rng.normal(size=64)).tolist()) for i in range(4500)]
    got = {tuple(r) for r in neighbours.similar_entries(vectors(spark, rows)).collect()}
    assert got == brute_top(rows)


def test_exact_blocks_of_several_leaders_and_dimensions(spark):
    rng = np.random.default_rng(5)
    rows = []
    for dim in (24, 64):
        for _ in range(3):
            centre = rng.normal(size=dim)
            rows += [(len(rows) + j, (centre + 0.3 * rng.normal(size=dim)).tolist()) for j in range(150)]
    reps = spark.createDataFrame([(i, len(v), v) for i, v in rows], "id long, dim int, vec array<float>")
    got = neighbours.crowded_pairs(reps, reps.select("id"), 5, 0.9, homes=40).select("a", "b").distinct()
    assert {tuple(r) for r in got.collect()} == brute_top(rows)
    assert neighbours.crowded_pairs(reps, reps.select("id").limit(0), 5, 0.9) is None


def test_one_direction_in_many_lengths_is_one_class(spark):
    base = np.random.default_rng(6).integers(-9, 10, size=64).astype(float)
    rows = [(i, (base * (i + 1)).tolist()) for i in range(120)] + [(500, np.abs(base[::-1]).tolist())]
    got = {tuple(r) for r in neighbours.similar_entries(vectors(spark, rows)).collect()}
    assert got == brute_top(rows)


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(np.arange(8), np.arange(8)), -1).reshape(-1, 2)
    keys = neighbours.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(64))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_windows_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 32, rng.normal(size=32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, dim int, vec array<float>")
    assert neighbours.candidate_pairs(df, 0.2, window=300).count() == neighbours.candidate_pairs(df, 0.2, window=299, range_rows=10**9).count()


def test_leaks_against_brute_force(spark):
    item = " ".join(f"Word{i}" for i in range(30))
    items = [(1, item, "s"), (2, " ".join(f"word{i}" for i in range(10, 40)), "s"), (3, "short one", "s"), (4, None, "s")]
    docs = [(1, "x, " + ", ".join(f"word{i}" for i in range(5, 17)) + " y"), (2, " ".join(f"word{i}" for i in range(5, 16))), (3, " ".join(f"WORD{i}" for i in range(12, 26))), (4, None), (5, ""), (6, "z " * 50_000 + item), (7, item.replace(" ", "_"))]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string, suite string")
    want = set()
    for doc, body in docs:
        w = leaks.words(body or "")
        grams = {tuple(w[a:a + 12]) for a in range(len(w) - 11)}
        for item_id, t, _ in items:
            v = leaks.words(t or "")
            if any(tuple(v[a:a + 12]) in grams for a in range(len(v) - 11)):
                want.add((doc, item_id))
    assert {tuple(r) for r in leaks.leaked_items(d, i).collect()} == want
    assert {tuple(r) for r in leaks.leaked_items(d, i, block_chars=50).collect()} == want
    assert (3, 2) in want and (7, 1) in want and (2, 1) not in want
    assert {r.item_id: r.n_documents for r in leaks.leak_report(leaks.leaked_items(d, i), i).collect()}[3] == 0


def test_pivotal_step_keeps_mass_and_means():
    settled = []
    for seed in range(4000):
        a, b = mixture.pair_up((1, 30, 0.25), (2, 50, 0.6), seed)
        assert a[2] in (0.0, 1.0) and abs(a[1] * a[2] + b[1] * b[2] - (30 * 0.25 + 50 * 0.6)) < 1e-9
        settled.append(next(p for d, _, p in (a, b) if d == 1))
    assert abs(sum(settled) / 4000 - 0.25) < 0.03


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "some words of text number %d " % i * (1 + i % 9), [" Big", "big ", "small", "other", None][0 if i % 3 else 1 + i % 4], 1) for i in range(600)]
    return spark.createDataFrame([*rows, (9001, None, "big", 1), (9002, "", "big", 1)], "doc_id long, text string, source string, tokens int")


def test_mixture(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixture, "TASK_DOCS", 40)
    goals = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 3), ("absent", 0.2, 4)], "source string, target_share double, max_repeats int")
    draws, shares = mixture.draw_mixture(corpus, goals, total=20_000)
    d, s = draws.collect(), {r.source: r for r in shares.collect()}
    longest = max(r.tokens for r in d)
    assert len({r.doc_id for r in d}) == len(d) and not {9001, 9002} & {r.doc_id for r in d}
    assert all(0 <= r.copies <= {"big": 2, "small": 3}[r.source] for r in d)
    assert abs(s["big"].drawn_tokens - 10_000) <= longest and s["big"].target_met
    assert not s["small"].target_met and s["small"].drawn_tokens == 3 * s["small"].source_tokens
    assert s["absent"].drawn_tokens == 0 and not s["absent"].target_met
    again = {r.doc_id: r.copies for r in mixture.draw_mixture(corpus.repartition(7), goals, total=20_000)[0].collect()}
    assert again == {r.doc_id: r.copies for r in d}


def test_mixture_of_nothing(spark, corpus):
    goals = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    draws, shares = mixture.draw_mixture(corpus.limit(0), goals)
    assert draws.count() == 0 and [r.reached_share for r in shares.collect()] == [0.0]
