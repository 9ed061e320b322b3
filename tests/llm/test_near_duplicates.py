import random
import re

from tidemark.llm import near_duplicates as nd


def plain_tokens(text):
    out = set()
    for run in re.findall(r"[一-鿿]+|(?:(?![一-鿿])[^\W_])+", (text or "").lower()):
        if "一" <= run[0] <= "鿿" and len(run) > 1:
            out.update(run[i:i + 2] for i in range(len(run) - 1))
        else:
            out.add(run)
    return out


def brute(rows):
    sets = {i: plain_tokens(t) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}


def pairs(spark, rows):
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "id long, content string, n string, cid int")
    return {tuple(r) for r in nd.similar_pairs(df).collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["压缩", "索引告警", "ab_cd"]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 30]))]
        rows.append((3 * i, " ".join(base)))
        edited = base[:]
        edited[rng.randrange(len(edited))] = rng.choice(words)
        rows.append((3 * i + 1, " ".join(rng.sample(edited, len(edited))) + rng.choice(["", " extra", " W1"])))
    rows += [(1000, None), (1001, ""), (1002, "__ -- !"), (1003, "same Text"), (1004, "same text"), (1005, "SAME-text")]
    assert pairs(spark, rows) == brute(rows)


def test_long_records_use_single_tokens(spark, monkeypatch):
    monkeypatch.setattr(nd, "LONG", 20)
    rng = random.Random(8)
    rows = []
    for i in range(25):
        base = [f"x{rng.randrange(80)}" for _ in range(rng.randint(12, 45))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[1:] + [f"y{rng.randrange(5)}"]))]
    rows.append((99, " ".join(f"z{i}" for i in range(3000))))
    rows.append((100, " ".join(f"z{i}" for i in range(2900))))
    assert pairs(spark, rows) == brute(rows)


def test_groups_and_links(spark):
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(1, text), (2, text), (3, text + " u"), (4, text + " u v"), (5, "other"), (6, None)]
    df = spark.createDataFrame(rows, "id long, content string")
    got = {r.id: (r.group_id, r.copies, r.links) for r in nd.duplicate_groups(df).collect()}
    assert got == {1: (1, 2, 3), 2: (1, 2, 3), 3: (1, 1, 3), 4: (1, 1, 3), 5: (5, 1, 0)}


def test_query_has_a_row_for_every_record(spark, tmp_path):
    from tidemark.llm import queries

    rows = [(1, "one two"), (2, "two one"), (3, None), (4, ""), (5, " -- !_"), (5, " -- !_"), (6, "压"), (7, "\u00b2"), (8, None), (8, "three")]
    spark.createDataFrame(rows, "id long, content string").write.parquet(str(tmp_path / "unified_knowledge.parquet"))
    got = [tuple(r) for r in queries.p1_groups(spark, str(tmp_path)).select("id", "group_id", "copies", "links").collect()]
    assert sorted(got) == [(1, 1, 2, 1), (2, 1, 2, 1), *((i, i, 1, 0) for i in range(3, 9))]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.cid: r.root for r in nd.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_empty(spark):
    assert pairs(spark, []) == set()


def brute_at(rows, ten):
    sets = {i: plain_tokens(t) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if 10 * len(sets[a] & sets[b]) >= ten * len(sets[a] | sets[b])}


def test_low_thresholds_and_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(nd, "RARE", 5)
    monkeypatch.setattr(nd, "LISTED", 1)
    rows = [(i, f"common u{i}") for i in range(40)] + [(40, "common")]
    rng = random.Random(3)
    rows += [(100 + i, " ".join(rng.sample([f"v{j}" for j in range(9)], rng.randint(1, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, content string")
    for ten in (2, 3, 5, 7):
        assert {tuple(r) for r in nd.similar_pairs(df, threshold=ten / 10).collect()} == brute_at(rows, ten)


def test_listed_tokens_stay_bounded(spark):
    rows = [(i, f"a b{i % 3} c{i % 7} d{i}") for i in range(60)]
    _, sets = nd.classes(spark.createDataFrame(rows, "id long, content string"), "id", "content")
    tok, count, limit = nd.frequencies(sets, listed=2, most=4)
    assert limit == 16 and len(tok) == 4 and sorted(count.tolist()) == [20, 20, 20, 60] and (tok[1:] > tok[:-1]).all()
