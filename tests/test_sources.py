import threading

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import retrieval
from tidemark.plugins import Adapter, HealthChecks, embedders
from tidemark.sources import snapshots
from tidemark.sources.index import TextIndex
from tidemark.streaming import hooks


def test_writers_never_share_a_version(spark, tmp_path):
    table = snapshots.VersionedTable(spark, str(tmp_path / "t"))
    got = []
    threads = [threading.Thread(target=lambda n=n: got.append(table.write(spark.range(n)))) for n in (3, 4, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [1, 2, 3] == table.versions() and {table.read(v).count() for v in got} == {3, 4, 5}
    assert all(table.intact(v) for v in got)


def test_damage_is_set_aside(spark, tmp_path):
    table = snapshots.VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3))
    table.write(spark.range(4))
    for part in (tmp_path / "t" / "v=000002" / "data").glob("*.parquet"):
        part.unlink()
    assert table.last_intact() == 1 and table.repair() == 1 and any(n.startswith("corrupted_") for n in table.folder.names())
    # an unfinished version is none
    table.folder.create("v=000003/_CLAIMED", "x")
    assert table.versions() == [1] and table.write(spark.range(2)) == 4


def test_settings_and_notes(spark, tmp_path):
    settings = snapshots.Settings(spark, str(tmp_path / "s"))
    settings.put("a", "1")
    settings.put("a", "2")
    assert settings.get("a") == "2" and settings.get("b", "x") == "x"
    rows = spark.createDataFrame([("n1", "# one"), ("n2", "# two")], "name string, body string")
    assert snapshots.notes(rows, str(tmp_path / "n"), "name", "body") == 2 and snapshots.notes(rows, str(tmp_path / "n"), "name", "body") == 0
    line = snapshots.prometheus("rows", spark.createDataFrame([("a", 3)], "t string, n long"), "t", "n")
    assert line.first().line == 'rows{t="a"} 3'


def test_index_is_rebuilt_when_a_text_changes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma_delta"), (3, None)], "id long, content string")
    index = TextIndex(spark, str(tmp_path / "i"))
    assert index.ensure(docs) and not index.ensure(docs)
    asked = [(1, "beta"), (2, "gamma_delta"), (3, "")]
    want = {tuple(r) for r in retrieval.bm25(docs, asked, "id", "content").collect()}
    assert {tuple(r) for r in retrieval.bm25(docs, asked, "id", "content", stored=index.stored()).collect()} == want and len(want) == 3
    assert index.ensure(docs.withColumn("content", F.concat("content", F.lit(" more"))))
    empty = TextIndex(spark, str(tmp_path / "e"))
    assert empty.rebuild(docs.limit(0)) == 0 and retrieval.bm25(docs.limit(0), asked, "id", "content", stored=empty.stored()).count() == 0


def test_queries_beyond_the_term_limit(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common w{i}") for i in range(30)], "id long, content string")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(0, 30, 3)], "query_id int, text string")
    want = {tuple(r) for r in retrieval.bm25(docs, asked, "id", "content").collect()}
    monkeypatch.setattr(retrieval, "MOST_TERMS", 3)
    assert {tuple(r) for r in retrieval.bm25(docs, asked, "id", "content").collect()} == want and len(want) == 20


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return Context._jsc

            @staticmethod
            def getCheckpointDir():
                return type("None_", (), {"isDefined": staticmethod(lambda: False)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(type("S", (), {"sparkContext": Context}))


def test_plug_ins():
    assert embedders.create("hashing", dim=8) is embedders.create("hashing", dim=8) and embedders.create("hashing", dim=8).dim == 8
    with pytest.raises(ValueError):
        embedders.create("unknown")
    checks = HealthChecks()
    checks.register("good", lambda: True)
    checks.register("bad", lambda: 1 / 0)
    assert checks.run() == {"good": "ok", "bad": "failed: division by zero"}
    kept = []
    adapter = Adapter(kept.extend, lambda q: [t for t, _ in kept if q in t])
    adapter.save_context("hello", "world")
    adapter.remember("likes tea", "identity")
    assert adapter.recall("o", 1) == ["user: hello"] and adapter.load("tea") == "likes tea"


def test_hooks_on_a_stream(spark, tmp_path):
    runs, demoted = [], []
    folder = tmp_path / "in"
    spark.createDataFrame([(i, "write" if i < 25 else "view", 5) for i in range(30)], "event_id long, event_type string, knowledge_id long").withColumn("ts", F.timestamp_seconds("event_id")).write.json(str(folder))
    stream = lambda: spark.readStream.schema("event_id long, event_type string, knowledge_id long, ts timestamp").json(str(folder))
    for writer in (
        hooks.on_tick(stream(), str(tmp_path / "ticks"), lambda: runs.append("tick")),
        hooks.on_write(stream(), lambda: 50, lambda: runs.append("write")),
        hooks.on_write(stream(), lambda: 49, lambda: runs.append("never")),
        hooks.on_correct(stream(), lambda ids: demoted.extend(r.id for r in ids.collect()), lambda: spark.createDataFrame([(9,)], "id long")),
    ):
        writer.option("checkpointLocation", str(tmp_path / f"c{len(runs)}{len(demoted)}{id(writer)}")).trigger(availableNow=True).start().awaitTermination()
    assert runs == ["tick", "write"] and sorted(demoted) == [5, 9]
    # a batch that is delivered again is counted once
    hooks.on_tick(stream(), str(tmp_path / "ticks"), lambda: runs.append("again")).option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start().awaitTermination()
    assert "again" not in runs
