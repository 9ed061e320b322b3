from tidemark.operators.lifecycle import confidence
from tidemark.streaming import folds

EVENTS = [(i, 1 + i % 2, ["explicit_positive", "explicit_negative", "correction", "zzz"][i % 4]) for i in range(40)]


def source(spark, tmp_path, rows, schema, files=3):
    folder = str(tmp_path / "in")
    for part in range(files):
        chunk = [r for j, r in enumerate(rows) if j * files // len(rows) == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder), folder


def collect(query_df, spark, tmp_path, mode):
    q = query_df.writeStream.format("memory").queryName("sink").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("sink").collect()


def test_stream_confidence_ends_like_the_batch(spark, tmp_path, at):
    from pyspark.sql import functions as F

    rows = [(i, k, kind, at(f"2024-01-01T00:{i:02d}:00")) for i, k, kind in EVENTS]
    schema = "id long, knowledge_id long, feedback_type string, created_at timestamp"
    stream, folder = source(spark, tmp_path, rows, schema, files=1)
    out = collect(folds.running_confidence(stream), spark, tmp_path, "update")
    last = {}
    for r in sorted(out, key=lambda r: r.events):
        last[r.key] = r.confidence
    batch = spark.read.parquet(folder).withColumn("b", F.date_trunc("hour", "created_at"))
    want = {r.knowledge_id: r.confidence for r in confidence(batch, "knowledge_id", "feedback_type", ["created_at", "id"], "b").collect()}
    assert last == want


def test_admission_counts_only_admitted(spark, tmp_path, at):
    rows = [(i, 5, at(f"2024-01-01T00:00:{i:02d}")) for i in range(10)] + [(10, 5, at("2024-01-01T00:02:00"))]
    stream, _ = source(spark, tmp_path, rows, "event_id long, user_id long, ts timestamp", files=1)
    out = collect(folds.admissions(stream, "ts", "user_id", 60, 3), spark, tmp_path, "append")
    assert {r.id for r in out if r.admitted} == {0, 1, 2, 10}


def test_tumbling_stream(spark, tmp_path, at):
    rows = [(i, "a", 1.0, at(f"2024-01-01T0{i}:10:00")) for i in range(6)] + [(9, "a", 1.0, at("2024-01-09T00:00:00"))]
    stream, _ = source(spark, tmp_path, rows, "event_id long, kind string, v double, ts timestamp", files=1)
    out = collect(folds.tumbling(stream, "ts", "kind", "v", "3 hours"), spark, tmp_path, "append")
    assert sorted(r.n for r in out) == [3, 3]
