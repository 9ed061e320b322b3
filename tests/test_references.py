import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import references


def tables(spark, at, used):
    k = spark.createDataFrame(
        [(1, at("2024-01-10"), at("2024-01-20"), None), (2, at("2024-03-10"), None, 99), (70, at("2024-03-05"), at("2024-03-06"), 1)],
        "id long, created_at timestamp, updated_at timestamp, replaced_by long",
    )
    v = spark.createDataFrame([(1, 50, "deleted", at("2024-01-01")), (2, None, "deleted", None)], "id long, knowledge_id long, status string, created_at timestamp")
    f = spark.createDataFrame(
        [(1, 50, at("2024-01-02")), (1, 50, at("2024-01-02")), (2, 2, at("2024-03-09")), (3, 2, at("2024-03-11")), (4, -1, at("2024-02-01")), (5, None, at("2024-02-01")), (6, 1, None)],
        "id long, knowledge_id long, created_at timestamp",
    )
    i = spark.createDataFrame([(n, t, at("2024-02-02")) for n, t in enumerate(used)], "id long, knowledge_used string, created_at timestamp")
    return k, v, f, i


def run(spark, at, used=()):
    k, v, f, i = tables(spark, at, used or [None])
    refs = references.all_references(k, v, f, i)
    return {tuple(r) for r in references.orphan_references(refs, k, v.filter(F.col("status") == "deleted")).collect()}


def test_states(spark, at):
    got = run(spark, at)
    assert ("feedback_log", "2024-01", 1, 50, "deleted") in got
    assert ("feedback_log", "2024-03", 2, 2, "late") in got
    assert ("feedback_log", "2024-02", 4, -1, "missing") in got
    assert ("unified_knowledge", None, 2, 99, "missing") in got
    assert not any(r[2] in (3, 5, 6) and r[0] == "feedback_log" for r in got)


def test_only_whole_valid_json_arrays_count(spark, at):
    used = [
        '[{"id": 7}]', '[{"id": "8"}] tail', '[{"id": 9}', "[{'id': 10}]", '{"id": 11}', '[{"id": "12"}, {"id": 1.5}, 3, null, {"x": 1}]',
        "", None, '[{"id": 13}],[{"id": 14}]', '[{"id": 15}]} {"a":1', ' [{"id": 16}] ',
    ]
    got = {r[3] for r in run(spark, at, used) if r[0] == "interaction_log"}
    assert got == {7, 12, 16}


def test_bits_round_trip(spark):
    codes = spark.createDataFrame([(x,) for x in (0, 1, 63, 64, 32_767, 32_768, 4_000_000_000)], "code long")
    maps = references.bitmaps(codes, []).collect()
    back = [c for r in maps for c in references.set_bits(np.frombuffer(r.bits, np.uint8), r["range"] * references.RANGE).tolist()]
    assert sorted(back) == [0, 1, 63, 64, 32_767, 32_768, 4_000_000_000] and len(maps) == 3


def test_ids_of_nineteen_digits(spark, at):
    used = ['[{"id": 1234567890123456789}, {"id": "-9223372036854775808"}, {"id": 9223372036854775808}]']
    got = {r[3] for r in run(spark, at, used) if r[0] == "interaction_log"}
    assert got == {1234567890123456789, -9223372036854775808}


def test_dictionary_codes_are_dense(spark):
    many = references.dictionary_encode(spark.range(50).withColumnRenamed("id", "k"), "k", blocks=7).collect()
    assert sorted(r.code for r in many) == list(range(50))
    codes = references.dictionary_encode(spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("c",)], "k string"), "k").collect()
    assert sorted(r.code for r in codes) == [0, 1, 2]


def test_report_counts(spark, at):
    k, v, f, i = tables(spark, at, [None])
    refs = references.all_references(k, v, f, i)
    report = references.orphan_report(refs, references.orphan_references(refs, k, v.filter(F.col("status") == "deleted")))
    rows = {(r.table_name, r.ref_month): r for r in report.collect()}
    assert rows["feedback_log", "2024-03"].n_references == 2 and rows["feedback_log", "2024-03"].n_late == 1
