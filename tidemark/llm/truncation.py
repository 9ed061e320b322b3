"""Text cut off by field limits: broken values of a log, and how often each source breaks off.

Every value goes through the structural check and the end-of-text model of ``endings``, whose words
and n-grams are counted over all rows; values that need the model meet the counts of their
contexts in a join, so no task holds the model.  The share of values of the same source and field
that end with a terminator is counted over all rows and decides where the model has seen too little.

Defined cases: null, empty and blank values are not broken; redelivered rows give one
result; a JSON text is broken if it stops inside a structure or the content of an element
does; other invalid JSON is not; a row without a session belongs to the source "none".
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.endings import RARE, SURE, Words, verdict, verdicts
from tidemark.session import materialise

#: Sources up to which their baselines are broadcast.
MOST_SOURCES = 50_000
PROSE, JSON = ["user_query", "model_response"], ["knowledge_used"]
_CONTENT = r'"content"\s*:\s*"((?:[^"\\]|\\.)*+)"'
_MARK = r"(?:[.!?。！？]|```)[\"'”’»)）\]】」』*_`›\s]*$"


def source_of(session: Column) -> Column:
    return F.coalesce(F.substring_index(session, "-", 1), F.lit("none"))


def texts_of(batch: pa.RecordBatch, columns: list[str] = PROSE) -> list[str]:
    return [t for c in columns for t in batch[c].to_pylist() if t]


def word_list(log: DataFrame, vocabulary: int = 6_000) -> Words:
    """The words that stand in many texts, counted over all rows.  What reaches the driver are at most
    ``vocabulary`` words, each in one of 2,000 texts at least."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Words.counts(texts_of(batch))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    n_texts = sum(log.agg(*[F.count_if(F.length(c) > 0) for c in PROSE]).first())
    seen = log.select(*PROSE).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = seen.filter(F.col("n") >= Words.least(n_texts)).orderBy(F.col("n").desc(), "word").limit(vocabulary)
    return Words([r.word for r in most.collect()], n_texts)


def context_counts(log: DataFrame, words: Words) -> DataFrame:
    """(key, n, ends): how often each n-gram stands in the prose of all rows, and a sentence ends after it."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("ends", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in words.grams(texts_of(batch))], schema=schema)

    seen = log.select(*PROSE).mapInArrow(run, "key long, n long, ends long")
    return seen.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).filter(F.col("n") > RARE)


def decided(rows: DataFrame, log: DataFrame, words: Words) -> DataFrame:
    """``rows`` with ``broken``: as ``broken`` says where that is not null, else by the counts of the
    contexts in ``asked`` and the ``base`` of the value."""
    rows = materialise(rows, "ends")
    names = [c for c in rows.columns if c not in ("broken", "asked")]
    # each asked value has a row for each of its contexts until the counts have met it
    asked = rows.filter(F.col("broken").isNull()).withColumn("value", F.monotonically_increasing_id())
    asked = asked.select("value", *names, F.posexplode("asked").alias("at", "key"))
    # only contexts that are asked for meet the values
    counts = context_counts(log, words).join(asked.select("key").distinct(), "key", "left_semi")
    places = range(len(Words.ORDERS + Words.SHORTER))
    met = asked.join(counts, "key", "left").groupBy("value", *names).agg(
        *[F.sum(F.when(F.col("at") == i, F.col(c))).alias(f"{c}{i}") for i in places for c in ("n", "ends")]
    )
    longer = len(Words.ORDERS)
    chance, weight = {}, {}
    for some in (places[:longer], places[longer:]):
        heavy = [F.least(F.coalesce(f"n{i}", F.lit(0)), F.lit(words.enough)) for i in some]
        ends = [F.coalesce((F.col(f"ends{i}") + 0.5) / (F.col(f"n{i}") + 1), F.lit(0.0)) for i in some]
        weight[some], chance[some] = sum(heavy), sum(h * e for h, e in zip(heavy, ends))
    p = F.coalesce(*[F.when(weight[s] > 0, chance[s] / weight[s]) for s in weight])
    # without any evidence the baseline decides alone
    broken = F.coalesce(p < F.least(F.greatest("base", F.lit(0.5)), F.lit(SURE)), F.col("base") >= SURE)
    return rows.filter(F.col("broken").isNotNull()).select(*names, "broken").union(met.select(*names, broken.alias("broken")))


def baselines(log: DataFrame, columns: list[str]) -> DataFrame:
    """Per source: share of non-empty values of each of ``columns`` that end with a terminator; of JSON texts
    those of the contents of their elements."""
    prose, json = ([c for c in some if c in columns] for some in (PROSE, JSON))
    share = lambda c: F.avg(F.when(F.length(F.trim(c)) > 0, F.col(c).rlike(_MARK).cast("double")))
    # contents stand between their name and the next name or the end of their object
    texts = {c: F.regexp_extract_all(c, F.lit(_CONTENT), F.lit(1)) for c in json}
    sums = [F.sum(F.size(texts[c])).alias(f"n_{c}") for c in json] + [
        F.sum(F.size(F.filter(texts[c], lambda t: t.rlike(_MARK)))).alias(f"m_{c}") for c in json
    ]
    rows = log.groupBy(source_of(F.col("session_id")).alias("client")).agg(*[share(c).alias(f"base_{c}") for c in prose], *sums)
    return rows.select("client", *[f"base_{c}" for c in prose], *[F.try_divide(f"m_{c}", f"n_{c}").alias(f"base_{c}") for c in json])


def with_baselines(log: DataFrame, columns: list[str], weighed: list[str]) -> DataFrame:
    """``columns`` of ``log``, and the baselines of those in ``weighed``."""
    slim = log.select(F.col("id").cast("long").alias("id"), source_of(F.col("session_id")).alias("client"), *columns)
    base = materialise(baselines(log, weighed), "baselines")
    # one row per source: sent to all tasks if it is a small table, so that a source with a
    # third of all rows is not one task's share of a join
    if base.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        base = F.broadcast(base)
    return slim.join(base, "client").fillna(1.0, [f"base_{c}" for c in weighed])


def broken_values(log: DataFrame) -> DataFrame:
    """(interaction_id, field_name) of every value that breaks off."""
    words = word_list(log)
    schema = pa.schema([
        ("interaction_id", pa.int64()), ("field_name", pa.string()), ("base", pa.float64()), ("broken", pa.bool_()), ("asked", pa.list_(pa.int64()))
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch["id"].to_pylist(), []
            for column in PROSE + JSON:
                check = verdict if column in PROSE else verdicts
                bases = batch[f"base_{column}"].to_pylist()
                for i, text, base in zip(ids, batch[column].to_pylist(), bases):
                    if not text or not (what := check(text, words, base)):
                        continue
                    if what is True:
                        found.append((i, column, base, True, None))
                    else:
                        found += [(i, column, base, None, keys) for keys in ([what] if column in PROSE else what)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found) if found else [[]] * 5, schema)], schema=schema)

    rows = with_baselines(log, PROSE + JSON, PROSE + JSON).mapInArrow(run, "interaction_id long, field_name string, base double, broken boolean, asked array<long>")
    return decided(rows, log, words).filter("broken").select("interaction_id", "field_name").distinct()


def broken_rates(log: DataFrame) -> DataFrame:
    """(client, field_name, n_values, n_broken, rate) over distinct interactions."""
    fields = PROSE + JSON
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), (F.length(f) > 0).alias("there")) for f in fields]))
    values = log.select("id", source_of(F.col("session_id")).alias("client"), pairs.alias("p")).filter("p.there").select(
        "id", "client", "p.field_name"
    ).distinct()
    broken = broken_values(log).select(F.col("interaction_id").alias("id"), "field_name", F.lit(1).alias("hit"))
    return values.join(broken, ["id", "field_name"], "left").groupBy("client", "field_name").agg(
        F.count(F.lit(1)).alias("n_values"), F.count("hit").alias("n_broken"),
        F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("rate"),
    )
