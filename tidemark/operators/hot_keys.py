"""Per-key results when a few keys hold most rows (value-frequency compression).

Rows are grouped by (key, value) first, so what a hot key contributes is spread over its
values and over all tasks; the second grouping by key alone then meets at most one row per
distinct (key, value).  Distinct counts and modes are exact on those weighted values, and
weighted percentiles come from a range-partitioned prefix sum in which no task ever holds
all values of a key.

Defined cases: null or blank names give no key; rows with equal content all count (a
redelivered row is a row); null measures count as absent (0 in sums, ignored in minima,
maxima and percentiles); an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Outer white space, of any script.
OUTER_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def normal_name(name: Column) -> Column:
    """Trimmed, lower-cased name; null where nothing is left."""
    bare = F.lower(F.regexp_replace(name, OUTER_BLANKS, ""))
    return F.when(bare != "", bare)


def both_sides(edges: DataFrame) -> DataFrame:
    """One row per edge and named end: side, key, value (the other end), measures."""
    a, b = normal_name(F.col("entity_a")), normal_name(F.col("entity_b"))
    slim = edges.select(
        a.alias("a"), b.alias("b"), F.col("weight").cast("double").alias("weight"),
        F.col("hit_count").cast("long").alias("hits"), F.col("first_seen"), F.col("last_seen"),
    )
    ends = F.array(
        F.struct(F.lit("entity_a").alias("side"), F.col("a").alias("entity_key"), F.col("b").alias("other")),
        F.struct(F.lit("entity_b").alias("side"), F.col("b").alias("entity_key"), F.col("a").alias("other")),
    )
    return slim.withColumn("end", F.explode(ends)).select("end.*", "weight", "hits", "first_seen", "last_seen").filter(
        F.col("entity_key").isNotNull()
    )


def compress(rows: DataFrame, keys: list[str], values: list[str], *aggregates: Column) -> DataFrame:
    """First stage: one row per (key, value) with its frequency ``n`` and partial aggregates."""
    return rows.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("n"), *aggregates)


def heavy_keys(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(side, entity_key) of names standing in at least ``share`` of all rows of ``edges``."""
    by_value = compress(both_sides(edges), ["side", "entity_key"], ["other"])
    by_key = by_value.groupBy("side", "entity_key").agg(F.sum("n").alias("edges"))
    total = edges.agg(F.count(F.lit(1)).alias("all_rows"))
    return by_key.join(F.broadcast(total)).filter(F.col("edges") >= F.col("all_rows") * F.lit(share)).select(
        "side", "entity_key"
    )


def ranked_values(values: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """(keys, v, c, upto, all_c): values per key with their cumulated count, and the key's count.

    The values are range-partitioned by (key, value) and written with their partition
    number.  Only (key, partition) sums cross a window per key, at most one row per
    partition; inside a partition the cumulation covers one range."""
    ranged = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), F.col(count).alias("c"))
    ranged = ranged.repartitionByRange(*[F.col(k) for k in keys], F.col("v")).withColumn(
        "block", F.spark_partition_id()
    )
    ranged = materialise(ranged, "percentile")
    per_block = ranged.groupBy(*keys, "block").agg(F.sum("c").alias("bc"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("block").alias("_block"), F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("ahead"),
        F.sum("bc").over(by_key).alias("all_c"),
    )
    within = Window.partitionBy(*keys, "block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("block") == F.col("_block")]
    return ranged.join(offsets, same).withColumn("upto", F.col("ahead") + F.sum("c").over(within)).select(*keys, "v", "c", "upto", "all_c")


def running_sum(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``cost`` over the rows of their keys up to them in ``order``.

    Rows are range-partitioned by keys and order, so that those of one key are spread over
    several tasks; each sums its own range and adds what the ranges before it hold."""
    ranged = rows.withColumn("_cost", cost).repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_block", F.spark_partition_id())
    ranged = materialise(ranged, "running")
    per_block = ranged.groupBy(*keys, "_block").agg(F.sum("_cost").alias("_bc"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_block") == F.col("_b")]
    return ranged.withColumn("_in", F.sum("_cost").over(within)).join(offsets, same).withColumn(name, F.col("_ahead") + F.col("_in")).select(*rows.columns, name)


def weighted_percentile(values: DataFrame, keys: list[str], value: str, count: str, q: float, name: str) -> DataFrame:
    """Exact lower percentile per key of weighted values: the first value whose cumulated
    count reaches ``q`` of the key's count."""
    running = ranked_values(values, keys, value, count)
    return running.filter(F.col("upto") >= F.col("all_c") * q).groupBy(*keys).agg(F.min("v").alias(name))


def name_profiles(edges: DataFrame) -> DataFrame:
    """Per side and name: edges, summed weight and hits, first and last sighting, exact
    number of distinct other names, the most frequent other name (ties to the smaller) and
    the lower median weight."""
    keys = ["side", "entity_key"]
    fine = materialise(
        compress(
            both_sides(edges), keys, ["other", "weight"], F.sum("hits").alias("h"),
            F.min("first_seen").alias("f"), F.max("last_seen").alias("l"),
        ),
        "name-values",
    )
    by_other = fine.groupBy(*keys, "other").agg(
        F.sum("n").alias("n"), F.sum(F.col("weight") * F.col("n")).alias("w"), F.sum("h").alias("h"),
        F.min("f").alias("f"), F.max("l").alias("l"),
    )
    # the mode is the least (-n, other): one struct minimum, no sort and no list
    mode = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("other").alias("o"))))
    sums = by_other.groupBy(*keys).agg(
        F.sum("n").alias("edges"), F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 6).alias("weight_sum"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("hits"), F.min("f").alias("first_seen"), F.max("l").alias("last_seen"),
        F.count("other").alias("partners"), mode.alias("mode"),
    )
    by_weight = compress(fine, keys, ["weight"], F.sum("n").alias("c")).drop("n")
    median = weighted_percentile(by_weight, keys, "weight", "c", 0.5, "median_weight")
    return sums.join(median, keys, "left").select(
        *keys, "edges", "weight_sum", "hits", "first_seen", "last_seen", "partners",
        F.col("mode.o").alias("top_partner"), "median_weight",
    )
