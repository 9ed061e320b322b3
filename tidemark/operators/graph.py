"""Entity graph: accumulated edges, bounded traversal.

Edges are stored directed and read both ways, by mirroring instead of an OR in the join
condition, so each hop is one equi-join.  A hop first reduces the frontier and the edges to
distinct pairs, so a hub's sightings are one row per neighbour before the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.operators.hot_keys import normal_name
from tidemark.session import materialise

#: Characters of a term that are looked up at each place, and of all terms of one pass.
PREFIX, BLOCK_CHARS = 3, 2_000_000


def accumulate(sightings: DataFrame) -> DataFrame:
    """(entity_a, entity_b, relation_type, hit_count, weight): the state that upserting every
    sighting in turn would leave, in closed form: 1 and half a point per repetition, 5 at most."""
    pairs = sightings.select(
        normal_name(F.col("entity_a")).alias("entity_a"), normal_name(F.col("entity_b")).alias("entity_b"), "relation_type"
    ).filter(F.col("entity_a").isNotNull() & F.col("entity_b").isNotNull())
    return pairs.groupBy("entity_a", "entity_b", "relation_type").agg(F.count(F.lit(1)).alias("hit_count")).withColumn(
        "weight", F.least(F.lit(5.0), 1 + 0.5 * (F.col("hit_count") - 1))
    )


def mirrored(edges: DataFrame, least: float) -> DataFrame:
    """(node, next, relation_type, weight) both ways, heaviest of each, weight >= least."""
    heavy = edges.filter(F.col("weight") >= least)
    both = heavy.select(F.col("entity_a").alias("node"), F.col("entity_b").alias("next"), "relation_type", "weight").unionByName(
        heavy.select(F.col("entity_b").alias("node"), F.col("entity_a").alias("next"), "relation_type", "weight")
    )
    return both.groupBy("node", "next", "relation_type").agg(F.max("weight").alias("weight"))


def traverse(edges: DataFrame, start: DataFrame, depth: int = 2, least: float = 0.5) -> DataFrame:
    """(node, relation_type, depth, weight) reached from ``start`` (node) within ``depth``
    hops, start nodes left out: least depth and greatest weight per node and relation."""
    both = mirrored(edges, least)
    if depth > 1:
        both = materialise(both, "edges")
    frontier = start.select(normal_name(F.col("node")).alias("node")).distinct()
    reached = None
    for hop in range(1, depth + 1):
        step = frontier.join(both, "node").select(F.col("next").alias("node"), "relation_type", "weight").groupBy(
            "node", "relation_type"
        ).agg(F.max("weight").alias("weight")).withColumn("depth", F.lit(hop))
        reached = step if reached is None else reached.unionByName(step)
        frontier = step.select("node").distinct()
    origin = start.select(normal_name(F.col("node")).alias("node")).distinct()
    return reached.join(origin, "node", "left_anti").groupBy("node", "relation_type").agg(
        F.min("depth").alias("depth"), F.max("weight").alias("weight")
    )


def nearest_nodes(reached: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` rows of a traversal, near and heavy ones first."""
    return reached.orderBy("depth", F.col("weight").desc(), "node", "relation_type").limit(most)


def _scan(terms: list[tuple[str, str]]):
    """Arrow function: (id, body) -> (term, id) of every (term, lower-cased term) that is a substring of the body.
    A table from the first ``PREFIX`` characters (all of a shorter term) to the terms by length
    makes each place of a body a few lookups, however many terms share a prefix."""
    table: dict[str, dict[int, dict[str, list[str]]]] = {}
    for term, low in terms:
        table.setdefault(low[:PREFIX], {}).setdefault(len(low), {}).setdefault(low, []).append(term)
    sizes = sorted({len(p) for p in table})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, body in enumerate(batch["body"].to_pylist()):
                held: dict[str, None] = {}
                for size in sizes:
                    for at in range(len(body) - size + 1):
                        by_length = table.get(body[at:at + size])
                        if by_length:
                            for length, names in by_length.items():
                                for name in names.get(body[at:at + length], ()):
                                    held[name] = None
                rows += [row] * len(held)
                found += held
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch["id"].take(pa.array(rows, pa.int64()))], ["term", "id"])

    return scan


def mentions(docs: DataFrame, terms: DataFrame, key: Column, text: Column, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(term, id): documents that hold a term, as LOWER(text) LIKE '%term%' with the term's
    wildcards taken literally; null and empty terms are in none.  Terms go to the tasks in
    blocks of about ``block_chars`` characters, one pass over the documents for each."""
    bodies = docs.select(key.alias("id"), F.lower(text).alias("body")).filter(F.col("body").isNotNull())
    schema = StructType([StructField("term", StringType()), StructField("id", bodies.schema["id"].dataType)])
    named = terms.select("term", F.lower("term").alias("low")).filter(F.length("low") > 0).distinct()
    out, block, chars = None, [], 0

    def scanned() -> DataFrame:
        part = bodies.mapInArrow(_scan(block), schema)
        return part if out is None else out.unionByName(part)

    for r in named.toLocalIterator():
        if block and chars + len(r.low) > block_chars:
            out, block, chars = scanned(), [], 0
        block.append((r.term, r.low))
        chars += len(r.low)
    if block or out is None:
        out = scanned()
    return out.distinct()
