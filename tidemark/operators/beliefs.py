"""Beliefs: a confidence and a type per memory, folded from events, decayed when idle.

Defined cases: events of an unknown kind or without a memory do nothing; the first event of a
memory without a belief starts one; ties in time are ordered by id; a memory without beliefs is
never idle; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidemark.operators.lifecycle import CONFIDENCE_STEPS, START_CONFIDENCE

# Confidences at which a type is won or lost, at which a row is archived, and what
# and when idle rows lose; layers that show a type.
BELIEF_FROM, FACT_FROM, OBSERVATION_BELOW, ARCHIVED_BELOW = 0.70, 0.90, 0.50, 0.30
DECAY, IDLE_HOURS = 0.05, 48
LAYER_OF = {"observation": "instant", "belief": "candidate", "fact": "consolidated"}


def next_type(kind: Column, level: Column) -> Column:
    """Type after a change of confidence: at most one step."""
    return (
        F.when((kind == "observation") & (level >= BELIEF_FROM), "belief").when((kind == "belief") & (level >= FACT_FROM), "fact")
        .when((kind == "belief") & (level < OBSERVATION_BELOW), "observation").when((kind == "fact") & (level < BELIEF_FROM), "belief")
        .otherwise(kind)
    )


def layer_of(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in LAYER_OF.items() for x in p]), kind)


#: Types in the order of the digits of a packed state.
_TYPES = ["observation", "belief", "fact"]
#: Confidences of a fold in units of the least common step.
_UNIT = 0.05


def _moves() -> dict[int, np.ndarray]:
    """Per step, in units, the state (level * 3 + type) that follows each state."""
    at = lambda v: round(v / _UNIT)
    top, out = at(1.0), {}
    for step in {at(v) for v in CONFIDENCE_STEPS.values()}:
        to = []
        for state in range(3 * (top + 1)):
            level, kind = min(top, max(0, state // 3 + step)), state % 3
            if kind == 0 and level >= at(BELIEF_FROM) or kind == 2 and level < at(BELIEF_FROM):
                kind = 1
            elif kind == 1:
                kind = 2 if level >= at(FACT_FROM) else 0 if level < at(OBSERVATION_BELOW) else 1
            to.append(level * 3 + kind)
        out[step] = np.array(to, np.int8)
    return out


def _compose(moves: dict[int, np.ndarray]):
    """Arrow function over rows (key, block, d) sorted by key, block and time: one row per key and
    block with the state that follows each state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now, many = None, None, 0
        for batch in batches:
            kind, out = batch.schema.field("key").type, []
            for tag in zip(batch["key"].to_pylist(), batch["block"].to_pylist(), batch["d"].to_pylist()):
                if open_ != tag[:2]:
                    if open_ is not None:
                        out.append((*open_, many, now.tolist()))
                    open_, now, many = tag[:2], np.arange(len(next(iter(moves.values())))), 0
                now, many = moves[tag[2]][now], many + 1
            yield table(out, kind)
        if open_ is not None:
            yield table([(*open_, many, now.tolist())], kind)

    def table(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        key, block, n, to = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(key, kind), pa.array(block, pa.int64()), pa.array(n, pa.int64()), pa.array(to, pa.list_(pa.int32()))], ["key", "block", "n", "to"])

    return run


def fold(events: DataFrame, key: str, kind: str, order: list[str], seconds: int = 7 * 86_400) -> DataFrame:
    """(key, events, confidence, belief_type): the state after all events in ``order``, whose first
    column is their time.

    All steps are multiples of one unit, so confidence has 21 levels and a state is one of 63
    (level, type).  The events of a key and a piece of time make a map from states to states, and
    the maps of a key are applied one after the other: a key with a third of all events is spread
    over its pieces, and no list of events is built."""
    steps = F.create_map(*[F.lit(x) for k, v in CONFIDENCE_STEPS.items() for x in (k, round(v / _UNIT))])
    typed = events.select(
        F.col(key).alias("key"), F.coalesce(F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (seconds * 1_000_000)), F.lit(-(1 << 40))).alias("block"),
        *order, F.try_element_at(steps, F.col(kind)).alias("d"),
    ).filter(F.col("d").isNotNull() & F.col("key").isNotNull())
    rows = typed.repartition("key", "block").sortWithinPartitions("key", "block", *order).select("key", "block", "d")
    fields = [StructField("key", typed.schema["key"].dataType), StructField("block", LongType()), StructField("n", LongType()), StructField("to", ArrayType(IntegerType()))]
    maps = rows.mapInArrow(_compose(_moves()), StructType(fields))
    whole = maps.groupBy("key").agg(F.sum("n").alias("events"), F.sort_array(F.collect_list(F.struct("block", "to"))).alias("maps"))
    last = F.aggregate("maps", F.lit(round(START_CONFIDENCE / _UNIT) * 3), lambda s, m: F.get(m["to"], s))
    types = F.array(*map(F.lit, _TYPES))
    return whole.select("key", "events", last.alias("s")).select(
        F.col("key").alias(key), "events", F.round(F.floor(F.col("s") / 3) * _UNIT, 6).alias("confidence"), F.get(types, F.pmod("s", F.lit(3))).alias("belief_type")
    )


def stats(beliefs: DataFrame) -> DataFrame:
    """One row: (observations, beliefs, facts, total, average_confidence)."""
    kind = F.col("belief_type")
    return beliefs.agg(
        F.count_if(kind == "observation").alias("observations"), F.count_if(kind == "belief").alias("beliefs"), F.count_if(kind == "fact").alias("facts"),
        F.count_if(kind.isin(*_TYPES)).alias("total"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("average_confidence"),
    )


def idle(beliefs: DataFrame, knowledge: DataFrame, at: Column, seen: str = "updated_at", hours: int = IDLE_HOURS) -> DataFrame:
    """(knowledge_id): beliefs, facts left out, whose memory was not seen for some hours."""
    cut = at - F.make_dt_interval(hours=F.lit(hours))
    rows = knowledge.filter(F.col(seen) < cut).select(F.col("id").alias("knowledge_id"))
    return beliefs.filter(F.col("belief_type").isin("belief", "observation")).join(rows, "knowledge_id").select("knowledge_id")


def decayed(beliefs: DataFrame, knowledge: DataFrame, at: Column, seen: str = "updated_at") -> DataFrame:
    """(knowledge_id, confidence, belief_type, decayed): every belief after one step of decay, which
    may change its type in both ways."""
    gone = idle(beliefs, knowledge, at, seen).distinct().withColumn("decayed", F.lit(True))
    joined = beliefs.select("knowledge_id", "confidence", "belief_type").join(gone, "knowledge_id", "left")
    hit = F.coalesce("decayed", F.lit(False))
    level = F.when(hit, F.round(F.greatest(F.lit(0.0), F.col("confidence") - DECAY), 6)).otherwise(F.col("confidence"))
    return joined.select("knowledge_id", level.alias("confidence"), "belief_type", hit.alias("decayed")).withColumn(
        "belief_type", F.when(F.col("decayed"), next_type(F.col("belief_type"), F.col("confidence"))).otherwise(F.col("belief_type"))
    )


def archived_by_belief(beliefs: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(id): active memories of an observation with too little confidence."""
    weak = beliefs.filter((F.col("belief_type") == "observation") & (F.col("confidence") < ARCHIVED_BELOW))
    return knowledge.filter(F.col("status") == "active").select("id").join(weak.select(F.col("knowledge_id").alias("id")), "id").distinct()


def promoted(beliefs: DataFrame, ids: DataFrame, level: float = FACT_FROM) -> DataFrame:
    """``beliefs`` with the given ones (knowledge_id) set to ``level``, a fact from ``FACT_FROM`` on."""
    chosen = ids.select("knowledge_id", F.lit(True).alias("_p")).distinct()
    kind = "fact" if level >= FACT_FROM else "belief"
    hit = F.coalesce("_p", F.lit(False))
    return beliefs.join(chosen, "knowledge_id", "left").withColumns({
        "confidence": F.when(hit, level).otherwise(F.col("confidence")), "belief_type": F.when(hit, kind).otherwise(F.col("belief_type")),
    }).select(*beliefs.columns)
