"""Streams: the same results as the batch operators, kept up to date as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.lifecycle import CONFIDENCE_STEPS, START_CONFIDENCE


def tumbling(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, n, total) per window; on a stream, events later than ``late`` are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")
    ).select(F.col("w.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, time: str, key: str, width: str, step: str, late: str = "1 day") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), key, "n"
    )


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, start, stop, n): runs of events with less than ``gap`` between them."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n"
    )


def rate_windows(events: DataFrame, time: str, key: str, order: str, seconds: int = 60, limit: int = 60) -> DataFrame:
    """Batch: per event the number of the key's events in the ``seconds`` before it, and
    whether it is beyond the limit."""
    us, wide = F.unix_micros(F.col(time).cast("timestamp")), seconds * 1_000_000
    # a piece of time as wide as the window sees its own events and those of the piece before it,
    # so a key with a third of all events is spread over its pieces
    piece = F.floor(us / wide)
    both = events.withColumn("_us", us).withColumn("_piece", F.explode(F.array(piece, piece + 1)))
    before = Window.partitionBy(key, "_piece").orderBy("_us").rangeBetween(-wide, -1)
    counted = both.withColumn("recent", F.count(F.lit(1)).over(before)).filter(F.col("_piece") == F.floor(F.col("_us") / wide))
    return counted.withColumn("over", F.col("recent") >= limit).select(order, key, "recent", "over")


def running_confidence(events: DataFrame, key: str = "knowledge_id", kind: str = "feedback_type", time: str = "created_at") -> DataFrame:
    """Stream: (key, events, confidence) after every micro-batch, for keys that had events.
    The state of a key is two numbers; events of one batch are folded in time order."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, level = state.get if state.exists else (0, START_CONFIDENCE)
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        for step in rows["kind"].map(CONFIDENCE_STEPS).dropna():
            level = min(1.0, max(0.0, level + step))
            n += 1
        state.update((n, level))
        yield pd.DataFrame({"key": [k[0]], "events": [n], "confidence": [round(level, 6)]})

    slim = events.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), "id", F.col(kind).alias("kind"), F.col(time).alias("t")
    )
    return slim.groupBy("key").applyInPandasWithState(
        fold, "key long, events long, confidence double", "events long, confidence double", "update", GroupStateTimeout.NoTimeout
    )


def admissions(events: DataFrame, time: str, key: str, seconds: int = 60, limit: int = 60) -> DataFrame:
    """Stream: (key, id, admitted): sliding-window admission, where only admitted events count.
    The state of a key is the times of its last ``limit`` admitted events at most."""

    def admit(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["us", "id"])
        out = []
        for event, us in zip(rows["id"], rows["us"]):
            held = [x for x in held if x > us - seconds * 1_000_000]
            ok = len(held) < limit
            if ok:
                held.append(int(us))
            out.append((k[0], event, ok))
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "id", "admitted"])

    slim = events.select(F.col(key).alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    return slim.groupBy("key").applyInPandasWithState(
        admit, "key long, id long, admitted boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout
    )
