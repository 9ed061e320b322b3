"""What follows events, as functions of micro-batches: maintenance after enough writes, demotion
after corrections, extraction from turns.  Counters live in the shared folder, so a restarted
stream goes on with them; a batch that is delivered again is known by its number and counted once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions import patterns
from tidemark.sources.snapshots import Folder

# Rows of the instant layer, events, and writes among the last events that start maintenance.
INSTANT_ROWS, TICK_EVENTS, TICK_WRITES, LAST_EVENTS = 50, 5, 20, 100
WRITES = ("write", "purchase", "signup")


def on_write(events: DataFrame, waiting: Callable[[], int], run: Callable[[], None], least: int = INSTANT_ROWS) -> DataStreamWriter:
    """Run maintenance after a batch with writes if at least ``least`` rows wait for it."""
    def each(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count() and waiting() >= least:
            run()

    return events.writeStream.foreachBatch(each)


def on_correct(events: DataFrame, demote: Callable[[DataFrame], None], risky: Callable[[], DataFrame]) -> DataStreamWriter:
    """Demote the corrected rows (knowledge_id) of a batch and all rows at risk."""
    def each(batch: DataFrame, number: int) -> None:
        ids = batch.filter(F.col("knowledge_id").isNotNull()).select(F.col("knowledge_id").alias("id"))
        if ids.limit(1).count():
            demote(ids.unionByName(risky().select("id")).distinct())

    return events.writeStream.foreachBatch(each)


def on_tick(
    events: DataFrame, folder: str, run: Callable[[], None], order: tuple[str, str] = ("ts", "event_id"), kind: str = "event_type",
    writes: tuple[str, ...] = WRITES,
) -> DataStreamWriter:
    """Run maintenance when, after at least ``TICK_EVENTS`` events, more than ``TICK_WRITES`` of the
    last ``LAST_EVENTS`` are writes; then count anew."""
    def each(batch: DataFrame, number: int) -> None:
        files = Folder(batch.sparkSession, folder)
        earlier = [n for n in files.names() if n.startswith("tick=")]
        if any(int(n[5:]) >= number for n in earlier):
            return
        held = json.loads(files.read(max(earlier))) if earlier else []
        rows = batch.orderBy(*[F.col(c).desc() for c in order]).limit(LAST_EVENTS).select(F.col(kind).isin(*writes).alias("w")).collect()
        held = (held + [bool(r.w) for r in reversed(rows)])[-LAST_EVENTS:]
        due = len(held) >= TICK_EVENTS and sum(held) > TICK_WRITES
        if due:
            run()
        files.create(f"tick={number:012d}", json.dumps([] if due else held))

    return events.writeStream.foreachBatch(each)


def statements_of_turns(turns: DataFrame, key: str = "id", text: str = "user_query") -> DataFrame:
    """(key, content, domain): statements worth keeping of every turn, on a stream or a table; an
    own extractor is mapped over the turns in its place."""
    return turns.filter(F.col(text).isNotNull()).select(key, F.explode(patterns.statements(F.col(text))).alias("s")).select(key, "s.content", "s.domain")
