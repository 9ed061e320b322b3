"""Evaluation texts leaking into training text: Wu-Manber search over words.

A pattern is every run of ``WORDS`` consecutive words of a test item.  Documents are
scanned from the pattern length on in blocks of two words: the shift table says how far
the window may move when its last block can not end a pattern (by default almost a whole
pattern, so a clean document is looked at once in eleven words); a block that can selects
the bucket of patterns with that suffix, and after a prefix check the words are compared.

The patterns are sent to all tasks behind a check of their size; more items than
``ITEM_CHARS`` characters are searched in blocks of items, one pass each.

Defined cases: null or short texts and items leak nothing; items with equal passages are
all reported; a document is reported once per item; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12
#: Characters of items in one broadcast block.
ITEM_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-cased maximal runs of letters and digits."""
    return " ".join(_WORD.findall(text)).lower().split(" ") if text else []


class Patterns:
    """Shift table, suffix buckets and pattern words for one block of items."""

    def __init__(self, items: list[tuple[int, str]], size: int = WORDS):
        self.size, self.far = size, size - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], list[int]]] = {}
        for item, text in items:
            w = words(text or "")
            for at in range(len(w) - size + 1):
                pattern = tuple(w[at:at + size])
                for j in range(1, size):
                    block = (pattern[j - 1], pattern[j])
                    move = size - 1 - j
                    if move < self.shift.get(block, self.far):
                        self.shift[block] = move
                owners = self.bucket.setdefault(pattern[-2:], {}).setdefault(pattern, [])
                if item not in owners:
                    owners.append(item)
        self.first = {p[:2] for same in self.bucket.values() for p in same}

    def search(self, text: str | None) -> set[int]:
        """Items of which ``text`` holds a pattern."""
        w = words(text or "")
        found: set[int] = set()
        shift, far, size = self.shift.get, self.far, self.size
        at, n = size - 1, len(w)
        while at < n:
            block = (w[at - 1], w[at])
            move = shift(block, far)
            if move:
                at += move
                continue
            start = at - size + 1
            if (w[start], w[start + 1]) in self.first:
                owners = self.bucket[block].get(tuple(w[start:at + 1]))
                if owners:
                    found.update(owners)
            at += 1
        return found


def leaked_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS,
    block_chars: int = ITEM_CHARS,
) -> DataFrame:
    """(doc_id, item_id): documents that hold ``size`` consecutive words of an item."""
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).filter(
        F.col("item_text").isNotNull()
    )
    chars = tests.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())

    def scan(patterns: Patterns) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs_, found = [], []
                for doc, body in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    for item in patterns.search(body):
                        docs_.append(doc)
                        found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(found, pa.int64())], schema=schema)

        return slim.mapInArrow(run, "doc_id long, item_id long")

    out = None
    for b in range(blocks):
        some = tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else tests
        part = scan(Patterns([(r.item_id, r.item_text) for r in some.collect()], size))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, n_documents): every item with the number of documents leaking it."""
    n = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return items.select("item_id", "suite").distinct().join(n, "item_id", "left").select(
        "item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents")
    )
