"""A stored full-text index: postings and statistics as one versioned table, with a marker of
the way texts are split, an integrity check and a rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.retrieval import postings
from tidemark.sources.snapshots import VersionedTable

#: How texts are split; an index of another number is rebuilt.
SPLITTER = "3"


class TextIndex:
    """Postings (id, term, tf, len) below ``path``, written sorted by term so that a search reads
    the row groups of its terms only."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", text: str = "content"):
        self.spark, self.key, self.text = spark, key, text
        self.table = VersionedTable(spark, path)

    def fingerprint(self, docs: DataFrame) -> dict:
        """Number of documents and a sum over their keys and texts: any change of a text changes it."""
        row = docs.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(self.key, self.text).cast("decimal(38,0)")).alias("h")
        ).first()
        return {"splitter": SPLITTER, "documents": row.n, "hash": str(row.h)}

    def rebuild(self, docs: DataFrame) -> int:
        """Write the index anew; returns the number of documents."""
        marks = self.fingerprint(docs)
        rows = postings(docs, self.key, self.text).repartitionByRange("term").sortWithinPartitions("term", "id")
        lengths = docs.count() and rows.select("id", "len").distinct().agg(F.sum("len")).first()[0]
        self.table.write(rows, marks=marks | {"length": int(lengths or 0)})
        return marks["documents"]

    def intact(self, docs: DataFrame) -> bool:
        """Whether the newest version was built from these documents in this way."""
        version = self.table.last_intact()
        marks = self.table.marks(version) if version else {}
        return all(marks.get(k) == v for k, v in self.fingerprint(docs).items())

    def ensure(self, docs: DataFrame) -> bool:
        """Rebuild if the index does not fit ``docs``; returns whether it had to."""
        if self.intact(docs):
            return False
        self.rebuild(docs)
        return True

    def stored(self) -> tuple[DataFrame, DataFrame]:
        """(postings, statistics) for ``retrieval.bm25``."""
        version = self.table.last_intact()
        marks = self.table.marks(version)
        n = marks["documents"]
        stats = self.spark.createDataFrame([(n, marks["length"] / n if n else 0.0)], "n long, avg_len double")
        return self.table.read(version), stats
