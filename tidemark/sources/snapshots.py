"""A table as numbered versions in a shared folder: atomic publication, reading back, repair,
export, and a small store of names and values."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """Small files of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._root)) if self._fs.exists(self._root) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one of that name already.  Only one of several
        writers can create it: stores such as HDFS see to that themselves, a plain file system does
        through an exclusive open."""
        if self._fs.getScheme() == "file":
            path = self._at(name).toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            try:
                with open(path, "x", encoding="utf-8") as out:
                    out.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = self._fs.create(self._at(name), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        source = self._fs.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def move(self, name: str, to: str) -> bool:
        return self._fs.rename(self._at(name), self._at(to))


class VersionedTable:
    """Versions are folders ``v=000001``.  A writer first claims its number with a file that only
    one can create, so two writers never share one; a version exists once its marker file does,
    so a writer that dies leaves nothing that a reader would take."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def versions(self) -> list[int]:
        names = (n for n in self.folder.names() if n.startswith("v="))
        return sorted(int(n[2:]) for n in names if self.folder.exists(f"{n}/_COMPLETE"))

    def _name(self, version: int) -> str:
        return f"v={version:06d}"

    def _claim(self) -> int:
        taken = [int(n[2:]) for n in self.folder.names() if n.startswith("v=")]
        version = max(taken, default=0) + 1
        while not self.folder.create(f"{self._name(version)}/_CLAIMED", uuid.uuid4().hex):
            version += 1
        return version

    def write(self, state: DataFrame, partition_by: list[str] | None = None, marks: dict | None = None) -> int:
        """Publish ``state`` as the next version and return its number; ``marks`` are kept with it."""
        from pyspark.sql import Observation

        version, seen = self._claim(), Observation()
        writer = state.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{self._name(version)}/data")
        text = json.dumps((marks or {}) | {"rows": seen.get["rows"], "at": time.time()})
        self.folder.create(f"{self._name(version)}/_COMPLETE", text)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        version = version if version is not None else self.versions()[-1]
        return self.spark.read.parquet(f"{self.path}/{self._name(version)}/data")

    def marks(self, version: int) -> dict:
        return json.loads(self.folder.read(f"{self._name(version)}/_COMPLETE"))

    def intact(self, version: int) -> bool:
        """Whether a version still has the number of rows it was published with."""
        try:
            return self.read(version).count() == self.marks(version)["rows"]
        except Exception:
            return False

    def last_intact(self) -> int | None:
        return next((v for v in reversed(self.versions()) if self.intact(v)), None)

    def repair(self) -> int | None:
        """Set damaged versions aside as ``corrupted_...`` and return the newest intact one."""
        for version in self.versions():
            if not self.intact(version):
                self.folder.move(self._name(version), f"corrupted_{int(time.time() * 1000)}_{version:06d}")
        return (self.versions() or [None])[-1]


class Settings:
    """Names and values; the newest value of a name counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def put(self, name: str, value: str) -> None:
        number = len([n for n in self.folder.names() if n.startswith("s=")])
        while not self.folder.create(f"s={number:09d}", json.dumps([name, value])):
            number += 1

    def get(self, name: str, default: str | None = None) -> str | None:
        for file in reversed([n for n in self.folder.names() if n.startswith("s=")]):
            found, value = json.loads(self.folder.read(file))
            if found == name:
                return value
        return default


def export_json(rows: DataFrame, path: str) -> None:
    """All columns of all rows as JSON lines."""
    rows.write.mode("overwrite").json(path)


def json_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): every row as one JSON text."""
    return rows.select(*keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def prometheus(name: str, rows: DataFrame, label: str, value: str) -> DataFrame:
    """(line): one gauge line per row in the text exposition format."""
    return rows.select(F.format_string(f'{name}{{{label}="%s"}} %s', F.col(label), F.col(value).cast("string")).alias("line"))


def notes(rows: DataFrame, folder: str, name: str, body: str) -> int:
    """One Markdown file per row of a report, those that exist already stay; returns the number
    written.  Meant for reports of a few rows, which pass through the driver one by one."""
    sink, written = Folder(rows.sparkSession, folder), 0
    for r in rows.select(name, body).toLocalIterator():
        written += sink.create(f"{r[0]}.md", r[1])
    return written
