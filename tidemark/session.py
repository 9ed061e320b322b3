"""Session settings and the two ways this library cuts a plan's lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for: UTC clock, AQE with
    skew handling, zstd shuffle blocks.  ``conf`` keys use ``_`` for ``.``."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("_", "."): v for k, v in conf.items()})
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  A temporary one is set only where
    none is configured and the session runs in one process; elsewhere that is an error, since
    other machines would not see it."""
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(local)
    return local


_FOLDERS: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one, removed when Python ends."""
    path = os.path.join(shared_dir(spark), f"tidemark-{spark.sparkContext.applicationId}")
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:
        # the JVM may be gone already; a local folder can still be removed
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back.

    Unlike a cached or locally checkpointed plan, the files outlive any executor, and the
    reader sees column statistics.  An empty result keeps its schema."""
    spark = df.sparkSession
    path = os.path.join(work_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, chosen by the hash of ``key``: the same ones at every
    run and under any partitioning.

    A top-n sends n rows of every task to the driver, so most rows are filtered by their
    hash first; what arrives is about twice the sample, however many tasks there are."""
    total = df.count()
    if not total:
        return df.limit(0)
    # twice the wanted share, so that fewer than ``rows`` are left only in tiny tables
    cells = 1_000_003
    most = cells if total <= 4 * rows else max(1, round(cells * 2 * rows / total))
    cell = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(cells))
    return df.filter(cell < most).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(rows)
