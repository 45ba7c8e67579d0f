"""Intermediate tables in the folder that driver and executors share.

Lineage is cut with written Parquet tables, never with ``localCheckpoint``: a lost
executor then costs its running tasks and nothing that was finished before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids, with a number or two, up to which ``told`` has them broadcast.
TOLD_ROWS = 1_000_000

_CLEANED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where none is set and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="arcspark-checkpoint-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, below one folder per application."""
    top = f"{shared_folder(spark).rstrip('/')}/arcspark-{spark.sparkContext.applicationId}"
    if top not in _CLEANED:
        _CLEANED.add(top)
        atexit.register(sweep, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A write inside removes the shuffle files it made when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more, so that a loop's disk doesn't grow with its rounds."""
    for df in tables:
        if path := df.__dict__.pop("_scratch", None):
            sweep(df.sparkSession, path)


def told(table: DataFrame, n: int | None = None) -> DataFrame:
    """``table`` to join with a large one: by a broadcast if its rows (``n``, counted if not given) are few, so that the large one isn't shuffled."""
    return F.broadcast(table) if (table.count() if n is None else n) <= TOLD_ROWS else table


def sweep(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate tables."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may be gone already; the cluster's own retention applies then
        return
