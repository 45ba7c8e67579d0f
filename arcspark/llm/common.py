"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, as texts can be long; affects memory only."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What the operators of a worker process keep between tasks.
_CACHES: list = []


class WordCache(dict):
    """word -> ``make(word)``, kept while there is room; one operator's at a time in a process."""

    def __init__(self, make: Callable, limit: int = 300_000) -> None:
        super().__init__()
        self._make, self._limit = make, limit
        _CACHES.append(self)

    def __missing__(self, word):
        if len(self) >= self._limit:
            self.clear()
        self[word] = value = self._make(word)
        return value


def claim(mine) -> None:
    """Empty the other caches of this worker process, so that tasks of different operators don't add up."""
    if any(len(c) for c in _CACHES if c is not mine):
        for cache in _CACHES:
            if cache is not mine:
                cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def arrow_map(
    df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, begin: Callable[[], None] | None = None
) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch; ``begin`` is called first in each task."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if begin:
            begin()
        return (rows(b) for b in batches if b.num_rows)

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores before them until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def partitions_for(spark: SparkSession) -> int:
    """Partitions for a payload that is dealt out as it is: no fewer than a shuffle gets."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
