"""Operator 5: token ids as Parquet list columns, and reading them back.

One row holds one document: ``doc_id``, its token count and ``ids array<int>``. Rows are
in ascending ``doc_id`` order over the files; Parquet encodes the ids by dictionary
(bit-packed indexes) and, where a dictionary grows too large, by delta (format v2), with
row groups and pages of controlled size, so that page indexes let a reader take the
metadata columns or the tokens of a range of documents alone.

Defined cases: null text counts as empty; an empty text holds only the end id; rows that
share a ``doc_id`` are all stored, ordered by text; an empty table gives an empty store;
columns of the input other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcspark.llm.common import arrow_map, partitions_for, small_batches
from arcspark.llm.tokens import encoder, slices, with_end
from arcspark.plans.scratch import scratch_path

END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 128 << 10, 2000


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, n_tokens, ids, part, part_start`` in the order of ``docs``' partitions.

    ``part`` numbers the partition and ``part_start`` counts the ids before a row in it.
    """
    schema = "doc_id long, n_tokens long, ids array<int>, part int, part_start long"
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, start, words = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                ids, ends = with_end(words.encode_array(texts), end_id)
                counts = np.diff(ends).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                        pa.array(np.full(len(counts), part, np.int32)),
                        pa.array(start + ends[:-1].astype(np.int64)),
                    ],
                    names=["doc_id", "n_tokens", "ids", "part", "part_start"],
                )
                at += len(texts)
                start += int(ends[-1])

    return docs.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text of ``docs`` into a token store at ``path``.

    The texts are range-partitioned by ``doc_id`` (one shuffle, no key is gathered) and
    sorted within partitions; tokens are made only after that.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    n = partitions_for(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        encode(ordered, tokenizer, end_id)
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``start``: the number of ids of all documents before each.

    The offsets of the parts are summed from the metadata columns alone; there is one row
    a part, so they are broadcast.
    """
    stored = spark.read.parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return stored.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("_base") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def digests(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from rows of ``read``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(3)
        values = ids.values.to_numpy(zero_copy_only=False).view("<u4")
        ends = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    return arrow_map(stored, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the store, read it back, and return the digest of every document."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    return digests(read(docs.sparkSession, path))
