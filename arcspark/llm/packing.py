"""Operator 8: bounded-space online best-fit packing of token sequences.

Each document's ids (with an end id) are cut into pieces of at most ``capacity`` tokens.
Pieces arrive in ``(doc_id, piece)`` order at a packer that keeps at most ``open_bins``
open sequences. A bitset has bit f set when some open bin has f free tokens, so the
tightest bin that fits is the lowest set bit at or above the piece's length. Where none
fits and all bins are open, the fullest closes first.

Packers are independent tasks over at most about ``pieces_per_task`` pieces, dealt by a
hash of ``doc_id``; a task leaves no more than ``open_bins`` partly filled sequences.

Defined cases: null text counts as empty (one piece: the end id); repeated rows are packed
each for itself; an empty table packs to nothing; other input columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import small_batches
from arcspark.llm.tokens import encoder, slices, with_end
from arcspark.plans.scratch import materialise

CAPACITY, OPEN_BINS, PIECES_PER_TASK, END_ID = 2048, 512, 200_000, 0
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class BestFit:
    """The open bins of one packer; ``place`` returns (bin number, offset)."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.opened = self.n_open = 0

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
            if self.n_open == self.open_bins and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.n_open -= 1
            self.n_open += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        return number, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the pieces of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                ids, ends = with_end(words.encode_array(texts), end_id)
                sizes = np.diff(ends)
                n = -(-sizes // capacity)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.repeat(sizes, n) - start)
                first, packed = (np.repeat(ends[:-1], n) + start).tolist(), memoryview(ids).cast("B")
                crc = [zlib.crc32(packed[4 * a : 4 * (a + k)]) for a, k in zip(first, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)).take(pa.array(np.repeat(np.arange(len(texts)), n))), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                at += len(texts)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return kept.mapInArrow(run, PIECES)


def assign(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, start, length``."""
    n = max(1, -(-cut.count() // pieces_per_task))
    dealt = cut.repartition(n, F.xxhash64("doc_id", "piece")).sortWithinPartitions("doc_id", "piece", "ids_crc32")
    at = cut.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, packer = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for batch in batches:
            placed = np.array([packer.place(x) for x in batch.column(at).to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first + placed[:, 0]), pa.array(placed[:, 1])],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """One row a piece, with the sequence it is in and its place there."""
    cut = materialise(pieces(docs, tokenizer, capacity, end_id), "pieces")
    return assign(cut, capacity, open_bins).withColumn("length", F.col("length").cast("long"))
