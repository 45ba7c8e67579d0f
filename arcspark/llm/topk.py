"""Operator 11: exact top-k by inner product with block-at-a-time pruning.

Vectors are rows of terms (dimensions) with whole-number weights. Candidates lie in document
ranges of ascending id; a range is stored as one row: ids, weights, and for each block of
``BLOCK`` documents the greatest and least weight of every term. For a query q the sum over terms
of q's weight times the greatest (for a negative weight: least) one bounds every score
in the block. Blocks are taken in descending order of that bound, and scored through the
block's stored weights, until the bound falls below the query's k-th score so far. A bound
that equals it is still scored, as ties go to the smaller id.

Queries form groups of ``QUERIES`` rows. A task holds one group, and reads a slice of the ranges one
after the other, so what it holds is one group, one range and k candidates a query, and a k-th
score found in one range prunes the next. Each slice returns k rows a query; a window over
slices x k rows a query merges them. Ranges are sent once for each group of queries.

How much is pruned depends on the vectors: ranges of ids that hold like vectors are skipped
nearly whole, vectors drawn alike in all directions let no block be skipped and are all scored.

Defined cases: null ids, null vectors and vectors that hold a null or non-finite component take no part;
an empty vector scores 0 with all; of vectors of different length the shorter one counts as
filled up with zeros; rows that share an id are scored each for itself as candidates, never against their own
id, and as queries they share one list; weights or scores that don't fit 64 bits are an error; an
empty table, or one without queries, gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspark.llm.common import partitions_for, small_batches
from arcspark.plans.scratch import materialise

BLOCK, RANGE, QUERIES = 64, 16_384, 16_384
NONE_YET = np.iinfo(np.int64).min

PACKED = "part int, nth int, terms int, width int, ids binary, weights binary, most binary, least binary"


def whole_weights(df: DataFrame, vec_id: str, vector: str, scale: int = 64) -> DataFrame:
    """``id, v``: each component x as floor(scale * x), for the vectors that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.forall("v", lambda x: F.abs(x.cast("double")) < float("inf")))  # null and NaN aren't less
    whole = lambda y: F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error("a weight needs more than 64 bits"))
    return rows.select("id", F.transform("v", lambda x: whole(x.cast("double") * scale)).alias("v"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of whole numbers, the shorter ones filled up with zeros."""
    flat, sizes = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _bounds(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest and least weight of each term in each block."""
    firsts = np.arange(0, len(weights), BLOCK)
    return np.maximum.reduceat(weights, firsts), np.minimum.reduceat(weights, firsts)


def _packer(most_rows: int):
    """Rows in id order -> one row for each ``most_rows`` of them."""

    def emit(part: int, nth: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        wide = max(w.shape[1] for _, w in held)
        ids = np.concatenate([i for i, _ in held])
        weights = np.concatenate([np.pad(w, ((0, 0), (0, wide - w.shape[1]))) for _, w in held])
        most, least = _bounds(weights) if wide else (weights[:0], weights[:0])
        kind = np.int16 if np.abs(most).max(initial=0) < 1 << 15 and np.abs(least).max(initial=0) < 1 << 15 else np.int64
        row = [part, nth, wide, kind().itemsize, ids.tobytes(), *(x.astype(kind).tobytes() for x in (weights, most, least))]
        types = [pa.int32()] * 4 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids, weights = np.asarray(batch.column(0)), _matrix(batch.column(1))
            while len(ids):
                room = most_rows - n
                held.append((ids[:room], weights[:room]))
                n += len(held[-1][0])
                ids, weights = ids[room:], weights[room:]
                if n == most_rows:
                    yield emit(part, nth, held)
                    nth, held, n = nth + 1, [], 0
        if held:
            yield emit(part, nth, held)

    return run


def packed(rows: DataFrame, most_rows: int, partitions: int) -> DataFrame:
    """Document ranges of at most ``most_rows`` rows each, in id order, with their blocks' bounds; written."""
    small_batches(rows.sparkSession)
    ordered = rows.repartitionByRange(partitions, "id").sortWithinPartitions("id")
    return materialise(ordered.mapInArrow(_packer(most_rows), PACKED), "ranges")


class Best:
    """The k best candidates so far of each query of a group."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, k: int) -> None:
        self.ids, self.weights, self.k = ids, weights, k
        self.rows, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(len(ids), NONE_YET)
        self.scored = self.blocks = 0

    def add(self, rows: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        rows, found, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.found, found), (self.scores, scores)))
        order = np.lexsort((found, ~scores, rows))  # ~ turns the order round without overflow
        rows, found, scores = rows[order], found[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.rows, self.found, self.scores = rows[kept], found[kept], scores[kept]
        last = place == self.k - 1
        self.kth[rows[last]] = scores[last]

    def search(self, ids: np.ndarray, weights: np.ndarray, most: np.ndarray, least: np.ndarray) -> None:
        """One range: each query's blocks in descending order of their bound, 1, 1, 2, 4, ... at a time."""
        terms = max(weights.shape[1], self.weights.shape[1])
        q, weights, most, least = (np.pad(x, ((0, 0), (0, terms - x.shape[1]))) for x in (self.weights, weights, most, least))
        largest = terms * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(weights.astype(float)).max(initial=0))
        kind = np.float32 if largest < 1 << 23 else np.float64 if largest < 1 << 52 else object  # whole numbers stay exact
        q, weights, most, least = (x.astype(kind) for x in (q, weights, most, least))
        n_blocks = -(-len(ids) // BLOCK)
        if terms:
            bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
        else:
            bound = np.zeros((len(q), n_blocks), kind)
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        self.blocks += bound.size
        begin, end = 0, 1
        while begin < n_blocks:
            row, column = np.nonzero(bound[:, begin:end] >= self.kth[:, None])
            if not len(row):
                return  # later blocks have lower bounds
            block = order[row, begin + column]
            by_block = np.argsort(block, kind="stable")
            row, block = row[by_block], block[by_block]
            self.scored += len(row)
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            hits = []
            for at, to in zip(cuts, [*cuts[1:], len(block)], strict=True):
                rows, docs = row[at:to], slice(block[at] * BLOCK, (block[at] + 1) * BLOCK)
                scores = (q[rows] @ weights[docs].T).astype(np.int64)
                i, j = np.nonzero((scores >= self.kth[rows][:, None]) & (ids[docs] != self.ids[rows][:, None]))
                hits.append((rows[i], ids[docs][j], scores[i, j]))
            self.add(*(np.concatenate(x) for x in zip(*hits, strict=True)))
            begin, end = end, end * 2

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[self.rows], self.found, self.scores)], names=["query_id", "vec_id", "score"])


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    kind = np.int16 if row["width"] == 2 else np.int64
    ids = np.frombuffer(row["ids"], np.int64)
    blocks = -(-len(ids) // BLOCK)
    return ids, *(np.frombuffer(row[c], kind).reshape(n, row["terms"]) for c, n in (("weights", len(ids)), ("most", blocks), ("least", blocks)))


def _searcher(k: int):
    """Rows by (group, slice): first the group's queries, then ranges -> the best of the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, *rest = _unpacked(row)
                if row["is_range"]:
                    best.search(ids, *rest)
                else:
                    if best is not None:
                        yield best.batch()
                    best = Best(ids, rest[0], k)
        if best is not None:
            yield best.batch()

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k candidates of highest inner product.

    Both tables hold ``id, v`` as ``whole_weights`` gives them; candidates with the query's id aren't its candidates.
    """
    spark = candidates.sparkSession
    n = partitions_for(spark)
    groups = packed(queries, QUERIES, max(1, n // 8))
    ranges = packed(candidates, RANGE, n)
    slices = max(1, -(-n // max(1, groups.count())))
    key = F.struct(F.col("part").alias("group_part"), F.col("nth").alias("group_nth"))
    names = groups.select(key.alias("group"))
    told = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    first = groups.select(key.alias("group"), told, F.lit(False).alias("is_range"), "*")
    dealt = ranges.withColumn("slice", F.pmod(F.col("part") + F.col("nth"), F.lit(slices)))
    sent = dealt.join(_listed(names), F.lit(True)).withColumn("group", F.explode("groups")).select("group", "slice", F.lit(True).alias("is_range"), *groups.columns)
    cells = first.unionByName(sent).repartitionByRange(n, "group", "slice")
    cells = cells.sortWithinPartitions("group", "slice", "is_range", "part", "nth")
    found = cells.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _listed(names: DataFrame) -> DataFrame:
    """One row: the groups' keys, eight bytes for each ``QUERIES`` queries."""
    return F.broadcast(names.agg(F.collect_list("group").alias("groups")))


def every(column: str, n: int) -> Column:
    """The stated query set: ids that ``n`` divides."""
    return F.col(column) % n == 0


def search(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", nth: int = 20, k: int = 20) -> DataFrame:
    """Each row whose id is divisible by ``nth``, against all rows but its own."""
    rows = whole_weights(vectors, vec_id, vector)
    return top_k(rows, rows.filter(every("id", nth)), k)
