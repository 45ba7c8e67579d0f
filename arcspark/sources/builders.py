"""Builders and generators of graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcspark.functions import md5
from arcspark.graph import Graph, GraphError
from arcspark.plans.scratch import materialise

#: Pairs that a task hashes, as a power of two, and rows of bits whose arcs are listed at once.
TASK_PAIRS, AT_ONCE = 26, 32
#: Sources drawn side by side, and the most pairs that these have.
SOURCES, HELD_BITS = 256, 1 << 28


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with its rank 0, 1, ... in this order as ``name``, without a single-task sort.

    Rows are range-partitioned and written once; ranks within partitions are shifted by the
    sizes of the partitions before, of which there is one each (broadcast).
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    stored = materialise(dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}), "numbered")
    return _shifted(stored, name)


def _shifted(stored: DataFrame, name: str) -> DataFrame:
    """Written rows whose partitions (_part) follow each other in order, with their rank as ``name``: _place and the sizes of the partitions before."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return stored.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


def from_arcs(arcs: DataFrame, vertices: DataFrame | None = None) -> Graph:
    """A graph whose arc ids are ranks by (src, dst, properties), from 0.

    Without ``vertices`` the endpoints are the vertices; isolated ones need the table.
    """
    rest = [c for c in arcs.columns if c not in ("src", "dst", "arc_id")]
    rows = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *rest)
    named = numbered(rows, "arc_id", "src", "dst", *rest).select("arc_id", "src", "dst", *rest)
    if vertices is None:
        vertices = named.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(vertices, named)


def indexed(graph: Graph, by: str = "src") -> Graph:
    """The same graph with arcs stored by source (or target), for repeated joins on that end."""
    arcs = graph.arcs.repartition(by).sortWithinPartitions(by, "src", "dst")
    return Graph(graph.vertices, materialise(arcs, f"by-{by}"))


def static_graph(n: int, arcs: DataFrame) -> Graph:
    """Vertices 0..n-1 and ``arcs`` (src, dst, ...); raises if an end is outside."""
    bad = arcs.where(~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1) | F.col("src").isNull() | F.col("dst").isNull())
    if bad.limit(1).count():
        raise GraphError(f"an arc ends outside 0..{n - 1}")
    return from_arcs(arcs, arcs.sparkSession.range(n))


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "arc_id long, src long, dst long"))


def compacted(graph: Graph, *order: str | Column) -> Graph:
    """Vertices renumbered 0..n-1 in this order, arcs by (new source, old id); properties follow.

    The old ids stay as ``old_id`` and ``old_arc_id``.
    """
    order = order or ("id",)
    vertices = numbered(graph.vertices, "_new", *order, "id")
    new = vertices.select("id", "_new")
    arcs = graph.arcs
    for end in ("src", "dst"):
        arcs = arcs.join(new.select(F.col("id").alias(end), F.col("_new").alias(f"_{end}")), end)
    rest = [c for c in graph.arcs.columns if c not in ("arc_id", "src", "dst")]
    arcs = arcs.select(F.col("arc_id").alias("old_arc_id"), F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)
    arcs = numbered(arcs, "arc_id", "src", "old_arc_id")
    return Graph(
        vertices.withColumnRenamed("id", "old_id").withColumnRenamed("_new", "id"),
        arcs.select("arc_id", "src", "dst", "old_arc_id", *rest),
    )


def complete_digraph(spark: SparkSession, n: int) -> Graph:
    """All ordered pairs of 0..n-1 without loops, generated by arithmetic on the arc id."""
    k = max(n - 1, 1)
    src, skip = F.floor(F.col("arc_id") / k).cast("long"), (F.col("arc_id") % k).cast("long")
    arcs = spark.range(n * (n - 1) if n > 1 else 0).withColumnRenamed("id", "arc_id")
    return Graph(spark.range(n), arcs.select("arc_id", src.alias("src"), (skip + (src <= skip).cast("long")).alias("dst")))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Directed G(n, p): each ordered pair of different vertices is kept with probability p.

    A source draws how many arcs it has and then which, from a generator of its own, so the work is
    that of the arcs kept rather than of all pairs, and the result depends on neither partitioning nor run.
    """
    if not 0 <= p <= 1:
        raise GraphError("p is not a probability")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for u in batch.id.tolist():
                rng = np.random.Generator(np.random.PCG64([seed & (1 << 64) - 1, u]))
                to = np.sort(rng.choice(n - 1, int(rng.binomial(n - 1, p)), replace=False, shuffle=False)) if n > 1 else np.zeros(0, np.int64)
                yield pd.DataFrame({"src": np.full(len(to), u), "dst": to + (to >= u)})

    vertices = spark.range(n)
    return from_arcs(vertices.mapInPandas(draw, "src long, dst long"), vertices)


def erdos_renyi_md5(spark: SparkSession, n: int, threshold: int) -> Graph:
    """G(n, p) with p = threshold / 2^32 by the first 32 bits of md5('src,dst'), as any engine can compute it.

    Pairs are hashed side by side in tasks and told by a bit each, which are written once; arcs are
    numbered and listed from these bits, as their reader takes them, and neither written nor shuffled.
    """
    pieces = md5.runs(0, n)
    group = max(1, min(SOURCES, HELD_BITS // max(n, 1)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            part, ids = batch.column("_part")[0].as_py() if batch.num_rows else 0, batch.column("id").to_numpy()
            for some in md5.runs(int(ids[0]), int(ids[-1]) + 1, group) if len(ids) else ():
                n_some = some[1] - some[0]
                kept = [drawn(some, piece) for piece in pieces]
                ends = place + np.cumsum(np.column_stack([sizes for sizes, _ in kept]).ravel())
                rows = [np.full(len(ends), part, np.int32), np.repeat(np.arange(*some), len(pieces)), np.tile([low for low, _ in pieces], n_some), np.append(place, ends[:-1]), ends]
                told = [bits[k].tobytes() for k in range(n_some) for _, bits in kept]
                place = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in rows), pa.array(told, pa.binary())], ["_part", "src", "low", "_place", "_end", "kept"])

    def drawn(some: tuple[int, int], piece: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """How many targets of the piece each of some sources keeps, and their bits."""
        at_once = max(1, round(md5.RUN / (piece[1] - piece[0])))
        keep = np.concatenate([md5.first_bits(part, piece) < threshold for part in md5.runs(*some, at_once)])
        both = np.arange(max(some[0], piece[0]), min(some[1], piece[1]))
        keep[both - some[0], both - piece[0]] = False
        return np.count_nonzero(keep, axis=1), np.packbits(keep, axis=1)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(k, AT_ONCE)
                first, src, low = (some.column(c).to_numpy() for c in ("first", "src", "low"))
                to = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))) for b in some.column("kept").to_pylist()]
                sizes = np.array([len(v) for v in to])
                arc = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                dst = np.concatenate(to) + np.repeat(low, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(np.repeat(src, sizes)), pa.array(dst)], ["arc_id", "src", "dst"])

    vertices = spark.range(n)
    tasks = max(1, spark.sparkContext.defaultParallelism, min(n, n * n >> TASK_PAIRS))
    sources = spark.range(0, n, 1, tasks).withColumn("_part", F.spark_partition_id())
    stored = materialise(sources.mapInArrow(draw, "_part int, src long, low long, _place long, _end long, kept binary"), "numbered")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = stored.groupBy("_part").agg(F.max("_end").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = stored.join(F.broadcast(base), "_part").select((F.col("_base") + F.col("_place")).alias("first"), "src", "low", "kept")
    return Graph(vertices, rows.mapInArrow(listed, "arc_id long, src long, dst long"))
