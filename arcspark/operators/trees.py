"""Spanning forests of least cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.graph import GraphError, UndirectedGraph
from arcspark.operators.components import component_labels
from arcspark.plans.fixpoint import rounds
from arcspark.plans.scratch import discard, materialise
from arcspark.sources.builders import numbered


def spanning_forest(graph: UndirectedGraph, cost: str, ordered: bool = False) -> DataFrame:
    """``edge_id, src, dst, cost`` of the least spanning forest; ties go to the lesser edge id.

    ``ordered`` adds ``pos``, the place of each edge by (cost, edge_id) from 0 on.

    Each round every component takes its cheapest outgoing edge by (cost, edge_id), which are
    all different, so the chosen edges are those of the sequential greedy algorithm with this
    tie-break. Components at least halve in number. Self-loops are never taken.
    """
    edges = graph.edges.select("edge_id", "src", "dst", F.col(cost).alias("cost"))
    if not edges.where("cost is null").isEmpty():
        raise GraphError("a cost is null")
    left = materialise(edges.where("src <> dst").withColumns({"a": F.col("src"), "b": F.col("dst")}), "edges")
    chosen = None
    for _ in rounds():
        key = F.struct("cost", "edge_id", "src", "dst", "a", "b")
        ends = left.select(F.explode(F.array("a", "b")).alias("c"), key.alias("e"))
        taken = materialise(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "taken")
        if taken.isEmpty():
            break
        before, chosen = chosen, taken if chosen is None else materialise(chosen.unionByName(taken), "forest")
        merged = materialise(component_labels(taken, "a", "b"), "merged")
        moved = left
        for end in ("a", "b"):
            names = merged.select(F.col("id").alias(end), F.col("component").alias("_to"))
            moved = moved.join(names, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        older, left = left, materialise(moved.where("a <> b"), "edges")
        discard(older, merged, *([] if before is None else [before, taken]))
    out = (edges.limit(0) if chosen is None else chosen).select("edge_id", "src", "dst", "cost")
    return numbered(out, "pos", "cost", "edge_id") if ordered else out


def spanning_tree(graph: UndirectedGraph, cost: str, root: int) -> DataFrame:
    """The part of the forest in ``root``'s component: what growing a tree from there gives."""
    forest = materialise(spanning_forest(graph, cost), "forest")
    labels = materialise(component_labels(graph.edges, "src", "dst"), "labels")
    mine = labels.where(F.col("id") == root).select("component")
    return forest.join(labels.select(F.col("id").alias("src"), "component"), "src").join(mine, "component", "left_semi").select("edge_id", "src", "dst", "cost")
