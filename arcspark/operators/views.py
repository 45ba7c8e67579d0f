"""Graph views: lazy transformations of a graph, composed with ``graph | view``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.graph import Graph, UndirectedGraph

View = Callable[[Graph], Graph]


def reverse(graph: Graph) -> Graph:
    """Sources and targets swapped; arc ids and properties stay."""
    rest = [c for c in graph.arcs.columns if c not in ("arc_id", "src", "dst")]
    return Graph(graph.vertices, graph.arcs.select("arc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def subgraph(vertex_filter: Column | str | None = None, arc_filter: Column | str | None = None) -> View:
    """Vertices that pass, and arcs that pass and keep both ends; None passes all. Null doesn't pass."""

    def view(graph: Graph) -> Graph:
        vertices, arcs = graph.vertices, graph.arcs
        if arc_filter is not None:
            arcs = arcs.where(arc_filter)
        if vertex_filter is not None:
            vertices = vertices.where(vertex_filter)
            arcs = _between(arcs, vertices)
        return Graph(vertices, arcs)

    return view


def _between(arcs: DataFrame, vertices: DataFrame) -> DataFrame:
    columns = arcs.columns
    for end in ("src", "dst"):
        arcs = arcs.join(vertices.select(F.col("id").alias(end)), end, "left_semi")
    return arcs.select(*columns)


def induced_subgraph(ids: DataFrame) -> View:
    """The vertices among ``ids`` (id) and all arcs between them."""

    def view(graph: Graph) -> Graph:
        kept = graph.vertices.join(ids.select("id").distinct(), "id", "left_semi").select(*graph.vertices.columns)
        return Graph(kept, _between(graph.arcs, kept))

    return view


def set_flags(ids: DataFrame, value: bool, flag: str = "enabled", arcs: bool = False) -> View:
    """Turn vertices (``id``) or arcs (``arc_id``) on or off in a boolean property; absent flags are on."""
    key = "arc_id" if arcs else "id"

    def view(graph: Graph) -> Graph:
        table = graph.arcs if arcs else graph.vertices
        now = F.coalesce(flag, F.lit(True)) if flag in table.columns else F.lit(True)
        marked = table.join(ids.select(key).distinct().withColumn("_set", F.lit(True)), key, "left")
        out = marked.withColumn(flag, F.when(F.col("_set"), F.lit(value)).otherwise(now)).drop("_set")
        return Graph(graph.vertices, out) if arcs else Graph(out, graph.arcs)

    return view


def undirect(graph: Graph) -> UndirectedGraph:
    """Arcs as edges. A self-loop is incident twice and counts 2 in the degree."""
    return UndirectedGraph(graph)


def enabled_keys(flags: DataFrame, low: int, high: int, flag: str = "enabled", key: str = "id") -> DataFrame:
    """Keys in [low, high) whose flag is set, in increasing order."""
    return flags.where(F.col(flag) & (F.col(key) >= low) & (F.col(key) < high)).select(key).orderBy(key)
