"""The data model: a directed multigraph as two DataFrames, and its access and update operations.

``vertices`` has ``id`` and any property columns; ``arcs`` has ``arc_id, src, dst`` and any
property columns. Parallel arcs and self-loops are legal. A property is a column, so maps
over vertices or arcs are made with ``withColumn`` and dropped with ``drop``. Every operation
is a lazy transformation that gives a new graph or DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERTEX, ARC = ["id"], ["arc_id", "src", "dst"]


class GraphError(ValueError):
    """Input that breaks a precondition of an operation."""


def _as_long(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise GraphError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*(F.col(n).cast("long").alias(n) if n in names else F.col(n) for n in df.columns))


class Graph:
    """A directed multigraph over ``vertices`` (id, ...) and ``arcs`` (arc_id, src, dst, ...)."""

    def __init__(self, vertices: DataFrame, arcs: DataFrame) -> None:
        self.vertices, self.arcs = _as_long(vertices, VERTEX), _as_long(arcs, ARC)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def __or__(self, view: Callable[[Graph], Graph]) -> Graph:
        """``graph | view``: views compose from left to right."""
        return view(self)

    transform = __or__

    def check(self) -> Graph:
        """This graph, or GraphError if ids repeat or are null, or an arc ends outside the vertices."""
        bad = self.vertices.groupBy("id").count().where("id is null or count > 1").limit(1).count()
        bad_arcs = self.arcs.groupBy("arc_id").count().where("arc_id is null or count > 1").limit(1).count()
        ends = self.arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        loose = ends.join(self.vertices.select("id"), "id", "left_anti").limit(1).count()
        for found, what in ((bad, "vertex ids repeat or are null"), (bad_arcs, "arc ids repeat or are null"), (loose, "an arc ends at no vertex")):
            if found:
                raise GraphError(what)
        return self

    # access

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_arcs(self) -> int:
        return self.arcs.count()

    def arcs_entries(self) -> DataFrame:
        return self.arcs.select(*ARC)

    def arc_sources(self) -> DataFrame:
        return self.arcs.select("arc_id", "src")

    def arc_targets(self) -> DataFrame:
        return self.arcs.select("arc_id", "dst")

    def _incident(self, end: str, of: DataFrame | int) -> DataFrame:
        if isinstance(of, DataFrame):
            return self.arcs.join(of.select(F.col("id").alias(end)), end, "left_semi").select(*self.arcs.columns)
        return self.arcs.where(F.col(end) == of)

    def out_arcs(self, of: DataFrame | int) -> DataFrame:
        """Arcs that leave a vertex, or the vertices ``id`` of a DataFrame."""
        return self._incident("src", of)

    def in_arcs(self, of: DataFrame | int) -> DataFrame:
        return self._incident("dst", of)

    def out_neighbors(self) -> DataFrame:
        """``id, neighbor``, a row for each arc: parallel arcs give the neighbour again."""
        return self.arcs.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))

    def in_neighbors(self) -> DataFrame:
        return self.arcs.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"))

    def _degree(self, end: str, name: str) -> DataFrame:
        counts = self.arcs.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
        return self.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def out_degree(self) -> DataFrame:
        return self._degree("src", "out_degree")

    def in_degree(self) -> DataFrame:
        return self._degree("dst", "in_degree")

    def has_vertices(self, ids: DataFrame) -> DataFrame:
        """``ids`` (id, ...) with ``valid``: whether each is a vertex."""
        return ids.join(self.vertices.select("id", F.lit(True).alias("valid")), "id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))

    def has_arcs(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.arcs.select("arc_id", F.lit(True).alias("valid")), "arc_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))

    def with_vertex_map(self, name: str, value: Column | object = None) -> Graph:
        """A vertex property: a column expression, a constant, or null (not yet set)."""
        return Graph(self.vertices.withColumn(name, value if isinstance(value, Column) else F.lit(value)), self.arcs)

    def with_arc_map(self, name: str, value: Column | object = None) -> Graph:
        return Graph(self.vertices, self.arcs.withColumn(name, value if isinstance(value, Column) else F.lit(value)))

    # updates

    def add_vertices(self, rows: DataFrame) -> Graph:
        """New vertices (ids must be fresh); properties that they lack are null."""
        fresh = _as_long(rows, VERTEX)
        if fresh.join(self.vertices.select("id"), "id", "left_semi").limit(1).count():
            raise GraphError("a new vertex has the id of another")
        return Graph(self.vertices.unionByName(fresh, allowMissingColumns=True), self.arcs)

    def remove_vertices(self, ids: DataFrame) -> Graph:
        """Without these vertices and every arc at them."""
        gone = ids.select(F.col("id").cast("long").alias("id")).distinct()
        arcs = self.arcs
        for end in ("src", "dst"):
            arcs = arcs.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*self.arcs.columns)
        return Graph(self.vertices.join(gone, "id", "left_anti").select(*self.vertices.columns), arcs)

    def add_arcs(self, rows: DataFrame) -> Graph:
        """New arcs (src, dst, ...), numbered after the greatest id; both ends must be vertices."""
        fresh = _as_long(rows, ["src", "dst"]).drop("arc_id")
        ends = fresh.select(F.explode(F.array("src", "dst")).alias("id"))
        if ends.join(self.vertices.select("id"), "id", "left_anti").limit(1).count():
            raise GraphError("a new arc ends at no vertex")
        from arcspark.sources.builders import numbered

        first = self.arcs.agg(F.coalesce(F.max("arc_id") + 1, F.lit(0)).alias("_first"))
        named = numbered(fresh, "_rank", "src", "dst", *[c for c in fresh.columns if c not in ("src", "dst")])
        named = named.join(F.broadcast(first)).withColumn("arc_id", F.col("_first") + F.col("_rank")).drop("_first", "_rank")
        return Graph(self.vertices, self.arcs.unionByName(named, allowMissingColumns=True))

    def remove_arcs(self, ids: DataFrame) -> Graph:
        gone = ids.select(F.col("arc_id").cast("long").alias("arc_id"))
        return Graph(self.vertices, self.arcs.join(gone, "arc_id", "left_anti").select(*self.arcs.columns))

    def repoint(self, changes: DataFrame) -> Graph:
        """Move arcs to the non-null ``src`` or ``dst`` of ``changes`` (arc_id, src, dst); ids stay."""
        new = changes.select("arc_id", F.col("src").cast("long").alias("_src"), F.col("dst").cast("long").alias("_dst"))
        ends = new.select(F.explode(F.array("_src", "_dst")).alias("id")).where("id is not null")
        if ends.join(self.vertices.select("id"), "id", "left_anti").limit(1).count():
            raise GraphError("an arc would end at no vertex")
        moved = self.arcs.join(new, "arc_id", "left")
        moved = moved.withColumns({"src": F.coalesce("_src", "src"), "dst": F.coalesce("_dst", "dst")})
        return Graph(self.vertices, moved.select(*self.arcs.columns))


class UndirectedGraph:
    """A graph whose arcs are taken as edges: the view ``undirect`` of a directed one."""

    def __init__(self, graph: Graph) -> None:
        self.vertices, self.edges = graph.vertices, graph.arcs.withColumnRenamed("arc_id", "edge_id")

    def num_edges(self) -> int:
        return self.edges.count()

    def edge_endpoints(self) -> DataFrame:
        """``edge_id, u, v`` with u <= v: an unordered pair."""
        return self.edges.select("edge_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))

    def incidence(self) -> DataFrame:
        """``id, edge_id, other``: a self-loop comes twice."""
        out = self.edges.select(F.col("src").alias("id"), "edge_id", F.col("dst").alias("other"))
        return out.unionAll(self.edges.select(F.col("dst").alias("id"), "edge_id", F.col("src").alias("other")))

    def degree(self) -> DataFrame:
        counts = self.incidence().groupBy("id").agg(F.count("*").alias("degree"))
        return self.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def with_edge_map(self, name: str, value: Column | object = None) -> UndirectedGraph:
        out = UndirectedGraph.__new__(UndirectedGraph)
        out.vertices, out.edges = self.vertices, self.edges.withColumn(name, value if isinstance(value, Column) else F.lit(value))
        return out
