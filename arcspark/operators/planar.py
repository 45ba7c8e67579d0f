"""Planar maps (experimental): arcs carry ``twin`` (an arc id) and ``face``, vertices ``x, y``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.graph import Graph, GraphError
from arcspark.plans.scratch import materialise


def faces(graph: Graph) -> DataFrame:
    """``face, n_arcs``: the faces and how many arcs bound each."""
    return graph.arcs.groupBy("face").agg(F.count("*").alias("n_arcs"))


def bounding_arcs(graph: Graph, of: DataFrame) -> DataFrame:
    """The arcs that bound the faces ``face`` of a DataFrame."""
    return graph.arcs.join(of.select("face").distinct(), "face", "left_semi").select(*graph.arcs.columns)


def arc_coordinates(graph: Graph, *keep: str) -> DataFrame:
    """``arc_id, x1, y1, x2, y2``: where each arc starts and ends; and the properties to ``keep``."""
    out = graph.arcs.select("arc_id", "src", "dst", *keep)
    for end, k in (("src", 1), ("dst", 2)):
        out = out.join(graph.vertices.select(F.col("id").alias(end), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), end)
    return out.select("arc_id", "x1", "y1", "x2", "y2", *keep)


def dual(graph: Graph) -> Graph:
    """Faces as vertices: each arc leads from its twin's face to its own; arc ids and other properties stay.

    An arc and its twin, named by both ids, meet in one range of them, so each arc is dealt once and arcs of near ids stay
    together; the pairs are written. Arc ids are taken as unique (``Graph.check``).
    GraphError: an arc without a twin, or twins that don't name each other.
    """
    twin, kind = F.col("twin").cast("long"), dict(graph.arcs.dtypes)["twin"]
    rest = [c for c in graph.arcs.columns if c not in ("arc_id", "src", "dst", "face", "twin")]
    sides = {"low": F.col("arc_id") <= twin, "high": F.col("arc_id") >= twin}  # an arc that is its own twin is both
    ends = F.least("arc_id", twin).alias("_low"), F.greatest("arc_id", twin).alias("_high")
    dealt = graph.arcs.select(*ends, *(side.alias(f"_is_{name}") for name, side in sides.items()), F.col("face").cast("long").alias("face"), *rest)
    pairs = dealt.repartitionByRange("_low", "_high").groupBy("_low", "_high").agg(
        *(F.count(F.when(F.col(f"_is_{name}"), 1)).alias(f"_n_{name}") for name in sides),
        *(F.first(F.when(F.col(f"_is_{name}"), F.col(c)), True).alias(f"_{name}_{c}") for name in sides for c in ("face", *rest)),
    )
    both = materialise(pairs, "twins", compression="zstd")
    if not both.where("_n_low <> 1 or _n_high <> 1").isEmpty():
        raise GraphError("twins must name each other")

    def arc(own: str, other: str) -> Column:
        return F.struct(
            F.col(f"_{own}").alias("arc_id"), F.col(f"_{other}_face").alias("src"), F.col(f"_{own}_face").alias("dst"),
            F.col(f"_{other}").cast(kind).alias("twin"), *(F.col(f"_{own}_{c}").alias(c) for c in rest),
        )

    low, high = arc("low", "high"), arc("high", "low")
    each = both.select(F.explode(F.when(F.col("_low") == F.col("_high"), F.array(low)).otherwise(F.array(low, high))).alias("a")).select("a.*")
    return Graph(graph.arcs.select(F.col("face").cast("long").alias("id")).distinct(), each)
