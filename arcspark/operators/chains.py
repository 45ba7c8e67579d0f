"""Pointer doubling: chains of a graph contracted to arcs, and lists ranked, in rounds that grow as a logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.graph import Graph
from arcspark.plans.fixpoint import Accumulated, rounds
from arcspark.plans.scratch import discard, materialise


def chain_places(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Of the vertices with one arc in and one out: ``id, head, place`` (from the vertex where the chain begins, which is none of
    them), and ``id`` of those on a cycle of such vertices, which have no head.

    Each round doubles how far a vertex has looked back; those that have found their head rest.
    """
    arcs = graph.arcs.select("src", "dst")
    ins = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("head")).where("n = 1").select("id", "head")
    outs = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where("n = 1").select("id")
    inner = materialise(ins.join(outs, "id"), "inner")
    n = inner.count()
    steps = inner.select("id", "head", F.lit(1).cast("long").alias("place"))
    known = inner.select(F.col("id").alias("head"), F.lit(True).alias("on"))
    steps = materialise(steps.join(known, "head", "left").select("id", "head", "place", F.col("on").isNotNull().alias("on")), "steps")
    found = Accumulated(materialise(steps.where("not on").select("id", "head", "place"), "found"))
    for k in rounds():
        if 1 << (k - 1) > n or steps.where("on").isEmpty():
            break  # what still goes on has gone round
        ahead = steps.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"), F.col("on").alias("_on"))
        last = found.table().select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"), F.lit(False).alias("_on"))
        going = steps.where("on").join(ahead.where("_on").unionByName(last), "head")
        now = materialise(going.select("id", F.col("_head").alias("head"), (F.col("place") + F.col("_place")).alias("place"), F.col("_on").alias("on")), "steps")
        found.add(materialise(now.where("not on").select("id", "head", "place"), "found"))
        discard(steps)
        steps = now
    return found.table(), steps.where("on").select("id")


def list_sums(items: DataFrame, values: list[str]) -> DataFrame:
    """``id, last`` and, for each of ``values``, the sum from the item to the end of its list.

    ``items``: id, next (null at an end) and the values. Each round joins the items that haven't reached an end with
    what those they point at have summed up, so that the reach doubles.
    """
    n = items.count()
    now = materialise(items.select("id", "next", F.col("id").alias("last"), *values), "list")
    for k in rounds():
        if 1 << (k - 1) > n or now.where("next is not null").isEmpty():
            break
        further = now.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("last").alias("_last"), *(F.col(v).alias(f"_{v}") for v in values))
        joined = now.join(further, "next", "left")
        summed = [(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values]
        older, now = now, materialise(joined.select("id", F.col("_next").alias("next"), F.coalesce("_last", "last").alias("last"), *summed), "list")
        discard(older)
    return now.where("next is null").select("id", "last", *values)
