"""Connected components of an edge table, by random contraction; and under insertions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.plans.fixpoint import rounds
from arcspark.plans.scratch import discard, materialise


#: Rows of one vertex from which on it is a centre of its own, and how many of these there can be.
CENTRE_ROWS, MAX_CENTRES = 1_000_000, 1_000_000


def _with_least(pairs: DataFrame, size: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (u, v) with m, the least v of the same u, and the tables written for it; ``size``: at least the number of rows.

    The least are found map-side first. A u with a MAX_CENTRES-th of all rows or more, and at least CENTRE_ROWS, has
    them told by a broadcast, so that the centre of a star isn't one task of the join.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = max(CENTRE_ROWS, size // MAX_CENTRES)
    if size <= hot:
        return pairs.join(least.select("u", "m"), "u"), []
    least = materialise(least, "least")
    centres = F.broadcast(least.where(F.col("n") > hot).select("u", "m"))
    rest = pairs.join(centres, "u", "left_anti").join(least.where(F.col("n") <= hot).select("u", "m"), "u")
    return pairs.join(centres, "u").select("u", "v", "m").unionByName(rest.select("u", "v", "m")), [least]


def _mixed(v: Column, k: int) -> Column:
    """The order of vertices in round ``k``, by bits flipped at random: which of two comes first is as likely as not. Twice gives the vertex again."""
    return v.bitwiseXOR(F.lit(random.Random(k).getrandbits(64) - (1 << 63)))


def _renamed(rows: DataFrame, end: str, names: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` with the name ``_{end}`` of an end (``names``: u, r); those of centres (``hot``) are told by a broadcast."""
    at = lambda t: t.select(F.col("u").alias(end), F.col("r").alias(f"_{end}"))
    if hot is None:
        return rows.join(at(names), end)
    centres = F.broadcast(at(hot))
    rest = rows.join(centres.select(end), end, "left_anti").join(at(names), end)
    return rows.join(centres, end).unionByName(rest)


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component`` for every endpoint; the component is its least endpoint.

    In each round every vertex takes the name of the first of itself and its neighbours, in an order drawn for the round, and edges
    within one name go. That leaves some half of the vertices on a chain and fewer elsewhere, so all rounds together
    cost a few times the edges, and long chains no more than others. Names are followed back from the last round to the first.
    Null endpoints and self-loops link nothing, but a self-loop's vertex is labelled.
    """
    ends = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    ends = ends.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    now = materialise(
        ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    alone = ends.where("u = v").select(F.col("u").alias("id")).distinct()
    levels: list[tuple[DataFrame, DataFrame | None]] = []
    for k in rounds():
        n = now.count()
        if not n:
            break
        limit = max(CENTRE_ROWS, 2 * n // MAX_CENTRES)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        counted = [F.count("*").alias("n")] if 2 * n > limit else []
        first = both.groupBy("u").agg(F.min(_mixed(F.col("v"), k)).alias("m"), *counted)
        name = _mixed(F.least("m", _mixed(F.col("u"), k)), k).alias("r")
        names = materialise(first.select("u", name, *(["n"] if counted else [])), "names")
        hot = names.where(F.col("n") > limit).select("u", "r") if counted else None
        hot = None if hot is None or hot.isEmpty() else hot
        levels.append((names, hot))
        both_named = _renamed(_renamed(now, "u", names, hot), "v", names, hot).where("_u <> _v")
        older, now = now, materialise(both_named.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct(), "edges")
        discard(older)
    if not levels:
        return alone.select("id", F.col("id").alias("component"))
    roots = levels[-1][0].select("u", "r")
    for (names, hot), (after, _) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        last = roots.select(F.col("u").alias("r"), F.col("r").alias("_r"))
        rows = names.select("u", "r")
        if hot is None:
            further = rows.join(last, "r", "left")
        else:
            centres = F.broadcast(last.join(F.broadcast(hot.select(F.col("u").alias("r"))), "r"))
            rest = rows.join(centres.select("r"), "r", "left_anti").join(last, "r", "left")
            further = rows.join(centres, "r").unionByName(rest)
        older, roots = roots, materialise(further.select("u", F.coalesce("_r", "r").alias("r")), "roots")
        discard(older, after)
    told, _ = _with_least(roots.select(F.col("r").alias("u"), F.col("u").alias("v")), roots.count())
    found = told.select(F.col("v").alias("id"), F.col("m").alias("component"))
    rest = alone.join(roots.select(F.col("u").alias("id")), "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.unionByName(rest)


def count_components(labels: DataFrame) -> int:
    """How many components ``labels`` (id, component) name; each has the id of one of its vertices."""
    return labels.where("id = component").count()


def merge_edges(labels: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``labels`` (id, component) after a batch of edges, without the edges before.

    ``labels`` name each component by its least vertex, as ``component_labels`` does: a forest of stars. Edges become
    links between components, whose own components rename the stars that merge; other stars aren't looked at again.
    Endpoints without a label are new vertices; null endpoints link nothing.
    """
    ends = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    new = ends.select(F.col("u").alias("id")).unionByName(ends.select(F.col("v").alias("id"))).distinct().join(labels, "id", "left_anti")
    stars = materialise(labels.select("id", "component").unionByName(new.select("id", F.col("id").alias("component"))), "stars")
    for end in ("u", "v"):
        ends = ends.join(stars.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")), end)
    links = ends.where("_u <> _v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct()
    names = materialise(component_labels(links, "u", "v"), "names").select(F.col("id").alias("component"), F.col("component").alias("_name"))
    return stars.join(names, "component", "left").select("id", F.coalesce("_name", "component").alias("component"))
