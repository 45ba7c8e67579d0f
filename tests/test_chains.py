"""Chains contracted, critical paths and preorders found by doubling, against plain algorithms."""

import pytest
from graphs import graph, ids, rows
from pyspark.sql import functions as F

from arcspark.graph import Graph
from arcspark.operators import traverse
from arcspark.operators.chains import chain_places, list_sums


def plain_ranks(n, arcs):
    """Longest path to each vertex on or behind no cycle."""
    rank, changed = {}, True
    ins = {v: [u for u, w in arcs if w == v] for v in range(n)}
    while changed:
        changed = False
        for v in range(n):
            if v not in rank and all(u in rank for u in ins[v]):
                rank[v], changed = max((rank[u] + 1 for u in ins[v]), default=0), True
    return rank


def random_chains(rng, n):
    """Paths and trees with some joins, parallel arcs, loops and cycles."""
    arcs = [(v - 1, v) for v in range(1, n) if rng.random() < 0.75]
    arcs += [(u, v) for u, v in ((rng.randrange(n), rng.randrange(n)) for _ in range(n // 6)) if u < v]
    arcs += rng.sample(arcs, 3) + [(5, 5), (n - 4, n - 9), (n, n + 1), (n + 1, n + 2), (n + 2, n)]
    return arcs


@pytest.mark.parametrize("task_arcs", [10**6, 0])
def test_ranks_of_random_chains(spark, rng, task_arcs):
    n = 40
    arcs = random_chains(rng, n)
    g = graph(spark, n + 5, " ".join(f"{u}-{v}" for u, v in arcs))
    order = traverse.topological_sort(g, task_arcs=task_arcs)
    want = plain_ranks(n + 5, arcs)
    assert dict(rows(order, "id", "rank")) == want
    ends = {r.arc_id: (r.src, r.dst) for r in g.arcs.collect()}
    for r in order.collect():
        tight = [a for a, (u, v) in ends.items() if v == r.id and u in want and want[u] + 1 == want[v]]
        assert (r.pred_arc, r.pred_vertex) == ((min(tight), ends[min(tight)][0]) if tight else (None, None))
    path = {}
    for r in traverse.critical_path(order, g.vertices).collect():
        path.setdefault(r.target, {})[r.pos] = r.arc_id
    assert {v: len(p) for v, p in path.items()} == {v: k for v, k in want.items() if k}
    for v, p in path.items():
        walk = [ends[p[k]] for k in range(len(p))]
        assert walk[-1][1] == v and [b for _, b in walk[:-1]] == [a for a, _ in walk[1:]]


def test_places_on_chains_and_cycles(spark):
    g = graph(spark, 12, "0-1 1-2 2-3 3-4 3-5 6-7 7-6 8-9 9-10 10-8 11-11")
    found, turning = chain_places(g)
    assert rows(found) == [(1, 0, 1), (2, 0, 2)]
    assert rows(turning) == [(v,) for v in (6, 7, 8, 9, 10, 11)]
    assert rows(traverse.topological_sort(g), "id", "rank") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4)]


def test_a_very_long_chain_in_few_rounds(spark):
    n = 100_000
    arcs = spark.range(n - 1).select(F.col("id").alias("arc_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    g = Graph(spark.range(n).select("id"), arcs)
    order = traverse.topological_sort(g, task_arcs=0)
    assert order.agg(F.count("*"), F.sum((F.col("id") != F.col("rank")).cast("int"))).first() == (n, 0)
    assert traverse.is_acyclic(g, order)


def test_preorder_of_forests(spark, rng):
    n = 90
    parent = {v: rng.randrange(v) for v in range(4, n) if rng.random() < 0.9}
    arcs = list(parent.items())
    rng.shuffle(arcs)
    g = Graph(spark.range(n).select("id"), spark.createDataFrame([(i, p, v) for i, (v, p) in enumerate(arcs)], "arc_id long, src long, dst long"))
    roots = [v for v in range(n) if v not in parent]
    for start in (roots[1:], []):
        start = ids(spark, *start) if start else ids(spark, 0).limit(0)
        want = traverse.depth_first_search(Graph(g.vertices, g.arcs.unionByName(g.arcs.withColumn("arc_id", F.col("arc_id") + 1000))), start)  # by a task
        assert rows(traverse.depth_first_search(g, start)) == rows(want)


def test_deep_tree(spark):
    n = 3_000
    arcs = spark.range(1, n).select(F.col("id").alias("arc_id"), (F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    found = traverse.depth_first_search(Graph(spark.range(n).select("id"), arcs), ids(spark, 0), most_arcs=10)
    assert found.agg(F.count("*"), F.sum((F.col("pos") != F.col("id")).cast("int")), F.sum((F.col("depth") != F.col("id")).cast("int"))).first() == (n, 0, 0)


def test_sums_along_lists(spark):
    items = spark.createDataFrame([(i, i + 1 if i % 10 < 9 else None, i, 1) for i in range(40)], "id long, next long, v long, one long")
    assert rows(list_sums(items, ["v", "one"])) == [(i, i - i % 10 + 9, sum(range(i, i - i % 10 + 10)), 10 - i % 10) for i in range(40)]
