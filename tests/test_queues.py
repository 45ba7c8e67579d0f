"""Queues against heapq, stars whose centre is hot, forests in order, and what rounds leave behind."""

import heapq
from pathlib import Path

import pytest
from graphs import rows

from arcspark.graph import Graph, GraphError, UndirectedGraph
from arcspark.operators import components, queues, trees
from arcspark.plans import fixpoint
from arcspark.plans.scratch import materialise


def queue(spark, items):
    return spark.createDataFrame(items, "id long, priority long")


def test_queue_by_heapq(spark, rng):
    items = {i: rng.randrange(9) for i in rng.sample(range(100), 40)}
    start = queue(spark, list(items.items()))
    ups = [(rng.randrange(100), rng.randrange(9)) for _ in range(50)] + [(3, None), (None, 2)]
    downs = [(rng.randrange(100), rng.randrange(9)) for _ in range(50)]
    now = queues.updated(queues.updated(start, queue(spark, ups), "promote"), queue(spark, downs), "demote")
    now = queues.pushed(now, queue(spark, [(200, 4), (200, 3), (201, 0)]))
    for changes, best in ((ups, min), (downs, max)):
        for i, p in changes:
            if i in items and p is not None:
                items[i] = best(items[i], p)
    items |= {200: 3, 201: 0}
    heap = [(p, i) for i, p in items.items()]
    heapq.heapify(heap)
    order = [heapq.heappop(heap) for _ in range(len(heap))]
    assert rows(queues.first(now, 7), "pos", "id", "priority") == [(k, i, p) for k, (p, i) in enumerate(order[:7])]
    assert rows(queues.popped(now, 7), "id") == sorted((i,) for _, i in order[7:])
    assert rows(queues.first(now.limit(0), 7)) == [] and rows(queues.first(now, 500), "pos") == [(k,) for k in range(len(order))]


def test_many_queues(spark, rng):
    held = [(rng.choice("aab"), i, rng.randrange(5)) for i in range(60)] + [("c", 99, 1)]
    many = spark.createDataFrame(held, "q string, id long, priority long")
    want = []
    for q in "abc":
        mine = sorted((p, i) for name, i, p in held if name == q)[:4]
        want += [(q, k, i) for k, (_, i) in enumerate(mine)]
    assert rows(queues.first(many, 4, "q"), "q", "pos", "id") == want
    assert queues.popped(many, 4, "q").count() == len(held) - len(want)


def test_priorities_that_are_set(spark):
    start = queue(spark, [(1, 5), (2, 6)])
    assert rows(queues.updated(start, queue(spark, [(1, 9), (1, 9), (7, 1)])), "id", "priority") == [(1, 9), (2, 6)]
    with pytest.raises(GraphError):
        queues.updated(start, queue(spark, [(1, 9), (1, 8)]))
    with pytest.raises(GraphError):
        queues.updated(start, start, "lower")


def test_centres_of_stars_are_told_by_broadcast(spark, rng, monkeypatch):
    """With every vertex of more than three rows a centre, the components are the same."""
    edges = [(0, i) for i in range(1, 30)] + [(50 + i, 50) for i in range(20)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(60)] + [(29, 140), (80, 80)]
    table = spark.createDataFrame(edges, "src long, dst long")
    plain = rows(components.component_labels(table), "id", "component")
    monkeypatch.setattr(components, "CENTRE_ROWS", 3)
    assert rows(components.component_labels(table), "id", "component") == plain
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    assert plain == sorted((v, root(v)) for v in parent)
    assert components.count_components(components.component_labels(table)) == len({root(v) for v in parent})


def test_forest_in_order_of_cost(spark, rng):
    edges = [(k, rng.randrange(30), rng.randrange(30), rng.randrange(6)) for k in range(90)]
    arcs = spark.createDataFrame(edges, "arc_id long, src long, dst long, w long")
    g = UndirectedGraph(Graph(spark.range(30), arcs))
    got = rows(trees.spanning_forest(g, "w", ordered=True), "pos", "edge_id", "cost")
    name, want = list(range(30)), []
    for w, k, u, v in sorted((w, k, u, v) for k, u, v, w in edges):
        if name[u] != name[v]:
            name = [name[u] if x == name[v] else x for x in name]
            want.append((len(want), k, w))
    assert got == want


def test_merged_rounds_are_removed(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "COMPACT_EVERY", 3)
    parts = [materialise(spark.range(k, k + 1), "part") for k in range(8)]
    paths = [Path(p._scratch.removeprefix("file:")) for p in parts]
    held = fixpoint.Accumulated(parts[0])
    for k, part in enumerate(parts[1:], 1):
        held.add(part)
        assert part.count() == 1, "the last part is still read by the next round"
        assert rows(held.table(), "id") == [(i,) for i in range(k + 1)]
    assert sum(p.exists() for p in paths) <= 3
