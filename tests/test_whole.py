"""Queries over whole tables against plain algorithms."""

import heapq

import pytest

from arcspark.plans.catalogue import QUERIES
from arcspark.sources import datasets


def reach(out, start):
    seen, todo = {start}, [start]
    while todo:
        for v in out.get(todo.pop(), ()):
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


def test_searches_over_all_handoffs(spark, sf_dir):
    events = sorted((r.ts, r.event_id, r.user_id) for r in datasets.read(spark, sf_dir, "events").collect())
    users, out = sorted({u for *_, u in events}), {}
    for (*_, a), (*_, b) in zip(events, events[1:]):
        out.setdefault(a, set()).add(b)
    all_reached = {u: reach(out, u) for u in users}

    assert datasets.whole_handoff(spark, sf_dir).arcs.count() == len(events) - 1
    found = {r.id: r.reached for r in QUERIES["bfs_reached"](spark, sf_dir).collect()}
    assert found == {u: u in all_reached[users[0]] for u in users}
    trees = {}
    for root in (u for u in users if u % 10 == 0):
        for v in all_reached[root]:
            trees.setdefault(v, root)
    assert {r.id: r.tree for r in QUERIES["forest"](spark, sf_dir).collect()} == trees
    found = {r.id: r.component for r in QUERIES["strong_components"](spark, sf_dir).collect()}
    assert found == {u: min(v for v in all_reached[u] if u in all_reached[v]) for u in users}
    for name, n in (("vertex_map", len(users)), ("add_vertices", len(users) + sum(u % 10 == 0 for u in users))):
        assert QUERIES[name](spark, sf_dir).count() == n


SF = "/root/testdata/sf0.01"


def best(arcs, start, plus, first):
    """Greatest path values from vertex 0."""
    found, todo = {}, [(-first, start)]
    while todo:
        d, u = heapq.heappop(todo)
        if u not in found:
            found[u] = -d
            for (a, v), w in arcs.items():
                if a == u and v not in found:
                    heapq.heappush(todo, (-plus(-d, w), v))
    return found


def least_front(labels):
    return {x for x in labels if not any(y != x and y[0] <= x[0] and y[1] <= x[1] for y in labels)}


def largest_flow(arcs, s, t):
    left, total = dict(arcs), 0
    while True:
        came, todo = {s: None}, [s]
        for u in todo:
            for v in range(25):
                if v not in came and left.get((u, v), 0) > 0:
                    came[v] = u
                    todo.append(v)
        if t not in came:
            return total
        path, v = [], t
        while v != s:
            path.append((came[v], v))
            v = came[v]
        push = min(left[x] for x in path)
        for u, v in path:
            left[u, v] -= push
            left[v, u] = left.get((v, u), 0) + push
        total += push


@pytest.fixture(scope="module")
def arcs(spark):
    return {(r.src, r.dst): r.w for r in datasets.trade_arcs(spark, SF).collect()}


def test_searches_over_all_trade(spark, arcs):
    found = {n: QUERIES[n](spark, SF).collect() for n in ("widest_paths", "reliable_paths", "pareto_fronts", "competing")}
    assert len(arcs) > 3 * 25
    assert {r.id: r.dist for r in found["widest_paths"]} == best(arcs, 0, min, 2**63 - 1)
    assert {r.id: r.dist for r in found["reliable_paths"]} == best({k: 0.5 ** (w % 4) for k, w in arcs.items()}, 0, lambda a, b: a * b, 1.0)
    fronts, todo = {0: {(0, 0)}}, [0]
    while todo:
        u = todo.pop()
        for (a, v), w in arcs.items():
            if a == u:
                front = set(least_front(fronts.get(v, set()) | {(b + w % 7, r + w % 5) for b, r in fronts[u]}))
                if front != fronts.get(v):
                    fronts[v] = front
                    todo.append(v)
    assert sorted((r.id, r.blue, r.red) for r in found["pareto_fronts"]) == sorted((v, *x) for v, f in fronts.items() for x in f)
    todo, settled = [(0, 0, 0), (0, 1, 12)], {}
    while todo:
        d, colour, u = heapq.heappop(todo)
        if u not in settled:
            settled[u] = (d, colour)
            for (a, v), w in arcs.items():
                if a == u:
                    heapq.heappush(todo, (d + (w - w % 3 if colour else w), colour, v))
    assert {r.id: r.dist for r in found["competing"]} == {u: d for u, (d, c) in settled.items() if not c}


def test_flow_over_all_nations(spark, arcs):
    want = largest_flow({k: w for k, w in arcs.items() if k[0] != k[1]}, 0, 9)
    for name in ("max_flow_value", "min_cut_value"):
        assert [r.value for r in QUERIES[name](spark, SF).collect()] == [want]


def test_labels_and_knapsacks_over_all_rows(spark):
    labels = {}
    for r in datasets.read(spark, SF, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").collect():
        labels.setdefault(r[0] % 50, set()).add((r[1], r[2] % 20))
    want = {(i, *x): x not in least_front(at) for i, at in labels.items() for x in at}
    assert {(r.id, r.blue, r.red): r.dominated for r in QUERIES["dominated_labels"](spark, SF).collect()} == want
    brands = {}
    for r in datasets.read(spark, SF, "part").collect():
        brands.setdefault(r.p_brand, []).append((int(r.p_retailprice), r.p_size))
    assert max(map(len, brands.values())) > 12
    for name, repeat in (("knapsack_value", False), ("unbounded_knapsack_value", True)):
        want = {}
        for brand, items in brands.items():
            most = [0] * 61
            for value, cost in items:
                for c in range(cost, 61) if repeat else range(60, cost - 1, -1):
                    most[c] = max(most[c], most[c - cost] + value)
            want[brand] = most[60]
        assert {r.problem_id: r.value for r in QUERIES[name](spark, SF).collect()} == want
