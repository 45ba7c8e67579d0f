"""Operators against plain algorithms on random multigraphs, many at once as one disjoint union."""

import random

import pytest
from graphs import ids, rows
from pyspark.sql import functions as F

from arcspark.graph import Graph
from arcspark.operators import flow, knapsack, paths, traverse, trees, views
from arcspark.operators.segments import intersections

GRAPHS, STEP, FAR = 60, 100, 1 << 20


@pytest.fixture(scope="module")
def many():
    """(first id, n, arcs) of graphs of 2 to 12 vertices, with parallel arcs and self-loops."""
    rng, out = random.Random(5), []
    for k in range(GRAPHS):
        n = 2 + rng.randrange(11)
        arcs = [(STEP * k + rng.randrange(n), STEP * k + rng.randrange(n), 1 + rng.randrange(9)) for _ in range(rng.randrange(2 * n + 4))]
        out.append((STEP * k, n, arcs))
    return out


@pytest.fixture(scope="module")
def union(spark, many):
    vertices = [(a + i,) for a, n, _ in many for i in range(n)]
    arcs = [(i, *x) for i, x in enumerate(sorted(x for *_, arcs in many for x in arcs))]
    return Graph(spark.createDataFrame(vertices, "id long").cache(), spark.createDataFrame(arcs, "arc_id long, src long, dst long, w long").cache())


@pytest.fixture(scope="module")
def distances(many):
    """All-pairs distances of each graph."""
    out = {}
    for a, n, arcs in many:
        d = {(i, j): 0 if i == j else FAR for i in range(a, a + n) for j in range(a, a + n)}
        for u, v, w in arcs:
            d[u, v] = min(d[u, v], w)
        for k in range(a, a + n):
            for i in range(a, a + n):
                for j in range(a, a + n):
                    d[i, j] = min(d[i, j], d[i, k] + d[k, j])
        out.update(d)
    return out


def test_distances_and_paths(spark, many, union, distances):
    found = paths.shortest_paths(union, "w", ids(spark, *(a for a, *_ in many)), store_paths=True).cache()
    got = dict(rows(found, "id", "dist"))
    assert got == {v: d for (a, v), d in distances.items() if a % STEP == 0 and d < FAR}
    weight = dict(rows(union.arcs, "arc_id", "w"))
    total = {}
    for target, _, arc in rows(paths.path_to(found, found.select("id"))):
        total[target] = total.get(target, 0) + weight[arc]
    assert {v: total.get(v, 0) for v in got} == got


def test_voronoi(spark, many, union, distances):
    kernels = [a + i for a, n, _ in many for i in (0, n - 1)]
    found = {v: (d, k) for v, d, k in rows(paths.network_voronoi(union, "w", ids(spark, *kernels)), "id", "dist", "kernel")}
    want = {}
    for (k, v), d in distances.items():
        if k in kernels and d < FAR:
            want[v] = min(want.get(v, (FAR, 0)), (d, k))
    assert found == want


def test_components_orders_and_forests(spark, many, union, distances):
    strong = traverse.strongly_connected_components(union).cache()
    want = {v: min(u for u in range(v // STEP * STEP, v // STEP * STEP + STEP) if (u, v) in distances and distances[u, v] < FAR and distances[v, u] < FAR) for (v, x) in distances if v == x}
    assert dict(rows(strong)) == want
    number = dict(rows(traverse.component_order(union, strong)))
    assert sorted(number.values()) == list(range(len(number)))
    assert all(number[want[u]] >= number[want[v]] for *_, arcs in many for u, v, _ in arcs)
    order = dict(rows(traverse.topological_sort(union), "id", "rank"))
    on_cycle = {u for *_, arcs in many for u, v, _ in arcs if distances[v, u] < FAR}
    behind = {v for (u, v), d in distances.items() if u in on_cycle and d < FAR}
    assert set(order) == set(want) - behind
    assert all(order[u] < order[v] for *_, arcs in many for u, v, _ in arcs if v in order)
    forest = dict(rows(traverse.traversal_forest(union, union.vertices)))
    assert forest == {v: min(u for u in range(v // STEP * STEP, v + STEP) if distances.get((u, v), FAR) < FAR) for v in want}
    hops = dict(rows(traverse.breadth_first_search(union, ids(spark, *(a for a, *_ in many))), "id", "dist"))
    assert set(hops) == {v for (a, v), d in distances.items() if a % STEP == 0 and d < FAR}


def test_spanning_forest(many, union):
    got = {e for e, in rows(trees.spanning_forest(views.undirect(union), "w"), "edge_id")}
    group, want = {}, set()

    def top(v):
        while group.setdefault(v, v) != v:
            v = group[v]
        return v

    for _, e, u, v in sorted(rows(union.arcs, "w", "arc_id", "src", "dst")):
        if top(u) != top(v):
            group[top(u)] = top(v)
            want.add(e)
    assert got == want


def test_flows(spark, many, union):
    """Conservation, capacity, and a cut of the same value."""
    pid = F.floor(F.col("src") / STEP).cast("long")
    arcs = union.arcs.withColumns({"problem_id": pid, "capacity": F.col("w")})
    ends = spark.createDataFrame([(a // STEP, a, a + n - 1) for a, n, _ in many], "problem_id long, s long, t long")
    found = flow.max_flow(arcs, ends).cache()
    value = dict(rows(flow.flow_value(found, ends)))
    balance = {}
    for p, _, u, v, c, f, *_ in rows(found):
        assert 0 <= f <= c
        balance[u] = balance.get(u, 0) - f
        balance[v] = balance.get(v, 0) + f
    for a, n, _ in many:
        for v in range(a, a + n):
            assert balance.get(v, 0) == (-value[a // STEP] if v == a else value[a // STEP] if v == a + n - 1 else 0)
    for side in ("source", "target"):
        cuts = dict(rows(flow.minimum_cut(found, side).groupBy("problem_id").agg(F.sum("capacity"))))
        assert all(cuts.get(p, 0) == v for p, v in value.items())


def test_competing_races_against_settling_in_order(spark, many):
    rng = random.Random(9)
    arcs = [(u, v, w, w - rng.randrange(w + 1)) for *_, part in many[:12] for u, v, w in part]
    g = Graph(spark.createDataFrame([(a + i,) for a, n, _ in many[:12] for i in range(n)], "id long"), spark.createDataFrame([(i, *x) for i, x in enumerate(arcs)], "arc_id long, src long, dst long, full long, reduced long"))
    blue, red = ids(spark, *(a for a, *_ in many[:12])), ids(spark, *(a + n - 1 for a, n, _ in many[:12]))
    task, by_rounds = (rows(paths.competing_searches(g, "full", "reduced", blue, red, most)) for most in (10_000, 0))
    assert task == by_rounds and task


def test_knapsacks_by_brute_force(spark):
    rng, items, want, want_repeat = random.Random(4), [], {}, {}
    for p in range(40):
        mine = [(p, i, rng.randrange(12), 1 + rng.randrange(9)) for i in range(1 + rng.randrange(9))]
        items += mine
        best = [0] * 21
        for budget in range(21):
            best[budget] = max([best[budget - c] + v for _, _, v, c in mine if c <= budget], default=0)
        want_repeat[p] = best[20]
        want[p] = max(sum(x[2] for k, x in enumerate(mine) if m >> k & 1) for m in range(1 << len(mine)) if sum(x[3] for k, x in enumerate(mine) if m >> k & 1) <= 20)
    df = spark.createDataFrame(items, "problem_id int, item_id long, value long, cost long")
    budgets = spark.createDataFrame([(p, 20) for p in range(40)], "problem_id int, budget long")
    for repeat, best in ((False, want), (True, want_repeat)):
        got = knapsack.knapsack(df, budgets, repeat=repeat)
        value = dict(rows(got.groupBy("problem_id").agg(F.sum(F.col("value") * F.col("count")))))
        cost = dict(rows(got.groupBy("problem_id").agg(F.sum(F.col("cost") * F.col("count")))))
        assert {p: v for p, v in best.items() if v} == value and max(cost.values()) <= 20


def test_segments_by_brute_force(spark):
    from fractions import Fraction

    rng = random.Random(8)
    segments = [tuple(rng.randrange(-12, 13) for _ in range(4)) for _ in range(60)]
    points = {}

    def on(p, s):
        (x, y), (x1, y1, x2, y2) = p, s
        return (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)

    for i, s in enumerate(segments):
        for j in range(i):
            t = segments[j]
            det = (s[2] - s[0]) * (t[3] - t[1]) - (s[3] - s[1]) * (t[2] - t[0])
            if det:
                k = Fraction((t[0] - s[0]) * (t[3] - t[1]) - (t[1] - s[1]) * (t[2] - t[0]), det)
                met = [(s[0] + k * (s[2] - s[0]), s[1] + k * (s[3] - s[1]))]
            else:
                met = [p for q in (s, t) for p in (q[:2], q[2:])]
            for p in met:
                if on(p, s) and on(p, t):
                    points.setdefault((Fraction(p[0]), Fraction(p[1])), set()).update((i, j))
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(segments)], "seg_id long, x1 long, y1 long, x2 long, y2 long")
    for cell in (None, 3):
        got = {(Fraction(int(r.x.num), int(r.x.den)), Fraction(int(r.y.num), int(r.y.den))): set(r.segments) for r in intersections(df, cell).collect()}
        assert got == points
