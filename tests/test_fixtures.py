"""Operators against small examples with known answers."""

import pytest
from graphs import HEXAGON, graph, ids, rows
from pyspark.sql import functions as F

from arcspark.functions import rational as R
from arcspark.functions.semiring import MAX_CAPACITY_PATH, MOST_RELIABLE_PATH, SHORTEST_PATH, SPANNING_TREE
from arcspark.graph import Graph, GraphError, UndirectedGraph
from arcspark.operators import flow, knapsack, paths, planar, sampling, traverse, trees, views
from arcspark.operators.components import component_labels
from arcspark.operators.segments import intersections
from arcspark.sources import builders, dot


def test_builder_ids_are_ranks(spark):
    g = graph(spark, 8, "3-4 1-7 5-2 2-4 5-3 6-5 1-2 1-6 2-3")
    want = "1-2 1-6 1-7 2-3 2-4 3-4 5-2 5-3 6-5".split()
    assert [f"{s}-{d}" for _, s, d in rows(g.arcs, "arc_id", "src", "dst")] == want
    assert [a for a, in rows(g.arcs, "arc_id")] == list(range(9))
    with pytest.raises(GraphError):
        graph(spark, 3, "0-3")


def test_compacted_keeps_out_arc_order(spark):
    g = graph(spark, 3, "0-1:100 0-2:101 1-2:102")
    g = builders.compacted(g.with_vertex_map("p", F.col("id") + 10), F.desc("p"))
    assert rows(g.arcs, "arc_id", "src", "dst", "w") == [(0, 1, 0, 102), (1, 2, 1, 100), (2, 2, 0, 101)]
    assert rows(g.vertices, "id", "p") == [(0, 12), (1, 11), (2, 10)]


def test_generators(spark):
    assert builders.erdos_renyi(spark, 100, 0.0).num_arcs() == 0
    assert builders.erdos_renyi(spark, 100, 1.0).num_arcs() == 9900
    a, b = (rows(builders.erdos_renyi(spark, 40, 0.3, 5).arcs) for _ in range(2))
    assert a == b and 300 < len(a) < 640 and all(s != d for _, s, d in a)
    assert rows(builders.complete_digraph(spark, 3).arcs) == [(0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 1, 2), (4, 2, 0), (5, 2, 1)]
    assert builders.complete_digraph(spark, 1).num_arcs() == 0
    assert builders.empty_graph(spark).check().num_vertices() == 0


def test_access_keeps_parallel_arcs_and_loops(spark):
    g = graph(spark, 4, "0-1 0-1 1-1 2-0")
    assert rows(g.out_degree()) == [(0, 2), (1, 1), (2, 1), (3, 0)]
    assert rows(g.in_degree()) == [(0, 1), (1, 3), (2, 0), (3, 0)]
    assert rows(g.out_neighbors()) == [(0, 1), (0, 1), (1, 1), (2, 0)]
    assert rows(g.in_arcs(1), "src") == [(0,), (0,), (1,)]
    u = views.undirect(g)
    assert rows(u.degree()) == [(0, 3), (1, 4), (2, 1), (3, 0)]
    assert u.with_edge_map("m", 3).edges.agg(F.sum("m")).first()[0] == 12
    assert rows(u.edge_endpoints(), "u", "v") == [(0, 1), (0, 1), (0, 2), (1, 1)]


def test_checks(spark):
    g = graph(spark, 3, "0-1 1-2")
    assert g.check() is g
    with pytest.raises(GraphError):
        Graph(g.vertices.unionAll(g.vertices), g.arcs).check()
    with pytest.raises(GraphError):
        Graph(ids(spark, 0, 1), g.arcs).check()
    with pytest.raises(GraphError):
        Graph(g.vertices.withColumnRenamed("id", "x"), g.arcs)
    with pytest.raises(GraphError):
        g.add_arcs(spark.createDataFrame([(0, 9)], "src long, dst long"))
    with pytest.raises(GraphError):
        g.add_vertices(ids(spark, 2))


def test_updates(spark):
    g = graph(spark, 4, "0-1 1-2 2-3 3-0")
    g = g.add_vertices(ids(spark, 9)).add_arcs(spark.createDataFrame([(9, 0)], "src long, dst long"))
    assert rows(g.arcs)[-1] == (4, 9, 0)
    g = g.remove_vertices(ids(spark, 2))
    assert rows(g.arcs) == [(0, 0, 1), (3, 3, 0), (4, 9, 0)]
    g = g.repoint(spark.createDataFrame([(3, None, 1)], "arc_id long, src long, dst long")).remove_arcs(spark.createDataFrame([(0,)], "arc_id long"))
    assert rows(g.arcs) == [(3, 3, 1), (4, 9, 0)]
    assert rows(g.has_vertices(ids(spark, 2, 9))) == [(2, False), (9, True)]
    assert rows(g.has_arcs(spark.createDataFrame([(0,), (3,)], "arc_id long"))) == [(0, False), (3, True)]


def test_views_compose(spark):
    g = graph(spark, 4, "0-1:1 0-2:0 1-0:0 1-2:1 1-3:0 2-0:0 2-1:1 2-3:1 3-1:0 3-2:1")
    kept = g | views.subgraph(None, "w = 1")
    assert rows(kept.out_neighbors()) == [(0, 1), (1, 2), (2, 1), (2, 3), (3, 2)]
    both = g | views.subgraph("id <> 3", "w = 1") | views.reverse
    assert rows(both.out_neighbors()) == [(1, 0), (1, 2), (2, 1)]
    assert rows((both | views.reverse).arcs) == rows((g | views.subgraph("id <> 3", "w = 1")).arcs)
    off = g | views.set_flags(ids(spark, 1), False) | views.set_flags(ids(spark, 1, 2), True)
    assert rows(views.enabled_keys(off.vertices, 1, 3)) == [(1,), (2,)]
    arc = spark.createDataFrame([(0,)], "arc_id long")
    assert (g | views.set_flags(arc, False, arcs=True) | views.subgraph(None, "enabled")).num_arcs() == 9


def test_breadth_first(spark):
    g = graph(spark, 8, HEXAGON + " 7-5:1")
    found = traverse.breadth_first_search(g, ids(spark, 0))
    assert rows(found, "dist", "id") == [(0, 0), (1, 1), (1, 2), (1, 5), (2, 3), (2, 4)]
    assert rows(traverse.reached(g, found))[6:] == [(6, False), (7, False)]
    assert rows(traverse.breadth_first_search(g, ids(spark, 0), max_hops=1), "id") == [(0,), (1,), (2,), (5,)]
    assert rows(traverse.breadth_first_search(g, ids(spark)), "id") == []


def test_depth_first_preorder(spark):
    g = graph(spark, 8, "0-1 0-2 0-3 1-3 2-4 3-5 3-6 4-7 4-5 5-2")
    found = rows(traverse.depth_first_search(g, ids(spark, 0)), "pos", "id", "depth")
    assert [v for _, v, _ in found] == [0, 1, 3, 5, 2, 4, 7, 6]
    assert [d for *_, d in found] == [0, 1, 2, 3, 4, 5, 6, 3]


@pytest.mark.parametrize("task_arcs", [1000, 0])
def test_topological_ranks(spark, task_arcs):
    g = graph(spark, 6, "5-2 5-0 4-0 4-1 2-3 3-1")
    order = traverse.topological_sort(g, task_arcs)
    assert [v for _, v in rows(order, "rank", "id")] == [4, 5, 0, 2, 3, 1]
    g = graph(spark, 9, "0-2 0-3 0-4 1-2 1-7 2-4 2-5 3-4 4-5 5-6 6-8 7-6")
    order = traverse.topological_sort(g, task_arcs)
    assert [r for _, r in rows(order, "id", "rank")] == [0, 0, 1, 1, 2, 3, 4, 1, 5]
    path = rows(paths.path_to(order, ids(spark, 8)), "pos")
    assert len(path) == 5
    cyclic = graph(spark, 4, "0-1 1-2 2-1 2-3")
    assert rows(traverse.topological_sort(cyclic, task_arcs), "id", "rank") == [(0, 0)]
    assert not traverse.is_acyclic(cyclic) and traverse.is_acyclic(g)
    assert rows(traverse.topological_sort(graph(spark, 2, ""), task_arcs), "id") == [(0,), (1,)]


@pytest.mark.parametrize("task_arcs", [1000, 0])
def test_strong_components(spark, task_arcs):
    g = graph(spark, 8, "0-1 1-2 2-0 3-1 3-2 3-5 4-2 4-6 5-3 5-4 6-4 7-5 7-6")
    found = traverse.strongly_connected_components(g, task_arcs)
    assert rows(found) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 3), (6, 4), (7, 7)]
    assert rows(traverse.component_order(g, found)) == [(0, 0), (3, 2), (4, 1), (7, 3)]


def test_components_and_union_find(spark):
    g = graph(spark, 8, "0-1 1-2 1-3 2-0 4-3 5-6 6-5 5-6")
    want = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 5), (6, 5), (7, 7)]
    assert rows(traverse.weakly_connected_components(g)) == want
    assert rows(traverse.connected_components(UndirectedGraph(g))) == want
    pairs = spark.createDataFrame([(11, 20), (3, 3), (14, 14), (None, 5)], "src long, dst long")
    assert rows(component_labels(pairs)) == [(3, 3), (11, 11), (14, 14), (20, 11)]
    assert rows(traverse.weakly_connected_components(builders.empty_graph(spark))) == []


def test_forest(spark):
    g = graph(spark, 4, "0-1 2-1")
    assert rows(traverse.traversal_forest(g, g.vertices)) == [(0, 0), (1, 0), (2, 2), (3, 3)]
    g = graph(spark, 4, "0-1 2-3")
    assert rows(traverse.traversal_forest(g, ids(spark, 2))) == [(2, 2), (3, 2)]
    ordered = spark.createDataFrame([(2, 0), (0, 1)], "id long, pos int")
    assert rows(traverse.traversal_forest(graph(spark, 3, "0-1 2-1"), ordered)) == [(0, 0), (1, 2), (2, 2)]
    assert rows(traverse.traversal_forest(g, ids(spark))) == []


def test_shortest_paths(spark):
    g = graph(spark, 6, HEXAGON)
    found = paths.shortest_paths(g, "w", ids(spark, 0), store_paths=True)
    assert rows(found, "dist", "id") == [(0, 0), (7, 1), (9, 2), (11, 5), (20, 4), (21, 3)]
    assert [a for _, a in rows(paths.path_to(found, ids(spark, 3)), "pos", "arc_id")] == [1, 8]
    assert rows(paths.path_to(found, ids(spark, 0))) == []
    assert rows(paths.shortest_paths(g, "w", ids(spark, 0), max_dist=11), "id") == [(0,), (1,), (2,), (5,)]
    seeded = spark.createDataFrame([(0, 5), (0, 2), (5, 0)], "id long, offset long")
    assert rows(paths.shortest_paths(g, "w", seeded), "id", "dist")[:2] == [(0, 2), (1, 9)]
    part = g | views.induced_subgraph(ids(spark, 0, 1, 4, 5))
    assert rows(paths.shortest_paths(part, "w", ids(spark, 0)), "dist", "id") == [(0, 0), (7, 1), (14, 5), (23, 4)]
    with pytest.raises(GraphError):
        paths.shortest_paths(g, -F.col("w"), ids(spark, 0))


def test_paths_over_cycles_of_zero_length_end(spark):
    g = graph(spark, 4, "0-1:1 1-2:0 2-1:0 2-3:0 1-3:0")
    found = paths.shortest_paths(g, "w", ids(spark, 0), store_paths=True)
    assert rows(paths.path_to(found, ids(spark, 3, 2)), "target", "pos", "arc_id") == [(2, 0, 0), (2, 1, 1), (3, 0, 0), (3, 1, 2)]


def test_other_semirings(spark):
    g = graph(spark, 4, "0-1:5 1-2:3 0-2:2 2-3:9")
    assert rows(paths.shortest_paths(g, "w", ids(spark, 0), MAX_CAPACITY_PATH), "id", "dist")[1:] == [(1, 5), (2, 3), (3, 3)]
    p = g.with_arc_map("p", F.col("w") / 10)
    assert rows(paths.shortest_paths(p, "p", ids(spark, 0), MOST_RELIABLE_PATH), "id", "dist")[2][1] == pytest.approx(0.2)
    for ring, want in ((SHORTEST_PATH, 10), (MOST_RELIABLE_PATH, 21), (MAX_CAPACITY_PATH, 3), (SPANNING_TREE, 3)):
        assert spark.range(1).select(ring.plus(F.lit(7), F.lit(3))).first()[0] == want


def test_bidirectional(spark):
    g = graph(spark, 6, HEXAGON)
    dist, path = paths.bidirectional_shortest_path(g, "w", ids(spark, 0), ids(spark, 3))
    assert dist.first()[0] == 21 and [a for _, a in rows(path, "pos", "arc_id")] == [1, 8]
    dist, path = paths.bidirectional_shortest_path(g, "w", ids(spark, 2), ids(spark, 2))
    assert dist.first()[0] == 0 and rows(path) == []
    dist, path = paths.bidirectional_shortest_path(graph(spark, 2, ""), F.lit(1), ids(spark, 0), ids(spark, 1))
    assert dist.first()[0] is None and rows(path) == []


def test_voronoi(spark):
    g = graph(spark, 6, HEXAGON)
    assert rows(paths.network_voronoi(g, "w", ids(spark, 0, 3, 5)), "id", "dist", "kernel") == [(0, 0, 0), (1, 7, 0), (2, 2, 5), (3, 0, 3), (4, 6, 3), (5, 0, 5)]
    tie = graph(spark, 3, "2-1:1 0-1:1")
    assert rows(paths.network_voronoi(tie, "w", ids(spark, 2, 0)), "id", "kernel") == [(0, 0), (1, 0), (2, 2)]
    assert rows(paths.network_voronoi(g, "w", ids(spark))) == []


def test_pareto(spark):
    g = graph(spark, 10, "0-2:1,4 0-4:2,2 0-5:4,1 0-7:1,11 1-9:1,0 2-3:5,0 2-6:3,0 2-9:1,4 3-9:1,2 4-9:2,3 5-7:5,9 5-9:4,1 6-1:2,0 7-8:1,1 8-9:0,0", ("b", "r"))
    found = paths.pareto_paths(g, "b", "r", ids(spark, 0))
    want = {0: [(0, 0)], 1: [(6, 4)], 2: [(1, 4)], 3: [(6, 4)], 4: [(2, 2)], 5: [(4, 1)], 6: [(4, 4)], 7: [(1, 11), (9, 10)], 8: [(2, 12), (10, 11)], 9: [(2, 8), (4, 5), (7, 4), (8, 2)]}
    assert rows(found, "id", "blue", "red") == sorted((v, *x) for v, front in want.items() for x in front)
    kept = spark.createDataFrame([(0, 1, 1)], "id long, blue long, red long")
    asked = spark.createDataFrame([(0, b, r) for b in range(3) for r in range(3)], "id long, blue long, red long")
    assert [(b, r) for _, b, r, d in rows(paths.is_dominated(kept, asked)) if d] == [(1, 2), (2, 1), (2, 2)]
    with pytest.raises(GraphError):
        paths.pareto_paths(g, "b", "r", ids(spark, 0), max_labels=3)


COMPETING = (
    "0-1:1,2 0-6:1,2 0-7:3,3 1-0:1,2 1-2:4,4 2-1:4,4 2-3:2,3 2-7:1,3 3-2:2,3 3-4:1,2 3-5:1,3 4-3:1,2 4-5:1,3 5-3:1,3 5-4:1,3 5-6:2,2 "
    "5-7:1,2 6-0:1,2 6-5:2,2 7-0:3,3 7-2:1,3 7-5:1,2"
)


@pytest.mark.parametrize("task_arcs", [1000, 0])
def test_competing(spark, task_arcs):
    g = graph(spark, 8, COMPETING, ("reduced", "full"))
    g = g.remove_arcs(spark.createDataFrame([(1,)], "arc_id long"))
    blue = spark.createDataFrame([(6, 2)], "id long, offset long")
    assert rows(paths.competing_searches(g, "full", "reduced", blue, ids(spark, 0), task_arcs), "id") == [(4,), (5,), (6,)]


def test_flow_and_cuts(spark):
    g = graph(spark, 6, "0-1:16 0-2:13 1-2:10 1-3:12 2-1:4 2-4:14 3-2:9 3-5:20 4-3:7 4-5:4", ("capacity",))
    ends = spark.createDataFrame([(0, 0, 5)], "problem_id int, s long, t long")
    flows = flow.max_flow(g.arcs.withColumn("problem_id", F.lit(0)), ends)
    assert rows(flow.flow_value(flows, ends)) == [(0, 23)]
    assert rows(flow.minimum_cut(flows), "src", "dst") == [(1, 3), (4, 3), (4, 5)]
    assert flow.minimum_cut(flows, "target").agg(F.sum("capacity")).first()[0] == 23
    for capacity in (107, 0):
        one = graph(spark, 2, f"0-1:{capacity}", ("capacity",)).arcs.withColumn("problem_id", F.lit(0))
        ends = spark.createDataFrame([(0, 0, 1)], "problem_id int, s long, t long")
        assert rows(flow.flow_value(flow.max_flow(one, ends), ends)) == [(0, capacity)]
    with pytest.raises(GraphError):
        flow.max_flow(one, spark.createDataFrame([(0, 1, 1)], "problem_id int, s long, t long"))


def test_spanning_forest(spark):
    g = graph(spark, 6, "0-1:7 0-2:9 0-5:14 1-2:10 1-3:15 2-3:12 2-5:2 3-4:6 4-5:11")
    found = trees.spanning_forest(views.undirect(g), "w")
    assert [e for _, e in rows(found, "cost", "edge_id")] == [6, 7, 0, 1, 8]
    assert rows(trees.spanning_forest(views.undirect(graph(spark, 3, "").with_arc_map("w", 1)), "w")) == []
    looped = graph(spark, 4, "0-0:1 0-1:2 1-2:3")
    assert rows(trees.spanning_forest(views.undirect(looped), "w"), "edge_id") == [(1,), (2,)]
    assert rows(trees.spanning_tree(views.undirect(graph(spark, 4, "0-1:1 2-3:1")), "w", 2), "edge_id") == [(1,)]


def test_knapsacks(spark):
    items = spark.createDataFrame([(0, i, v, c) for i, (v, c) in enumerate(zip((10, 7, 1, 3, 2), (9, 12, 2, 7, 5)))], "problem_id int, item_id long, value long, cost long")
    budget = spark.createDataFrame([(0, 15)], "problem_id int, budget long")
    assert rows(knapsack.knapsack(items, budget), "item_id", "count") == [(0, 1), (4, 1)]
    assert rows(knapsack.knapsack(items, budget, repeat=True), "item_id", "count") == [(0, 1), (2, 3)]
    small = items.where("item_id < 3")
    for b, best in ((3, 1), (23, 18)):
        got = knapsack.knapsack(small, spark.createDataFrame([(0, b)], "problem_id int, budget long"), timeout=60)
        assert got.agg(F.sum("value")).first()[0] == best and got.first().optimal
    with pytest.raises(GraphError):
        knapsack.knapsack(items.withColumn("cost", F.lit(0)), budget, repeat=True)


def test_sampler_frequencies(spark):
    items = spark.createDataFrame([(0, 2), (1, 4), (2, 8), (3, 16), (4, 16)], "k int, x long").withColumn("weight", 1 / F.col("x"))
    got = dict(sampling.weighted_sample(items, 10_000, seed=3).groupBy("x").count().collect())
    for x, want in ((2, 0.5), (4, 0.25), (8, 0.125), (16, 0.125)):
        assert abs(got[x] / 10_000 - want) < 0.02
    eight = items.withColumn("weight", F.col("weight") * 8)
    assert rows(sampling.weighted_sample(eight, 50, seed=3), "draw", "k") == rows(sampling.weighted_sample(items, 50, seed=3), "draw", "k")
    with pytest.raises(GraphError):
        sampling.weighted_sample(items.where("false"), 1)


def test_segments(spark):
    def points(*segments):
        df = spark.createDataFrame([(i, *s) for i, s in enumerate(segments)], "seg_id long, x1 long, y1 long, x2 long, y2 long")
        return sorted((int(r.x.num), int(r.x.den), int(r.y.num), int(r.y.den), r.segments) for r in intersections(df).collect())

    assert points((0, 0, 4, 4), (0, 4, 4, 0), (2, -1, 2, 5)) == [(2, 1, 2, 1, [0, 1, 2])]
    # collinear overlaps give both their ends; a point of no length lies on both
    assert points((0, 0, 4, 0), (2, 0, 6, 0), (3, 0, 3, 0)) == [(2, 1, 0, 1, [0, 1]), (3, 1, 0, 1, [0, 1, 2]), (4, 1, 0, 1, [0, 1])]
    assert points((0, -1, 2, 1), (0, 1, 3, 0)) == [(3, 2, 1, 2, [0, 1])]
    assert points((0, 0, 1, 0), (3, 0, 4, 0)) == []


def test_dot(spark):
    g = graph(spark, 2, "0-1:3").with_vertex_map("label", F.lit('a"b\\c')).with_vertex_map("pos", F.struct(F.lit(1.0).alias("x"), F.lit(2.5).alias("y"))).with_arc_map("color", F.lit("red"))
    got = [x for *_, x in rows(dot.dot_lines(g, (5, 7)), "section", "pos", "line")]
    assert got == ['digraph { size="5,7";', '  0 [label="a\\"b\\\\c", pos="1.0,2.5!"];', '  1 [label="a\\"b\\\\c", pos="1.0,2.5!"];', '  0 -> 1 [color="red"];', "}"]


def test_hashed_random_graph_is_neither_sorted_nor_shuffled(spark, monkeypatch):
    from hashlib import md5

    want = [(u, v) for u in range(30) for v in range(30) if u != v and int(md5(f"{u},{v}".encode()).hexdigest()[:8], 16) < 1 << 30]
    plans = []
    write = builders.materialise
    monkeypatch.setattr(builders, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    found = rows(builders.erdos_renyi_md5(spark, 30, 1 << 30).arcs, "arc_id", "src", "dst")
    assert found == [(k, u, v) for k, (u, v) in enumerate(want)]
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Sort" not in plans[0]
    assert builders.erdos_renyi_md5(spark, 5, 1 << 32).arcs.count() == 20 and builders.erdos_renyi_md5(spark, 5, 0).arcs.count() == 0


def test_planar_dual(spark):
    # a triangle 0-1-2: inner face 0, outer face 1
    arcs = [(0, 0, 1, 3, 0), (1, 1, 2, 4, 0), (2, 2, 0, 5, 0), (3, 1, 0, 0, 1), (4, 2, 1, 1, 1), (5, 0, 2, 2, 1)]
    g = Graph(
        spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)], "id long, x double, y double"),
        spark.createDataFrame(arcs, "arc_id long, src long, dst long, twin long, face long"),
    )
    assert rows(planar.faces(g)) == [(0, 3), (1, 3)]
    assert rows(planar.bounding_arcs(g, spark.createDataFrame([(1,)], "face long")), "arc_id") == [(3,), (4,), (5,)]
    assert rows(planar.arc_coordinates(g))[1] == (1, 1.0, 0.0, 0.0, 1.0)
    assert rows(planar.arc_coordinates(g, "face").drop("face")) == rows(planar.arc_coordinates(g)) and planar.arc_coordinates(g, "face").columns[-1] == "face"
    d = planar.dual(g)
    assert rows(d.vertices) == [(0,), (1,)] and rows(d.arcs, "arc_id", "src", "dst") == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 0, 1), (5, 0, 1)]
    with pytest.raises(GraphError):
        planar.dual(Graph(g.vertices, g.arcs.withColumn("twin", F.lit(0))))


def test_dual_deals_each_arc_once(spark, monkeypatch):
    plans = []
    write = planar.materialise
    monkeypatch.setattr(planar, "materialise", lambda df, *args, **options: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *args, **options))

    def dual(*arcs):
        table = spark.createDataFrame(arcs, "arc_id long, src long, dst long, twin int, face int, label string")
        return planar.dual(Graph(spark.createDataFrame([(0,), (1,)], "id long"), table))

    there, back, own = (0, 0, 1, 1, 5, "a"), (1, 1, 0, 0, 6, None), (2, 1, 1, 2, 7, "c")
    d = dual(there, back, own)
    assert rows(d.arcs) == [(0, 6, 5, 1, "a"), (1, 5, 6, 0, None), (2, 7, 7, 2, "c")] and rows(d.vertices) == [(5,), (6,), (7,)]
    assert [dict(d.arcs.dtypes)[c] for c in ("src", "twin", "label")] == ["bigint", "int", "string"]
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and "Join" not in plans[0]
    for bad in ([there], [there, (*back[:3], None, *back[4:])], [there, (1, 1, 0, 2, 6, "b"), own], [there, there, back], [(0, 0, 1, None, 5, "a")]):
        with pytest.raises(GraphError):
            dual(*bad)


def test_rationals_are_exact(spark):
    big = 10**12
    row = spark.range(1).select(
        R.add(R.rational(1, 3), R.rational(1, 6)).alias("a"), R.multiply(R.rational(-2, big), R.rational(big, 4)).alias("m"),
        R.divide(R.rational(3, 4), R.rational(-3, 8)).alias("d"), R.subtract(R.rational(1, 2), R.rational(1, 2)).alias("z"),
        R.rational(-5, 0).alias("inf"), R.negate(R.rational(2, -6)).alias("n"), R.compare(R.rational(1, 0), R.rational(10**9, 1)).alias("c"),
        R.compare(R.rational(-1, 3), R.rational(-1, 4)).alias("l"), R.gcd(F.lit(0), F.lit(0)).alias("g"),
        R.overflows(F.lit(1 << 62), F.lit(1 << 62), "+").alias("o"), R.overflows(F.lit(3), F.lit(4), "*").alias("p"), R.bounded(F.lit(5), 0, 9).alias("b"),
    ).first()
    assert [tuple(map(int, row[k])) for k in ("a", "m", "d", "z", "inf", "n")] == [(1, 2), (-1, 2), (-2, 1), (0, 1), (1, 0), (1, 3)]
    assert (row.c, row.l, int(row.g), row.o, row.p, row.b) == (1, -1, 0, True, False, 5)
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(R.bounded(F.lit(10), 0, 9)).collect()
