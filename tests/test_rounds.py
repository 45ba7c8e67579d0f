"""Loops end with whole results or an error, and long chains don't need a round for each step."""

import pytest
from graphs import ids
from pyspark.sql import functions as F

from arcspark.graph import Graph, GraphError, UndirectedGraph
from arcspark.operators import paths, traverse, trees
from arcspark.operators.components import component_labels
from arcspark.plans import fixpoint, scratch


def chain(spark, n):
    arcs = spark.range(n - 1).select(F.col("id").alias("arc_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("w"))
    return Graph(spark.range(n).select("id"), arcs)


def test_loops_raise_rather_than_stop_early(spark, monkeypatch):
    g = chain(spark, 9)
    monkeypatch.setattr(fixpoint, "MAX_ROUNDS", 3)
    one = ids(spark, 0)
    ends = ids(spark, 8)
    calls = [
        lambda: traverse.breadth_first_search(g, one),
        lambda: traverse.topological_sort(g, task_arcs=0),
        lambda: traverse.is_acyclic(g, traverse.topological_sort(g, task_arcs=0)),
        lambda: traverse.traversal_forest(g, one),
        lambda: traverse.strongly_connected_components(g, task_arcs=0),
        lambda: paths.shortest_paths(g, "w", one),
        lambda: paths.bidirectional_shortest_path(g, "w", one, ends),
        lambda: paths.competing_searches(g, "w", "w", one, ends, task_arcs=0),
        lambda: paths.pareto_paths(g, "w", "w", one),
    ]
    for call in calls:
        with pytest.raises(GraphError, match="rounds"):
            call()
    assert traverse.breadth_first_search(g, one, max_hops=2).count() == 3
    assert trees.spanning_forest(UndirectedGraph(chain(spark, 3)), "w").count() == 2


def test_long_chain(spark):
    n = 50_000
    g = chain(spark, n)
    found = traverse.breadth_first_search(g, ids(spark, 0))
    wrong = F.sum((F.col("id") != F.col("dist")).cast("int")).alias("wrong")
    back = F.sum((F.col("pred_arc") != F.col("id") - 1).cast("int")).alias("back")
    assert found.agg(F.count("*"), wrong, back, F.countDistinct("id")).first() == (n, 0, 0, n)
    assert traverse.breadth_first_search(g, ids(spark, 0), max_hops=40).count() == 41
    order = traverse.topological_sort(g)
    assert order.agg(F.count("*"), F.sum((F.col("id") != F.col("rank")).cast("int"))).first() == (n, 0)
    assert traverse.is_acyclic(g, order)


def test_search_by_rounds_and_by_tasks_agree(spark, rng, monkeypatch):
    arcs = [(i, rng.randrange(60), rng.randrange(60)) for i in range(80)] + [(100 + i, 100 + i, 101 + i) for i in range(9)] + [(200, 105, 100)]
    g = Graph(spark.createDataFrame([(i,) for i in [*range(60), *range(100, 110)]], "id long"), spark.createDataFrame(arcs, "arc_id long, src long, dst long"))
    start = ids(spark, 0, 1, 100)
    want = sorted(traverse.breadth_first_search(g, start).collect())
    for hops, most in ((1, 10**6), (2, 10**6), (3, 20)):
        monkeypatch.setattr(traverse, "ROUND_HOPS", hops)
        monkeypatch.setattr(traverse, "TASK_ARCS", most)
        assert sorted(traverse.breadth_first_search(g, start).collect(), key=lambda r: r.id) == sorted(want, key=lambda r: r.id)


def test_components_of_a_star_and_a_path(spark):
    edges = spark.range(1, 3000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).union(spark.range(5000, 7000).selectExpr("id", "id + 1"))
    found = component_labels(edges)
    assert {(r.component, r["count"]) for r in found.groupBy("component").count().collect()} == {(0, 3000), (5000, 2001)}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Java:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False
                        return Option
                return Java

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match=r"checkpoint\.dir"):
        scratch.shared_folder(Session)
