"""Flows by rounds of joins, against the task's solver: values, conservation, capacities and both cuts."""

import pytest
from pyspark.sql import functions as F

from arcspark.graph import GraphError
from arcspark.operators import flow
from arcspark.plans import scratch


def problems(spark, rng, kind):
    arcs, ends = [], []
    for p in range(2):
        n = 9 + p
        ends.append((p, 0, n - 1))
        for i in range(4 * n):
            u, v = rng.randrange(n), rng.randrange(n)
            arcs.append((p, i, u, v, rng.choice([0, 1, 2, 5, 9]) if kind == "long" else rng.choice([0.0, 0.3, 1.1, 2.7])))
    arcs += [(9, 0, 0, 1, arcs[0][4] * 0 + 3), (9, 1, 2, 3, arcs[0][4] * 0 + 4)]  # no way from 0 to 3
    ends.append((9, 0, 3))
    return spark.createDataFrame(arcs, f"problem_id int, arc_id long, src long, dst long, capacity {kind}"), spark.createDataFrame(ends, "problem_id int, s long, t long")


@pytest.mark.parametrize("kind, most", [("long", 0), ("double", 40)])
def test_flows_by_rounds(spark, rng, kind, most):
    arcs, ends = problems(spark, rng, kind)
    flows = flow.max_flow(arcs, ends, max_arcs=most).persist()
    assert flows.count() == arcs.count() and flows.dtypes == flow.max_flow(arcs, ends).dtypes
    want = {r.problem_id: r.value for r in flow.flow_value(flow.max_flow(arcs, ends), ends).collect()}
    got = {r.problem_id: r.value for r in flow.flow_value(flows, ends).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in want)
    terminal = {(r.problem_id, v) for r in ends.collect() for v in (r.s, r.t)}
    net = {}
    for r in flows.collect():
        assert 0 <= r.flow <= r.capacity
        net[r.problem_id, r.src] = net.get((r.problem_id, r.src), 0) - r.flow
        net[r.problem_id, r.dst] = net.get((r.problem_id, r.dst), 0) + r.flow
    assert all(abs(x) < 1e-8 for v, x in net.items() if v not in terminal)
    for side in ("source", "target"):
        cut = {r.problem_id: r.c for r in flow.minimum_cut(flows, side).groupBy("problem_id").agg(F.sum("capacity").alias("c")).collect()}
        assert all(abs(cut.get(p, 0) - v) < 1e-8 for p, v in want.items())
    flows.unpersist()


def test_a_round_writes_only_arcs_with_flow(spark, monkeypatch):
    # 0 to 4 by way of 1, 2 and 3, and 400 arcs beside, which no flow takes
    rows = [(1, 0, 0, 1, 5), (1, 1, 1, 2, 3), (1, 2, 2, 3, 9), (1, 3, 3, 4, 2)] + [(1, 4 + k, 10 + k, 11 + k, 1) for k in range(400)]
    arcs = spark.createDataFrame(rows, "problem_id int, arc_id long, src long, dst long, capacity long")
    ends = spark.createDataFrame([(1, 0, 4)], "problem_id int, s long, t long")
    written = []
    write = flow.materialise

    def counted(df, name, **options):
        out = write(df, name, **options)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(flow, "materialise", counted)
    found = {r.arc_id: r.flow for r in flow.max_flow(arcs, ends, max_arcs=0).collect()}
    assert len(found) == 404 and {k: f for k, f in found.items() if f} == {0: 2, 1: 2, 2: 2, 3: 2}
    assert max(n for name, n in written if name in ("flow", "moved", "excess")) <= 4
    assert [n for _, n in written].count(404) == 1


def test_flows_beyond_broadcasts(spark, rng, monkeypatch):
    arcs, ends = problems(spark, rng, "long")
    arcs, ends = arcs.where("problem_id = 0"), ends.where("problem_id = 0")
    told = sorted(map(tuple, flow.max_flow(arcs, ends, max_arcs=0).collect()))
    monkeypatch.setattr(scratch, "TOLD_ROWS", 0)
    assert sorted(map(tuple, flow.max_flow(arcs, ends, max_arcs=0).collect())) == told


def test_terminals_without_arcs(spark):
    arcs = spark.createDataFrame([(1, 0, 5, 6, 2)], "problem_id int, arc_id long, src long, dst long, capacity long")
    ends = spark.createDataFrame([(1, 7, 8)], "problem_id int, s long, t long")
    assert [tuple(r) for r in flow.max_flow(arcs, ends, max_arcs=0).collect()] == [(1, 0, 5, 6, 2, 0, False, False)]
    with pytest.raises(GraphError):
        flow.max_flow(arcs, ends.withColumn("t", F.col("s")), max_arcs=0)
