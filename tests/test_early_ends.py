"""Buckets, early ends and two-sided bounds of path searches, against a plain heap."""

import heapq

import pytest
from graphs import ids
from pyspark.sql import functions as F

from arcspark.functions.semiring import MOST_RELIABLE_PATH
from arcspark.graph import Graph, GraphError
from arcspark.operators import paths
from arcspark.plans import fixpoint


def heap_order(n, arcs, sources):
    """(vertex, distance) in the order in which a heap of (distance, vertex) settles them."""
    out, heap, done = {}, sorted((0, s) for s in sources), {}
    for u, v, w in arcs:
        out.setdefault(u, []).append((v, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u not in done:
            done[u] = d
            for v, w in out.get(u, ()):
                heapq.heappush(heap, (d + w, v))
    return list(done.items())


def made(spark, n, arcs, kind="long"):
    rows = [(i, u, v, w) for i, (u, v, w) in enumerate(arcs)]
    return Graph(spark.range(n).select("id"), spark.createDataFrame(rows, f"arc_id long, src long, dst long, w {kind}"))


def grid(spark, n):
    v = spark.range(n * n)
    steps = [(F.col("id") % n < n - 1, 1), (F.col("id") < n * (n - 1), n)]
    ahead = [v.where(ok).select(F.col("id").alias("src"), (F.col("id") + step).alias("dst")) for ok, step in steps]
    arcs = ahead[0].unionByName(ahead[1])
    arcs = arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return Graph(v.select("id"), arcs.select((F.col("src") * n * n + F.col("dst")).alias("arc_id"), "src", "dst", F.lit(1).cast("long").alias("w")))


@pytest.mark.parametrize("delta", [None, 2])
def test_any_bucket_gives_the_same_labels(spark, rng, delta):
    arcs = [(rng.randrange(40), rng.randrange(40), rng.choice([0, 1, 2, 3, 50])) for _ in range(120)]
    want = heap_order(40, arcs, [0, 7])
    g = made(spark, 40, arcs)
    assert sorted(tuple(r) for r in paths.shortest_paths(g, "w", ids(spark, 0, 7), delta=delta).collect()) == sorted(want)


def test_limits_and_targets(spark, rng):
    arcs = [(rng.randrange(60), rng.randrange(50), rng.randrange(9)) for _ in range(150)] + [(3, v, 4) for v in range(12)]
    order = heap_order(60, arcs, [3])
    g, start, by = made(spark, 60, arcs), ids(spark, 3), lambda r: (r[1], r[0])
    order.sort(key=by)
    for n in (0, 7):
        assert sorted((tuple(r) for r in paths.shortest_paths(g, "w", start, limit=n, delta=9).collect()), key=by) == order[:n]
    far = dict(order)
    for asked in ([order[9][0], order[20][0]],):
        got = paths.shortest_paths(g, "w", start, targets=ids(spark, *asked), delta=4, store_paths=True)
        most = max(far[t] for t in asked)
        assert sorted(((r.id, r.dist) for r in got.collect()), key=by) == [x for x in order if x[1] <= most]
        assert {r.target for r in paths.path_to(got, ids(spark, *asked)).collect()} == {t for t in asked if t != 3}
    assert paths.shortest_paths(g, "w", start, targets=ids(spark, 59, order[2][0])).count() == len(order)
    assert paths.shortest_paths(g, "w", start, targets=ids(spark).limit(0)).count() == 0
    with pytest.raises(GraphError, match="add up"):
        paths.shortest_paths(g.with_arc_map("p", F.lit(0.5)), "p", start, MOST_RELIABLE_PATH, limit=3)


def test_an_early_end_settles_a_part_and_writes_what_improved(spark, monkeypatch):
    n, written = 40, []
    g = grid(spark, n)
    add = paths.Labels.add

    def counted(self, part):
        written.append(part.count())
        add(self, part)

    monkeypatch.setattr(paths.Labels, "add", counted)
    assert paths.shortest_paths(g, "w", ids(spark, 0), targets=ids(spark, 5), delta=2).count() == 21
    assert sum(written) < 60  # of 1600 vertices
    written.clear()
    assert paths.shortest_paths(g, "w", ids(spark, 0), max_dist=12).count() == 13 * 14 // 2
    assert max(written) <= 13 and sum(written) == 13 * 14 // 2 - 1  # each label once, a front a round
    settled = []
    s, t = 20 * n + 15, 20 * n + 21
    dist, arcs = paths.bidirectional_shortest_path(g, "w", ids(spark, s), ids(spark, t), delta=1, settled=settled)
    assert dist.first().dist == 6 and arcs.count() == 6
    assert sum(settled) < 85  # one search to distance 6 alone settles 85, both without bounds 3200


def test_many_rounds_are_merged(spark, rng, monkeypatch):
    monkeypatch.setattr(paths, "COMPACT_EVERY", 3)
    arcs = [(i, i + 1, 1 + i % 3) for i in range(14)] + [(rng.randrange(15), rng.randrange(15), 20) for _ in range(15)]
    g = made(spark, 15, arcs)
    assert sorted(tuple(r) for r in paths.shortest_paths(g, "w", ids(spark, 0), delta=4).collect()) == sorted(heap_order(15, arcs, [0]))


def test_two_sides_by_a_plain_heap(spark, rng):
    for kind, pairs in (("long", ((0, 1), (2, 2))), ("double", ((5, 28),))):
        arcs = [(rng.randrange(30), rng.randrange(30), rng.randrange(20) if kind == "long" else rng.randrange(80) / 4) for _ in range(90)]
        g = made(spark, 30, arcs, kind)
        for s, t in pairs:
            want = dict(heap_order(30, arcs, [s])).get(t)
            for delta in (12,):
                dist, found = paths.bidirectional_shortest_path(g, "w", ids(spark, s), ids(spark, t), delta=delta)
                assert dist.first().dist == want
                if want is not None:
                    chosen = [arcs[r.arc_id] for r in found.orderBy("pos").collect()]
                    assert [s, *(v for _, v, _ in chosen)] == [*(u for u, _, _ in chosen), t] and sum(w for *_, w in chosen) == want


def test_rounds_end_with_an_error(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "MAX_ROUNDS", 3)
    with pytest.raises(GraphError, match="rounds"):
        paths.shortest_paths(grid(spark, 9), "w", ids(spark, 0), limit=80, delta=40)
