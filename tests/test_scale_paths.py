"""What large inputs take another way for: long segments, many weighted items, sparse random graphs."""

import bisect
import hashlib
import math
from fractions import Fraction

from pyspark.sql import functions as F

from arcspark.operators import sampling
from arcspark.operators.segments import intersections
from arcspark.sources import builders


def test_long_segments_cost_their_length(spark, rng):
    far = 1_000_000
    long = [(1, 0, 0, far, far), (2, 0, far, far, 0), (3, 5, 7, 5, 7), (4, -far, 3, far, 3), (5, 500_000, -far, 500_000, far)]
    found = {(float(r.x.num / r.x.den), float(r.y.num / r.y.den)): list(r.segments) for r in intersections(spark.createDataFrame(long, "seg_id long, x1 long, y1 long, x2 long, y2 long"), cell=2_000).collect()}
    assert found == {(500_000.0, 500_000.0): [1, 2, 5], (3.0, 3.0): [1, 4], (999_997.0, 3.0): [2, 4], (500_000.0, 3.0): [4, 5]}


def test_cells_of_any_size_give_the_same_points(spark, rng):
    rows = [(i, *(rng.randrange(-60, 60) for _ in range(4))) for i in range(60)] + [(100, 0, 0, 40, 40), (101, 10, 10, 30, 30), (102, 7, 7, 7, 7)]
    segments = spark.createDataFrame(rows, "seg_id long, x1 long, y1 long, x2 long, y2 long")
    want = None
    for cell in (1_000, 30, 7):
        got = sorted((r.x.num, r.x.den, r.y.num, r.y.den, tuple(r.segments)) for r in intersections(segments, cell).collect())
        want = want or got
        assert got == want and len(got) > 100


def plain_draws(rows, n, seed):
    """The row of each draw, by whole sums in plain Python; weights come last in a row."""
    rows = sorted(rows)
    bits = 52 - (math.frexp(max(r[-1] for r in rows))[1] - 1)
    ends, total = [], 0
    for r in rows:
        total += int(Fraction(r[-1]) * Fraction(2) ** bits)
        ends.append(total)
    place = [int(hashlib.md5(f"{k}:{seed}".encode()).hexdigest()[:15], 16) * total >> 60 for k in range(n)]
    return [rows[bisect.bisect_right(ends, x)] for x in place]


def test_draws_by_plain_sums(spark, rng):
    """One item holds most of the weight, some hold none; partitions, sizes and powers of two change nothing."""
    rows = [(f"k{i}", i % 7, rng.choice([0.0, 1e-3, 0.3, 1.0, 2.5])) for i in range(500)] + [("heavy", 1, 900.0)] + [("twice", 2, 0.75)] * 2
    items, n = spark.createDataFrame(rows, "name string, part int, weight double"), 3_000
    want = [(k, *r) for k, r in enumerate(plain_draws(rows, n, 3))]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(tuple(r) for r in sampling.weighted_sample(items.repartition(int(parts)), n, seed=3).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    small = items.withColumn("weight", F.col("weight") / 1024)
    assert [r.name for r in sampling.weighted_sample(small, 200, seed=3).orderBy("draw").collect()] == [r[1] for r in want[:200]]
    assert sampling.weighted_sample(items, 0).count() == 0


def test_frequencies_of_draws(spark):
    """Chi-square over 40 items at a level of one in a thousand."""
    items = spark.range(1, 41).select(F.col("id").alias("item"), F.col("id").cast("double").alias("weight"))
    n, total = 40_000, 820
    seen = dict(sampling.weighted_sample(items, n, seed=11).groupBy("item").count().collect())
    assert sum(seen.values()) == n
    assert sum((seen.get(i, 0) - n * i / total) ** 2 / (n * i / total) for i in range(1, 41)) < 72.1  # 39 degrees of freedom


def test_random_graph_has_about_its_share_of_pairs(spark):
    n, p = 2_000, 0.002
    g = builders.erdos_renyi(spark, n, p, 9)
    arcs = g.arcs.select("src", "dst").collect()
    expected = n * (n - 1) * p
    assert abs(len(arcs) - expected) < 6 * math.sqrt(expected) and len(set(arcs)) == len(arcs) and all(a != b for a, b in arcs)
    assert {tuple(a) for a in arcs} == {tuple(a) for a in builders.erdos_renyi(spark.newSession(), n, p, 9).arcs.select("src", "dst").collect()}
