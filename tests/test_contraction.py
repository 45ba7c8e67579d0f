"""Components by random contraction: any ids, long chains, centres of stars, and what the rounds write."""

import random

import pytest
from graphs import rows
from pyspark.sql import functions as F

from arcspark.operators import components as C


def plain(pairs):
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return sorted((v, root(v)) for v in parent)


@pytest.mark.parametrize("centre", [1_000_000, 4])
def test_components_of_odd_graphs(spark, monkeypatch, centre):
    monkeypatch.setattr(C, "CENTRE_ROWS", centre)
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(1000, 1150)]
    star = [(-7, 2**62 + k) for k in range(40)] + [(2**62 + 3, -(2**63)), (500, 500)]
    loose = [(rng.randrange(3000, 3080), rng.randrange(3000, 3080)) for _ in range(50)]
    pairs = chain + star + loose
    assert rows(C.component_labels(spark.createDataFrame(pairs, "src long, dst long"))) == plain(pairs)


def test_rounds_write_a_few_times_the_edges(spark, monkeypatch):
    """Rounds shrink: before, each of them wrote all edges again."""
    sizes = []
    write = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: (t := write(df, name), sizes.append((name, t.count())))[0])
    k = F.col("id")
    chains = spark.range(6400).where(k % 64 != 63).select(k.alias("src"), (k + 1).alias("dst"))
    assert C.component_labels(chains).select("component").distinct().count() == 100
    edges = [n for name, n in sizes if name == "edges"]
    assert edges[0] == 6300 and sum(edges) < 3 * 6300 and sum(n for _, n in sizes) < 8 * 6300
