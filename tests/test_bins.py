"""Small weak components share tasks: calls of a kernel are few, and results those of each component alone."""

import pytest
from graphs import rows
from pyspark.sql import functions as F

from arcspark.graph import Graph
from arcspark.operators import traverse


@pytest.mark.parametrize("bin_rows", [50_000, 20])
def test_small_components_share_tasks(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(traverse, "BIN_ROWS", bin_rows)
    keys = []
    dealt = traverse.per_group
    monkeypatch.setattr(traverse, "per_group", lambda r, key, *rest: keys.append(r.select(key).distinct().count()) or dealt(r, key, *rest))
    k = F.col("id")
    # triangles 3k, 3k + 1, 3k + 2 whose last arc is missing in every other one
    arcs = spark.range(90).where("id % 6 <> 5").select(k.alias("arc_id"), k.alias("src"), F.when(k % 3 == 2, k - 2).otherwise(k + 1).alias("dst"))
    g = Graph(spark.range(91), arcs)
    found = dict(rows(traverse.strongly_connected_components(g)))
    assert found == {v: v - v % 3 if v % 6 < 3 and v < 90 else v for v in range(91)}
    assert keys and keys[0] <= (1 if bin_rows > 1000 else 8)
