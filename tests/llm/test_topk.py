import math

import numpy as np
import pytest

from arcspark.llm import topk
from arcspark.llm.queries import op11_exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def brute(rows, nth=20, k=20):
    """Plain Python over all pairs; scores of rows that share an id count each."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in kept if i % nth == 0}):
        scored = [(-sum(a * b for a, b in zip(v, w)), j) for i, v in kept if i == q for j, w in kept if j != q]  # noqa: B905 (the shorter one counts as filled up with zeros)
        out += [(q, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return out


def got(df, **options):
    return sorted(tuple(r) for r in topk.search(df, **options).collect())


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "BLOCK", 8)


def test_equals_brute_force(spark, rng, small_parts):
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(9)], None, "x", 1) for i in rng.sample(range(-900, 900), 600)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(brute(rows))
    assert got(df) == want == got(df.repartition(40))


def test_odd_rows(spark, rng, small_parts):
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)], 0, None, None) for i in range(120)]  # many ties
    rows += [(200, None, 1, "", 0), (220, [0.5, None], 1, "", 0), (240, [math.nan, 1.0], 1, "", 0), (260, [math.inf], 1, "", 0), (None, [1.0, 1.0, 1.0], 1, "", 0)]
    rows += [(280, [], 1, "", 0), (300, [1.0] * 7, 1, "", 0), (301, [-2.0], 1, "", 0), rows[20], rows[20], rows[21], (40, [9.0, 9.0, 9.0], 1, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == sorted(brute(rows))
    assert got(df.filter("vec_id % 20 <> 0")) == [] == got(df.limit(0))
    assert len(got(df.filter("vec_id in (20, 33)"))) == 3  # three rows of one id, fewer candidates than k


def test_large_weights_are_exact(spark, small_parts):
    rows = [(i, [float(2**24 + 2 * i), -1.0, float(i)], 0, None, None) for i in range(0, 60, 3)] + [(61, [3e6, 1.0, 0.5], 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == sorted(brute(rows))
    with pytest.raises(Exception, match="64 bits|too large|OverflowError"):
        got(spark.createDataFrame([(0, [3e20], 0, None, None), (1, [3e20], 0, None, None)], SCHEMA))


def test_blocks_are_pruned():
    """Ranges of like vectors are skipped, and the result doesn't change."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-60, 60, (40, 16))
    weights = np.repeat(centres, 4 * topk.BLOCK, axis=0) + rng.integers(-2, 3, (40 * 4 * topk.BLOCK, 16))
    ids = np.arange(len(weights))
    best = topk.Best(ids[::20], weights[::20], 20)
    for at in range(0, len(ids), 2048):
        part = weights[at : at + 2048]
        best.search(ids[at : at + 2048], part, *topk._bounds(part))
    assert best.scored < 0.3 * best.blocks
    scores = weights[::20] @ weights.T
    scores[np.arange(len(best.ids)), best.ids] = topk.NONE_YET
    want = np.sort(scores, axis=1)[:, ::-1][:, :20]
    assert (best.scores.reshape(-1, 20) == want).all()


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in op11_exact_top_k(spark, sf_dir).collect()) == sorted(brute(rows))
