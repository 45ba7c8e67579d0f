"""Dominance lists against brute force: selections, ties, real and decimal costs, many items, timeouts."""

import itertools
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from arcspark.operators import knapsack


def best_selection(items, budget, repeat):
    """Of (id, value, cost): most value, then least cost, then as few as possible of the last item, of the last but one, ..."""
    items = sorted(items)
    counts = [range(int(budget // c) + 1 if repeat else 2) if v and c <= budget else range(1) for _, v, c in items]
    best = None
    for n in itertools.product(*counts):
        cost = sum(k * c for k, (_, _, c) in zip(n, items, strict=True))
        if cost <= budget:
            key = (-sum(k * v for k, (_, v, _) in zip(n, items, strict=True)), cost, n[::-1])
            best = min(best, key) if best else key
    return {i: k for (i, _, _), k in zip(items, best[2][::-1], strict=True) if k}


def found(spark, problems, budget, repeat, kind="long", **options):
    rows = [(p, *x) for p, items in problems.items() for x in items]
    df = spark.createDataFrame(rows, f"problem_id int, item_id long, value {kind}, cost {kind}")
    budgets = spark.createDataFrame([(p, budget) for p in problems], f"problem_id int, budget {kind}")
    out = {}
    for r in knapsack.knapsack(df, budgets, repeat, **options).collect():
        out.setdefault(r.problem_id, {})[r.item_id] = r["count"]
    return out


@pytest.mark.parametrize("repeat", [False, True])
def test_selections_by_brute_force(spark, rng, repeat):
    problems = {p: [(i, rng.randrange(5), rng.randrange(repeat, 6)) for i in range(rng.randint(1, 6))] for p in range(40)}
    want = {p: best_selection(items, 9, repeat) for p, items in problems.items()}
    assert found(spark, problems, 9, repeat) == {p: s for p, s in want.items() if s}


@pytest.mark.parametrize("repeat", [False, True])
def test_real_and_decimal_costs(spark, rng, repeat):
    real = {p: [(i, float(rng.randint(1, 40)) / 4, rng.randint(4, 40) / 8) for i in range(6)] for p in range(10)}
    want = {p: best_selection(items, 7.5, repeat) for p, items in real.items()}
    assert found(spark, real, 7.5, repeat, "double") == want
    exact = {p: [(i, Decimal(str(v)), Decimal(str(c))) for i, v, c in items] for p, items in real.items()}
    assert found(spark, exact, Decimal("7.5"), repeat, "decimal(12,4)") == want


def test_candidates_of_a_cost(spark):
    """A crowd of items of few costs is cut down before it meets in a task, and the selection stays."""
    items = spark.range(40_000).select(F.lit(1).alias("problem_id"), F.col("id").alias("item_id"), (F.col("id") * 7919 % 1009).alias("value"), (1 + F.col("id") % 30).alias("cost"))
    budgets = spark.createDataFrame([(1, 60)], "problem_id int, budget long")
    kept = knapsack.candidates(items, budgets, False)
    assert kept.count() == sum(60 // c for c in range(1, 31))
    assert knapsack.candidates(items, budgets, True).count() == 30
    best = [0] * 61
    for r in kept.collect():
        for c in range(60, r.cost - 1, -1):
            best[c] = max(best[c], best[c - r.cost] + r.value)
    assert knapsack.knapsack(items, budgets, max_items=300).agg(F.sum("value"), F.min("optimal")).first() == (best[60], True)


@pytest.mark.parametrize("repeat", [False, True])
def test_search_where_lists_outgrow_memory(spark, rng, repeat, monkeypatch):
    problems = {p: [(i, rng.randrange(1, 30), rng.randrange(1, 9)) for i in range(7)] for p in range(15)}
    value = {p: sum(problems[p][i][1] * k for i, k in best_selection(items, 12, repeat).items()) for p, items in problems.items()}
    items = {p: {i: v for i, v, _ in x} for p, x in problems.items()}
    for p, x in problems.items():
        values, costs = [v for _, v, _ in x], [c for _, _, c in x]
        assert knapsack._by_lists(values, costs, 12, repeat, lambda: False)[1]
        monkeypatch.setattr(knapsack, "MAX_POINTS", 3)
        assert knapsack._by_lists(values, costs, 12, repeat, lambda: False) is None
        monkeypatch.undo()
        chosen, done = knapsack._searched(values, costs, 12, repeat, lambda: False)
        assert done and sum(items[p][i] * k for i, k in chosen.items()) == value[p]


def test_timeout_keeps_the_best_so_far(spark):
    rows = [(1, i, 1000 + i * 7919 % 1013, 100_000 + i * 104_729 % 99_991) for i in range(400)]
    df = spark.createDataFrame(rows, "problem_id int, item_id long, value long, cost long")
    budgets = spark.createDataFrame([(1, 8_000_000)], "problem_id int, budget long")
    began = time.monotonic()
    got = knapsack.knapsack(df, budgets, timeout=0.0).collect()
    assert time.monotonic() - began < 60
    assert got and not any(r.optimal for r in got) and sum(r.cost for r in got) <= 8_000_000
    assert not knapsack.knapsack(df.limit(0), budgets, timeout=0.2).collect()
