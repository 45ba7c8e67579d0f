"""Exact knapsacks by dominance lists, one task per problem, problems side by side.

Of the items of one cost only the best few can be in a best selection (as many as the budget
pays for; the best one where items repeat), so Spark drops the others before a problem's items meet in
a task: with whole costs that leaves about budget * ln(budget) of them, however many there were.

A task keeps the selections of the items so far that no cheaper one equals in value, as sorted arrays of
costs and values (dynamic programming over Pareto frontiers). An item shifts the whole
frontier, and one merge drops what is dominated. For each kept selection the place of the one it came
from is stored, so the items are found by walking back. Where the frontiers of a problem outgrow
``MAX_POINTS``, as real costs can make them, depth-first branch and bound goes on instead.

The selection is defined: the greatest value, then the least cost, then as few as possible of the
last item by id, of the last but one, and so on (branch and bound: one of the greatest value).
"""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcspark.graph import GraphError
from arcspark.plans.fixpoint import per_group

MAX_ITEMS, MAX_POINTS = 100_000, 20_000_000

Late = Callable[[], bool]


class Frontier:
    """Costs and values, both rising, of the selections that no other dominates."""

    def __init__(self, budget, kind: type) -> None:
        self.budget, self.points = budget, 1
        self.costs, self.values = np.zeros(1, kind), np.zeros(1, kind)
        self.layers: list[tuple[int, int, np.ndarray]] = []  # item, copies, 2 * place before + taken

    def offer(self, item: int, copies: int, cost, value) -> None:
        """Each selection may be joined by so many copies of an item."""
        fit = int(np.searchsorted(self.costs, self.budget - cost, "right"))
        costs = np.concatenate([self.costs, self.costs[:fit] + cost])
        values = np.concatenate([self.values, self.values[:fit] + value])
        came = np.concatenate([2 * np.arange(len(self.costs)), 2 * np.arange(fit) + 1])
        order = np.argsort(-values, kind="stable")  # of equals the one without the item comes first
        order = order[np.argsort(costs[order], kind="stable")]
        costs, values, came = costs[order], values[order], came[order]
        kept = np.ones(len(values), bool)
        kept[1:] = values[1:] > np.maximum.accumulate(values)[:-1]
        self.costs, self.values = costs[kept], values[kept]
        self.layers.append((item, copies, came[kept].astype(np.int32)))
        self.points += len(self.costs)

    def best(self) -> dict[int, int]:
        """``{item: count}`` of the selection of greatest value."""
        at, taken = len(self.costs) - 1, {}
        for item, copies, came in reversed(self.layers):
            at, with_it = divmod(int(came[at]), 2)
            if with_it:
                taken[item] = taken.get(item, 0) + copies
        return taken


def _by_lists(values: list, costs: list, budget, repeat: bool, late: Late) -> tuple[dict[int, int], bool] | None:
    """``{index: count}`` and whether all items were offered; None where the lists outgrow memory."""
    whole = all(isinstance(x, (int, np.integer)) for x in (*values, *costs)) and sum(map(int, values)) * (1 + int(budget) * repeat) < 2**62
    front = Frontier(budget, np.int64 if whole else np.float64 if all(isinstance(x, (int, float)) for x in (*values, *costs)) else object)
    for i, (value, cost) in enumerate(zip(values, costs, strict=True)):
        copies = 1
        while copies * cost <= budget:
            front.offer(i, copies, copies * cost, copies * value)
            if late():
                return front.best(), False
            if front.points > MAX_POINTS:
                return None
            copies *= 2
            if not repeat:
                break
    return front.best(), True


def _searched(values: list, costs: list, budget, repeat: bool, late: Late) -> tuple[dict[int, int], bool]:
    """``{index: count}`` of the best selection found, and whether the search finished.

    Depth first with an explicit stack, by falling value per cost: take as much as fits, and turn back
    where the rest, taken in fractions, can't beat the best.
    """
    order = sorted(range(len(values)), key=lambda i: (-(values[i] / costs[i]) if costs[i] else float("-inf"), costs[i], i))
    if repeat:
        order = _undominated(order, values, costs)
    v, c = [values[i] for i in order], [costs[i] for i in order]
    n = len(order)
    most = [int(budget // x) if repeat else 1 for x in c]
    sum_v, sum_c = np.cumsum([0, *v]).tolist(), np.cumsum([0, *c]).tolist()

    def bound(k: int, left):
        if k == n:
            return 0
        if repeat:
            return v[k] * left / c[k]
        m = bisect_right(sum_c, sum_c[k] + left) - 1
        return sum_v[m] - sum_v[k] + (v[m] * (left - sum_c[m] + sum_c[k]) / c[m] if m < n else 0)

    counts, value, left, k, steps = [0] * n, 0, budget, 0, 0
    best_value, best = 0, {}
    while True:
        while k < n:  # down: greedily
            counts[k] = fit = most[k] if not c[k] else min(most[k], int(left // c[k]))
            value, left, k = value + fit * v[k], left - fit * c[k], k + 1
        if value > best_value:
            best_value, best = value, {order[i]: x for i, x in enumerate(counts) if x}
        while True:  # back: one less of the last item whose rest may still win
            k -= 1
            while k >= 0 and not counts[k]:
                k -= 1
            if k < 0:
                return best, True
            counts[k] -= 1
            value, left = value - v[k], left + c[k]
            if value + bound(k + 1, left) > best_value:
                k += 1
                break
            value, left = value - counts[k] * v[k], left + counts[k] * c[k]
            counts[k] = 0
        steps += 1
        if steps % 256 == 0 and late():
            return best, False


def _undominated(order: list[int], values: list, costs: list) -> list[int]:
    """Without items that several of a cheaper one replace at no loss."""
    kept: list[int] = []
    for i in order:
        if not any(int(costs[i] // costs[j]) * values[j] >= values[i] for j in kept):
            kept.append(i)
    return kept


def candidates(items: DataFrame, budgets: DataFrame, repeat: bool) -> DataFrame:
    """The items that a best selection can hold, with their budget: of each cost the most valuable, as many as fit."""
    rows = items.select("problem_id", "item_id", "value", "cost").join(budgets.select("problem_id", "budget"), "problem_id").where("value > 0 and cost <= budget")
    place = F.row_number().over(W.partitionBy("problem_id", "cost").orderBy(F.desc("value"), "item_id"))
    fit = F.lit(1) if repeat else F.when(F.col("cost") > 0, F.floor(F.col("budget") / F.when(F.col("cost") > 0, F.col("cost"))))
    return rows.withColumn("place", place).withColumn("fit", fit).where("fit is null or place <= fit").drop("place", "fit")


def knapsack(items: DataFrame, budgets: DataFrame, repeat: bool = False, timeout: float | None = None, max_items: int = MAX_ITEMS) -> DataFrame:
    """``problem_id, item_id, value, cost, count, optimal`` of the items of a best selection.

    ``items``: problem_id, item_id, value, cost; ``budgets``: problem_id, budget. With ``repeat``
    an item may be taken any number of times. With ``timeout`` seconds a problem's best
    selection so far is given and ``optimal`` is false where the search hadn't finished.
    GraphError: null or negative values or costs, or costs of 0 with ``repeat``; more than
    ``max_items`` candidates of one problem.
    """
    least = "cost <= 0" if repeat else "cost < 0"
    if not items.where(f"value is null or cost is null or value < 0 or {least}").isEmpty():
        raise GraphError("values and costs must be 0 or more, and costs over 0 if items repeat")
    kinds = dict(items.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        deadline = None if timeout is None else time.monotonic() + timeout
        late = lambda: deadline is not None and time.monotonic() > deadline
        pdf = pdf.sort_values("item_id", kind="stable").reset_index(drop=True)
        problem = pdf.value.tolist(), pdf.cost.tolist(), pdf.budget.tolist()[0], repeat, late
        chosen, finished = _by_lists(*problem) or _searched(*problem)
        out = pdf.loc[sorted(chosen), ["problem_id", "item_id", "value", "cost"]]
        return out.assign(count=[chosen[i] for i in sorted(chosen)], optimal=finished)

    schema = f"problem_id {kinds['problem_id']}, item_id {kinds['item_id']}, value {kinds['value']}, cost {kinds['cost']}, count long, optimal boolean"
    return per_group(candidates(items, budgets, repeat), "problem_id", solve, schema, max_items)
