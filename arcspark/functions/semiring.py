"""Semirings that path searches run over."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """``plus`` extends a path value by an arc's; ``best`` ("min" or "max") chooses between values.

    Searches need that ``plus`` never improves a value and keeps the order of values;
    ``domain`` is the closed range of arc values for which that holds (None: no bound).
    """

    name: str
    zero: Callable[[], Column]
    plus: Callable[[Column, Column], Column]
    best: str
    domain: tuple[float | None, float | None] = (None, None)

    def better(self, a: Column, b: Column) -> Column:
        return a < b if self.best == "min" else a > b

    def choose(self, value: Column) -> Column:
        return F.min(value) if self.best == "min" else F.max(value)


SHORTEST_PATH = Semiring("shortest_path", lambda: F.lit(0).cast("long"), lambda a, b: a + b, "min", (0, None))
MOST_RELIABLE_PATH = Semiring("most_reliable_path", lambda: F.lit(1.0), lambda a, b: a * b, "max", (0, 1))
MAX_CAPACITY_PATH = Semiring("max_capacity_path", lambda: F.lit((1 << 63) - 1), lambda a, b: F.least(a, b), "max")
#: Drops the path so far, so it isn't for searches: its trees come from ``spanning_forest``.
SPANNING_TREE = Semiring("spanning_tree", lambda: F.lit(0).cast("long"), lambda a, b: b, "min")
