"""Loops over DataFrames, and sequential kernels run as tasks.

A round writes what it found to the shared folder, so the plan stays as small as one round
and a lost executor costs no finished round. ``per_group`` runs a sequential algorithm in one
task per independent problem, behind a check of the largest problem's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.graph import GraphError
from arcspark.plans.scratch import discard, materialise

MAX_ROUNDS, COMPACT_EVERY, MAX_TASK_ROWS = 10_000, 16, 5_000_000


class Accumulated:
    """The union of written round tables, which are its own: many are rewritten as one and removed."""

    def __init__(self, first: DataFrame) -> None:
        self.parts, self.last = [first], None

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) >= COMPACT_EVERY:
            merged = materialise(self.table().coalesce(max(1, self.table().rdd.getNumPartitions() // COMPACT_EVERY)), "rounds")
            discard(*self.parts[:-1], *([] if self.last is None else [self.last]))
            self.parts, self.last = [merged], part  # the last is what the next round goes on from

    def table(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out


def rounds(limit: int | None = None) -> Iterator[int]:
    """1, 2, ... for a loop that ends itself; GraphError where it hasn't after MAX_ROUNDS, unless ``limit`` was asked for."""
    yield from range(1, (MAX_ROUNDS if limit is None else limit) + 1)
    if limit is None:
        raise GraphError(f"not finished after {MAX_ROUNDS} rounds")


def per_group(rows: DataFrame, key: str | list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = MAX_TASK_ROWS) -> DataFrame:
    """``run`` for each group in one task; raises GraphError where a group has more than ``most`` rows."""
    keys = [key] if isinstance(key, str) else key
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise GraphError(f"a problem has {largest} rows; a task takes at most {most}")
    return rows.groupBy(*keys).applyInPandas(run, schema)
