"""Priority queues as tables: one row for each ``id`` with its ``priority``, lesser ones first, ties by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcspark.graph import GraphError
from arcspark.sources.builders import numbered


def pushed(queue: DataFrame, items: DataFrame) -> DataFrame:
    """The queue with more ids; one that it has already (or that comes twice) keeps the least of its priorities, as after a promotion."""
    return queue.unionByName(items).groupBy([c for c in queue.columns if c != "priority"]).agg(F.min("priority").alias("priority")).select(*queue.columns)


def updated(queue: DataFrame, changes: DataFrame, how: str = "set") -> DataFrame:
    """The queue after ``changes`` (id, priority): ``promote`` takes the lesser priority, ``demote`` the greater, ``set`` the new one.

    Ids that the queue hasn't got and null priorities change nothing. GraphError: another ``how``, or an id that is set twice.
    """
    folds = {"promote": (F.min, F.least), "demote": (F.max, F.greatest), "set": (F.min, lambda old, new: new)}
    if how not in folds:
        raise GraphError(f"{how} is no way to change a priority")
    merge, choose = folds[how]
    new = changes.groupBy("id").agg(merge("priority").alias("_new"), F.count_distinct("priority").alias("_n"))
    if how == "set" and not new.where("_n > 1").isEmpty():
        raise GraphError("an id is set to two priorities")
    both = queue.join(new.where("_new is not null").select("id", "_new"), "id", "left")
    return both.withColumn("priority", F.when(F.col("_new").isNull(), F.col("priority")).otherwise(choose(F.col("priority"), F.col("_new")))).select(*queue.columns)


def first(queue: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The ``k`` first, with ``pos`` from 0 on; ``by``: of each queue of a table that holds many.

    Tasks keep ``k`` rows of a queue before the shuffle, so one that has most rows costs no more than the others.
    """
    if by is None:
        return numbered(queue.orderBy("priority", "id").limit(k), "pos", "priority", "id").select("pos", *queue.columns)
    ranked = queue.withColumn("_rank", F.row_number().over(W.partitionBy(by).orderBy("priority", "id"))).where(F.col("_rank") <= k)
    return ranked.select((F.col("_rank") - 1).cast("long").alias("pos"), *queue.columns)


def popped(queue: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """What is left when the ``k`` first are taken out (of each queue of ``by``)."""
    keys = ["id"] if by is None else [by, "id"]
    return queue.join(first(queue, k, by).select(*keys), keys, "left_anti").select(*queue.columns)
