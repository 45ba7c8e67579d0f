"""Weighted draws with replacement, by an inverse distribution that is as large as its items.

Items stand in the order of their columns, each with an interval as long as its weight; a draw
falls at a hash of its number and the seed. Weights are whole numbers of 52 bits below the greatest, so that all
sums are exact: draws depend neither on partitions nor on sizes, and not on a factor of two to any power.

Where an item's interval begins is found from sums within range partitions and one total a
partition. Items and draws are then sorted together by place, and each draw takes the last item
before it: within a partition by one pass, and where a partition opens with draws, the last item of
the partitions before (one a partition). An item that gets most draws is thus met in as many tasks as its draws fill.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.graph import GraphError
from arcspark.plans.scratch import materialise

WEIGHT_BITS, DRAW_BITS = 52, 60
PLACE = "decimal(38,0)"


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def whole_weights(items: DataFrame, weight: str) -> Column:
    """The weight in 2^-WEIGHT_BITS of the power of two below the greatest; GraphError: null or negative weights, or none above 0."""
    w = F.col(weight).cast("double")
    rows, bad, most = items.agg(F.count("*"), F.sum(F.when(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")), 1).otherwise(0)), F.max(w)).first()
    if not rows or bad or not most > 0:
        raise GraphError("weights must be 0 or more, and some above 0")
    shift = WEIGHT_BITS - (math.frexp(most)[1] - 1)
    return F.floor(w * F.lit(math.ldexp(1.0, min(shift, 1000))) * F.lit(math.ldexp(1.0, max(shift - 1000, 0))))


def intervals(items: DataFrame, weight: str) -> tuple[DataFrame, int]:
    """The (written) items above weight 0 with ``_place``, where their intervals begin, and the end of the last one."""
    columns = items.columns
    rows = items.withColumn("_w", whole_weights(items, weight)).where("_w > 0")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in items.dtypes), f"_place {PLACE}", "_part int", f"_sum {PLACE}"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = []
            for w in batch.column(len(columns)).to_pylist():
                places.append(Decimal(total))
                total += w
            kind = pa.decimal128(38, 0)
            sums = [*places[1:], Decimal(total)] if places else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(places, kind), pa.array([part] * len(places), pa.int32()), pa.array(sums, kind)],
                names=[*columns, "_place", "_part", "_sum"],
            )

    ordered = rows.repartitionByRange(_partitions(items), *columns).sortWithinPartitions(*columns)
    local = materialise(ordered.mapInArrow(summed, schema), "sums")
    before, total = {}, 0
    for part, own in local.groupBy("_part").agg(F.max("_sum")).orderBy("_part").collect():  # one row a partition
        before[part] = total
        total += int(own)
    if len(before) <= 1:
        return local.drop("_part", "_sum"), total
    offsets = items.sparkSession.createDataFrame([(p, Decimal(x)) for p, x in before.items()], f"_part int, _before {PLACE}")
    placed = local.join(F.broadcast(offsets), "_part").withColumn("_place", (F.col("_place") + F.col("_before")).cast(PLACE))
    return placed.drop("_part", "_sum", "_before").select(*columns, "_place"), total


def weighted_sample(items: DataFrame, n: int, weight: str = "weight", seed: int = 0) -> DataFrame:
    """``draw`` 0..n-1, each with the row of ``items`` drawn with probability in proportion to its weight.

    Weights below 2^-WEIGHT_BITS of the greatest count as 0. The columns of ``items`` must be of kinds that can
    be ordered; rows that are alike are drawn alike. GraphError: null, negative or infinite weights, or none above 0.
    """
    columns = items.columns
    placed, total = intervals(items, weight)
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, DRAW_BITS // 4), 16, 10).cast("long")
    draws = items.sparkSession.range(n).select(F.col("id").alias("draw"), number.alias("u"))

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [Decimal(u * total >> DRAW_BITS) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.decimal128(38, 0))], names=["draw", "_place"])

    fallen = draws.mapInArrow(fall, f"draw long, _place {PLACE}")
    both = placed.select("_place", F.lit(None).cast("long").alias("draw"), *columns).unionByName(fallen, allowMissingColumns=True)
    ordered = both.repartitionByRange(_partitions(items), "_place", "draw").sortWithinPartitions("_place", F.asc_nulls_first("draw"))
    kinds = dict(items.dtypes)
    schema = ", ".join(["draw long", *(f"`{c}` {kinds[c]}" for c in columns), f"_part int, _last {PLACE}, _met boolean"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Draws with the last item before them, and for each partition a row without a draw that names its last item."""
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None  # held: the last item so far, as a batch of one row
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks()
            is_item = here["draw"].is_null().to_numpy()
            last = np.maximum.accumulate(np.where(is_item, np.arange(len(is_item)), -1))
            at = np.flatnonzero(~is_item)
            source = pa.array(np.where(last[at] < 0, 0, last[at]), mask=last[at] < 0)
            met = pa.array(last[at] >= 0)
            columns_of = [here[c].take(source).combine_chunks() for c in columns]
            if len(at):
                none = pa.nulls(len(at), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([here["draw"].take(pa.array(at)).combine_chunks(), *columns_of, pa.array([part] * len(at), pa.int32()), none, met], names=["draw", *columns, "_part", "_last", "_met"])
            if last[-1] >= 0:
                held = here.slice(int(last[-1]), 1).combine_chunks().to_batches()[0]
        if held:
            blank = [pa.nulls(1, held.column(c).type) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *blank, pa.array([part], pa.int32()), held.column("_place"), pa.array([True])], names=["draw", *columns, "_part", "_last", "_met"])

    found = materialise(ordered.mapInArrow(taken, schema), "draws")
    ends = dict(found.where("draw is null").select("_part", "_last").collect())  # one row a partition
    drawn = found.where("draw is not null and _met").select("draw", *columns)
    opening = [r[0] for r in found.where("not _met").select("_part").distinct().collect()]
    if not opening:
        return drawn
    before = [(p, max((ends[q] for q in ends if q < p))) for p in opening]
    named = items.sparkSession.createDataFrame(before, f"_part int, _place {PLACE}")
    carried = placed.join(F.broadcast(named), "_place").select("_part", *columns)
    rest = found.where("not _met").select("draw", "_part").join(F.broadcast(carried), "_part")
    return drawn.unionByName(rest.select("draw", *columns))
