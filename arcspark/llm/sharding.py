"""Operator 2: shards by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of (``doc_id``, size, CRC-32). An alternating
Feistel network over the grid a x b, the smallest near-square grid with a*b >= N, permutes
the cells; a row whose image is N or more walks on along its cycle until the image is a row
number. The image p gives shard p mod S and slot p div S, so shards differ by one row at
most, slots have no gaps, and either can be computed from the row number, N and the key.

Everything is built from DataFrame functions. Only (doc_id, size, CRC) rows are shuffled:
they are range-partitioned, numbered within partitions, and shifted by the row counts of
the partitions before, of which there is one each (broadcast).

Law ``rows``. Defined cases: null text has size 16 and CRC 0; equal rows get neighbouring
row numbers and so different places; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcspark.llm.common import crc32_of, partitions_for
from arcspark.plans.scratch import materialise

ROUNDS, WALK = 6, 64


def grid(n: int) -> tuple[int, int]:
    """The sides of the Feistel grid for n rows: a*b >= n and a*b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _step(x: Column, a: int, b: int, key: int) -> Column:
    """One pass of the network: x = left * b + right, halves changed in turn."""
    left, right = F.floor(x / F.lit(b)).cast("long"), x % F.lit(b)
    for r in range(ROUNDS):
        if r % 2:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(key), F.lit(r)), F.lit(b)), F.lit(b))
        else:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(key), F.lit(r)), F.lit(a)), F.lit(a))
    return left * F.lit(b) + right


def permuted(row: Column, n: int, key: int) -> Column:
    """The image of a row number in 0..n-1 under the keyed permutation of these numbers."""
    a, b = grid(n)
    pairs = F.transform(F.array(row.cast("long")), lambda x: _step(x, a, b, key))
    first = F.element_at(pairs, 1)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(_step(x, a, b, key)))
    image = F.when(first < n, first).otherwise(walked)
    return F.when(image < n, image).otherwise(F.raise_error(F.lit("cycle walk too long; use another key")).cast("long"))


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """Materialise ``df`` in this order with ``row_number`` 0..N-1, without a global sort task."""
    dealt = df.repartitionByRange(partitions_for(df.sparkSession), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = materialise(dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}), "numbered")
    counts = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return stored.join(F.broadcast(base), "_part").withColumn("row_number", F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


def shard(docs: DataFrame, shards: int = 40, key: int = 0x5EED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number``."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        crc32_of(F.col("text")).alias("text_crc32"),
    )
    rows = number_rows(sized, "doc_id", "size", "text_crc32")
    n = rows.count()
    placed = rows.withColumn("_p", permuted(F.col("row_number"), max(n, 1), key))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
