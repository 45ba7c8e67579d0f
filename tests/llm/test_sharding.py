import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from arcspark.llm import sharding


def _brute(row, n, key):
    """The permutation by plain arithmetic: XXH64 of (half, key, round), chained as Spark does."""

    def h(half, r):
        x = xxhash.xxh64_intdigest(half.to_bytes(8, "little", signed=True), 42)
        for v in (key, r):
            x = xxhash.xxh64_intdigest(v.to_bytes(4, "little"), x)
        return x - (1 << 64) if x >> 63 else x

    a, b = sharding.grid(n)
    x = row
    while True:
        left, right = divmod(x, b)
        for r in range(sharding.ROUNDS):
            if r % 2:
                right = (right + h(left, r) % b) % b
            else:
                left = (left + h(right, r) % a) % a
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_by_brute_force(spark, n):
    got = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 77).alias("p")).collect()
    assert [r.p for r in sorted(got)] == [_brute(i, n, 77) for i in range(n)]
    assert sorted(r.p for r in got) == list(range(n))


def test_law_of_rows(spark, odd_docs):
    found = sharding.shard(odd_docs, shards=4).collect()
    docs = odd_docs.collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted(
        (str(d.doc_id), len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs
    )
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r.row_number, r.shard, r.slot) for r in sharding.shard(odd_docs.repartition(3), shards=4).collect()}
    assert again == {(r.row_number, r.shard, r.slot) for r in found}


def test_empty_table(no_docs):
    assert sharding.shard(no_docs).collect() == []
