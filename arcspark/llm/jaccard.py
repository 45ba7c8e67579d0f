"""Operator 4: exact Jaccard join of word-shingle sets by multiple-global-order filtering.

Two sets with Jaccard of at least t/100 share a token among the first n - ceil(t*n/100) + 1
of each, under *any* global token order. All orders used here put tokens that are rare in
the corpus first (by a count sketch of fixed size over all documents, which every task
shares; its errors cost time, never results) and differ in how they order tokens of like
frequency. The first order gives candidates by a join on prefix tokens with bounds on
length and position; candidates must then share enough prefix tokens under every order, the
other orders' prefixes being longer; what is left is verified on the whole sets.

Groups of copies are never expanded into pairs:

* equal sets become one class before any join (aggregated map-side);
* in each prefix-token bucket the classes are first compared with the bucket's most
  typical member only (rows grow as the bucket, not its square). Verified links are merged
  into components; after that only members of different components are paired, and
  members alike in length and position are paired as one row;
* equal documents, or those whose link follows from verified links, need no pair of
  their own, so components are exact though links within them aren't all listed.

Tokens are 64-bit hashes of the shingles of the words ``[^\\x20\\x09-\\x0D]+`` of the text with
A-Z in lower case. A text with fewer words than a shingle has its whole word sequence as
one token. Defined cases: null or empty text, or text without words: no tokens, linked
with nothing, component = its own id; rows with null ``doc_id`` are returned with a null
component; rows that share a ``doc_id`` count as one document for links; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import WordCache, arrow_map, claim, small_batches
from arcspark.operators.components import component_labels
from arcspark.plans.scratch import materialise

SKETCH_BITS, BLOCK_BITS = 23, 15
BROADCAST_IDS = 2_000_000
#: Tasks whose counts one task adds up at most.
FAN_IN = 1000
#: The prefixes kept for the other orders are so many times as long as needed to share one token.
LONGER = 2
_MIX, _FOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers that permute token hashes: one more order each.
ORDERS = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
EMPTY = np.zeros(0, dtype=np.uint64)


_WORDS = WordCache(xxhash.xxh64_intdigest, 200_000)


def _begin() -> None:
    claim(_WORDS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct token hashes of a whole text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return EMPTY
    hashes = np.fromiter(map(_WORDS.__getitem__, found), dtype=np.uint64, count=n)
    width = min(n, words)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        h = _mixed(h * _FOLD + hashes[j : n - width + 1 + j])
    return np.unique(h)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rarity(docs: DataFrame, words: int) -> np.ndarray:
    """uint8 levels, rising with the document frequency, for the top SKETCH_BITS of a token.

    Tasks count their documents' tokens in a fixed table and send it in compressed blocks;
    blocks are summed as they stream in; the driver gets 2^SKETCH_BITS bytes.
    """
    small_batches(docs.sparkSession)
    size, block = 1 << SKETCH_BITS, 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _begin()
        seen = np.zeros(size, dtype=np.int32)
        for batch in batches:
            held = [(shingle_set(t.as_py(), words) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32) for t in batch.column(0)]
            if held:
                slots, more = np.unique(np.concatenate(held), return_counts=True)
                seen[slots] += more.astype(np.int32)
        pack = zstandard.ZstdCompressor(level=1)
        at = [k for k in range(size // block) if seen[k * block : (k + 1) * block].any()]
        lane = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(at, pa.int32()), pa.array([lane] * len(at), pa.int32()),
                pa.array([pack.compress(seen[k * block : (k + 1) * block].tobytes()) for k in at], pa.binary()),
            ],
            names=["block", "lane", "counts"],
        )

    def summed(batches: Iterator[pa.RecordBatch], wide: bool) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                more = np.frombuffer(unpack.decompress(counts), dtype=np.int64 if wide else np.int32)
                sums[k] = sums[k] + more if k in sums else more.astype(np.int64)
        return sums

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, pack = summed(batches, False), zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([pack.compress(x.tobytes()) for x in sums.values()], pa.binary())],
            names=["block", "lane", "counts"],
        )

    texts = docs.select(F.col("text").cast("string").alias("text"))
    tasks = texts.rdd.getNumPartitions()  # of the plan; nothing runs
    lanes = -(-tasks // FAN_IN)
    counted = texts.mapInArrow(count, "block int, lane int, counts binary")
    if lanes > 1:  # a task adds up those of FAN_IN tasks first
        counted = counted.repartition(32 * lanes, "block", "lane").mapInArrow(merge, "block int, lane int, counts binary")
    last = lanes > 1

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = {k: np.clip(np.rint(6 * np.log2(1 + v)), 0, 255).astype(np.uint8).tobytes() for k, v in summed(batches, last).items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(levels.keys(), pa.int32()), pa.array(levels.values(), pa.binary())], names=["block", "levels"]
        )

    found = counted.repartition(32, "block").mapInArrow(level, "block int, levels binary").collect()
    out = np.zeros(size, dtype=np.uint8)
    for k, levels in found:
        out[k * block : (k + 1) * block] = np.frombuffer(levels, dtype=np.uint8)
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, words: int, percent: int, levels: Broadcast) -> DataFrame:
    """``doc_id, n, key, typical, prefix, other_1, ...``: a row for each document.

    ``key`` identifies the set; ``typical`` is the mean level of its tokens; of the other
    orders' prefixes 15 bits of each token are kept, as tokens that are equal agree in them.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, out = levels.value, []
        for text in batch.column(1):
            tokens = shingle_set(text.as_py(), words)
            n = len(tokens)
            if not n:
                out.append((0, b"", 0.0, None, *(None for _ in ORDERS)))
                continue
            level = table[tokens >> np.uint64(64 - SKETCH_BITS)]
            head, p = level.astype(np.uint64) << np.uint64(56), prefix_size(n, percent)
            first = tokens[np.argsort(head | (tokens >> np.uint64(8)), kind="stable")[:p]]
            rest = [
                (tokens[np.argsort(head | ((tokens * m) >> np.uint64(8)), kind="stable")[: LONGER * p]] & np.uint64(0x7FFF)).astype(np.int16)
                for m in ORDERS
            ]
            key = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
            out.append((n, key, round(float(level.mean()), 4), first.view(np.int64), *rest))
        kinds = (pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int64()), *(pa.list_(pa.int16()) for _ in ORDERS))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))],
            names=["doc_id", "n", "key", "typical", "prefix", *_others()],
        )

    others = "".join(f", {x} array<short>" for x in _others())
    return arrow_map(_texts(docs), rows, f"doc_id long, n long, key binary, typical double, prefix array<long>{others}", _begin)


def _others() -> list[str]:
    return [f"other_{k}" for k in range(1, len(ORDERS) + 1)]


def _may_link(n1: Column, pos1: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Length and position bounds of two sets that first share the tokens at these places."""
    longest, least = F.greatest(n1, n2), F.least(n1, n2)
    room = F.least(n1 - pos1, n2 - pos2)
    return (100 * least >= percent * longest) & ((100 + percent) * room >= percent * (n1 + n2))


def _live(buckets: DataFrame, percent: int) -> DataFrame:
    """Bucket rows that some other row of the bucket may link with, by classes of (n, pos)."""
    alike = buckets.groupBy("token", "n", "pos").agg(F.count("*").alias("c"))
    a, b = alike.alias("a"), alike.alias("b")
    same = (F.col("a.n") == F.col("b.n")) & (F.col("a.pos") == F.col("b.pos"))
    met = a.join(b, F.col("a.token") == F.col("b.token")).where(
        _may_link(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), percent) & (~same | (F.col("a.c") > 1))
    )
    return buckets.join(met.select("a.token", "a.n", "a.pos").distinct(), ["token", "n", "pos"], "left_semi")


def _only(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose ``key`` is among ``ids``, which are broadcast only up to BROADCAST_IDS of them."""
    ids = ids.distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = ids.select(F.col(ids.columns[0]).alias(key))
    return table.join(F.broadcast(named) if few else named, key, "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, tokens`` of the documents named."""
    part = _only(_texts(docs), ids, "doc_id")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], names=["id", "tokens"])

    return arrow_map(part, rows, "id long, tokens binary", _begin)


def _attached(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with columns of ``table`` (id, ...) for both ends, as c_a and c_b.

    Up to BROADCAST_IDS pairs go to the rows of ``table`` for the first end; only rows of
    paired ids are shuffled for the second.
    """
    ends = {x: _only(table, pairs.select(x), "id") for x in "ba"}
    if pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        pairs = F.broadcast(pairs)
    for end, rows in ends.items():
        named = rows.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
        pairs = pairs.join(named, end)
    return pairs


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (written) pairs (a, b) that share enough prefix tokens in every order and link by their whole sets.

    Of two sets whose first p and q tokens are known, tokens shared beyond the shorter reach
    number at most max(n - p, m - q); the rest of the overlap that a link needs must be among the
    known ones. Equal tokens agree in the bits kept, and tokens of one prefix that collide are
    counted by the slack, so no link is lost.
    """
    orders = ["prefix", *_others()]
    kept = _attached(pairs, reps, "n", *orders)
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    for x in orders:
        a, b = F.col(f"{x}_a"), F.col(f"{x}_b")
        shared = F.size(F.array_intersect(a, b)) + F.size(a) - F.size(F.array_distinct(a))
        beyond = F.greatest(F.col("n_a") - F.size(a), F.col("n_b") - F.size(b))
        kept = kept.where(shared >= F.greatest(need - beyond, F.lit(1)))
    kept = materialise(kept.select("a", "b"), "pairs")
    whole = _attached(kept, sets, "tokens").select("a", "b", "tokens_a", "tokens_b")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return arrow_map(whole, rows, "a long, b long").distinct()


def _shared(heads: DataFrame, reps: DataFrame) -> DataFrame:
    """``a, b``: links between the classes of one ``doc_id``, which can have several texts."""
    rows = heads.where("n > 0 and doc_id is not null").select("doc_id", "key")
    several = rows.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id")
    own = rows.join(several, "doc_id").distinct().join(reps.select("key", "id"), "key")
    least = own.groupBy("doc_id").agg(F.min("id").alias("a"))
    return own.join(least, "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; exact at Jaccard >= percent/100."""
    levels = docs.sparkSession.sparkContext.broadcast(rarity(docs, words))  # 2^SKETCH_BITS bytes
    heads = materialise(prefixes(docs, words, percent, levels), "prefixes", compression="zstd")
    levels.destroy()  # what it was for is written
    columns = ["doc_id", "n", "typical", "prefix", *_others()]
    classes = heads.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct(*columns)).alias("r"))
    reps = materialise(classes.select("key", F.col("r.doc_id").alias("id"), "r.n", "r.typical", "r.prefix", *(f"r.{x}" for x in _others())), "sets", compression="zstd")

    tokens = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    buckets = materialise(tokens.join(often, "token"), "buckets")
    live = materialise(_live(buckets, percent), "live")
    sets = materialise(_sets(docs, live.select("id").distinct(), words), "tokens")

    known = _only(reps.select("id", "typical"), live.select("id"), "id")
    typical = F.struct("typical", -F.col("id"), "id", "n", "pos")
    top = live.join(known, "id").groupBy("token").agg(F.max(typical).alias("top"))
    to_top = live.join(top, "token").where(
        (F.col("id") != F.col("top.id")) & _may_link(F.col("n"), F.col("pos"), F.col("top.n"), F.col("top.pos"), percent)
    )
    spokes = to_top.select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b")).distinct()
    spokes = materialise(spokes, "spokes")
    links = materialise(_verified(spokes, reps, sets, percent), "links")

    merged = component_labels(links, "a", "b")
    known = live.join(merged, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    known = materialise(known, "grouped")
    alike = known.groupBy("token", "n", "pos", "group").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    x, y = alike.alias("x"), alike.alias("y")
    met = x.join(y, F.col("x.token") == F.col("y.token")).where(
        (F.col("x.group") < F.col("y.group")) & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
    )
    keys = ("token", "n", "pos", "group", "c", "id")
    met = met.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in keys))
    for s in "xy":  # rows that stand for several members are opened again
        members = known.select(*(F.col(c).alias(f"{c}_{s}") for c in keys[:4]), F.col("id").alias("member"))
        several = met.where(F.col(f"c_{s}") > 1).join(members, [f"{c}_{s}" for c in keys[:4]])
        single = met.where(F.col(f"c_{s}") == 1).withColumn("member", F.col(f"id_{s}"))
        met = single.unionByName(several).drop(f"id_{s}").withColumnRenamed("member", f"id_{s}")
    pairs = met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).where("a <> b").distinct()
    pairs = materialise(pairs, "candidates")
    more = materialise(_verified(pairs, reps, sets, percent), "links")

    found = component_labels(links.unionByName(more).unionByName(_shared(heads, reps)), "a", "b")
    by_key = reps.select("key", "id").join(found, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    return heads.select("doc_id", "n", "key").join(by_key, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the least ``doc_id``.

    Rows whose ``doc_id`` is null are kept. Rows of the kept id are all kept.
    """
    found = components(docs, words, percent).select("doc_id", "component_id")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
