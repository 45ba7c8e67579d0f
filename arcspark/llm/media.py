"""Operator 1: media payloads in a store of content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has its low bits zero,
so equal passages give equal chunks wherever they stand. Then

1. one scan finds each payload's SHA-256 and its chunks' digests and lengths (metadata);
2. Spark joins on the digests pick one owner for every distinct chunk, and this plan is written;
3. payloads, compressed, meet their chunk plan in one shuffle on the payload digest and
   are written as store rows: the recipe, the chunks they own with bytes, the others as references.
   Every distinct chunk is in the store once. The shuffles of this and the step before are
   removed when the step ends, so only one copy of the payloads lies beside the store;
4. reading back, payloads without references are rebuilt from their row; for the others,
   only chunks flagged as shared are joined in by digest. The bytes are verified chunk by chunk
   against the recipe and as a whole against the payload digest, and features are computed from them.

Stored form of a payload (``media``): its recipe, a column of its store row: the magic ``GCR1`` and then,
chunk by chunk in order, the length (uint32, little-endian) and the digest (16 bytes) under which the
store holds the chunk's 8-bit samples. ``media_bytes`` and ``media_sha256`` are those of the recipe as read from disk.

Defined cases: null text counts as empty and is padded like any other; equal texts share
one store row; an empty table gives an empty store and no rows; repeated rows are returned
as often as they come; other input columns are not read. A payload that doesn't verify
raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.llm.common import arrow_map, small_batches
from arcspark.plans.scratch import discard, materialise, scratch_path, shuffles_removed

UNIT, TAIL = 192, 16
LEAST, MASK, MOST = 512, (1 << 11) - 1, 8192
MAGIC = b"GCR1"
#: Bytes of a chunk's digest.
DIGEST = 16
#: Bytes of a payload's SHA-256 that joins carry, and the compression levels of shuffled payloads and of
#: the store (an executor has many of its writers, so their buffers are to be small).
KEY, LEVEL, STORE_LEVEL = 16, 9, 6
STORE = (
    "payload binary, sha256 binary, media binary, own array<struct<seq:int,digest:binary,shared:boolean,data:binary>>, "
    "refs array<struct<seq:int,digest:binary>>"
)


def gear_table(seed: int = 0x9E3779B9) -> np.ndarray:
    """256 random uint32 values from a seed."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = gear_table()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded bytes of a text and how many came from it."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\x20"), len(raw)


def gear_hashes(data: bytes) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-j]] << j over j < 32, mod 2^32, by doubling windows."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: the first zero of the masked hash from LEAST on, MOST at most."""
    ends, start, n = [], 0, len(data)
    marks = (np.flatnonzero((gear_hashes(data) & np.uint32(MASK)) == 0) + 1).tolist() if n > LEAST else []
    while start < n:
        k = bisect_left(marks, start + LEAST)
        end = min(start + MOST, n)
        if k < len(marks) and marks[k] < end:
            end = marks[k]
        ends.append(end)
        start = end
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def entry_of(chunk: bytes, digest: bytes) -> bytes:
    """What a recipe says of a chunk."""
    return len(chunk).to_bytes(4, "little") + digest


def cuts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload, digests``: metadata of every document's chunks."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, size = payload_of(text.as_py())
            digests = [digest_of(c) for c in chunks_of(data)]
            out.append((doc_id, size, hashlib.sha256(data).digest()[:KEY], digests))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
            names=["doc_id", "n_bytes", "payload", "digests"],
        )

    schema = "doc_id long, n_bytes long, payload binary, digests array<binary>"
    return arrow_map(_texts(docs), rows, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def owners(recipes: DataFrame) -> DataFrame:
    """``digest, owner (payload, seq), shared`` for each distinct chunk of the recipes."""
    parts = recipes.select("payload", F.posexplode("digests").alias("seq", "digest"))
    return parts.groupBy("digest").agg(
        F.min(F.struct("payload", "seq")).alias("owner"), (F.count("*") > 1).alias("shared")
    )


def plan(recipes: DataFrame) -> DataFrame:
    """``payload, owned``: for each distinct payload, the (seq, shared) of chunks it owns."""
    own = owners(recipes).select("owner.payload", F.struct("owner.seq", "shared").alias("part"))
    return own.groupBy("payload").agg(F.collect_list("part").alias("owned"))


def compressed(docs: DataFrame) -> DataFrame:
    """``payload, packed``: each task sends a payload once, compressed."""
    small_batches(docs.sparkSession)

    def run(batches):
        packer, seen = zstandard.ZstdCompressor(level=LEVEL), set()
        for batch in batches:
            out = []
            for text in batch.column(1):
                data, _ = payload_of(text.as_py())
                key = hashlib.sha256(data).digest()[:KEY]
                if key not in seen:
                    seen.add(key)
                    out.append((key, packer.compress(data)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["payload", "packed"]
                )

    return _texts(docs).mapInArrow(run, "payload binary, packed binary")


def write(docs: DataFrame, path: str) -> DataFrame:
    """Write the chunk store at ``path``; returns ``doc_id, payload, n_bytes`` of all documents."""
    recipes = materialise(cuts(docs), "recipes")
    distinct = recipes.groupBy("payload").agg(F.first("digests").alias("digests"))
    with shuffles_removed(docs.sparkSession):
        planned = materialise(plan(distinct), "plan")
    small_batches(docs.sparkSession)
    once = compressed(docs).groupBy("payload").agg(F.first("packed").alias("packed"))
    joined = once.join(planned.hint("merge"), "payload", "left").select("payload", "packed", "owned")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack, sums, media, own, refs = zstandard.ZstdDecompressor(), [], [], [], []
        for packed, owned in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            mine = {x["seq"]: x["shared"] for x in owned or ()}
            here, there, recipe, whole = [], [], [MAGIC], unpack.decompress(packed)
            sums.append(hashlib.sha256(whole).digest())
            for seq, data in enumerate(chunks_of(whole)):
                digest = digest_of(data)
                recipe.append(entry_of(data, digest))
                if seq in mine:
                    here.append({"seq": seq, "digest": digest, "shared": mine[seq], "data": data})
                else:
                    there.append({"seq": seq, "digest": digest})
            media.append(b"".join(recipe))
            own.append(here)
            refs.append(there)
        ref = [("seq", pa.int32()), ("digest", pa.binary())]
        full = pa.struct([*ref, ("shared", pa.bool_()), ("data", pa.binary())])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sums, pa.binary()), pa.array(media, pa.binary()), pa.array(own, pa.list_(full)), pa.array(refs, pa.list_(pa.struct(ref)))],
            names=["payload", "sha256", "media", "own", "refs"],
        )

    stored = arrow_map(joined, rows, STORE).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", STORE_LEVEL)
    with shuffles_removed(docs.sparkSession):
        stored.parquet(path)
    discard(planned)
    return recipes.select("doc_id", "n_bytes", "payload")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """``payload, sha256, media, parts``: the recipe and all chunks (seq, data) of every stored payload."""
    stored = spark.read.schema(STORE).parquet(path)
    whole = stored.where(F.size("refs") == 0).select(
        "payload", "sha256", "media", F.transform("own", lambda x: F.struct(x["seq"].alias("seq"), x["data"].alias("data"))).alias("parts")
    )
    rest = stored.where(F.size("refs") > 0)
    shared = stored.select(F.explode("own").alias("c")).where("c.shared").select("c.digest", "c.data")
    wanted = rest.select("payload", F.explode("refs").alias("r")).select("payload", "r.seq", "r.digest")
    fetched = wanted.join(shared, "digest").groupBy("payload").agg(F.collect_list(F.struct("seq", "data")).alias("fetched"))
    mended = rest.join(fetched, "payload").select(
        "payload", "sha256", "media",
        F.concat(F.transform("own", lambda x: F.struct(x["seq"].alias("seq"), x["data"].alias("data"))), "fetched").alias("parts"),
    )
    return whole.unionByName(mended)


def feature_of(data: bytes, chunks: int) -> str:
    """Chunk count, mean and variance of the samples (in 1/1000), sign changes about the mean, and an 8-bin histogram."""
    x = np.frombuffer(data, dtype=np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    squares = int((x.astype(np.int64) ** 2).sum())
    above = x.astype(np.int64) * n > total
    bins = np.bincount(x >> 5, minlength=8)
    mean, var = 1000 * total // n, 1000 * (n * squares - total * total) // (n * n)
    return f"chunks={chunks};mean={mean};var={var};cross={int((above[1:] != above[:-1]).sum())};hist={'/'.join(map(str, bins))}"


def features(parts: DataFrame) -> DataFrame:
    """Digests and features of the rebuilt payloads; raises where bytes don't verify against recipe and payload digest."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, told, media, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            ordered = [x["data"] for x in sorted(held, key=lambda x: x["seq"])]
            data = b"".join(ordered)
            digest = hashlib.sha256(data).digest()
            if media != b"".join([MAGIC, *(entry_of(x, digest_of(x)) for x in ordered)]) or digest != told or digest[:KEY] != key:
                raise ValueError(f"payload {key.hex()} doesn't verify")
            out.append((key, len(data), digest, zlib.crc32(data[-TAIL:]), len(media), hashlib.sha256(media).digest(), feature_of(data, len(ordered))))
        i, b, s = pa.int64(), pa.binary(), pa.string()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), i, b, i, i, b, s), strict=True)],
            names=["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    return arrow_map(
        parts, rows,
        "payload binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string",
    )


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store every document's payload, read all of them back, and return what was read."""
    path = path or scratch_path(docs.sparkSession, "media")
    whose = write(docs, path)
    found = whose.join(features(rebuilt(docs.sparkSession, path)), "payload").drop("payload")
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})
