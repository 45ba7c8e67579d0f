import hashlib
import random
import re
import time
import zlib

from arcspark.llm import media


def _want(doc_id, text):
    raw = (text or "").encode()
    data = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
    return doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])


def test_round_trip_is_exact(spark, odd_docs):
    found = media.round_trip(odd_docs).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found), key=str)
    assert got == sorted((_want(r.doc_id, r.text) for r in odd_docs.collect()), key=str)
    by_text = {}
    for r in found:
        assert by_text.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_empty_table(no_docs):
    assert media.round_trip(no_docs).collect() == []


def test_padding_is_not_part_of_the_size(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abc  ")], "doc_id long, text string")
    a, b = sorted(media.round_trip(docs).collect())
    assert (a.n_bytes, b.n_bytes) == (3, 5) and a.payload_sha256 == b.payload_sha256


def test_shared_chunks_are_stored_once(spark, tmp_path):
    rng = random.Random(1)
    common = bytes(rng.randrange(97, 123) for _ in range(40_000)).decode()
    docs = spark.createDataFrame([(i, f"{'start ' * (i * 13)}{i}{common}{i}") for i in range(6)], "doc_id long, text string")
    media.write(docs, str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store")).collect()
    digests = [c.digest for r in stored for c in r.own]
    assert len(digests) == len(set(digests)) and sum(len(r.refs) for r in stored) > 20
    assert sum(len(c.data) for r in stored for c in r.own) < 100_000


def test_cuts_follow_content():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(50_000))
    a, b = media.chunks_of(data), media.chunks_of(b"xyz" + data)
    assert b"".join(a) == data and all(len(c) <= media.MOST for c in a) and all(len(c) >= media.LEAST for c in a[:-1])
    assert len(set(a) & set(b)) >= len(a) - 3
    h = 0
    for byte in data[:100]:
        h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFFFFFF
    assert int(media.gear_hashes(data[:100])[-1]) == h


def test_shuffles_of_the_store_are_removed(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: set(filter(re.compile(r"shuffle_").match, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",").split(",")))
    docs = spark.createDataFrame([(i, f"text {i % 50} " * 200) for i in range(200)], "doc_id long, text string")
    before, set_before = held(), spark.conf.get(name, None)
    media.write(docs, str(tmp_path / "store"))
    until = time.monotonic() + 5
    while held() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(name, None) == set_before
    assert spark.read.parquet(str(tmp_path / "store")).count() == 50


def test_recipes_on_disk_rebuild_the_payloads(spark, tmp_path, odd_docs):
    """The stored form by a plain reader: recipes and chunks as they lie in the store's files."""
    store = str(tmp_path / "store")
    told = {(r.doc_id, r.payload_sha256): r for r in media.round_trip(odd_docs, store).collect()}
    stored = spark.read.parquet(store).collect()
    chunks = {bytes(c.digest): bytes(c.data) for r in stored for c in r.own}
    by_payload = {}
    for r in stored:
        recipe, at, parts = bytes(r.media), 4, []
        assert recipe[:4] == b"GCR1" and (len(recipe) - 4) % 20 == 0
        while at < len(recipe):
            parts.append(chunks[recipe[at + 4 : at + 20]])
            assert len(parts[-1]) == int.from_bytes(recipe[at : at + 4], "little")
            at += 20
        by_payload[hashlib.sha256(b"".join(parts)).hexdigest()] = len(recipe), hashlib.sha256(recipe).hexdigest()
    for r in odd_docs.collect():
        sha = _want(r.doc_id, r.text)[3]
        found = told[r.doc_id, sha]
        assert (found.media_bytes, found.media_sha256) == by_payload[sha]
