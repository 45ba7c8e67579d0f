"""Operator 7: main text of web pages, by a suffix array over a host's pages.

A page's visible words, block by block, form a token stream. The streams of a host's pages
are concatenated, with an end mark of its own after each, and their suffixes are sorted;
neighbours with a common prefix (LCP) of at least ``LEAST_RUN`` words lie in one interval,
and an interval's pages are those that share the substring. What is on enough pages of the
host is boilerplate: its places are covered, covered blocks go, unique runs stay.

A host of any size: pages are parsed once and dealt into groups of about ``BATCH_PAGES``,
each group has its suffix array in one task, and an interval is reported with the key of its
first ``LEAST_RUN`` words and its pages. Reports are added up over the host by a Spark
aggregation. A group doesn't report what stands on less than ``IGNORED`` of its pages, so a sum
may be too small, but by no more than that share of the pages of the groups that didn't report:
where this leaves open whether a substring passes a threshold, a second pass counts it on all
pages of the host. So counts decide as those over the whole host do, however it is grouped. A
substring of LEAST_RUN words or more is on so many pages only if all its windows of LEAST_RUN
words are, and windows cover no more than the substrings they form; so these keys lose nothing
against longer ones. Both passes and the extraction read the same shuffle of the pages.

Then, block by block,

* blocks that are covered (``COVERED``) by substrings on at least ``OUTSIDE`` of the host's
  pages go; in a marked article (``article``, ``main`` or the role) on at least ``INSIDE``;
* what the markup declares to be no content goes although it is unique, as reader comments
  and adverts are; so do blocks outside the article of a page that marks one;
* where removal by repetition would take nearly all of a page (``COPY``; half of a marked
  article), the page is a copy of others rather than made of boilerplate, and keeps all.

Defined cases: null html counts as empty and gives empty text; null urls form one host;
repeated rows are extracted each for itself (equal pages count each); markup that isn't closed
is closed as HTML says; an empty table gives no rows; other columns are not read. A page is
held by one task, however long. Words are told apart by 16 bits each, so two different
runs of LEAST_RUN words have the same key with a chance of 2^-64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import WordCache, claim, partitions_for, small_batches
from arcspark.llm.html_blocks import blocks
from arcspark.plans.scratch import materialise

#: Pages and characters of html that a group has on average at most, and words after which a group is cut.
BATCH_PAGES, BATCH_CHARS, HELD_WORDS = 100, 4 << 20, 1 << 20
#: Hosts of several groups that are broadcast at most; there is one row a host.
BROADCAST_HOSTS = 200_000
LEAST_RUN, IGNORED = 6, 0.05
OUTSIDE, INSIDE, LEAST_OUTSIDE, LEAST_INSIDE, COVERED = 0.3, 0.6, 3, 8, 0.6
COPY = {False: 0.9, True: 0.5}
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, np.int64)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) & 0xFFFF


_WORDS = WordCache(_hash)


def _begin() -> None:
    claim(_WORDS)


def tokens(parsed: list[tuple[str, bool, bool]]) -> list[list[int]]:
    """16-bit hashes of the words of every block of a page."""
    return [list(map(_WORDS.__getitem__, text.split(" "))) for text, _, _ in parsed]


def stream(words: list[list[int]]) -> np.ndarray:
    return np.fromiter((t for block in words for t in block), dtype=np.uint16, count=sum(map(len, words)))


def folded(windows: np.ndarray, host: int) -> np.ndarray:
    """64-bit keys of (host, window) for windows given as rows of LEAST_RUN words."""
    key = np.full(len(windows), host & (1 << 64) - 1, dtype=np.uint64)
    for j in range(LEAST_RUN):
        key = (key ^ windows[:, j].astype(np.uint64)) * _FOLD
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def window_keys(words: np.ndarray, host: int) -> np.ndarray:
    """The keys of all windows of a token stream, in order."""
    if len(words) < LEAST_RUN:
        return _NONE
    return folded(np.lib.stride_tricks.sliding_window_view(words, LEAST_RUN), host)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in sorted order, and the length of the common prefix of each and its next.

    ``text`` must end with a value that stands nowhere else. Prefix doubling: the rank by 2k values
    comes from sorting the pairs of ranks by k values; the ranks of all rounds give the common
    prefixes by descending powers of two.
    """
    n, width = len(text), 1
    levels = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
    while int(levels[-1].max()) + 1 < n:
        rank = levels[-1].astype(np.int64)
        pair = rank * (n + 1)
        pair[: n - width] += rank[width:] + 1
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        near = np.maximum(x, y) < n
        same = np.zeros(n - 1, bool)
        same[near] = levels[k][x[near]] == levels[k][y[near]]
        common[same] += 1 << k
    return order, common


def shared_runs(pages: list[np.ndarray], copies: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``at, longest, n, text`` of the intervals of LEAST_RUN common words on at least ``least`` pages.

    ``at`` is a place in ``text`` (the pages one after the other) where an interval's substring
    stands, ``longest`` the words that all or some of its places share at most, and ``n`` its pages, each
    counted as often as ``copies`` says.
    """
    text = np.concatenate([np.append(p.astype(np.int64), -1 - k) for k, p in enumerate(pages)])
    of = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
    order, common = suffix_array(text)
    joined = common >= LEAST_RUN
    interval = np.concatenate([[0], np.cumsum(~joined)])
    width = np.bincount(interval)
    several = width[interval] > 1 if least > 1 and max(copies) < least else np.ones(len(order), bool)
    held = np.unique(interval[several] * len(pages) + of[order[several]])
    n = np.bincount(held // len(pages), weights=np.array(copies)[held % len(pages)], minlength=len(width)).astype(np.int64)
    longest = np.zeros(len(width), np.int64)
    np.maximum.at(longest, interval[:-1][joined], common[joined])
    first = np.flatnonzero(np.append(True, ~joined))
    at = order[first]
    room = np.cumsum(np.bincount(of, minlength=len(pages)))[of[at]] - 1 - at  # words up to the page's end
    kept = (n >= least) & (room >= LEAST_RUN)
    return at[kept], longest[kept], n[kept], text


def reported(pages: list[np.ndarray], copies: list[int], host: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the host's substrings on at least ``least`` of these pages, and their pages."""
    if len(pages) == 1:
        key = np.unique(window_keys(pages[0], host)) if copies[0] >= least else _NONE
        return key, np.full(len(key), copies[0], np.int64)
    at, _, n, text = shared_runs(pages, copies, least)
    if not len(at):
        return _NONE, _NONE
    return folded(text[at[:, None] + np.arange(LEAST_RUN)].astype(np.uint16), host), n


def threshold(pages: int, inside: bool) -> int:
    """On how many of a host's pages a substring must be to count as boilerplate."""
    least, share = (LEAST_INSIDE, INSIDE) if inside else (LEAST_OUTSIDE, OUTSIDE)
    return max(least, math.ceil(share * pages - 1e-9))


def chosen(parsed: list[tuple[str, bool, bool]], words: list[list[int]], host: int, often: np.ndarray, firm: np.ndarray, repetition: bool = True) -> str:
    """The main text of a page; ``often`` and ``firm``: sorted keys that pass the thresholds outside and in an article."""
    has_main = any(inside and not noise for _, inside, noise in parsed)
    marks = firm if has_main else often
    covered = np.zeros(sum(map(len, words)), bool)
    if len(marks) and repetition:
        key = window_keys(stream(words), host)
        hit = marks[np.minimum(np.searchsorted(marks, key), len(marks) - 1)] == key
        for j in range(LEAST_RUN):
            covered[j : j + len(hit)] |= hit
    kept, repeated, lost, total, at = [], [], 0, 0, 0
    for (text, inside, noise), block in zip(parsed, words, strict=True):
        here = covered[at : at + len(block)]
        at += len(block)
        if noise or has_main and not inside:
            continue
        total += len(block)
        again = here.mean() >= COVERED
        lost += len(block) * again
        kept.append(text)
        repeated.append(again)
    copy = lost >= COPY[has_main] * total
    return " ".join(t for t, again in zip(kept, repeated, strict=True) if copy or not again)


def extract_batch(pages: list[str], repetition: bool = True) -> list[str]:
    """The main texts of all pages of one host, in memory; without ``repetition`` by markup alone."""
    parsed = [blocks(p) for p in pages]
    words = [tokens(p) for p in parsed]
    key, n = reported([stream(w) for w in words], [1] * len(pages), 0, threshold(len(pages), False))
    order = np.argsort(key)
    key, n = key[order], n[order]
    firm = key[n >= threshold(len(pages), True)]
    return [chosen(p, w, 0, key, firm, repetition) for p, w in zip(parsed, words, strict=True)]


def _host() -> Column:
    name = F.coalesce(F.regexp_extract(F.lower(F.col("url").cast("string")), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    return F.xxhash64(name)


def placed(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, host, n_groups, host_pages``; the last is null for hosts of one group."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", _host())
    sizes = rows.groupBy("host").agg(F.count("*").alias("host_pages"), F.sum(F.coalesce(F.char_length("html"), F.lit(0))).alias("chars"))
    groups = F.greatest(F.ceil(F.col("host_pages") / BATCH_PAGES), F.ceil(F.col("chars") / BATCH_CHARS)).cast("int")
    large = materialise(sizes.select("host", "host_pages", groups.alias("n_groups")).where("n_groups > 1"), "hosts")
    if large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    return rows.join(large, "host", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(1)))


def parsed_pages(rows: DataFrame) -> DataFrame:
    """``host, part, n_groups, host_pages, page_id, url, packed``: the blocks of every page, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = []
            for html in batch.column(6):
                lines = [f"{inside + 2 * noise}{text}" for text, inside, noise in blocks(html.as_py() or "")]
                packed.append(packer.compress("\n".join(lines).encode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(packed, pa.binary())], names=[*batch.schema.names[:6], "packed"])

    part = F.pmod(F.xxhash64("page_id", "url") + F.spark_partition_id(), F.col("n_groups")).cast("int")
    return rows.select("host", part.alias("part"), "n_groups", "host_pages", "page_id", "url", "html").mapInArrow(
        run, "host long not null, part int not null, n_groups int, host_pages long, page_id long, url string, packed binary"
    )


def unpacked(packed: bytes) -> list[tuple[str, bool, bool]]:
    lines = packed.decode("utf-8").split("\n") if packed else []
    return [(x[1:], bool(int(x[0]) & 1), bool(int(x[0]) & 2)) for x in lines]


_COUNTS = "host long not null, n_groups int, host_pages long, key long, own long, n long"


def _counts(host: int, groups: int, host_pages: int, key: np.ndarray, own: int, n: np.ndarray) -> pa.RecordBatch:
    same = ((host, pa.int64()), (groups, pa.int32()), (host_pages, pa.int64()), (own, pa.int64()))
    host, groups, host_pages, own = (pa.array([x] * len(key), t) for x, t in same)
    return pa.RecordBatch.from_arrays([host, groups, host_pages, pa.array(key), own, pa.array(n)], names=["host", "n_groups", "host_pages", "key", "own", "n"])


def reports(sent: DataFrame) -> DataFrame:
    """``host, n_groups, host_pages, key, own, n``: what stands on ``n`` of the ``own`` pages of a group, if that is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        unpack = zstandard.ZstdDecompressor()

        def done(host: int, part: int, groups: int, host_pages: int | None, copies: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
            own = sum(copies.values())
            least = threshold(own, False) if groups == 1 else max(1, math.ceil(IGNORED * own))
            if own >= least:
                key, n = reported([np.frombuffer(w, np.uint16) for w in copies], list(copies.values()), host, least)
                if len(key):
                    yield _counts(host, groups, own if groups == 1 else host_pages, key, own, n)

        group, copies, size = None, {}, 0
        for batch in batches:
            for *told, packed in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 6)), strict=True):
                if group and (group != told or size > HELD_WORDS and told[2] > 1):
                    yield from done(*group, copies)
                    copies, size = {}, 0
                group = told
                words = stream(tokens(unpacked(unpack.decompress(packed)))).tobytes()
                if words not in copies:
                    size += len(words) // 2
                copies[words] = copies.get(words, 0) + 1
        if group:
            yield from done(*group, copies)

    return sent.sortWithinPartitions("host", "part").mapInArrow(run, _COUNTS)


def recounted(sent: DataFrame, unsure: DataFrame) -> DataFrame:
    """``host, n_groups, host_pages, key, own, n``: on how many pages of a group the ``keys`` of ``unsure`` stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        unpack = zstandard.ZstdDecompressor()
        now, wanted, n, own = None, _NONE, _NONE, 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 2, 3, 6)]
            for i, (*told, packed) in enumerate(zip(*columns, strict=True)):
                if told != now:
                    if now:
                        yield _counts(*now, wanted, own, n)
                    wanted = np.array(batch.column(7)[i].values)
                    now, n, own = told, np.zeros(len(wanted), np.int64), 0
                here = window_keys(stream(tokens(unpacked(unpack.decompress(packed)))), told[0])
                n += np.isin(wanted, here)
                own += 1
        if now:
            yield _counts(*now, wanted, own, n)

    return sent.join(dealt(unsure), ["host", "part"]).mapInArrow(run, _COUNTS)


def dealt(lists: DataFrame) -> DataFrame:
    """The lists of each host for each of its groups."""
    return lists.withColumn("part", F.explode_outer(F.sequence(F.lit(0), F.col("n_groups") - 1))).drop("n_groups")


def marks(sent: DataFrame) -> DataFrame:
    """``host, n_groups, often, firm``: for hosts that have any, the sorted keys of what is on enough of their pages."""
    known = ["host", "n_groups", "host_pages", "key"]
    n, pages = F.col("n"), F.col("host_pages")
    outside = F.greatest(F.lit(LEAST_OUTSIDE), F.ceil(OUTSIDE * pages - 1e-9))
    inside = F.greatest(F.lit(LEAST_INSIDE), F.ceil(INSIDE * pages - 1e-9))
    most = n + F.floor(IGNORED * (pages - F.col("own")) + 1e-6)
    unsure = ((n < outside) & (most >= outside)) | ((n < inside) & (most >= inside))
    whole = reports(sent).groupBy(*known).agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    asked = whole.where(unsure).groupBy("host", "n_groups").agg(F.collect_list("key").alias("keys"))
    counted = recounted(sent, asked).groupBy(*known).agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    enough = whole.where(~unsure).unionByName(counted).where(n >= outside)
    return enough.groupBy("host", "n_groups").agg(
        F.sort_array(F.collect_list("key")).alias("often"), F.sort_array(F.collect_list(F.when(n >= inside, F.col("key")))).alias("firm")
    )


def extract(pages: DataFrame, repetition: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``; without ``repetition`` by markup alone."""
    small_batches(pages.sparkSession)
    sent = parsed_pages(placed(pages)).repartition(partitions_for(pages.sparkSession), "host", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in (0, 4, 5, 6)]
            for i, (host, page_id, url, packed) in enumerate(zip(*columns, strict=True)):
                often, firm = (batch.column(k)[i].values for k in (7, 8))
                page = unpacked(unpack.decompress(packed))
                text = chosen(page, tokens(page), host, *(_NONE if x is None else np.array(x) for x in (often, firm)), repetition)
                out.append((page_id, url, text, len(text)))
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "text", "n_chars"]
                )

    return sent.join(dealt(marks(sent)), ["host", "part"], "left").mapInArrow(run, "page_id long, url string, text string, n_chars long")
