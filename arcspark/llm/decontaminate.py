"""Operator 6: benchmark decontamination by canonical templates.

Words are canonicalised: numbers become a number placeholder, title-case words inside a
sentence a name placeholder, and words of measure after a number a unit placeholder; what a
placeholder replaced is its slot's value. Windows of ``WINDOW`` canonical words (with enough
literal ones) of benchmark items and of whole documents are hashed and joined on the hash.
Windows of the words as they stand are joined too, so that short items and passages dense in
numbers or names are found when copied. Windows of one item that meet a document on
neighbouring diagonals (document position minus item position) form an alignment, and its
slots are checked: a name or unit of the item must stand for one value throughout, or only
windows that agree word for word count. So a question with other numbers or names is
caught, while text that only shares a pattern of placeholders isn't.

A document is contaminated by an item when an alignment covers ``RUN`` words of the item, or
the given share of it where it is shorter.

Tasks test their windows against a bit table of fixed size made from all benchmark windows
and send only those that it may hold to the join; a full table would cost time and drop
nothing. Items of fewer than ``WINDOW`` words are matched by windows of their own length.
Windows of numbers alone match nothing.

Defined cases: null texts hold no words; an empty benchmark or table gives no matches;
repeated rows of a document or an item count once; different texts under one id are compared each for itself, and
the pair of ids has one row, that of its best alignment; other columns are not read by
``matches`` and are kept by ``clean``.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import WordCache, claim, small_batches
from arcspark.plans.scratch import materialise

WINDOW, LEAST, RUN, SHARE, TABLE_BITS = 8, 4, 13, 0.6, 22
#: Slots of the table that one row carries, and windows of the benchmark that are broadcast at most.
BLOCK_BITS, BROADCAST_WINDOWS = 15, 200_000
#: Words taken as units of measure after a number.
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yd yards meter meters metre metres kilometer kilometers "
    "kg g mg lb lbs pound pounds oz ounce ounces ton tons gram grams l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent % dollar dollars euro euros cent cents degree degrees mph kmh watt watts volt volts"
).split()
LITERAL, NUMBER, TITLE, UNIT, ENDS, BLANK = 0, 1, 2, 4, 8, 16
_FLAGS = np.uint64(31)
_PUNCTUATION = string.punctuation.encode()
_NUMBER = re.compile(rb"[0-9][0-9.,:/]*(?:%|st|nd|rd|th|[a-z]{1,2})?$")
_NAMED = {x: xxhash.xxh64_intdigest(x.encode()) for x in ("<number>", "<name>", "<unit>")}
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_UNITS = frozenset(x.encode() for x in UNITS)


def _code(word: bytes) -> int:
    """Hash of a word's literal form with its flags in the low bits."""
    core = word.strip(_PUNCTUATION)
    flags = ENDS if word[-1:] in b".!?:;|" or word[-2:-1] in b".!?" and len(word) > 1 else 0
    if core.isascii():
        low, title = core.lower(), core[:1].isupper() and (len(core) == 1 or core[1:].islower())
    else:
        text = core.decode("utf-8", "replace")
        low, title = text.lower().encode(), text[:1].isupper() and (len(text) == 1 or text[1:].islower())
    if not core:
        flags |= BLANK
    elif core[:1].isdigit() and _NUMBER.match(low):
        flags |= NUMBER
    else:
        flags |= TITLE * bool(title) | UNIT * (low in _UNITS)
    return xxhash.xxh64_intdigest(low) & ~31 | flags


_WORDS = WordCache(_code)


def _begin() -> None:
    claim(_WORDS)


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Template hashes, which of them are placeholders, the words, their own hashes, and which are numbers, of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    codes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    flags = (codes & _FLAGS).astype(np.uint8)
    if (flags & BLANK).any():
        kept = np.flatnonzero((flags & BLANK) == 0)
        ends = np.concatenate([[0], np.cumsum((flags & ENDS) > 0)])
        stops = np.diff(ends[np.append(kept, len(flags))], append=ends[-1])[: len(kept)] > 0
        words, codes, flags = [words[i] for i in kept], codes[kept], flags[kept]
    else:
        stops = (flags & ENDS) > 0
    begins = np.ones(len(flags), dtype=bool)
    begins[1:] = stops[:-1]
    number = (flags & NUMBER) > 0
    name = ((flags & TITLE) > 0) & ~begins
    unit = ((flags & UNIT) > 0) & ~name
    unit[1:] &= number[:-1]
    unit[:1] = False
    out = codes & ~_FLAGS
    for mask, kind in ((number, "<number>"), (name, "<name>"), (unit, "<unit>")):
        out[mask] = np.uint64(_NAMED[kind])
    return out, number | name | unit, words, codes & ~_FLAGS, number


def windows(hashes: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words, and where enough of the words are literal."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        h = h * _FOLD + hashes[j : j + n]
        h ^= h >> np.uint64(31)
    held = np.concatenate([[0], np.cumsum(~slot)])
    literal = held[size:] - held[:-size]
    return h, literal >= min(size, max(LEAST, (size + 1) // 2))


def verbatim(words: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words as they stand, and where not all of them are numbers."""
    h, _ = windows(words ^ _FOLD, number, size)
    held = np.concatenate([[0], np.cumsum(~number)])
    return h, held[size:] > held[:-size] if len(h) else np.zeros(0, bool)


def _value(word: bytes) -> str:
    return word.strip(_PUNCTUATION).decode("utf-8", "replace").lower()


HITS = "id long, key long, size int, hash long, pos int, template boolean, slots array<struct<at:int,value:string>>"


def _rows(doc_id: int, key: int, text: str | None, sizes: tuple[int, ...], table: np.ndarray | None) -> Iterator[tuple]:
    hashes, slot, words, own, number = canonical(text)
    for size in sizes:
        for template in (True, False):
            h, good = windows(hashes, slot, size) if template else verbatim(own, number, size)
            if table is not None:
                good = good & table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            for i in np.flatnonzero(good).tolist():
                at = np.flatnonzero(slot[i : i + size]) if template else ()
                # numbers are told from names by a place below 0
                slots = [{"at": -1 - int(k) if number[i + k] else int(k), "value": _value(words[i + k])} for k in at]
                yield doc_id, key, size, int(h[i].astype(np.int64)), i, template, slots


def _found(df: DataFrame, key: str, sizes: tuple[int, ...], table: np.ndarray | None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(table)
    small_batches(df.sparkSession)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["id", "key", "size", "hash", "pos", "template", "slots"],
            )

        _begin()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text_key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), strict=True):
                for row in _rows(doc_id, text_key, text.as_py(), sizes, shared.value):
                    rows.append(row)
                    if len(rows) == 20_000:
                        yield sent(rows)
                        rows = []
            if rows:
                yield sent(rows)

    return _texts(df, key).mapInArrow(run, HITS)


def _texts(df: DataFrame, key: str) -> DataFrame:
    """``id, key, text``: texts of one id are told apart by their hash."""
    text = F.col("text").cast("string")
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _table(asked: DataFrame) -> np.ndarray:
    """Which top TABLE_BITS of a hash occur: bits set in tasks, 2^TABLE_BITS of them (512 KB) to the driver."""
    slot = F.shiftrightunsigned("hash", 64 - TABLE_BITS).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(1).to_numpy()
            for block in np.unique(at >> BLOCK_BITS).tolist():
                mine = at[at >> BLOCK_BITS == block] & (1 << BLOCK_BITS) - 1
                found.setdefault(block, np.zeros(1 << BLOCK_BITS, bool))[mine] = True
        packed = [np.packbits(x).tobytes() for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(packed, pa.binary())], names=["block", "bits"])

    slots = asked.select(slot.alias("slot")).distinct().select((F.col("slot") / (1 << BLOCK_BITS)).cast("int").alias("block"), "slot")
    table = np.zeros((1 << TABLE_BITS - BLOCK_BITS, 1 << BLOCK_BITS), dtype=bool)
    for block, bits in slots.repartition(table.shape[0], "block").mapInArrow(run, "block int, bits binary").collect():
        table[block] |= np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return table.ravel()


def _lengths(benchmark: DataFrame) -> DataFrame:
    """``id, key, words``: how many canonical words each item's text has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(canonical(x.as_py())[0]) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], names=["id", "key", "words"])

    return _texts(benchmark, "item_id").mapInArrow(run, "id long, key long, words int").distinct()


def judged(hits: list[tuple], need: int, band: int) -> tuple[int, int, bool] | None:
    """``covered, n_slots, changed`` of the best alignment of one item and document that covers ``need`` words.

    A hit is (pos, item_pos, size, given slots, asked slots). Diagonals less than ``band`` apart
    are one alignment, so that inserted and lost words don't split it. Names and units must
    stand for one value throughout; numbers may differ place by place. Where they don't, each
    diagonal is tried alone, and windows that agree word for word count in any case.
    """
    lines: dict[int, list[tuple]] = {}
    for hit in hits:
        lines.setdefault(hit[0] - hit[1], []).append(hit)
    groups: list[list[int]] = []
    for d in sorted(lines):
        if groups and d - groups[-1][-1] < band:
            groups[-1].append(d)
        else:
            groups.append([d])
    best = None

    def tried(some: list[tuple]) -> bool:
        nonlocal best
        stands: dict[str, str] = {}
        pairs = [(a["value"], g["value"], a["at"] < 0) for _, _, _, given, asked in some for g, a in zip(given, asked, strict=True)]
        for asked, given, number in pairs:
            if not number and stands.setdefault(asked, given) != given:
                return False
        covered = len({i for _, at, size, _, _ in some for i in range(at, at + size)})
        if covered >= need:
            found = covered, len({a for a, _, _ in pairs}), any(a != g for a, g, _ in pairs)
            best = found if best is None else max(best, found)
        return True

    for group in groups:
        if not tried([h for d in group for h in lines[d]]):
            for d in group:
                tried(lines[d])
            tried([h for d in group for h in lines[d] if [x["value"] for x in h[3]] == [x["value"] for x in h[4]]])
    return best


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, covered, item_words, n_slots, reparameterised, contaminated``, a row for each contaminating pair."""
    lengths = materialise(_lengths(benchmark), "items")
    short = sorted(r[0] for r in lengths.where(f"words < {window} and words >= 1").select("words").distinct().collect())
    sizes = (*short, window)  # at most ``window`` numbers
    asked = materialise(_found(benchmark, "item_id", sizes, None), "windows")
    asked = asked.join(lengths, ["id", "key"]).where(F.col("size") == F.least("words", F.lit(window)))
    table = _table(asked)

    hits = _found(docs, "doc_id", sizes, table)
    asked = asked.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), "size", "hash", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "template", "words").dropDuplicates(["item_id", "item_key", "size", "item_pos", "template"])
    if asked.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        asked = F.broadcast(asked)  # so that a window that very many documents share isn't gathered
    met = hits.join(asked, ["size", "hash", "template"])
    pair = ["id", "key", "item_id", "item_key"]
    each = met.groupBy(*pair, "pos", "item_pos").agg(F.max(F.struct("template", "size", "words", "slots", "item_slots")).alias("m"))
    pairs = each.groupBy(*pair).agg(
        F.max("m.words").alias("words"), F.collect_list(F.struct("pos", "item_pos", "m.size", "m.slots", "m.item_slots")).alias("hits")
    )
    need = F.least(F.lit(run), F.ceil(F.col("words") * F.lit(share)))
    need = F.greatest(need, F.least(F.lit(window), F.col("words"))).cast("int")
    widest = F.size(F.array_distinct(F.transform("hits", lambda h: h["item_pos"]))) * F.least(F.lit(window), F.col("words"))
    pairs = pairs.where(widest >= need).select("id", "item_id", "words", need.alias("need"), "hits")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, words, least, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best = judged([(h["pos"], h["item_pos"], h["size"], h["slots"], h["item_slots"]) for h in found], least, window)
                if best:
                    out.append((doc, item, best[0], words, best[1], best[2], True))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["doc_id", "item_id", "covered", "item_words", "n_slots", "reparameterised", "contaminated"]
    found = pairs.mapInArrow(judge, "doc_id long, item_id long, covered long, item_words long, n_slots long, reparameterised boolean, contaminated boolean")
    best = F.max(F.struct(*names[2:])).alias("best")  # of all texts of the two ids
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` no item contaminates; null ids are kept."""
    bad = matches(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad["doc_id"], "left_anti").select(*docs.columns)
