"""Operator 12: fill-in-middle transformation by a parallel automaton scan.

A text is cut into units, its lines ``[^\\n]*\\n|[^\\n]+``; a prefix and a middle end after
pseudo-random numbers of units, and the parts are put in the order prefix, suffix, middle
(``psm``) or suffix, prefix, middle (``spm``) behind the markers ``<P>``, ``<S>`` and ``<M>``. Texts
that are empty or hold a marker stay as they are (``plain``).

Units and markers are found by one automaton over UTF-8 bytes (six states: at a line's start or
not, by how much of a marker was read). Nothing is scanned from a text's start on: every chunk of
``CHUNK`` bytes gives its state-transition function and, for each state it may be entered in, the
units that begin and the markers that end in it. Functions compose associatively, so a scan by
doubling resolves the state in which each chunk is entered and the units before it, and a cut is
looked up in the one chunk where its unit begins.

Texts of more than ``GIANT`` bytes are written in pieces of that size to the shared folder first, so that
tasks scan pieces of one text at the same time. Pieces send one function, counts by start state and
a count of code points; these are composed for each text, which selects the piece that
holds a cut, and the text's own row then looks into that piece only. Results are the same for any
``GIANT`` and ``CHUNK``.

Defined cases: null text counts as empty (``plain``, no units); a null ``doc_id`` counts as an empty
string where numbers are drawn; rows that repeat are transformed each for itself, and alike; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import arrow_map, small_batches
from arcspark.plans.scratch import materialise

CHUNK, GIANT = 1024, 1 << 20
P, S, M = b"<P>", b"<S>", b"<M>"
STATES, CLASSES, HIT = 6, 5, 16

OUT = "n long, form string, prefix_chars long, middle_chars long, output string"
PIECES = "key string, h1 long, h2 long, piece int, data binary"
SUMMARY = "key string, h1 long, h2 long, piece int, next array<int>, units array<long>, hits array<long>, chars long"
CUTS = "key string, n long, hits long, " + ", ".join(f"piece_{c} int, nth_{c} long, fresh_{c} boolean, chars_{c} long" for c in ("lo", "hi"))


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; next state, and what is counted, for state * CLASSES + class.

    State: 3 where a line has begun, plus 1 after ``<`` and 2 after ``<`` and a letter of a marker.
    Counted: 1 where a unit begins, 1 << HIT where a marker ends.
    """
    of_byte = np.zeros(256, np.uint8)
    for c, some in enumerate((b"\n", b"<", bytes({P[1], S[1], M[1]}), b">"), 1):
        of_byte[list(some)] = c
    then, counted = np.zeros(STATES * CLASSES, np.uint8), np.zeros(STATES * CLASSES, np.int32)
    for state in range(STATES):
        begun, read = divmod(state, 3)
        for c in range(CLASSES):
            marker = 1 if c == 2 else 2 if c == 3 and read == 1 else 0
            then[state * CLASSES + c] = 3 * (c != 1) + marker
            counted[state * CLASSES + c] = (not begun) + ((read == 2 and c == 4) << HIT)
    return of_byte, then, counted


_CLASS, _NEXT, _COUNTED = _automaton()


def functions_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chunks of up to CHUNK bytes: last state, units begun and markers ended, by start state (rows).

    All chunks advance together, byte by byte; once the states of all start states agree, one of them goes on for all.
    """
    order = np.argsort(-sizes, kind="stable")
    at, sizes = starts[order], sizes[order]
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], len(at), axis=1)
    counts = np.zeros((STATES, len(at)), np.int32)
    live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")  # chunks that have an i-th byte
    one = None
    for i, n in enumerate(live):
        of = _CLASS[data[at[:n] + i]]
        if one is None:
            step = state[:, :n] * np.uint8(CLASSES) + of
            counts[:, :n] += _COUNTED[step]
            state[:, :n] = _NEXT[step]
            if (state[:, :n] == state[0, :n]).all():
                one, joint, merged = state[0, :n].copy(), np.zeros(n, np.int32), n
        else:
            step = one[:n] * np.uint8(CLASSES) + of
            joint[:n] += _COUNTED[step]
            one[:n] = _NEXT[step]
    if one is not None:
        state[:, :merged] = one
        counts[:, :merged] += joint
    back = np.argsort(order, kind="stable")
    state, counts = state[:, back], counts[:, back].astype(np.int64)
    return state, counts & ((1 << HIT) - 1), counts >> HIT


def composed(place: np.ndarray, then: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """From each sequence's start through each of its elements, by doubling; ``place``: an element's number in its sequence."""
    step = 1
    while len(at := np.flatnonzero(place >= step)):
        before = then[:, at - step]
        sums = tuple(_replaced(s, at, s[:, at - step] + np.take_along_axis(s[:, at], before, axis=0)) for s in sums)
        then = _replaced(then, at, np.take_along_axis(then[:, at], before, axis=0))
        step *= 2
    return then, *sums


def _replaced(whole: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
    out = whole.copy()
    out[:, at] = part
    return out


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Scanned:
    """The chunks of several texts that lie one after the other in ``data``, resolved."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        pieces = -(-np.diff(offsets) // CHUNK)
        self.data, self.first = data, np.concatenate([[0], np.cumsum(pieces)])
        text = np.repeat(np.arange(len(pieces)), pieces)
        place = np.arange(len(text)) - self.first[text]
        self.starts = offsets[text] + place * CHUNK
        self.ends = np.minimum(self.starts + CHUNK, offsets[text + 1])
        self.then, self.units, self.hits = composed(place, *functions_of(data, self.starts, self.ends - self.starts))

    def total(self, text: int) -> tuple[int, int]:
        """Units and markers of a text."""
        last = self.first[text + 1] - 1
        return (0, 0) if last < self.first[text] else (int(self.units[0, last]), int(self.hits[0, last]))

    def begin_of(self, text: int, unit: int, state: int = 0) -> int:
        """Where a unit (from 0) of a text begins, the text being entered in ``state``."""
        first, end = self.first[text], self.first[text + 1]
        chunk = first + int(np.searchsorted(self.units[state, first:end], unit, "right"))
        before, entered = (0, state) if chunk == first else (int(self.units[state, chunk - 1]), int(self.then[state, chunk - 1]))
        nth = unit - before - (entered < 3)  # a line may begin with the chunk
        start = int(self.starts[chunk])
        return start if nth < 0 else start + 1 + int(np.flatnonzero(self.data[start : self.ends[chunk]] == 10)[nth])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column's texts, one after the other, and where each begins; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def _arranged(text: np.ndarray, lo: int, hi: int, spm: bool) -> bytes:
    prefix, middle, suffix = (text[a:b].tobytes() for a, b in ((0, lo), (lo, hi), (hi, len(text))))
    return b"".join((S, suffix, P, prefix, M, middle) if spm else (P, prefix, S, suffix, M, middle))


def _drawn(h1: int, h2: int, n: int) -> tuple[int, int]:
    """After how many units prefix and middle end."""
    return min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))


def _result(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *(c.split()[0] for c in OUT.split(", "))])


def _transformed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts of a batch: all their chunks are scanned at once."""
    data, offsets = _texts(batch.column("text"))
    scan, rows = Scanned(data, offsets), []
    h1, h2, mixed, spm = (batch.column(c).to_pylist() for c in ("h1", "h2", "mixed", "spm"))
    for i in range(batch.num_rows):
        begin, end = int(offsets[i]), int(offsets[i + 1])
        n, hits = scan.total(i)
        if not n or hits or not mixed[i]:
            rows.append((n, "plain", None, None, data[begin:end].tobytes()))
            continue
        lo, hi = (scan.begin_of(i, u) if u < n else end for u in _drawn(h1[i], h2[i], n))
        out = _arranged(data[begin:end], lo - begin, hi - begin, spm[i])
        rows.append((n, "spm" if spm[i] else "psm", _chars(data[begin:lo]), _chars(data[lo:hi]), out))
    return _result(batch.column("doc_id"), rows)


def _pieces(size: int):
    """Rows of giant texts -> their pieces; a piece may begin within a code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch.column("text"))
            key, h1, h2 = (batch.column(c).to_pylist() for c in ("key", "h1", "h2"))
            for i in range(batch.num_rows):
                for piece, at in enumerate(range(offsets[i], offsets[i + 1], size)):
                    part = data[at : min(at + size, offsets[i + 1])].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([key[i]]), pa.array([h1[i]]), pa.array([h2[i]]), pa.array([piece], pa.int32()), pa.array([part], pa.binary())], names=["key", "h1", "h2", "piece", "data"])

    return run


def _summary(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A piece's function and counts: those from its start through its last chunk."""
    data, offsets = _texts(batch.column("data"))
    scan = Scanned(data, offsets)
    last = scan.first[1:] - 1  # a piece isn't empty
    columns = [pa.array(x[:, last].T.astype(t).tolist(), pa.list_(pa.from_numpy_dtype(t))) for x, t in ((scan.then, np.int32), (scan.units, np.int64), (scan.hits, np.int64))]
    chars = pa.array([_chars(data[a:b]) for a, b in zip(offsets, offsets[1:])], pa.int64())  # noqa: B905
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "h1", "h2", "piece")), *columns, chars], names=[c.split()[0] for c in SUMMARY.split(", ")])


def _selected(text: pd.DataFrame) -> pd.DataFrame:
    """A giant text's pieces, composed: its units and markers, and the piece in which each cut's unit begins."""
    text = text.sort_values("piece")
    then, units, hits = (np.stack(text[c].to_list(), axis=1) for c in ("next", "units", "hits"))
    then, units, hits = composed(np.arange(len(text)), then, units, hits)
    chars = np.concatenate([[0], text["chars"].cumsum()])
    n = int(units[0, -1])
    row = {"key": text["key"].iloc[0], "n": n, "hits": int(hits[0, -1])}
    for name, unit in zip(("lo", "hi"), _drawn(int(text["h1"].iloc[0]), int(text["h2"].iloc[0]), n), strict=True):
        piece = int(np.searchsorted(units[0], unit, "right")) if unit < n else len(text)
        before, fresh = (int(units[0, piece - 1]), bool(then[0, piece - 1] < 3)) if 0 < piece < len(text) else (0, True)
        row |= {f"piece_{name}": piece, f"nth_{name}": unit - before, f"fresh_{name}": fresh, f"chars_{name}": int(chars[piece])}
    return pd.DataFrame([row])


def _cut(size: int):
    """Giant texts with their selected pieces -> transformed; only the pieces that hold a cut are scanned."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = _texts(batch.column("text"))
        out = []
        for i, x in enumerate(batch.drop_columns(["text"]).to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            if x["hits"] or not x["mixed"]:
                out.append((x["n"], "plain", None, None, text.tobytes()))
                continue
            at, chars = [], []
            for c in ("lo", "hi"):
                start, begin = x[f"piece_{c}"] * size, len(text)
                if start < len(text):
                    part = text[start : start + size]
                    begin = start + Scanned(part, np.array([0, len(part)])).begin_of(0, x[f"nth_{c}"], 0 if x[f"fresh_{c}"] else 3)
                at.append(begin)
                chars.append(x[f"chars_{c}"] + _chars(text[start:begin]))
            out.append((x["n"], "spm" if x["spm"] else "psm", chars[0], chars[1] - chars[0], _arranged(text, *at, x["spm"])))
        return _result(batch.column("doc_id"), out)

    return rows


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, giant: int | None = None) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``; rates in percent, of all texts and of those transformed."""
    small_batches(docs.sparkSession)
    size = giant or GIANT
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select("doc_id", "text", h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 < rate).alias("mixed"), (h[3] % 100 < spm_rate).alias("spm"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > size
    out = arrow_map(rows.filter(~long), _transformed, f"doc_id long, {OUT}")
    giants = rows.filter(long).withColumn("key", F.concat_ws(":", F.sha2("text", 256), F.col("doc_id").cast("string")))
    pieces = materialise(giants.mapInArrow(_pieces(size), PIECES), "pieces", **{"parquet.block.size": 4 << 20})
    if pieces.isEmpty():
        return out
    summary = arrow_map(pieces, _summary, SUMMARY).dropDuplicates(["key", "piece"])  # copies of a text give copies of its pieces
    cuts = materialise(summary.groupBy("key").applyInPandas(_selected, CUTS), "cuts")
    return out.unionByName(arrow_map(giants.join(cuts, "key"), _cut(size), f"doc_id long, {OUT}"))


def restored(output: Column, form: Column) -> Column:
    """The text, from what ``transform`` made of it."""
    head, middle = F.substring_index(output, M.decode(), 1), F.substring_index(output, M.decode(), -1)
    psm = F.concat(F.substr(F.substring_index(head, S.decode(), 1), F.lit(4)), middle, F.substring_index(head, S.decode(), -1))
    spm = F.concat(F.substring_index(head, P.decode(), -1), middle, F.substr(F.substring_index(head, P.decode(), 1), F.lit(4)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """Digests of outputs and of the texts restored from them."""
    out, form = F.col("output"), F.col("form")
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(out, 256).alias("output_sha256"), F.sha2(restored(out, form), 256).alias("restored_sha256")
    )
