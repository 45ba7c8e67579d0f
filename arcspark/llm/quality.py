"""Operator 10: ordinal cumulative-link regression on graded ratings.

A document's grade y in 0..K-1 follows P(y >= k) = logistic(score - threshold_k), with one
weight vector over hashed text features shared by all grades and ordered thresholds. The
expected grade is the sum of the tail probabilities; a document is selected when the
tail probability of the wanted grade is at least ``keep_from``.

Features: hashed words (lower case, outer punctuation off) and hashed word shapes, with
value SCALE * sqrt(share of the words), and how far the document repeats its words and lines.

The model is fitted in one task on at most ``SAMPLE`` rated documents, those whose hashed
ids are least; only features whose presence there tells grades apart (likelihood-ratio
statistic of at least ``TELLING``) get a weight and go to that task. Every whole text of the table is scored. The weights, 2^BITS floats, are
broadcast.

Defined cases: null or empty text, or text without words, has no word features and is scored
by its emptiness alone (as the ratings have it); ratings that are null or name no document are not used; a document
rated several times counts with its lowest grade, and one with several texts is learned from by the
least of them (by its bytes; null where it has no other); columns of ``docs`` named like those of ``ratings`` don't clash; without usable ratings of two grades all
documents get the middle of the scale and are kept; repeated rows are scored each for
itself; other columns are kept by ``select`` and not read by ``score``.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import WordCache, arrow_map, claim, small_batches, unused
from arcspark.plans.scratch import discard, materialise

BITS, SAMPLE, EPOCHS, RATE, DECAY, SEED = 18, 12_000, 30, 0.3, 1e-5, 7
SCALE, TELLING = 10.0, 12.0
_MASK = (1 << BITS) - 1
_PUNCTUATION = string.punctuation.encode()
_RUNS = ((re.compile(rb"[a-z]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"[\x80-\xff]+"), b"z"))


def bucket(kind: bytes, value: bytes) -> int:
    return xxhash.xxh64_intdigest(kind + b"\x00" + value) & _MASK


def _buckets(word: bytes) -> int:
    """The buckets of a word and of its shape, in one number."""
    core = word.strip(_PUNCTUATION)
    core = core.lower() if core.isascii() else core.decode("utf-8", "replace").lower().encode()
    shape = word
    for run, sign in _RUNS:
        shape = run.sub(sign, shape)
    return bucket(b"word", core) << BITS | bucket(b"shape", shape[:12])


_FEATURES = WordCache(_buckets)


def _begin() -> None:
    claim(_FEATURES)


def _decile(share: float) -> bytes:
    return b"%d" % int(10 * share)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of a whole text and their values."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.array([bucket(b"always", b""), bucket(b"empty", b"")], dtype=np.int64), np.ones(2)
    both = np.fromiter(map(_FEATURES.__getitem__, words), dtype=np.int64, count=n)
    found, counts = np.unique(np.concatenate([both >> BITS, both & _MASK]), return_counts=True)
    lines = raw.split(b"\n")
    size = b"%d" % (n.bit_length() // 2)
    again = sum(map(bytes.__eq__, words[1:], words)) / n
    whole = [
        bucket(b"always", b""),
        bucket(b"again", _decile(again)),
        bucket(b"variety", _decile(len(set(words)) / n) + b"/" + size),
        bucket(b"lines", _decile(len(set(lines)) / len(lines)) + b"/" + b"%d" % len(lines).bit_length()),
        bucket(b"length", size),
    ]
    values = SCALE * np.sqrt(counts / n)
    return np.concatenate([found, np.array(whole, dtype=np.int64)]), np.concatenate([values, np.full(len(whole), 1.0)])


@dataclass
class Model:
    """Shared weights and the K-1 ordered thresholds of K grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(y >= k) for k = 1..K-1."""
        at, values = features(text)
        return _logistic(float(self.weights[at] @ values) - self.thresholds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _telling(sizes: list[int]) -> Column:
    """The largest likelihood-ratio statistic over the grade boundaries, of counts ``n_0, n_1, ...`` by grade; ``sizes``: documents of each grade."""
    def surprise(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (total * F.lit(share)))).otherwise(0.0)

    total, here, stats = sum((F.col(f"n_{k}") for k in range(len(sizes))), F.lit(0)), F.lit(0), []
    for k in range(1, len(sizes)):
        here, share = here + F.col(f"n_{k - 1}"), sum(sizes[:k]) / sum(sizes)
        stats.append(2 * (surprise(here, share) + surprise(total - here, 1 - share)))
    return F.greatest(*stats, F.lit(0.0))


def fit(at: np.ndarray, values: np.ndarray, ends: np.ndarray, grades: np.ndarray, n_grades: int) -> Model:
    """Adagrad on the cumulative-link log likelihood, in shuffled batches.

    Document i has the features ``at[ends[i]:ends[i + 1]]`` with their values; none is empty.
    """
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]) if len(grades) else np.full(n_grades - 1, 0.5)
    start = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
    # thresholds = first, first + exp(step), ...: ordered whatever the parameters are
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    free_squares, rng = np.full(len(free), 1e-6), np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 4)
        for batch in np.array_split(rng.permutation(len(grades)), max(1, len(grades) // 256)):
            sizes = ends[batch + 1] - ends[batch]
            here = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in batch])
            of, x = at[here], values[here]
            score = np.add.reduceat(weights[of] * x, np.concatenate([[0], np.cumsum(sizes[:-1])]))
            steps = np.exp(free[1:])
            thresholds = np.cumsum(np.concatenate([free[:1], steps]))
            y = grades[batch]
            # P(y = k) = F(score - t_k) - F(score - t_{k+1}), with t_0 = -inf and t_K = inf
            edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
            low, high = _logistic(score - edges[y]), _logistic(score - edges[y + 1])
            p = np.maximum(low - high, 1e-9)
            d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
            slope = d_low - d_high
            gradient = np.bincount(of, np.repeat(-slope, sizes) * x, minlength=1 << BITS) / len(batch)
            touched = np.unique(of)
            g = gradient[touched] + DECAY * weights[touched]
            squares[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(squares[touched])
            d_edges = np.bincount(y, d_low, minlength=n_grades + 1) - np.bincount(y + 1, d_high, minlength=n_grades + 1)
            d_thresholds = d_edges[1:n_grades] / len(batch)
            tail = np.cumsum(d_thresholds[::-1])[::-1]
            g = np.concatenate([tail[:1], tail[1:] * steps])
            free_squares += g * g
            free -= rate * g / np.sqrt(free_squares)
    return Model(weights.astype(np.float32), np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from ratings: 0 toxic, 1 poor, 2 good; the lowest where there are several."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality").isNull(), None).otherwise(F.when(F.col("quality") > 0, 2).otherwise(1))
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _part(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.col("text").cast("string").alias(*unused(docs, "_text")))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ``ratings`` (doc_id, grade) that name a document.

    The sample's ids are broadcast (bounded by ``sample``). Features are counted by grade in Spark, and one
    task fits the telling ones of the sample; their names and the model, of fixed size, reach the driver.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = ratings.select("doc_id", "grade").join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    part = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(x.as_py()) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())), pa.array([y.astype(np.float32) for _, y in found], pa.list_(pa.float32()))],
            names=["doc_id", "grade", "at", "value"],
        )

    schema = f"doc_id {dict(part.dtypes)['doc_id']}, grade int, at array<int>, value array<float>"
    found = materialise(arrow_map(part, rows, schema, _begin), "features", compression="zstd")
    sizes = dict(found.groupBy("grade").count().collect())
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS, dtype=np.float32), np.zeros(n_grades - 1))
    here = found.select("grade", F.explode("at").alias("at")).groupBy("at").agg(*(F.count(F.when(F.col("grade") == k, 1)).alias(f"n_{k}") for k in range(n_grades)))
    told = here.where(_telling([sizes.get(k, 0) for k in range(n_grades)]) >= TELLING).select("at")
    wanted = np.zeros(1 << BITS, dtype=bool)
    wanted[[bucket(b"always", b""), *(r[0] for r in told.collect())]] = True  # at most 2^BITS numbers
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def trim(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = np.unpackbits(shared.value).astype(bool)
        at, value = batch.column(2), batch.column(3)
        ends, mask = at.offsets.to_numpy() - at.offsets[0].as_py(), kept[at.flatten().to_numpy()]
        ends = pa.array(np.concatenate([[0], np.cumsum(mask)])[ends].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x.flatten().filter(pa.array(mask))) for x in (at, value)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=batch.schema.names)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("doc_id")
        at, value = table["at"].combine_chunks(), table["value"].combine_chunks()
        model = fit(at.flatten().to_numpy(), value.flatten().to_numpy(), at.offsets.to_numpy() - at.offsets[0].as_py(), table["grade"].to_numpy().astype(np.int64), n_grades)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.thresholds)], names=["weights", "thresholds"])

    row = arrow_map(found, trim, schema).repartition(1).mapInArrow(fitted, "weights binary, thresholds binary").first()
    shared.destroy()
    discard(found)
    return Model(np.frombuffer(row.weights, np.float32), np.frombuffer(row.thresholds, np.float64))


def score(docs: DataFrame, model: Model, *columns: str, wanted: int = 2, keep_from: float = 0.5) -> DataFrame:
    """``columns`` with ``expected_grade``, ``p_wanted`` (the tail probability) and ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = _part(docs, *columns)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        tails = np.array([shared.value.tails(x.as_py()) for x in batch.column(batch.num_columns - 1)])
        p = tails[:, wanted - 1]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(tails.sum(axis=1)), pa.array(p), pa.array(p >= keep_from)],
            names=[*batch.schema.names[:-1], "expected_grade", "p_wanted", "keep"],
        )

    schema = ", ".join(f"`{n}` {t}" for n, t in part.dtypes[:-1])
    return arrow_map(part, rows, f"{schema}, expected_grade double, p_wanted double, keep boolean", _begin)


def select(docs: DataFrame, ratings: DataFrame, wanted: int = 2, keep_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model fitted on ``ratings`` keeps, in their own columns."""
    model = train(docs, ratings)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [bool(shared.value.tails(x.as_py())[wanted - 1] >= keep_from) for x in batch.column(at)]
        return batch.filter(pa.array(kept, pa.bool_()))

    return arrow_map(docs, rows, docs.schema, _begin)
