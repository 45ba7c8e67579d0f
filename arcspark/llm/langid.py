"""Operator 3: language identification by multinomial naive Bayes.

Features are hashed character 1-, 2- and 3-grams of the lower-cased letters of the whole
text, with runs of anything else as one separator. Training sums counts for each (language,
bucket) in Spark; the matrix of log probabilities, of languages x buckets, is broadcast,
and texts are scored in numpy by gathering matrix rows and summing them by document.

Memory: at most ``SLICE`` code points are expanded at a time, so long texts are scored in
slices. The matrix is bounded by ``MAX_LANGS`` x 2^``BITS``.

Defined cases: null text and text without letters give ``und`` with score 0; equal scores go
to the language first in order; without training rows all is ``und``; repeated rows count
and are predicted each for itself; columns other than those named are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import arrow_map, small_batches, unused
from arcspark.plans.scratch import materialise

BITS, SLICE, AT_ONCE, MAX_LANGS, SMOOTHING, UNKNOWN = 16, 1 << 19, 1 << 16, 256, 0.5, "und"
_MULTIPLIERS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased letters of a text, other runs as one 0, with a 0 at both ends; empty without letters."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[raw]
    if not letter.any():
        return np.zeros(0, dtype=np.uint32)
    points = np.where(letter, raw, 0).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep]
    return np.concatenate([[0], points, [0]] if points[-1] else [[0], points]).astype(np.uint32)


def buckets(points: np.ndarray) -> np.ndarray:
    """Hash buckets of all 1-, 2- and 3-grams of a code point array."""
    out, h = [], np.zeros(len(points), dtype=np.uint32)
    for order, multiplier in enumerate(_MULTIPLIERS):
        if len(points) <= order:
            break
        h = (h[: len(points) - order] + points[order:] + np.uint32(order + 1)) * multiplier
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def slices(points: np.ndarray) -> list[np.ndarray]:
    """Overlapping slices that hold each trigram once (lower orders at the seams twice)."""
    return [points[at : at + SLICE + 2] for at in range(0, max(1, len(points) - 2), SLICE)]


def counts(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``text, lang``; bucket -1 counts documents."""
    small_batches(docs.sparkSession)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                points = code_points(text.as_py())
                if not len(points):
                    continue
                seen[lang] = seen.get(lang, 0) + 1
                into = held.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                for part in slices(points):
                    found = buckets(part)
                    if len(found) > 1 << BITS:
                        into += np.bincount(found, minlength=1 << BITS)
                    else:
                        np.add.at(into, found, 1)
        for lang, into in held.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(at) + 1), pa.string()),
                    pa.array(np.append(at, -1).astype(np.int32)),
                    pa.array(np.append(into[at], seen[lang])),
                ],
                names=["lang", "bucket", "n"],
            )

    part = docs.where(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return part.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order, and their log probabilities (buckets x languages)."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, log_prior: np.ndarray) -> None:
        self.langs, self.log_prob, self.log_prior = langs, log_prob, log_prior

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_batch([text])[0]

    def predict_batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of each text: the rows that a batch's n-grams name are gathered and summed by text."""
        totals = np.tile(self.log_prior, (len(texts), 1))
        known = np.zeros(len(texts), bool)
        held: list[np.ndarray] = []
        whose: list[int] = []

        def add() -> None:
            if held:
                starts = np.cumsum([0, *(len(x) for x in held[:-1])])
                np.add.at(totals, whose, np.add.reduceat(self.log_prob[np.concatenate(held)], starts, axis=0, dtype=np.float64))
                held.clear()
                whose.clear()

        size = 0
        for i, text in enumerate(texts):
            points = code_points(text)
            if not len(points) or not self.langs:
                continue
            known[i] = True
            for part in slices(points):
                found = buckets(part)
                if len(found):
                    held.append(found)
                    whose.append(i)
                    size += len(found)
                if size > AT_ONCE:
                    add()
                    size = 0
        add()
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        best = totals.argmax(axis=1)
        score = 1 / np.exp(np.minimum(totals - totals.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return [(self.langs[b], float(x)) if k else (UNKNOWN, 0.0) for b, x, k in zip(best.tolist(), score, known.tolist(), strict=True)]


def train(docs: DataFrame) -> Model:
    """Fit on all rows with a language. The driver gets at most MAX_LANGS x (2^BITS + 1) counts."""
    summed = materialise(counts(docs), "counts")
    found = summed.where("bucket = -1").orderBy("lang").limit(MAX_LANGS + 1)
    table = summed.toArrow() if len(found.take(MAX_LANGS + 1)) <= MAX_LANGS else None
    if table is None:
        raise ValueError(f"more than {MAX_LANGS} languages")
    lang, bucket, n = (table[c].to_numpy() if c != "lang" else table[c].to_pylist() for c in ("lang", "bucket", "n"))
    langs = sorted(set(lang))
    at = {x: i for i, x in enumerate(langs)}
    column = np.fromiter((at[x] for x in lang), dtype=np.int64, count=len(lang))
    grams, docs_seen = np.full((1 << BITS, len(langs)), SMOOTHING), np.zeros(len(langs))
    is_doc = bucket == -1
    grams[bucket[~is_doc], column[~is_doc]] += n[~is_doc]
    docs_seen[column[is_doc]] = n[is_doc]
    return Model(
        langs,
        np.log(grams / grams.sum(axis=0)).astype(np.float32) if langs else grams.astype(np.float32),
        np.log(docs_seen / docs_seen.sum()) if langs else docs_seen,
    )


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = docs.select(*keep, F.col("text").cast("string").alias(*unused(docs, "_text")))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        said = shared.value.predict_batch(batch.column(batch.num_columns - 1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())],
            names=[*batch.schema.names[:-1], "lang_pred", "score"],
        )

    schema = ", ".join(f"`{n}` {t}" for n, t in part.dtypes[:-1])
    return arrow_map(part, rows, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """True where CRC-32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that aren't held out; predict all of them."""
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = train(marked.where(~F.col("held_out")))
    return predict(marked, model, "doc_id", "held_out")
