import re
import zlib

import numpy as np

import corpus_pipeline
from arcspark.llm import quality
from arcspark.llm.common import table
from arcspark.llm.queries import QUERIES
from arcspark.plans.scratch import materialise

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS).cache()
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept = {r.doc_id for r in out.collect()}
        assert kept <= ids
        if name == "pii":
            assert kept == ids and out.where("text rlike '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'").count() <= docs.where("text rlike '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'").count()
        else:
            assert 0.5 * len(ids) <= len(kept) <= len(ids)
        docs, ids = out, kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_run_is_the_stages_one_after_the_other(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, docs.select(*columns).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*columns).collect()))


def test_stage_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_every_query_is_registered():
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert quality.SAMPLE == 12_000


def _plain_run(spark):
    """The pipeline in plain Python, but for the trained weights and the terms that pii adds."""
    from tokenizers import Tokenizer

    from arcspark.llm.tokens import tokenizer_path

    rows = [r.asDict() for r in table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS).collect()]
    model = quality.train(table(spark, SF, "documents"), quality.graded(table(spark, SF, "labels")))
    rows = [r for r in rows if model.tails(r["text"])[1] >= 0.5]

    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    group = {d: d for d in sets}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]], Tokenizer.from_file(tokenizer_path())


def test_stages_against_plain_python(spark):
    want, tokenizer = _plain_run(spark)
    docs = corpus_pipeline.keep_distinct(spark, corpus_pipeline.keep_good(spark, table(spark, SF, "documents"), SF), SF)
    docs = materialise(docs, "test")
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(r["doc_id"] for r in want)

    def grams(text):
        w = re.findall(r"\w+", (text or "").lower())
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    asked = set().union(*(grams(r.text) for r in table(spark, SF, "benchmark").collect()))
    clean = materialise(corpus_pipeline.drop_leaks(spark, docs, SF), "test")
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in want if not grams(r["text"]) & asked}
    told = materialise(corpus_pipeline.sanitise(spark, clean, SF), "test")
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in told.collect():
        assert r.n_chars == len(r.text)
        # what is left of a text stands in it in the same order
        at = 0
        for part in re.split(r"\[(?:EMAIL|IP|CARD|PHONE|TERM)\]", r.text):
            at = before[r.doc_id].index(part, at) + len(part)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
    pieces = {}
    for r in corpus_pipeline.pack(spark, told, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for r in told.collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = range(0, len(ids), 2048)
        assert sorted(pieces[r.doc_id]) == [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(cuts)]


def test_stages_on_odd_rows(spark, odd_docs):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names: no stage fails, and ids that it keeps were there."""
    rows = odd_docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept = out.collect()
        assert len(kept) <= rows and {r.doc_id for r in kept} <= {r.doc_id for r in odd_docs.select("doc_id").collect()}, name
        if name == "ngram_jaccard":
            assert any(r.text is None for r in kept) and any(r.text == "" for r in kept)
        if name in ("pii", "decontamination"):
            assert len(kept) == rows, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, SF).select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count()
