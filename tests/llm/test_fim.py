import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcspark.llm import fim
from arcspark.llm.queries import op12_fill_in_middle

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


def plain_way(doc_id, text, rate=100):
    """The transformation over code points, with no automaton."""
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    spm = h4 % 100 < 50
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), out


def key(row):
    return tuple((x is not None, x) for x in row)


def check(docs, **options):
    got = sorted((tuple(r) for r in fim.transform(docs, **options).collect()), key=key)
    options.pop("giant", None)
    assert got == sorted((plain_way(r.doc_id, r.text, **options) for r in docs.select("doc_id", "text").collect()), key=key)


def some_text(rng, n):
    return "".join(rng.choice(["\n", "\n\n", "<", "<P", "S>", ">", "<M", "é", "日本", "😀", "word ", "x", "\r", " ", "\x0b"]) for _ in range(n))


@pytest.fixture
def texts(spark, rng):
    rows = [(i, some_text(rng, rng.choice([1, 2, 3, 30, 300, 3000]))) for i in range(150)]
    rows += [(1000 + i, some_text(rng, 400).replace("<P>", "").replace("S>", "").replace("<M", "")) for i in range(60)]
    rows += [(2000 + i, t) for i, t in enumerate(["\n", "\n\n", "a\n", "a", "<P>", "x<M>", "<<S>", "<P\n>", "\n" * 5000, "y" * 5000, "z" * 1023 + "\nb", "z" * 1022 + "<P>"])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equals_the_plain_way(texts):
    check(texts)
    check(texts, rate=40)


@pytest.mark.parametrize("giant", [7, 100, 1500])
def test_giant_documents_in_pieces(texts, giant):
    check(texts.unionByName(texts.limit(20)), giant=giant)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    check(odd_docs, giant=1000)
    assert fim.transform(no_docs).collect() == []


def test_functions_of_chunks_compose(rng):
    """Every start state of every chunk, against a run from that state; composed, against a run over the whole text."""
    data = np.frombuffer(some_text(rng, 4000).encode(), np.uint8)

    def run(state, part):
        units = hits = 0
        for byte in part:
            step = state * fim.CLASSES + fim._CLASS[byte]
            units, hits, state = units + (state < 3), hits + (fim._COUNTED[step] >> fim.HIT), fim._NEXT[step]
        return state, units, hits

    starts = np.sort(np.append(rng.sample(range(1, len(data)), 40), 0))
    sizes = np.diff(np.append(starts, len(data)))
    found = fim.functions_of(data, starts, sizes)
    for i, (at, size) in enumerate(zip(starts, sizes, strict=True)):
        for state in range(fim.STATES):
            assert tuple(x[state, i] for x in found) == run(state, data[at : at + size])
    through = fim.composed(np.arange(len(starts)), *found)
    assert tuple(x[0, -1] for x in through) == run(0, data)
    assert through[2][0, -1] == len(re.findall(rb"<[PSM]>", data.tobytes()))


def test_restored(texts):
    rows = fim.digests(fim.transform(texts)).join(texts.withColumn("sha", F.sha2("text", 256)), "doc_id").collect()
    assert rows
    assert all(r.restored_sha256 == r.sha for r in rows)
    assert all((r.output_sha256 == r.sha) == (r.form == "plain") for r in rows)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(*(w := plain_way(*r))[:5], sha(w[5]), sha(r.text)) for r in rows]
    assert sorted(tuple(r) for r in op12_fill_in_middle(spark, sf_dir).collect()) == sorted(want)
