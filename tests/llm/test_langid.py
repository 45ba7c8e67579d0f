from pyspark.sql import functions as F

from arcspark.llm import langid
from arcspark.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == docs.count() and 150 < len(held) < 350
    assert sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows(odd_docs, no_docs):
    found = langid.identify(odd_docs).collect()
    assert len(found) == odd_docs.count()
    unknown = {r.doc_id for r in found if r.lang_pred == "und"}
    assert unknown >= {0, 1, 2, 8} and 10 not in unknown
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    assert langid.identify(no_docs).collect() == []
    untrained = langid.predict(odd_docs, langid.train(no_docs), "doc_id").collect()
    assert {r.lang_pred for r in untrained} == {"und"}


def test_long_texts_are_scored_in_slices_as_a_whole(monkeypatch):
    text = "Der schnelle braune Fuchs springt. " * 400
    whole = sorted(langid.buckets(langid.code_points(text)))
    monkeypatch.setattr(langid, "SLICE", 1000)
    parts = [int(b) for p in langid.slices(langid.code_points(text)) for b in langid.buckets(p)]
    assert set(parts) == {int(b) for b in whole} and abs(len(parts) - len(whole)) < len(whole) / 100


def test_against_a_plain_naive_bayes(spark, rng):
    import math

    rows = [(i, "".join(rng.choice("abcdé fgh,ij") for _ in range(rng.choice([0, 3, 40, 200]))), rng.choice(["xx", "yy", "zz", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_text", F.lit("no"))
    counts, seen = {}, {}
    for _, text, lang in rows:
        points = langid.code_points(text)
        if lang and len(points):
            seen[lang] = seen.get(lang, 0) + 1
            for b in langid.buckets(points).tolist():
                counts.setdefault(lang, {})[b] = counts.setdefault(lang, {}).get(b, 0) + 1
    total = {k: sum(v.values()) + langid.SMOOTHING * 2**langid.BITS for k, v in counts.items()}
    found = {r.doc_id: r for r in langid.predict(docs, langid.train(docs), "doc_id", "_text").collect()}
    for i, text, _ in rows:
        points = langid.code_points(text)
        if not len(points):
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        logs = {k: math.log(seen[k] / sum(seen.values())) + sum(math.log((counts[k].get(b, 0) + langid.SMOOTHING) / total[k]) for b in langid.buckets(points).tolist()) for k in seen}
        top = max(logs.values())
        share = 1 / sum(math.exp(x - top) for x in logs.values())
        assert abs(found[i].score - share) < 1e-3
        assert logs[found[i].lang_pred] >= top - 1e-3 and found[i]._text == "no"
