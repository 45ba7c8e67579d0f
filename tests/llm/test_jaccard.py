import itertools
import re

import pytest

from arcspark.llm import jaccard


def brute(rows, words, percent):
    """Components by comparing all pairs of sets of shingle tuples."""
    sets = []
    for doc_id, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(found) < words:
            sets.append({tuple(found)} if found else set())
        else:
            sets.append({tuple(found[i : i + words]) for i in range(len(found) - words + 1)})
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
        linked = rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
        if linked or same_id and sets[i] and sets[j]:
            group[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((str(d), len(sets[i]), str(least.get(top(i), d) if sets[i] else d)) for i, (d, _) in enumerate(rows)))


def got(docs, words, percent):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.components(docs, words, percent).collect())


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 50)])
def test_components_by_brute_force(spark, rng, words, percent):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.choice([2, 30, 90, 160]))
        if base % 3 == 0:
            text = text + passage
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(copy).title() if base % 4 == 0 else "  ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "w1"), (2004, "W1"), (2005, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(docs, words, percent) == brute(rows, words, percent)


def test_chain_of_links_is_one_component(spark):
    base = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(8):  # each differs from the next in one word, the ends in many
        base = list(base)
        base[k * 12] = f"new{k}"
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard.components(docs, 3, 90).collect()} == {0}
    assert got(docs, 3, 90) == brute(rows, 3, 90)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(odd_docs, 3, 90) == brute(rows, 3, 90)
    assert jaccard.components(no_docs).collect() == []
    kept = jaccard.keep_first(odd_docs, 3, 90)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd_docs.collect()} - {6}


def test_texts_of_one_id_are_one_document(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(5, one), (5, two), (3, one), (9, two), (7, "something else entirely here")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.components(docs).collect()} == {(3, 3), (5, 3), (9, 3), (7, 7)}
