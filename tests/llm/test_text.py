import hashlib
import re

import pytest
from pyspark.sql import functions as F

from arcspark.llm import decontaminate, html_text, pii, quality
from arcspark.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_by_brute_force(spark, rng, odd_docs):
    words = ["4111 1111-1111 1111", "4111111111111111", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.2.3.0004", "a@b.c@d.e", "a@b.c_x@d.e", "+1 (555) 123-4567", "+12345678901234567", "12", "- 1", "4111  1111", "é😀"]
    texts = ["".join(rng.choice("a@.b-+1 2().0_%é😀") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" ".join(rng.choice(words) for _ in range(8)) for _ in range(300)] + ["1 " * 20_000, "a" * 100_000, "1" * 50_000, "x@" * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (docs, odd_docs):
        found = {}
        for r in pii.digests(pii.find(rows)).collect():
            found.setdefault(r.doc_id, []).append(r.base_sha256)
        want = {}
        for r in rows.collect():
            want.setdefault(r.doc_id, []).append(hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest())
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_addresses_with_zero_parts(spark):
    texts = ["at 10.0.0.1 now", "0.0.0.0", "1.000.2.3", "192.168.0.1, 127.0.0.1", "00256.0.0.1", "0.0.0.256", "0" * 4_000 + ".0.0.00255", "0" * 4_000 + ".0.0.256"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.base_sha256 for r in pii.digests(pii.find(docs)).collect()}
    assert found == {i: hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest() for i, t in enumerate(texts)}
    assert [r.text for r in pii.sanitise(docs).orderBy("doc_id").limit(4).collect()] == ["at [IP] now", "[IP]", "[IP]", "[IP], [IP]"]


def test_terms_that_disclose_an_entity(spark, no_docs):
    rows = [(i, f"Report {i} says the Zorblatt office, mail boss@corp.example now and the rest number{i}") for i in range(5)]
    rows += [(10 + i, f"Report {i} says the usual office now and the rest is mail, nothing else {i}") for i in range(40)]
    rows += [(100, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(1).cast("long"))
    found = {r.doc_id: r for r in pii.digests(pii.find(docs)).collect()}
    text = dict(rows)
    terms = {text[0][int(a) : int(b)] for k, a, b in (x.split(":") for x in found[0].spans.split(",")) if k == "term"}
    assert "Zorblatt" in terms and not terms & {"Report", "says", "the", "office", "rest"}
    assert found[0].n_email == 1 and found[10].spans == "" and found[100].spans == found[0].spans
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[0].text.startswith("Report 0 says the [TERM] office, mail [EMAIL]") and clean[0].n_chars == len(clean[0].text)
    assert clean[10].text == text[10]
    assert pii.digests(pii.find(no_docs)).collect() == [] and pii.sanitise(no_docs).collect() == []


def test_disclosing_terms_anywhere(spark):
    far = "Some words in between that fill more than the window of sixty-four code points on either side. "
    rows = [(i, f"Zorblatt{' and more' * i} opens {i}. {far}Mail boss@corp.example now {'x' * (i + 3)}. {far}zorblatt ends") for i in range(5)]
    rows += [(10 + i, f"Report {i} says the usual and more opens now mail some words in between ends") for i in range(40)]
    rows += [(60, "A text that holds Zorblatt alone"), (61, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[60].endswith("holds [TERM] alone")
    assert all("orblatt" not in t for t in clean.values()) and clean[0].startswith("[TERM] opens 0.")
    assert all(clean[i] == text[i] for i in range(10, 50))
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(5)] + rows[5:45], "doc_id long, text string")
    assert all(r.n_term == 0 for r in pii.digests(pii.find(copies)).collect())


def test_sanitise_keeps_rows_and_columns(odd_docs):
    out = pii.sanitise(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted((str(r.doc_id), r.text or "", r._spans or "") for r in out.collect()) == sorted((str(r.doc_id), r.text or "", r._spans or "") for r in odd_docs.collect())


def test_decontamination(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [
            (1, "If Alice buys 12 apples for 30 dollars and Alice sells 5 of them to Bob then how much money does Alice have left over at the end?"),
            (2, "short item of five"),
            (3, " ".join(map(str, range(30)))),
            (4, None),
        ],
        "item_id long, text string",
    )
    same = "noise. If Carol buys 7 apples for 99 dollars and Carol sells 3 of them to Dave then how much money does Carol have left over at the end? more"
    docs = spark.createDataFrame(
        [(10, same), (10, same), (11, same.replace("Carol sells", "Erin sells").replace("does Carol", "does Frank")), (12, None), (13, ""), (14, "here is a short item of five words"), (15, " ".join(map(str, range(30)))), (16, "- - -")],
        "doc_id long, text string",
    )
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, items).collect()}
    assert set(found) == {(10, 1), (14, 2)} and found[10, 1].reparameterised and found[10, 1].n_slots == 6
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [11, 12, 13, 15, 16]
    assert decontaminate.matches(no_docs, items).collect() == [] and decontaminate.matches(odd_docs, items.limit(0)).collect() == []
    kept = decontaminate.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_several_texts_of_one_id(spark):
    """Each text of an item and of a document is compared, whatever the order and partitioning of the rows."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(150)]
    one, two, three = (" ".join(words[a : a + 40]) for a in (0, 50, 100))
    items = spark.createDataFrame([(1, one), (1, two), (1, one), (2, three), (2, None), (2, "")], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"then {one} so"), (11, f"then {two} so"), (12, "clean"), (12, f"{three} end"), (12, "clean too"), (13, "clean"), (10, two)], "doc_id long, text string")
    for n in (2, 200):
        found = decontaminate.matches(docs.repartition(n), items.repartition(n, "text")).collect()
        assert sorted((r.doc_id, r.item_id, r.covered, r.item_words) for r in found) == [(10, 1, 40, 40), (11, 1, 40, 40), (12, 2, 40, 40)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [13]


def test_verbatim_leaks(spark):
    items = [(1, "What is 7 times 8?"), (2, "Name three colours"), (3, "Alpha 12 Beta 15 Gamma 17 Delta 19 Epsilon 23 Zeta 29 Eta 31 Theta 37"), (4, "how many sides has a square")]
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = [(10, "asked, What is 7 times 8? now"), (11, "please Name three colours"), (12, "in Alpha 12 Beta 15 Gamma 17 Delta 19 Epsilon 23 Zeta 29 Eta 31 Theta 37 out"), (13, "then How many sides has a square"), (14, "What is 7 times 9? Name two colours")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == {(10, 1), (11, 2), (12, 3), (13, 4)}


def test_leaks_with_changed_places(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)]
    named = [*words[:10], "Alice", *words[10:40], "Alice", *words[40:]]
    twice = "if a shop sells 5 apples and 5 pears to each man who comes in then what is left"
    items = spark.createDataFrame([(1, " ".join(named)), (2, twice), (3, " ".join(words[:20]))], "item_id long, text string")
    docs = [(10, " ".join([*named[:41], "Erin", *named[42:]])), (11, twice.replace("5 apples and 5", "7 apples and 3")), (12, " ".join([*words[:10], "more", *words[10:20]]))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(10, 1), (11, 2), (12, 3)} <= {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}


def test_leaks_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")

    def words(text):
        return re.findall(r"\w+", text.lower())

    def grams(text, n=13):
        w = words(text)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    asked = {r.item_id: grams(r.text) for r in items.collect()}
    want = set()
    for r in docs.collect():
        mine = grams(r.text)
        want |= {(r.doc_id, i) for i, g in asked.items() if g & mine}
    assert want and {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()} == want


def test_main_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>'
        "<article><header><h1>Title &amp; more</h1><p>by me</p></header><p>a<b>b</b>c&nbsp; d<br>e<aside>no</aside><p title='a>b'>f<!-- x --><script>1<2</script>"
        '<form><p>name</p></form><div id="comments"><p>nice</p></div></article><article class="comment">bad</article><footer>foot</footer></body></html>'
    )
    pages = spark.createDataFrame([(1, "http://a.example/x", page), (1, "http://a.example/x", page), (2, None, None), (None, "u", "plain &lt;text"), (4, "http://b.example", "")], "page_id long, url string, html string")
    got = sorted(((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages.withColumn("host", F.lit("x"))).collect()))
    want = "Title & more abc d e f"
    assert got == [("1", want, len(want)), ("1", want, len(want)), ("2", "", 0), ("4", "", 0), ("None", "plain <text", 11)]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_repeated_text_of_a_host_goes_and_copies_stay():
    page = "<html><body><p>Read about our company and its many fine services here</p><p>Unique %s words %s of page %s stand alone %s.</p><p>All rights reserved by the owners of this great site</p></body></html>"
    pages = [page % (i, i * 7, i * 13, i * 17) for i in range(12)]
    assert html_text.extract_batch(pages) == [f"Unique {i} words {i * 7} of page {i * 13} stand alone {i * 17}." for i in range(12)]
    copies = html_text.extract_batch([pages[0]] * 12)
    assert len(set(copies)) == 1 and copies[0].startswith("Read about our company")


def test_repeats_count_over_the_whole_host(spark, monkeypatch):
    page = "<html><body><p>Read about our company and its many fine services here</p><p>Unique %s words %s of page %s stand alone %s.</p></body></html>"
    rows = [(i, f"http://one.example/{i}", page % (i, i * 7, i * 13, i * 17)) for i in range(401)]
    rows += [(1000 + i, f"http://two.example/{i}", page % (i, i * 7, i * 13, i * 17)) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Unique {i} words {i * 7} of page {i * 13} stand alone {i * 17}." for i in range(401)}
    want |= {1000 + i: "Read about our company and its many fine services here " + want[i] for i in range(2)}
    for batch, n in ((400, 1), (5, 7)):
        monkeypatch.setattr(html_text, "BATCH_PAGES", batch)
        monkeypatch.setattr(html_text, "partitions_for", lambda _, n=n: n)
        assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


def test_article_text_by_its_markup(spark):
    import html

    pages = table(spark, "/root/testdata/sf0.01", "pages")

    def want(page):
        inside = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = re.split(r"</?(?:p|h1|br)>", inside)
        return " ".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts) if t)

    found = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert found == {r.page_id: want(r.html) for r in pages.collect()}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, rated = table(spark, sf, "documents"), quality.graded(table(spark, sf, "labels"))
    learn = rated.where("doc_id % 3 <> 0")
    found = quality.score(docs, quality.train(docs, learn), "doc_id").join(rated.where("doc_id % 3 = 0"), "doc_id").collect()
    share = {g: sum(r.keep for r in found if r.grade == g) / sum(r.grade == g for r in found) for g in (0, 1, 2)}
    assert share[2] >= 0.99 and share[0] <= 0.15 and share[1] <= 0.15
    assert all(0 <= r.expected_grade <= 2 for r in found)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, None), (5, 0, 1), (None, 1, 0), (7, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(quality.graded(labels).collect()) == [(3, 2), (4, 1), (5, 0), (99, 2)]
    model = quality.train(odd_docs, quality.graded(labels))
    assert quality.score(odd_docs, model, "doc_id").count() == odd_docs.count()
    none = quality.train(no_docs, quality.graded(labels))
    assert all(r.keep for r in quality.score(odd_docs, none, "doc_id").collect())
    kept = quality.select(odd_docs, quality.graded(labels.limit(0)))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_several_texts_and_clashing_names(spark):
    """The model is the same for any order and partitioning of the rows, whatever other columns are called."""
    import numpy as np

    docs, rated = table(spark, "/root/testdata/sf0.001", "documents"), quality.graded(table(spark, "/root/testdata/sf0.001", "labels"))
    more = docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("zz "), "text"))
    both = docs.unionByName(more).unionByName(docs.where("doc_id % 2 = 0")).withColumns({c: F.lit("x") for c in ("grade", "at", "value", "_text", "keep")})
    one, other = quality.train(both.repartition(2), rated), quality.train(both.repartition(30, "text").orderBy(F.desc("text")), rated)
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.thresholds, other.thresholds) and one.weights.any()
    assert quality.score(both, one, "doc_id", "grade").columns == ["doc_id", "grade", "expected_grade", "p_wanted", "keep"]
    assert quality.select(both, rated).columns == both.columns


def test_chosen_features_by_brute_force(spark):
    """Weights go to the features whose likelihood ratio passes, computed plainly."""
    import math

    docs, rated = table(spark, "/root/testdata/sf0.001", "documents"), quality.graded(table(spark, "/root/testdata/sf0.001", "labels"))
    rows = docs.join(rated, "doc_id").select("text", "grade").collect()
    seen, n = {}, [sum(r.grade == k for r in rows) for k in range(3)]
    for r in rows:
        for at in quality.features(r.text)[0].tolist():
            seen.setdefault(at, [0, 0, 0])[r.grade] += 1

    def ratio(counts):
        best = 0.0
        for k in (1, 2):
            low, share = sum(counts[:k]), sum(n[:k]) / sum(n)
            parts = ((low, share), (sum(counts) - low, 1 - share))
            best = max(best, 2 * sum(c * math.log(c / (sum(counts) * s)) for c, s in parts if c))
        return best

    chosen = {at for at, counts in seen.items() if ratio(counts) >= quality.TELLING} | {quality.bucket(b"always", b"")}
    model = quality.train(docs, rated)
    assert {i for i, w in enumerate(model.weights.tolist()) if w} <= chosen
    assert sum(model.weights[i] != 0 for i in chosen) > 0.9 * len(chosen)


def test_thresholds_are_ordered_and_tails_fall():
    import numpy as np

    rng = np.random.default_rng(0)
    rows, grades = [], rng.integers(0, 4, 600)
    for g in grades:
        rows.append((np.array([quality.bucket(b"always", b""), 5 + g]), np.array([1.0, 3.0])))
    flat = [np.concatenate(x) for x in zip(*rows)]
    model = quality.fit(*flat, np.arange(0, 2 * len(rows) + 1, 2), grades, 4)
    assert np.all(np.diff(model.thresholds) > 0)
    scores = [float(model.weights[at] @ values) for at, values in (rows[list(grades).index(g)] for g in range(4))]
    assert scores == sorted(scores)


@pytest.mark.parametrize("word,kind", [("12", "NUMBER"), ("3.5kg", "NUMBER"), ("Alice,", "TITLE"), ("km", "UNIT"), ("---", "BLANK")])
def test_word_classes(word, kind):
    assert decontaminate._code(word.encode()) & 31 & getattr(decontaminate, kind)


def test_many_entities_in_one_text(spark):
    n = 30_000
    long = " ".join(f"Contact{i} user{i}@mail{i % 97}.example.com, 10.0.{i % 256}.{i % 200}" for i in range(n))
    docs = spark.createDataFrame([(1, long), (2, "x" * 3_000 + " a@b.c " + "é" * 3_000)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.digests(pii.find(docs)).collect()}
    assert (found[1].n_email, found[1].n_ip) == (n, n)
    assert all(found[k].base_sha256 == hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest() for k, t in docs.collect())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean == {1: " ".join(f"Contact{i} [EMAIL], [IP]" for i in range(n)), 2: "x" * 3_000 + " [EMAIL] " + "é" * 3_000}


def test_rewriting_by_brute_force(spark, rng):
    texts = []
    for k in range(200):
        text = "".join(rng.choice("abé😀 ") for _ in range(rng.choice([0, 5, 90, 2_500])))
        cuts = [sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(rng.randint(0, 130))] if text else []
        texts.append((k, text, [(a, b, rng.choice(pii.KINDS)) for a, b in cuts]))
    docs = spark.createDataFrame(texts, "doc_id long, text string, spans array<struct<s:int,e:int,kind:string>>")
    found = dict(docs.select("doc_id", pii.rewritten(F.col("text"), F.col("spans"))).collect())
    for k, text, cuts in texts:
        out, at = [], 0
        for a, b, kind in sorted(cuts):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert found[k] == "".join(out) + text[at:], k


def test_scores_against_the_plain_link_function(spark):
    import math

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = quality.train(docs, quality.graded(table(spark, "/root/testdata/sf0.001", "labels")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs, model, "doc_id").collect():
        at, values = quality.features(texts[r.doc_id])
        total = sum(float(model.weights[i]) * float(x) for i, x in zip(at.tolist(), values.tolist(), strict=True))
        tails = [1 / (1 + math.exp(min(max(t - total, -40), 40))) for t in model.thresholds.tolist()]
        assert math.isclose(r.expected_grade, sum(tails), abs_tol=1e-4) and math.isclose(r.p_wanted, tails[1], abs_tol=1e-4)
        assert r.keep == (r.p_wanted >= 0.5)


def test_fitting_raises_the_plain_likelihood(rng):
    import numpy as np

    n = 600
    at = np.array([rng.randrange(40) for _ in range(n * 5)]) + 100
    values, ends = np.ones(n * 5), np.arange(0, n * 5 + 1, 5)
    signal = np.add.reduceat((at < 112).astype(float) - (at > 130), ends[:-1])
    grades = np.clip(np.round(signal / 2 + 1), 0, 2).astype(np.int64)
    model = quality.fit(at, values, ends, grades, 3)

    def likelihood(weights, thresholds):
        score = np.add.reduceat(weights[at] * values, ends[:-1])
        tails = np.column_stack([np.ones(n), *(1 / (1 + np.exp(t - score)) for t in thresholds), np.zeros(n)])
        return float(np.log(np.maximum(tails[np.arange(n), grades] - tails[np.arange(n), grades + 1], 1e-12)).sum())

    share = [(grades >= k).mean() for k in (1, 2)]
    plain = likelihood(np.zeros_like(model.weights), [-np.log(p / (1 - p)) for p in share])
    assert likelihood(model.weights, model.thresholds) > 0.5 * plain
    assert model.thresholds[0] < model.thresholds[1]
