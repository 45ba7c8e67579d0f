"""Operator 9: information-theoretic sanitisation, in DataFrame functions only.

Base entities (email, ip, card, phone) are found by pattern in every whole text. From the
corpus, the strength with which a term reveals one is estimated by pointwise mutual
information over whole documents,

    PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e))),    IC(e) = -log2(n(e) / N),

with n(t, e) the documents that hold t and e, n(t) all that hold t, and n(e) those that hold
e. A term with PMI / IC of at least ``DISCLOSURE``, seen in at least ``SUPPORT`` different
contexts, discloses e: all its occurrences in all texts become spans of kind ``term``. A
context is the text within ``WINDOW`` code points of e with the words next to the term;
copies of one count once for the support, so repeated rows prove nothing. Sanitising
generalises entities to their kind and replaces disclosing terms by a placeholder.

Spans are in code points, end exclusive. Counts are aggregated map-side first, as one entity may be in a third of the
rows, and joins on entities can be split when skewed.

Defined cases: null text counts as empty; rows that share ``doc_id`` and text get the same
spans; an empty table gives no rows; other columns aren't read by ``find`` and are kept by
``sanitise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import unused
from arcspark.plans.scratch import materialise

#: The base patterns in forms that scan in linear time and match the same strings.
#: email: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: ip: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: card: runs [0-9]([\x20-]?[0-9])+ of 16 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?+[0-9])"
#: phone: \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
TERM = r"\p{L}{3,}+"
KINDS = ("email", "ip", "card", "phone")
HINTS = {"email": "@", "ip": ".", "phone": "+"}
WINDOW, SUPPORT, DISCLOSURE = 64, 3, 0.8
#: Elements that one fold gathers, and code points of the pieces that a text is rewritten from.
BLOCK, PIECE = 64, 1024


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern that never matches the empty string."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], start: Column) -> Column:
    """Running results of ``merge`` over an array, starting from ``start``: one for each element, that included.

    Folds copy what they have gathered at each step, so the array is folded in blocks of ``BLOCK``,
    each from the result over all blocks before it; time grows as the size, not as its square.
    """

    def grown(some: Column, first: Column) -> Column:
        return F.aggregate(some, F.array(first), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    def joined_up(blocks: Column) -> Column:
        firsts = grown(F.transform(blocks, lambda b: F.aggregate(b, start, merge)), start)
        return bound(firsts, lambda f: F.flatten(F.zip_with(
            blocks, F.slice(f, F.lit(1), F.size(blocks)), lambda b, first: F.slice(grown(b, first), F.lit(2), F.size(b))
        )))

    def over(v: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.ceil(F.size(v) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda k: F.slice(v, (k - 1) * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(v) > 0, bound(blocks, joined_up)).otherwise(F.array().cast("array<int>"))

    return bound(values, over)


def sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def gaps(text: Column, found: Column, pattern: str) -> Column:
    """What stands before each match."""
    return F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))


def placed(found: Column, ends: Column) -> Column:
    """``array<struct<s, e, value>>`` of matches that end at these code points."""
    return F.zip_with(found, ends, lambda value, e: F.struct((e - F.char_length(value)).alias("s"), e.alias("e"), value.alias("value")))


def end_of_each(before: Column, found: Column) -> Column:
    """Where the matches end, in code points, from what stands before each."""
    return sums(F.zip_with(before, found, lambda gap, value: F.char_length(gap) + F.char_length(value)))


def words(text: Column) -> Column:
    """The terms of a text outside base spans, in lower case and in order; of the base kinds only emails hold letters."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.transform(matches(bare, TERM), F.lower)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True where the digits of a string pass the Luhn check."""
    d = F.reverse(digits(value))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def _spans(kind: str, found: Column, near: Column) -> Column:
    """``array<struct<kind, s, e, entity, near>>`` of the valid ones among placed matches, with a hash of what is around each."""
    entity = F.lower if kind in ("email", "ip") else digits
    both = F.zip_with(found, near, lambda x, n: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"), n.alias("near")))
    return F.transform(
        F.filter(both, lambda x: _valid(kind, x["value"])),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), entity(x["value"]).alias("entity"), x["near"].alias("near")),
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of (kind, s, e), comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def entities(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, spans, words``: base spans by kind and start, and the terms.

    ``spans``: (kind, s, e, entity, near), the last a hash of the entity with up to WINDOW code points
    on either side, as far as the next of its kind; ``words``: all terms in order, of rows with spans only.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
    none = F.array().cast("array<string>")
    for k, p in patterns.items():
        found = matches(F.col("text"), p)
        rows = rows.withColumn(f"m_{k}", F.when(F.contains("text", F.lit(HINTS[k])), found).otherwise(none) if k in HINTS else found)
    empty = F.array().cast("array<struct<kind:string,s:int,e:int,entity:string,near:bigint>>")
    kept = []

    def found_in(k: str) -> Callable[[Column], Column]:
        m = F.col(f"m_{k}")

        def spans(parts: Column) -> Column:
            before, after = F.slice(parts, F.lit(1), F.size(m)), F.slice(parts, F.lit(2), F.size(m))
            around = F.zip_with(before, after, lambda x, y: F.concat(F.right(x, F.lit(WINDOW)), F.lit("|"), F.left(y, F.lit(WINDOW))))
            near = F.zip_with(around, m, lambda x, value: F.xxhash64(x, value))
            return _spans(k, placed(m, end_of_each(before, m)), near)

        return spans

    for k, p in patterns.items():
        kept.append(F.when(F.size(f"m_{k}") > 0, bound(F.split("text", p, -1), found_in(k))).otherwise(empty))
    rows = rows.select("doc_id", "text_key", "text", F.concat(*kept).alias("spans"))
    held = F.when(F.size("spans") > 0, words(F.col("text"))).otherwise(none)
    return rows.select("doc_id", "text_key", "spans", held.alias("words"))


def document_counts(docs: DataFrame) -> DataFrame:
    """``term, n_t``: in how many rows each term stands, over all whole texts."""
    held = F.array_distinct(words(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``kind, entity, term, strength`` of the pairs that reach both thresholds.

    n(t, e) is at most n(e), so n(t) of a disclosing term is at most n(e) (N / n(e)) ^ (1 - ``disclosure``);
    that and the support prune terms and entities before they meet, and lose no pair.
    """
    named = ["kind", "entity"]
    n = found.count()
    total = F.lit(float(max(n, 1)))
    rows = found.where(F.size("spans") > 0).withColumn("row", F.xxhash64("doc_id", "text_key"))
    each = rows.select("row", F.explode("spans").alias("x")).select("row", "x.kind", "x.entity", "x.near")
    # as text, since distinct structs of an array are compared pair by pair
    once = F.array_distinct(F.transform("spans", lambda x: F.concat(x["kind"], F.lit(":"), x["entity"])))
    held = rows.select(F.explode(once).alias("x")).groupBy("x").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    having = held.select(F.substring_index("x", ":", 1).alias("kind"), F.expr("substr(x, instr(x, ':') + 1)").alias("entity"), "n_e")
    holds = each.groupBy("row", *named).agg(F.min("near").alias("near")).join(having, named)
    holds = materialise(holds.withColumn("most", F.col("n_e") * F.pow(total / F.col("n_e"), 1 - disclosure) * (1 + 1e-9)), "holds")
    if holds.isEmpty():
        return holds.select(*named, F.lit("").alias("term"), F.lit(0.0).alias("strength"))
    bound = holds.agg(F.max("most")).first()[0]
    spread = document_counts(docs).where((F.col("n_t") >= support) & (F.col("n_t") <= bound))
    terms = rows.join(holds.select("row").distinct(), "row", "left_semi").select("row", "words", F.posexplode("words").alias("at", "term"))
    around = F.xxhash64(F.slice("words", F.greatest(F.col("at") - 3, F.lit(1)), F.lit(9)))
    terms = terms.select("row", "term", around.alias("around")).groupBy("row", "term").agg(F.min("around").alias("around"))
    met = terms.join(spread, "term").join(holds, "row").where("n_t <= most")
    by_context = met.groupBy(*named, "term", F.xxhash64("near", "around").alias("context")).agg(
        F.count("*").alias("n"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")
    )
    known = by_context.groupBy(*named, "term").agg(
        F.sum("n").alias("n_te"), F.count("*").alias("contexts"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")
    ).where(F.col("contexts") >= support)
    pmi = F.log2(total * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    carried = -F.log2(F.col("n_e") / total)
    strength = F.when(carried > 0, pmi / carried).otherwise(F.lit(0.0))
    return known.withColumn("strength", F.least(strength, F.lit(1.0))).where(F.col("strength") >= disclosure).select(*named, "term", "strength")


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, text_key, at``: arrays of (s, e) of every occurrence of the terms, for the rows that have any."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    each = rows.select("doc_id", "text_key", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    hit = each.join(terms, "term").groupBy("doc_id", "text_key").agg(F.collect_set("term").alias("told"))
    hit = hit.withColumnsRenamed({"doc_id": "whose", "text_key": "of"})
    both = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("whose")) & (F.col("text_key") == F.col("of"))).dropDuplicates(["doc_id", "text_key"])
    both = both.withColumn("emails", F.when(F.contains("text", F.lit("@")), matches(F.col("text"), EMAIL)).otherwise(F.array().cast("array<string>")))
    both = both.withColumn("parts", F.when(F.size("emails") > 0, F.split("text", EMAIL, -1)).otherwise(F.array("text")))
    both = both.withColumn("first", F.concat(F.array(F.lit(0)), end_of_each(F.slice("parts", F.lit(1), F.size("emails")), F.col("emails"))))

    def hits(part: Column, first: Column) -> Column:
        def told(m: Column) -> Column:
            at = placed(m, end_of_each(gaps(part, m, TERM), m))
            mine = F.filter(at, lambda x: F.array_contains("told", F.lower(x["value"])))
            return F.transform(mine, lambda x: F.struct((first + x["s"]).alias("s"), (first + x["e"]).alias("e")))

        return bound(matches(part, TERM), told)

    return both.select("doc_id", "text_key", F.flatten(F.zip_with("parts", "first", hits)).alias("at"))


def find(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``doc_id, text_key, base, terms``: arrays of (kind, s, e), base and added, for every row of ``docs``."""
    found = materialise(entities(docs), "entities")
    told = materialise(disclosing(docs, found, support, disclosure).select("term").distinct(), "told")
    base = F.transform(F.col("spans"), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    if told.isEmpty():
        return found.select("doc_id", "text_key", base.alias("base"), none.alias("terms"))
    added = occurrences(docs, told)
    terms = F.transform("at", lambda x: F.struct(F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    on = found["doc_id"].eqNullSafe(added["doc_id"]) & (found["text_key"] == added["text_key"])
    return found.join(added, on, "left").select(
        found["doc_id"], found["text_key"], base.alias("base"), F.coalesce(terms, none).alias("terms")
    )


def digests(spans: DataFrame) -> DataFrame:
    """Counts, the base digest and the span string of every row of ``find``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each span's place taken by ``[KIND]``; spans that overlap are one place, named by the first.

    The text is cut from pieces of ``PIECE`` code points, as reaching a place of a string takes time
    in proportion to what is before it.
    """
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(held: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        parts = F.transform(F.sequence(first, last), lambda k: F.substring(F.get(held, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, b - F.greatest(a, k * PIECE)))
        return F.when(b > a, F.array_join(parts, "")).otherwise("")

    def put_together(held: Column, found: Column, until: Column) -> Column:
        free = F.concat(F.array(F.lit(0)), F.slice(until, F.lit(1), F.size(found) - 1))

        def place(x: Column, at: Column) -> Column:
            return F.when(x["s"] >= at, F.concat(cut(held, at, x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.zip_with(found, free, place), ""), cut(held, F.element_at(until, -1), F.char_length(text)))

    def with_ends(held: Column, found: Column) -> Column:
        ends = running(F.transform(found, lambda x: x["e"]), lambda a, b: F.greatest(a, b), F.lit(0))
        return bound(ends, lambda until: put_together(held, found, until))

    whole = bound(pieces, lambda held: bound(ordered, lambda found: with_ends(held, found)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with entities and disclosing terms replaced; ``n_chars``, where there is one, follows the text.

    Null texts stay null. Only rows that have spans are joined with them.
    """
    own, key, whose, held = unused(docs, "_own", "_key", "_id", "_spans")
    spans = find(docs, support, disclosure).where((F.size("base") > 0) | (F.size("terms") > 0))
    spans = spans.select(F.col("doc_id").alias(whose), F.col("text_key").alias(key), F.concat("base", "terms").alias(held))
    spans = spans.dropDuplicates([whose, key])
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(whose)) & (F.col(own) == F.col(key))
    both = keyed.join(spans, on, "left")
    text = F.when(F.col(held).isNull(), F.col("text")).otherwise(rewritten(F.col("text"), F.col(held)))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
