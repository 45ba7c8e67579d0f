"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arcspark.llm import decontaminate, fim, html_text, jaccard, langid, media, packing, pii, quality, sharding, token_store, topk, trie
from arcspark.llm.common import table
from arcspark.llm.tokens import tokenizer_path


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, "doc_id")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_media_columns, op2_sharding, op3_language_id, op4_ngram_jaccard, op5_token_output, op6_decontamination,
        op7_html_extraction, op8_best_fit_packing, op9_pii, op10_quality_classifier,
        op11_exact_top_k, op12_fill_in_middle, op13_prefix_trie,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: SQL where it can express an operator; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": f"""with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as g
from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
r(id, c) using key (id) as (select doc_id, doc_id from documents union select l.y, min(r.c) from r join l on l.x = r.id
left join recurring.r k on k.id = l.y group by l.y having min(r.c) < coalesce(min(k.c), 9223372036854775807))
select id as doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.c as component_id from r left join n on n.doc_id = r.id""",
    "op12_fill_in_middle": """with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as x from documents),
u as (select *, string_split(t, chr(10)) as p, len(t) - len(replace(t, chr(10), '')) + (case when t <> '' and right(t, 1) <> chr(10) then 1 else 0 end) as n,
('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
l as (select *, case when a = n then len(t) else coalesce(list_sum(list_transform(p[1:a], lambda s: len(s) + 1)), 0)::bigint end as i,
case when b = n then len(t) else coalesce(list_sum(list_transform(p[1:b], lambda s: len(s) + 1)), 0)::bigint end as j from c),
o as (select *, substring(t, 1, i) as pre, substring(t, i + 1, j - i) as mid, substring(t, j + 1) as suf from l)
select doc_id, n::bigint as n, form, case when form <> 'plain' then i::bigint end as prefix_chars, case when form <> 'plain' then (j - i)::bigint end as middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
sha256(case form when 'plain' then t else pre || mid || suf end) as restored_sha256 from o""",
    "op13_prefix_trie": """with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select c, list({'role': role, 'text': text} order by turn nulls first, role, sha256(len(role) || ':' || role || text)) as s,
xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
lambda k, x: list_reduce([xor(k, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 4 as h from t group by c),
r as (select o.c, list_concat(case when b.c is null then o.s[1:0] else b.s[1:o.h] end, o.s[o.h + 1:]) as s from o left join o b on b.c = o.c - o.c % 20),
k as (select c, d, d = len(s) as last, s[1:d] as s from (select c, s, unnest(range(0, len(s) + 1)) as d from r)),
g as (select s, d, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) as ends from k group by s, d),
n as (select *, s[1:d - 1] as up, (n_convs - 1) * (case when d = 0 then 0 else len(regexp_extract_all(s[d].text, '[^\x20\x09-\x0D]+')) end) as saved from g),
c as (select up, d - 1 as d, count(*) as n_children from n where d > 0 group by all),
f as (select n.*, coalesce(c.n_children, 0) as n_children from n left join c on c.d = n.d and c.up = n.s)
select f.conv_id, f.d::bigint as depth, any_value(p.conv_id) as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children, count(*) filter (x.n_children = 0)::bigint as n_leaves,
sum(x.saved)::bigint as saved_tokens, f.ends as ends_sha256 from f left join n p on p.d = f.d - 1 and p.s = f.up and f.d > 0 join f x on x.d >= f.d and x.s[1:f.d] = f.s
group by f.s, f.conv_id, f.d, f.n_convs, f.n_children, f.ends""",
    "op11_exact_top_k": """with w as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score from w q join w c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20""",
}
