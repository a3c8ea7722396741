"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import identify_languages
from .lexical import ranked_documents
from .maintext import page_texts
from .mixing import Mix
from .partitions import learned_neighbours
from .pieces import piece_codes
from .sharding import balanced_shards
from .simhash import simhash_groups
from .spelling import spelling_forms
from .suffixes import without_repeats
from .texts import read
from .threshold import inner_product_top
from .tokencount import token_counts
from .toxicity import toxic_texts

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(read(spark, sf_dir, "documents"), "doc_id", "text", 24)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_texts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", "text")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_neighbours(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def highest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product_top(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(read(spark, sf_dir, "pages"), "html", ["page_id", "url"])


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(read(spark, sf_dir, "documents"), "doc_id", "text", "source").taken()


def piece_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return piece_codes(documents, "text", vocabulary("piece_bpe_32k.model"), ["doc_id"], content=False)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"), "doc_id", "text", words=3, max_bits=2)


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return token_counts(documents, "text", vocabulary("word_bpe_49k.json"), 2048, ["doc_id"])


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(read(spark, sf_dir, "documents"), "doc_id", "text")


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"), "text", 400, ["doc_id"], content=False)


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return ranked_documents(documents, items, "doc_id", "text", "item_id")


QUERIES: dict[str, Query] = {
    "op1_shards": shards,
    "op2_language": languages,
    "op3_learned_partitions": neighbours,
    "op4_threshold_top": highest_products,
    "op5_main_text": main_texts,
    "op6_mixture": mixture,
    "op7_sentencepiece": piece_digests,
    "op8_toxicity": toxicity,
    "op9_simhash_groups": near_duplicates,
    "op10_token_counts": document_tokens,
    "op11_spelling_variants": spellings,
    "op12_suffix_dedup": suffix_dedup,
    "op13_ranked_search": ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op4_threshold_top": """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))::bigint as score
    from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rk from s)
select query_id, rk::int as "rank", vec_id, score from r where rk <= 10""",
    "op6_mixture": r"""
with d as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        md5(coalesce(doc_id::varchar, '') || ':1') as o
    from documents),
s as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as sid
    from d group by source),
w as (
    select *, case (sid - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight, source_size * 4 as cap,
        (sum(source_size * 3) over ())::bigint as total
    from s),
b as (
    select *,
        (total - coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0)) * weight
        > cap * sum(weight) over (order by cap / weight, sid rows between current row and unbounded following) as stops
    from w),
t as (
    select *, case when stops or cap = 0 then cap::double / 2.0 else
        ((total - coalesce(sum(case when stops then cap end) over (), 0)) * weight)::double
        / (2.0 * (sum(case when not stops then weight end) over ())::double) end as target
    from b),
p as (
    select d.*, t.source_size, t.target, least(floor(t.target + 0.5)::bigint, t.source_size * 2) as takes,
        coalesce(sum(d.size) over (partition by t.sid order by o, doc_id, d.size
            rows between unbounded preceding and 1 preceding), 0)::bigint as start
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
    (greatest(0, least(start + size, takes) - start)
    + greatest(0, least(source_size + start + size, takes) - source_size - start))::bigint as taken
from p""",
    # The checksum is worked out byte by byte; words are near if they are equal without one letter.
    "op11_spelling_variants": r"""
with recursive k as (select 3988292384::ubigint as p),
step as (select i as b, i::ubigint as c, 0 as round from range(256) t(i)
    union all select b, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end, round + 1 from step where round < 8),
tab as (select list(c order by b) as t from step where round = 8),
runs as (
    select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run
    from documents),
r as (select id, run, count(*)::bigint as n from runs group by all),
bytes as (
    select id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c:
        case when unicode(c) < 128 then [unicode(c)] else [192 + unicode(c) // 64, 128 + unicode(c) % 64] end)) as b
    from r),
marked as (
    select run, n, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(b, lambda x: x::ubigint)),
        lambda h, x: xor(h // 256, tab.t[(xor(h, x) & 255)::int + 1])), 4294967295::ubigint) as h
    from bytes, tab),
cut as (
    select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n
    from marked),
w as (select word, sum(n)::bigint as n from cut where length(word) >= 7 group by word having sum(n) >= 2),
del as (select word, n, unnest(range(length(word))) as i from w),
d as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as v from del),
near as (
    select distinct a.word, b.word as other, b.n as m from d a join d b on a.v = b.v and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
    union select distinct d.word, w.word, w.n from d join w on d.v = w.word
    union select distinct w.word, d.word, d.n from d join w on d.v = w.word),
best as (
    select word, count(*) as n_near, arg_min(other, (-m, other)) as f, max(m) as m from near group by word),
f as (
    select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 10 * w.n then f end as form, case when m >= 10 * w.n then m end as form_n
    from w left join best using (word)),
up as (select word, word as at from f union all select up.word, f.form from up join f on f.word = up.at where f.form is not null),
root as (select up.word, up.at from up join f on f.word = up.at where f.form is null)
select f.word, form, root.at as root, n, n_near, form_n from f join root using (word)""",
    "op12_suffix_dedup": r"""
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as u, hex(encode(coalesce(text, ''))) as h from documents),
p as (select r, u, unnest(range(0, greatest(0, length(h) // 2 - 399))) as i from d),
w as (select r, i, md5(u[(i + 1)::bigint:(i + 400)::bigint]) as m from p),
c as (select m from w group by m having count(*) > 1),
hit as (select r, i from w semi join c using (m)),
g as (select *, case when i > coalesce(max(i) over (partition by r order by i rows between unbounded preceding and 1 preceding) + 400, -1) then 1 else 0 end as fresh from hit),
n as (select *, sum(fresh) over (partition by r order by i) as k from g),
span as (select r, k, min(i) as a, max(i) + 400 as b from n group by r, k),
gaps as (
    select r, coalesce(lag(b) over (partition by r order by a), 0) as a, a as b from span
    union all select r, max(b), null from span group by r),
left_over as (
    select d.r, string_agg(substr(h, (2 * g.a + 1)::bigint, (2 * (coalesce(g.b, length(h) // 2) - g.a))::bigint), '' order by g.a) as h
    from gaps g join d using (r) group by d.r),
total as (select r, count(*) as n_spans, sum(b - a)::bigint as n_removed from span group by r)
select doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
    sha256(unhex(coalesce(l.h, d.h))) as kept_sha256
from d left join left_over l using (r) left join total using (r)""",
    "op13_ranked_search": r"""
with d as (
    select row_number() over () as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents),
c as (select count(*) filter (len(terms) > 0)::bigint as n, sum(len(terms))::bigint as l from d),
t as (select r, doc_id, len(terms)::bigint as n, unnest(terms) as term from d),
f as (select r, doc_id, n, term, count(*)::bigint as tf from t group by all),
w as (
    select term, floor(1000 * ln((2 * c.n + 2)::double / (2 * count(*) + 1)::double))::bigint as w
    from f, c group by term, c.n),
q as (
    select distinct i, item_id, term from (
        select row_number() over () as i, item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark)),
s as (
    select i, item_id, r, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * c.n) // c.l))))::bigint as score
    from q join f using (term) join w using (term), c group by all),
k as (
    select *, row_number() over (partition by i order by score desc, doc_id) as rk from s where score > 0)
select item_id, rk::int as "rank", doc_id, score from k where rk <= 10""",
}
