"""The queries of the corpus operators and their SQL. Each takes (spark, sf_dir) and reads its whole tables."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, bit_sliced, interpolation, lexical, near_duplicates, neighbours, packing, personal, severity, spelling, token_count, unigram, vector_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity.score(docs, severity.fit(docs, table(spark, sf_dir, "labels")))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count the base spans, as base_sha256 does; n_spans counts all spans in `spans`."""
    found = personal.find(table(spark, sf_dir, "documents"))
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return found.select("doc_id", *(f"n_{k}" for k in personal.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans", n_spans.alias("n_spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates.link_duplicates(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op10_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_QUERIES = (
    op1_deleted_interpolation,
    op2_near_duplicates,
    op3_severity,
    op4_personal_data,
    op5_token_counts,
    op6_neighbours,
    op7_packed_ids,
    op8_vector_duplicates,
    op9_packing,
    op10_unigram,
    op11_bit_sliced_search,
    op12_spelling_variants,
    op13_lexical_search,
)


def queries() -> dict[str, functools.partial]:
    return {f.__name__: f for f in _QUERIES}


#: Components over `link (a, b)` of all `node (id)`: the smallest id that links lead to.
_COMPONENTS = """sides as (select a, b from link union all select b, a from link),
reach as (select id as a, id as b from node union select reach.a, sides.b from reach join sides on sides.a = reach.b)
"""

SQL = {
    "op2_near_duplicates": rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) >= 3 then concat_ws(' ', w[i], w[i + 1], w[i + 2]) else array_to_string(w, ' ') end as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from w where len(w) > 0)),
node as (select doc_id as id, (select count(*) from s where s.doc_id = w.doc_id) as n from w),
common as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by all),
link as (select a, b from common join node p on p.id = a join node q on q.id = b where 100 * m >= 85 * (p.n + q.n - m)),
{_COMPONENTS}select id as doc_id, n as n_shingles, least_id as component_id, id = least_id as kept from node join (select a, min(b) as least_id from reach group by a) on a = id""",
    "op8_vector_duplicates": rf"""with recursive node as (select vec_id as id, label, embedding::double[] as x from embeddings),
link as (select p.id as a, q.id as b from node p join node q on p.label = q.label and p.id < q.id where list_cosine_similarity(p.x, q.x) >= 0.98),
{_COMPONENTS}select id as vec_id, (select count(*) from sides where sides.a = id) as n_links, least_id as component_id, id = least_id as kept from node join (select a, min(b) as least_id from reach group by a) on a = id""",
    "op11_bit_sliced_search": """with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)])::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s)
select query_id, place::integer as rank, vec_id, score from r where place <= 5""",
    # the crc32 of a run's bytes one by one; a letter of two bytes in UTF-8 is C3 and its code point less 64
    "op12_spelling_variants": r"""with recursive bits(k, i, c) as (select 0, i, i::bigint from range(256) t(i)
  union all select k + 1, i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
run as (select coalesce(doc_id::varchar, '') || ':' as head, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
times as (select head, w, count(*) as m from run group by all),
hashed as (select w, m, xor(list_reduce(list_prepend(4294967295::bigint, flatten([case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end for x in string_split(head || w, '')])),
  lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) as h from times, crc),
kept as (select case when h % 97 = 0 then left(w, (h % length(w))::integer) || substr(w, (h % length(w))::integer + 2) else w end as w, m from hashed),
words as (select w, sum(m)::bigint as n from kept where length(w) >= 5 group by w having sum(m) >= 3),
cut as (select w, n, i, left(w, i) || substr(w, i + 2) as r from (select w, n, unnest(range(length(w))) as i from words)),
near as (select a.w, b.w as v, b.n from cut a join cut b on a.r = b.r and a.i = b.i and a.w <> b.w
  union select c.w, s.w, s.n from cut c join words s on s.w = c.r union select s.w, c.w, c.n from cut c join words s on s.w = c.r),
best as (select w, count(*) as n_near, max(n) as m, arg_min(v, (-n, v)) as v from near group by w),
formed as (select w, words.n, coalesce(n_near, 0) as n_near, case when m >= 2 * words.n then v end as form, case when m >= 2 * words.n then m end as form_n from words left join best using (w)),
chain as (select w, w as root from formed union all select chain.w, formed.form from chain join formed on formed.w = chain.root where formed.form is not null)
select w as word, form, arg_max(chain.root, words.n) as root, formed.n, n_near, form_n from formed join chain using (w) join words on words.w = chain.root group by all""",
    "op13_lexical_search": r"""with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
total as (select count(*) as n, sum(len(w))::bigint as l from d where len(w) > 0),
tf as (select row, term, count(*) as tf from (select row, unnest(w) as term from d) group by all),
asked as (select item_id, term, count(*) as m from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
weight as (select term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::bigint as weight from tf, total group by term, n),
sums as (select item_id, row, sum(m * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n) // l))))::bigint as score from asked join weight using (term) join tf using (term) join d using (row), total group by item_id, row),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as place, doc_id, score from sums join d using (row) where score > 0)
select item_id, place::integer as rank, doc_id, score from r where place <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
