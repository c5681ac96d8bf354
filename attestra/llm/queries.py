"""The registered queries of the ten operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import embed_dedup, html_text, minhash, packing, pii, quality, sentencepiece_unigram, topk, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers package; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    path = tokenizer_path("piece_bpe_32k.model")
    coded = _table(spark, sf_dir, "documents").select("doc_id", sentencepiece_unigram.encode_checked("text", path).alias("c"))
    return coded.select("doc_id", "c.ids", F.size("c.ids").cast("long").alias("n_ids"), F.col("c.same").alias("round_trip"))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract_text("html").alias("text")
    return _table(spark, sf_dir, "pages").select("page_id", text).withColumn("n_chars", F.length("text").cast("long"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


#: Verdict, host and start of the path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def queries() -> dict[str, Query]:
    found = (op1_sentencepiece, op2_warc_segments, op3_exact_top_k, op4_best_fit_packing, op5_pii, op6_html_text, op7_quality_classifier, op8_embedding_near_dedup, op9_url_filter, op10_minhash_near_dedup)
    return {f.__name__: f for f in found}


_FINITE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

_WARC = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as n, sha1(coalesce(html, '')) as digest from pages
), m as (
  select *, case when n >= 1000 then max(page_id) over (partition by digest, n >= 1000) else page_id end as first from p
)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id < first then 'revisit' else 'response' end as record_type,
  case when page_id < first then first end as refers_to, null::varchar as problem
from m
"""

_TOP_K = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as vector
  from embeddings where {_FINITE}
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.vector, c.vector)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

_EMBED_DEDUP = f"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and {_FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (
  select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a
), ended as (select a as vec_id, min(b) as root from reach group by a
), counted as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, e.vec_id) as component_id, coalesce(root, e.vec_id) = e.vec_id as kept
from embeddings e left join ended using (vec_id) left join counted using (vec_id)
"""

_MINHASH = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k : k + 4], ' '))) as s
  from words where len(w) > 0
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared
  from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all
), links as (
  select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * shared >= 85 * (p.n + q.n - shared)
), reach as (
  select a, a as b from links union select r.a, l.b from reach r join links l on r.b = l.a
), ended as (select a as doc_id, min(b) as root from reach group by a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(root, d.doc_id) as component_id, coalesce(root, d.doc_id) = d.doc_id as kept
from documents d left join ended using (doc_id) left join sizes using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_segments": _WARC,
        "op3_exact_top_k": _TOP_K,
        "op8_embedding_near_dedup": _EMBED_DEDUP,
        "op10_minhash_near_dedup": _MINHASH,
    }
