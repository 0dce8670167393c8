"""The queries of this subpackage, with SQL for DuckDB where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cells, decontaminate, langid, lmscore, quality, repeats, resample, secrets, simhash, topk, toxicity, whitening

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(_read(spark, sf_dir, "documents"), VOCABULARY)


def op2_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(_read(spark, sf_dir, "documents")).drop("kept")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_read(spark, sf_dir, "documents"), VOCABULARY)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    table = quality.word_vectors(docs)
    return quality.score(docs, table, quality.fit(docs, _read(spark, sf_dir, "labels"), table))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score(_read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), components=4)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_long_repeats, op3_exact_top_k, op4_benchmark_decontamination, op5_byte_bpe, op6_quality_classifier, op7_simhash_near_dedup, op8_lm_scoring, op9_toxicity, op10_language_id,
              op11_embedding_near_dedup, op12_embedding_whitening, op13_importance_resampling)
}

ORACLES: dict[str, str] = {
    "op3_exact_top_k": """
        with v as (
            select row_number() over () as place, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as w from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.place, q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.w, v.w) as bigint) as score
            from v q join v on q.place <> v.place where q.vec_id % 100 = 0
        ), r as (select *, row_number() over (partition by place order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
    """,
    "op11_embedding_near_dedup": """
        with recursive v as (
            select vec_id, list_transform(embedding, lambda x: x::double) as w from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.w, b.w) >= 0.9
        ), r as (select vec_id as node, vec_id as seen from v union select r.node, e.b from r join e on r.seen = e.a
        ), c as (select node, min(seen) as component from r group by node), n as (select a, count(*) as links from e group by a)
        select vec_id, coalesce(links, 0) as n_links, coalesce(component, vec_id) as component_id, coalesce(vec_id = coalesce(component, vec_id), false) as kept
        from embeddings left join c on vec_id = node left join n on vec_id = a
    """,
    "op8_lm_scoring": """
        with w as (
            select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') as ws from documents
        ), t as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as place from w
        ), b as (select *, coalesce(lag(word) over (partition by doc_id order by place), '\n') as before from t
        ), own as (
            select *, count(*) over (partition by doc_id, before, word) as o2, count(*) over (partition by doc_id, before) as o1b,
                count(*) over (partition by doc_id, word) as o1, count(*) over (partition by doc_id) as o0,
                count(*) over (partition by before, word) as c2, count(*) over (partition by before) as c1b,
                count(*) over (partition by word) as c1, count(*) over () as c0
            from b
        ), s as (
            select doc_id, case when c1 > o1 then (c1 - o1)::double / greatest(c0 - o0, 1) else 0.4 / (c0 - o0 + 1) end as s1,
                c2 - o2 as n2, c1b - o1b as n1b from own
        ), r as (
            select doc_id, count(*) as n_words, sum(ln(case when n2 > 0 then n2::double / n1b else 0.4 * s1 end)) as log_score from s group by doc_id
        )
        select d.doc_id, coalesce(n_words, 0) as n_words, round(coalesce(log_score, 0), 4) as log_score from documents d left join r using (doc_id)
    """,
}
