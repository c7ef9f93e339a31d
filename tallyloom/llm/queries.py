"""The queries opN_<name> of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunkdedup, langid, mixing, quality_cnn, setjoin, sharding, spotsigs, topk, urlfilter

RANKS = "byte_bpe_multi_50k.tiktoken"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source at the same share of the characters, in as much text as there is."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return topk.search(e, e.filter("vec_id % 100 = 0"), k=10)


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without the runs of chunks that stand elsewhere before."""
    return chunkdedup.deduplicate(_read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_cnn.learn(docs, _read(spark, sf_dir, "labels"), langid.fold(5) != 0)
    held = F.coalesce(langid.fold(5) == 0, F.lit(False))
    return quality_cnn.classify(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), RULES, keep=["page_id"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs, langid.fold(3) != 1)
    held = F.coalesce(langid.fold(3) == 1, F.lit(False))
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixing, op2_exact_topk, op3_chunk_dedup, op4_byte_bpe, op5_quality_cnn, op6_ngram_jaccard_join, op7_url_filter, op8_language_id, op9_spotsigs, op10_hash_tree_sharding)}


OP1 = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
whole AS (SELECT sum(size) AS total, count(*)::DOUBLE AS weights FROM sizes),
rates AS (SELECT source, 1.0::DOUBLE * total * 1.0 / (weights * size) AS rate FROM sizes, whole),
draws AS (SELECT d.*, rate, (('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
          FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
steps AS (SELECT rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS p FROM rates, range(0, 200) t(k)),
cdf AS (SELECT rate, list(c ORDER BY k) AS c FROM (SELECT rate, k, sum(p) OVER (PARTITION BY rate ORDER BY k) AS c FROM steps) GROUP BY rate),
counted AS (SELECT d.*, len(list_filter(c, lambda x: x < u))::INTEGER AS n_copies FROM draws d JOIN cdf USING (rate)),
copies AS (SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM counted WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5('7:' || doc_id || ':' || copy) AS shuffle_key FROM copies
"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP7 = """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
folded AS (SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM folded, rules
         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM folded LEFT JOIN fits USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1, "op2_exact_topk": OP2, "op7_url_filter": OP7}
