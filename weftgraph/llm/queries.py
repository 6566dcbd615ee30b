"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(spark, _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


@query
def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .id_files import token_id_files

    return token_id_files(spark, _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import duplicates

    return duplicates(spark, _table(spark, sf_dir, "documents"))


ORACLE["op10_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, _table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(spark, _table(spark, sf_dir, "documents"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secrets

    return secrets(spark, _table(spark, sf_dir, "documents"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(spark, _table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE["op6_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w WHERE len(words) >= 20
), k AS (
  SELECT doc_id, p, md5(array_to_string(words[p:p + 19], ' ')) AS h FROM s
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r WHERE n > 1
), lists AS (
  SELECT doc_id, list(i) AS l, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN l IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(l, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
"""


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar

    return similar(spark, _table(spark, sf_dir, "documents")).drop("h")


@query
def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming_search import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(spark, vectors, vectors.where("vec_id % 50 = 0"))


ORACLE["op4_hamming_topk"] = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: (z[1] <> z[2])::BIGINT))::BIGINT AS distance
  FROM c q, c WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d
)
SELECT * FROM r WHERE rank <= 10
"""


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(spark, _table(spark, sf_dir, "documents")).drop("h")
