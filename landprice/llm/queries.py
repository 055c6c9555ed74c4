"""Queries of the training-data operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landprice.llm import (
    bpe, chunks, filter_audit, forest, language, lattice, licences, mixing, runs, simhash,
    surrogates, topk, urls,
)


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; other files are a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(number: int) -> Column:
    """Whether a document belongs to one of five folds; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == number, F.lit(False))


def op1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.compare_with_edited(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold(0))
    model = language.learn(docs.filter(~F.col("held_out")), "lang", "text", "doc_id")
    rows = docs.select("doc_id", "held_out", "text")
    return language.predict(rows, model, keep_text=False)


#: Stands for the secret that a user keeps; with another key all surrogates change.
DEMO_KEY = b"key of the example queries"


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, DEMO_KEY, count="n_entities")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_report(_table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold(1))
    return lattice.score_texts(docs, tokenizer("piece_bpe_32k.model"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors, F.col("vec_id") % 50 == 0, "vec_id", "embedding")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(_table(spark, sf_dir, "documents"))


def op12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, F.col("vec_id") % 20 == 0, "vec_id", "embedding")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_TOPK_SQL = """
WITH vectors AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_chunks, op2_bpe, op3_simhash, op4_language, op5_surrogates, op6_mixing, op7_urls,
        op8_lattice, op9_licences, op10_topk, op11_runs, op12_forest, op13_filter_audit,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": mixing.oracle_sql(),
    "op7_urls": urls.oracle_sql(),
    "op10_topk": _TOPK_SQL,
    "op13_filter_audit": filter_audit.oracle_sql(),
}
