"""Stages of the corpus pipeline; each takes and returns a table of documents.

All stages keep null columns, extra columns and their order. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landprice.llm import bpe, language, mixing, simhash, surrogates
from landprice.llm.batches import free_name
from landprice.llm.queries import DEMO_KEY, fold, tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; a missing label is filled in.

    Null texts and texts without a letter go.
    """
    model = language.learn(docs.filter(~fold(0)), "lang", "text", "doc_id")
    found, score = free_name(docs, "_language"), free_name(docs, "_score")
    named = language.predict(docs, model, named=(found, score))
    named = named.filter(F.col(found) != language.UNKNOWN)
    return named.withColumn("lang", F.coalesce("lang", found)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of ``op3_simhash``, by its shingles and bit distance: the one
    with the smallest id."""
    return simhash.one_of_each(docs)


def surrogates_for_entities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data; ``n_chars`` follows the text."""
    out = surrogates.with_surrogates(docs, DEMO_KEY)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return out


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens have the target shares of sources, languages, topics."""
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.encoding_digests(docs, tokenizer("byte_bpe_50k.json"))
