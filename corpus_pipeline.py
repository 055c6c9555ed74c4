"""Corpus preparation: language, near copies, personal data, source mix, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landprice.llm import stages
from landprice.session import discard_rows, materialised

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", stages.known_language),
    ("near_dedup", stages.one_of_each_group),
    ("personal_data", stages.surrogates_for_entities),
    ("mixing", stages.mixed_sources),
    ("tokens", stages.encoded),
]

#: Language models, shingle sets and merges are not SQL; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each works on what the stage before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard_rows(written)  # its successor has all that is still needed
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
