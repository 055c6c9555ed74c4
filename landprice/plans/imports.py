"""Import of landed yearly files into the register table."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import batched, groupby

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from landprice.schema import CODEC, LOAD
from landprice.session import (
    compiled_methods,
    discard_rows,
    freed_shuffles,
    materialised,
    path_exists,
)
from landprice.sources.register_csv import (
    POSITION,
    YEAR_FILE,
    accepted,
    outcome_counts,
    read_group_headers,
    read_register,
    tagged,
    year_path,
)
from landprice.sources.table import create_table, insert_new, year_counts

# Years decoded at the same time, as one gzip file keeps one core busy, and inserted as one load.
CONCURRENT_YEARS = 8

SUCCESS, ALREADY_IMPORTED, FAILED = "success", "already_imported", "failed"
_RESULT = (
    "year int, status string, records bigint, inserted bigint, time_seconds double, error string"
)
_OUTCOMES = "year int, outcome string, rows bigint"


@dataclass(frozen=True)
class ImportResult:
    years: DataFrame
    outcomes: DataFrame
    total_records: int


def stage_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Decode and clean once, into the shared scratch folder.

    Gzip is read by one task per file and cannot be split, so everything after this point
    (reports, de-duplication, insert, recovery from a lost executor) reads the staged
    columnar copy instead of decoding again.
    """
    return materialised(read_register(spark, paths), "staged", **CODEC)


def stage_and_count(
    spark: SparkSession, paths: Sequence[str], headers: Mapping[str, str] | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """``stage_files`` and its rows by outcome, observed while they are written.

    The write is the last stage of its job, whose tasks report once however often they are
    repeated, so the counts are those of the written rows and no scan follows.
    """
    observed = Observation()
    cleaned = read_register(spark, paths, headers).observe(observed, *outcome_counts())
    staged = materialised(cleaned, "staged", **CODEC)
    return staged, {outcome: rows for outcome, rows in observed.get.items() if rows}


def import_staged(staged: DataFrame, name: str, year: int) -> int:
    """Insert the accepted rows of one staged year; returns the exact number inserted."""
    return insert_new(tagged(accepted(staged), F.lit(year)), name)


def import_files(spark: SparkSession, name: str, year: int, paths: Sequence[str]) -> int:
    """Stage and insert one group of files, compressed or not, under one import year."""
    create_table(spark, name)
    with compiled_methods(spark), freed_shuffles(spark):
        staged = stage_files(spark, paths)
        inserted = import_staged(staged, name, year)
    discard_rows(staged)
    return inserted


def _known_headers(spark: SparkSession, places: Mapping[int, str]) -> dict[int, dict[str, str]]:
    """Headers of all years by one job; nothing if a year can't be read, so that each looks alone."""
    landed = {year: [place] for year, place in places.items() if path_exists(spark, place)}
    try:
        return read_group_headers(spark, landed) if landed else {}
    except Exception:  # noqa: BLE001 - the year that can't be read reports it when it is staged
        return {}


def _insert_years(
    spark: SparkSession, name: str, staged: Mapping[int, DataFrame]
) -> dict[int, tuple[int, int]]:
    """Insert staged years as one load, earlier years first where they hold the same key.

    Returns the rows that each year has now and those that this load brought. A failure before
    anything could be published, with several years at hand, is tried again year by year.
    """
    numbers: list[int] = []
    batch = reduce(
        DataFrame.unionByName,
        [tagged(accepted(rows), F.lit(year)) for year, rows in staged.items()],
    )
    try:
        inserted = insert_new(
            batch,
            name,
            ("import_year", *POSITION),
            before_publish=lambda load, number: numbers.append(number),
        )
    except Exception:
        if numbers or len(staged) == 1:
            raise
        return {}
    if not inserted:
        return dict.fromkeys(staged, (0, 0))
    own = F.count_if(F.col(LOAD) == numbers[-1])
    rows = spark.table(name).filter(F.col("import_year").isin(list(staged)))
    counted = rows.groupBy("import_year").agg(F.count(F.lit(1)).alias("rows"), own.alias("own"))
    found = {row.import_year: (row.rows, row.own) for row in counted.collect()}
    return {year: found.get(year, (0, 0)) for year in staged}


def import_years(
    spark: SparkSession,
    name: str,
    template: str,
    start_year: int,
    end_year: int,
    file_name: str = YEAR_FILE,
) -> ImportResult:
    """Import an inclusive year range of ``template.format(year=…)`` folders.

    A year that already has rows is skipped, a failing year does not stop the others.
    Files are decoded concurrently. Years that follow each other become one load, in which
    the first year that holds a key keeps it; a year's seconds are those of its staging and of
    the load it came with.
    """
    create_table(spark, name)
    years = range(start_year, end_year + 1)
    present = year_counts(spark, name, years)
    places = {year: year_path(template, year, file_name) for year in years if year not in present}
    headers = _known_headers(spark, places) if places else {}

    def stage(year: int) -> tuple[DataFrame, dict[str, int], float]:
        started = time.monotonic()
        staged, counts = stage_and_count(spark, [places[year]], headers.get(year))
        return staged, counts, time.monotonic() - started

    results, outcomes = {}, []

    def failed(year: int, problem: Exception | None, seconds: float) -> None:
        error = None if problem is None else f"{type(problem).__name__}: {problem}"
        results[year] = (year, FAILED, None, 0, round(seconds, 2), error)

    def insert(staged: Mapping[int, DataFrame], staging: Mapping[int, float]) -> None:
        started = time.monotonic()
        try:
            counts = _insert_years(spark, name, staged)
        except Exception as problem:  # noqa: BLE001 - one year must not stop the others
            for year in staged:
                failed(year, problem, staging[year] + time.monotonic() - started)
            return
        if not counts:
            for year, rows in staged.items():
                insert({year: rows}, staging)
            return
        seconds = time.monotonic() - started
        for year, (records, inserted) in counts.items():
            discard_rows(staged[year])
            taken = staging[year] + seconds
            if inserted:
                results[year] = (year, SUCCESS, records, inserted, round(taken, 2), None)
            else:
                failed(year, None, taken)

    with (
        compiled_methods(spark),
        freed_shuffles(spark),
        ThreadPoolExecutor(max_workers=CONCURRENT_YEARS) as pool,
    ):
        # Each task carries its own copy of the caller's job properties.
        jobs = {year: pool.submit(inheritable_thread_target(spark)(stage), year) for year in places}
        # Years already there end a load: its ids then lie apart from theirs.
        for pending, run in groupby(years, key=lambda year: year in places):
            if not pending:
                for year in run:
                    results[year] = (year, ALREADY_IMPORTED, present[year], 0, None, None)
                continue
            for together in batched(run, CONCURRENT_YEARS):
                staged, staging = {}, {}
                for year in together:
                    try:
                        staged[year], counts, staging[year] = jobs[year].result()
                        outcomes.extend((year, outcome, rows) for outcome, rows in counts.items())
                    except Exception as problem:  # noqa: BLE001 - as above
                        failed(year, problem, 0.0)
                if staged:
                    insert(staged, staging)
    ordered = [results[year] for year in years]
    return ImportResult(
        years=spark.createDataFrame(ordered, _RESULT),
        outcomes=spark.createDataFrame(outcomes, _OUTCOMES),
        total_records=sum(row[2] or 0 for row in ordered),
    )
