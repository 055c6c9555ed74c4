"""Restartable incremental ingest of landed register files.

Structured Streaming tracks which files were taken; every micro-batch goes through the same
cleaning, de-duplication and insert as a batch import.
"""

from __future__ import annotations

import contextlib
from functools import partial, reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landprice.operators.dedup import new_rows
from landprice.schema import STORED_SCHEMA
from landprice.session import compiled_methods, discard_rows, freed_shuffles, materialised
from landprice.sources.register_csv import (
    POSITION,
    accepted,
    by_layout,
    clean_records,
    numbered,
    parse_header,
    raw_records,
    spread,
    tagged,
    unbound_records,
    year_of_path,
)
from landprice.sources.loads import WrittenLoad, is_published
from landprice.sources.table import append_rows, create_table, insert_new

FILES_PER_BATCH = 64


def _batch_time(spark: SparkSession, folder: str, batch_id: int) -> tuple[object, bool]:
    """Import time of a micro-batch, fixed before its first insert, and whether it is a replay."""
    path, schema = f"{folder}/batch_id={batch_id}", "import_date timestamp"
    known = _read_record(spark, path, schema)
    if known is not None:
        return known.import_date, True
    now = spark.range(1).select(F.current_timestamp().alias("import_date"))
    now.coalesce(1).write.mode("overwrite").parquet(path)
    return _read_record(spark, path, schema).import_date, False


def _read_record(spark: SparkSession, path: str, schema: str) -> Row | None:
    reader = spark.read.schema(schema).option("ignoreMissingFiles", "true")
    try:
        return reader.parquet(path).first()
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


_ATTEMPT = "folder string, years array<int>, rows bigint, number int"


def _attempts(spark: SparkSession, folder: str, batch_id: int) -> str:
    return f"{folder}/attempt_id={batch_id}"


def _record_attempt(path: str, load: WrittenLoad, number: int, spark: SparkSession) -> None:
    row = spark.createDataFrame([(load.folder, list(load.years), load.rows, number)], _ATTEMPT)
    row.coalesce(1).write.mode("overwrite").parquet(path)


def _arrived(spark: SparkSession, name: str, path: str) -> bool:
    """Whether the load that a micro-batch last tried to publish is in the table."""
    tried = _read_record(spark, path, _ATTEMPT)
    if tried is None:
        return False
    load = WrittenLoad(tried.folder, tuple(tried.years), tried.rows)
    return is_published(spark, name, load, tried.number)


def _bound_lines(landed: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Records of the lines, each file by its own header; a file without a usable one is all
    rejects, so that it can't stop the load."""
    usable = {}
    for file, header in headers.items():
        with contextlib.suppress(ValueError):
            parse_header(header)
            usable[file] = header
    parts = [
        raw_records(landed.filter(F.col("_file").isin(files)), names, [usable[f] for f in files])
        for names, files in by_layout(usable).items()
    ]
    others = sorted(set(headers) - set(usable))
    if others:
        parts.append(unbound_records(landed.filter(F.col("_file").isin(others))))
    return reduce(DataFrame.unionByName, parts)


def insert_batch(lines: DataFrame, batch_id: int, name: str, times: str) -> None:
    """Insert one micro-batch exactly once; see ``_insert_once``."""
    with compiled_methods(lines.sparkSession), freed_shuffles(lines.sparkSession):
        _insert_once(lines, batch_id, name, times)


def _insert_once(lines: DataFrame, batch_id: int, name: str, times: str) -> None:
    """A micro-batch, inserted although it may come again.

    A micro-batch may be replayed after a failure between its insert and its commit. Keys
    alone cannot catch that, since rows with a null key part never conflict. So the load that a
    batch is about to publish is recorded first, and a replay whose load is in the catalog is
    done without reading a row. Loads arrive whole or not at all; only where others have put
    rows of the batch's recorded import time into its years does a replay compare rows, and
    inserts the multiset difference.
    """
    spark = lines.sparkSession
    attempts = _attempts(spark, times, batch_id)
    if _arrived(spark, name, attempts):
        return
    # Each file is decoded here and never again; headers are looked up in the written lines.
    landed = materialised(spread(numbered(lines)), "lines")
    starts = landed.filter("_block = 0").groupBy("_file").agg(F.min_by("value", "_line").alias("line"))
    headers = {row._file: row.line.strip() for row in starts.collect()}  # a row for each file
    if not headers:
        return
    cleaned = materialised(clean_records(_bound_lines(landed, headers)), "batch")
    moment, replayed = _batch_time(spark, times, batch_id)
    batch = tagged(accepted(cleaned), year_of_path(F.col("_file"))).withColumn(
        "import_date", F.lit(moment)
    )
    if not batch.filter(F.col("import_year").isNull()).isEmpty():
        raise ValueError("landed files must lie in a four-digit year folder")
    before_publish = partial(_record_attempt, attempts, spark=spark)
    mine = None
    if replayed:
        years = [row.import_year for row in batch.select("import_year").distinct().collect()]
        mine = spark.table(name).filter(
            F.col("import_year").isin(years) & (F.col("import_date") == F.lit(moment))
        )
    if mine is None or mine.isEmpty():
        insert_new(batch, name, before_publish=before_publish)
    else:
        others = spark.table(name).filter(F.col("import_date") != F.lit(moment))
        complete = new_rows(batch, others, [F.col(part) for part in POSITION])
        stored = STORED_SCHEMA.names
        missing = materialised(complete.select(stored).exceptAll(mine.select(stored)), "replay")
        append_rows(missing, name)
        discard_rows(missing)
    spark.catalog.refreshTable(name)
    discard_rows(landed)
    discard_rows(cleaned)


def ingest_stream(
    spark: SparkSession,
    landing: str,
    name: str,
    checkpoint: str,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Start loading ``landing/<year>/*.csv[.gz]``; stops by itself when all files are taken."""
    create_table(spark, name)
    lines = (
        spark.readStream.format("text")
        .option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv*")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )
    return (
        lines.writeStream.foreachBatch(
            lambda batch, batch_id: insert_batch(batch, batch_id, name, f"{checkpoint}/times")
        )
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
    )
