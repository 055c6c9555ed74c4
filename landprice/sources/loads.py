"""Atomic loads of the register table: written aside, published by one catalog call.

The table is partitioned by import year and load number. A load writes its files into a folder of
its own, which no reader sees, and then adds its partitions, one per year, in a single
``ALTER TABLE … ADD PARTITION``. A writer that dies before leaves files without a partition, not
half a load. The load number is the next free one and every load adds a partition of an empty
marker year with it, so of two writers that took the same number one fails as a whole, compares
its rows with what the other published and tries the next number. The catalog is the manifest;
nothing else is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landprice.operators.dedup import insert_if_absent
from landprice.schema import CODEC, LOAD, MARKER_YEAR, STORED_SCHEMA
from landprice.session import discard, folder_names, make_folder

#: Row groups are what lookups skip, and pages inside them; files stay large.
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 4_000
#: Looked up by equality, and too many values for minima and maxima to tell groups apart.
BLOOM_COLUMNS = ("id_parcelle", "id_mutation")


@dataclass(frozen=True)
class WrittenLoad:
    """Rows in a folder of their own that no reader of the table sees yet."""

    folder: str
    years: tuple[int, ...]
    rows: int


def _detail(spark: SparkSession, described: str, detail: str) -> str:
    row = spark.sql(f"DESCRIBE EXTENDED {described}").filter(F.col("col_name") == detail).first()
    return row.data_type


def table_folder(spark: SparkSession, name: str) -> str:
    return _detail(spark, name, "Location").rstrip("/")


def partitions(spark: SparkSession, name: str) -> list[tuple[int, int]]:
    """Year and load number of everything published, the marker year included."""
    listed = spark.sql(f"SHOW PARTITIONS {name}").collect()
    parts = (dict(part.split("=") for part in row.partition.split("/")) for row in listed)
    return [(int(part["import_year"]), int(part[LOAD])) for part in parts]


def latest_load(spark: SparkSession, name: str) -> int:
    return max((load for _, load in partitions(spark, name)), default=0)


def _spec(year: int, load: int) -> str:
    return f"PARTITION (import_year = {year}, {LOAD} = {load})"


def partition_folder(spark: SparkSession, name: str, year: int, load: int) -> str:
    return _detail(spark, f"{name} {_spec(year, load)}", "Location").rstrip("/")


def write_aside(rows: DataFrame, name: str, *runs: Sequence[int]) -> WrittenLoad:
    """Write rows, as they are arranged, into a new folder below the table's own.

    ``runs`` of years, all of them if any, are written one after the other, so that only the rows of
    one run are sorted and shuffled at a time.
    """
    spark = rows.sparkSession
    folder = f"{table_folder(spark, name)}/loads/{uuid.uuid4().hex}"
    options = CODEC | {
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.bloom.filter.adaptive.enabled": "true",
    }
    options |= {f"parquet.bloom.filter.enabled#{column}": "true" for column in BLOOM_COLUMNS}
    names = [field.name for field in STORED_SCHEMA]
    for years in runs or [None]:
        part = rows if years is None else rows.filter(F.col("import_year").isin(list(years)))
        writer = part.select(*names).write.mode("append").options(**options)
        writer.partitionBy("import_year").parquet(folder)
    years = [x.split("=")[1] for x in folder_names(spark, folder) if x.startswith("import_year=")]
    written = spark.read.schema(STORED_SCHEMA).parquet(folder).count() if years else 0
    return WrittenLoad(folder, tuple(sorted(map(int, years))), written)


def _marker_folder(load: WrittenLoad) -> str:
    return f"{load.folder}/_published"


def publish(spark: SparkSession, name: str, load: WrittenLoad, number: int) -> bool:
    """Make a load visible under a number; false, and nothing changes, if the number is taken."""
    make_folder(spark, _marker_folder(load))
    places = {MARKER_YEAR: _marker_folder(load)}
    places |= {year: f"{load.folder}/import_year={year}" for year in load.years}
    added = " ".join(f"{_spec(year, number)} LOCATION '{at}'" for year, at in places.items())
    try:
        spark.sql(f"ALTER TABLE {name} ADD {added}")
    except Exception as problem:
        if "ALREADY_EXIST" in str(problem):
            return False
        raise
    spark.catalog.refreshTable(name)
    return True


def is_published(spark: SparkSession, name: str, load: WrittenLoad, number: int) -> bool:
    """Whether the table's partitions of this number are the folders of this load.

    A cleared or rearranged year counts as not published; what it holds must be looked at.
    """
    known = set(partitions(spark, name))

    def tail(folder: str) -> list[str]:  # without the scheme, which catalogs may add
        return folder.rstrip("/").split("/")[-2:]

    return all(
        (year, number) in known
        and tail(partition_folder(spark, name, year, number))
        == tail(f"{load.folder}/import_year={year}")
        for year in load.years
    )


def add_load(
    rows: DataFrame,
    name: str,
    seen: int,
    arrange: Callable[[DataFrame], DataFrame],
    before_publish: Callable[[WrittenLoad, int], None] = lambda load, number: None,
    runs: Sequence[Sequence[int]] = (),
) -> int:
    """Write and publish rows that were compared with the table up to load ``seen``.

    ``runs`` are for ``write_aside``. If others published since, the written rows are compared with those loads only. Returns the
    number of rows inserted, as counted in the written files.
    """
    spark = rows.sparkSession
    load = write_aside(arrange(rows), name, *runs)
    while load.rows:
        latest = latest_load(spark, name)
        if latest > seen:
            spark.catalog.refreshTable(name)
            others = spark.table(name).filter(F.col(LOAD) > seen)
            own = spark.read.schema(STORED_SCHEMA).parquet(load.folder)
            compared = write_aside(arrange(insert_if_absent(own, others)), name, *runs)
            discard(spark, load.folder)
            load, seen = compared, latest
            continue
        before_publish(load, seen + 1)
        if publish(spark, name, load, seen + 1):
            return load.rows
    discard(spark, load.folder)
    return 0


def drop_partitions(spark: SparkSession, name: str, dropped: list[tuple[int, int]]) -> None:
    """Hide partitions in one catalog call, then delete their files."""
    if not dropped:
        return
    folders = [partition_folder(spark, name, *part) for part in dropped]
    specs = ", ".join(_spec(*part) for part in dropped)
    spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {specs}")
    spark.catalog.refreshTable(name)
    discard(spark, *folders)


def replace_partitions(
    spark: SparkSession, name: str, year: int, loads: list[int], replacement: WrittenLoad
) -> None:
    """Put a rewritten year in the place of its loads.

    The last partition is pointed to the new files, in one catalog call; with one load readers
    see the old or the new rows. Earlier loads are dropped right after, so a report that starts
    between the two calls would see their rows twice. The last number stays, so that a writer
    which has not seen that load yet still compares its rows with it.
    """
    *others, last = sorted(loads)
    old = partition_folder(spark, name, year, last)
    spark.sql(
        f"ALTER TABLE {name} {_spec(year, last)} "
        f"SET LOCATION '{replacement.folder}/import_year={year}'"
    )
    spark.catalog.refreshTable(name)
    drop_partitions(spark, name, [(year, load) for load in others])
    discard(spark, old)


def remove_unpublished(spark: SparkSession, name: str) -> list[str]:
    """Delete folders that no partition uses: what writers that died have left.

    For quiet times: the folder of a load that is being written has no partition either.
    """
    base = f"{table_folder(spark, name)}/loads"
    used = {partition_folder(spark, name, *part).split("/")[-2] for part in partitions(spark, name)}
    left = sorted(set(folder_names(spark, base)) - used)
    discard(spark, *[f"{base}/{folder}" for folder in left])
    return left
