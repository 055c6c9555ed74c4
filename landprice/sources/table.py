"""The register table: partitioned Parquet in the session catalog."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landprice.functions.prices import price, price_per_m2, surface
from landprice.operators.dedup import conflicting_keys, without_conflicts
from landprice.operators.layout import rank_bounds, with_curve_position
from landprice.schema import CODEC, FLAT, HOUSE, LOAD, STORED_SCHEMA, TABLE_CANDIDATES, TABLE_SCHEMA
from landprice.session import compiled_methods, discard_rows, freed_shuffles, materialised
from landprice.sources import loads
from landprice.sources.register_csv import POSITION

#: Rows that an insert sorts and shuffles at a time, or one year if it has more.
ROWS_AT_ONCE = 1 << 22

# Clustering inside a year: lookups by any of these skip row groups by their min and max.
LAYOUT = ("type_local", "code_postal", "date_mutation", "id_parcelle")


def create_table(spark: SparkSession, name: str) -> None:
    """Create the table if it does not exist."""
    columns = ", ".join(
        f"`{field.name}` {field.dataType.simpleString()}" for field in TABLE_SCHEMA
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"PARTITIONED BY (import_year, {LOAD})"
    )


def resolve_table(spark: SparkSession, candidates: Sequence[str] = TABLE_CANDIDATES) -> str:
    """The first candidate that exists."""
    for name in candidates:
        if spark.catalog.tableExists(name):
            return name
    raise LookupError(f"none of the tables {', '.join(candidates)} exists")


def read_register_table(spark: SparkSession, name: str | None = None) -> DataFrame:
    return spark.table(name or resolve_table(spark))


def arranged(rows: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Range-partitioned and sorted along a curve through all layout columns.

    ``like`` holds rows of about the same values that are cheaper to sample than ``rows``. The
    number of files follows the data: no count is given, so adaptive execution merges small
    ranges. Line positions, where present, end the range key, so that any number of rows of one
    place or sale can be cut into several ranges.
    """
    bounds = rank_bounds(rows if like is None else like, LAYOUT)
    placed = with_curve_position(rows, bounds, "_curve")
    years = [name for name in ("import_year",) if name in rows.columns]
    order = [*years, "_curve", *LAYOUT]
    ends = [name for name in POSITION if name in rows.columns] or ["id_mutation"]
    ranged = placed.repartitionByRange(*[F.col(name) for name in [*order, *ends]])
    return ranged.sortWithinPartitions(*order).drop("_curve")


def append_rows(rows: DataFrame, name: str) -> int:
    """Publish rows as one load; the number of rows written."""
    with compiled_methods(rows.sparkSession), freed_shuffles(rows.sparkSession):
        written = loads.write_aside(arranged(rows), name)
    while written.rows:
        number = loads.latest_load(rows.sparkSession, name) + 1
        if loads.publish(rows.sparkSession, name, written, number):
            break
    return written.rows


def year_runs(batch: DataFrame) -> list[list[int]]:
    """Years of a batch, those that follow each other together up to ``ROWS_AT_ONCE`` rows.

    None if one run holds all, or if a row has no year.
    """
    runs, held = [], 0
    counts = batch.groupBy("import_year").agg(F.count(F.lit(1)).alias("rows"))
    found = [(row.import_year, row.rows) for row in counts.collect()]
    if any(year is None for year, _ in found):
        return []
    for year, rows in sorted(found):
        if not runs or held + rows > ROWS_AT_ONCE:
            runs.append([])
            held = 0
        runs[-1].append(year)
        held += rows
    return runs if len(runs) > 1 else []


def insert_new(
    batch: DataFrame, name: str, order: Sequence[str] = POSITION, **options
) -> int:
    """Insert the rows whose key is neither repeated in the batch nor in the table, as one load.

    ``batch`` carries the line positions, which order equal keys unless told otherwise. Nothing is visible before all
    is; the key holds against writers that publish meanwhile. The number of inserted rows is
    counted in the written files, so task retries and other writers cannot distort it.
    """
    spark = batch.sparkSession
    spark.catalog.refreshTable(name)
    seen = loads.latest_load(spark, name)
    existing = spark.table(name).filter(F.col(LOAD) <= seen)
    # Stored, so that the insert is planned with their size.
    conflicts = materialised(conflicting_keys(batch, existing), "conflicts")
    stored = [conflicts]

    def kept(first: DataFrame) -> DataFrame:
        if runs:  # else every run would look for the first rows among all years
            first = materialised(first, "first", **CODEC)
            stored.append(first)
        return first

    try:
        runs = year_runs(batch)
        fresh = without_conflicts(batch, conflicts, order, kept=kept)
        return loads.add_load(
            fresh, name, seen, lambda rows: arranged(rows, batch), runs=runs, **options
        )
    finally:
        for frame in stored:
            discard_rows(frame)


def year_count(spark: SparkSession, name: str, year: int) -> int:
    return spark.table(name).filter(F.col("import_year") == F.lit(year).cast("short")).count()


def year_counts(spark: SparkSession, name: str, years: Iterable[int]) -> dict[int, int]:
    """Rows of each of these years that has any; years without a partition are not looked at."""
    held = sorted({year for year, _ in loads.partitions(spark, name)} & set(years))
    if not held:
        return {}
    rows = spark.table(name).filter(F.col("import_year").isin(held))
    return {row.import_year: row["count"] for row in rows.groupBy("import_year").count().collect()}


def has_year(spark: SparkSession, name: str, year: int) -> bool:
    return not spark.table(name).filter(
        F.col("import_year") == F.lit(year).cast("short")
    ).isEmpty()


def clear_year(spark: SparkSession, name: str, year: int) -> int:
    """Remove a year; returns the number of rows it had. Readers see all of it or nothing."""
    removed = year_count(spark, name, year)
    loads.drop_partitions(
        spark, name, [part for part in loads.partitions(spark, name) if part[0] == int(year)]
    )
    return removed


def import_status(table: DataFrame) -> DataFrame:
    """Rows and import time span per year, newest year first."""
    return (
        table.groupBy("import_year")
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.min("import_date").alias("first_import"),
            F.max("import_date").alias("last_import"),
        )
        .orderBy(F.col("import_year").desc())
    )


def table_statistics(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("import_year").alias("years_imported"),
        F.min("date_mutation").alias("earliest_date"),
        F.max("date_mutation").alias("latest_date"),
        F.count_if(F.col("type_local") == F.lit(FLAT)).alias("apartments"),
        F.count_if(F.col("type_local") == F.lit(HOUSE)).alias("houses"),
    )


def table_bytes(spark: SparkSession, name: str) -> int:
    """Size from the catalog statistics, which this call brings up to date."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
    details = spark.sql(f"DESCRIBE EXTENDED {name}")
    row = details.filter(F.col("col_name") == "Statistics").first()
    return int(row.data_type.split()[0]) if row else 0


def table_stats(spark: SparkSession, name: str) -> DataFrame:
    """``table_statistics`` plus the stored size."""
    size = table_bytes(spark, name)
    return table_statistics(spark.table(name)).withColumn("table_bytes", F.lit(size))


def _with_price_m2(table: DataFrame, year: int) -> DataFrame:
    return table.filter(F.col("import_year") == F.lit(year).cast("short")).withColumn(
        "prix_m2", price_per_m2(price(), surface())
    )


def integrity_report(table: DataFrame, year: int) -> DataFrame:
    """Rows of a year, rows with a usable price per square metre, and whether any exist."""
    priced = (F.col("surface_reelle_bati") > 0) & F.col("prix_m2").isNotNull()
    return _with_price_m2(table, year).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(priced).alias("with_prix_m2"),
        (F.count(F.lit(1)) > 0).alias("ok"),
    )


def integrity_sample(table: DataFrame, year: int, count: int = 5) -> DataFrame:
    """The first rows of a year in key order."""
    shown = ("id_mutation", "date_mutation", "valeur_fonciere", "type_local")
    order = ("id_mutation", "numero_disposition", "id_parcelle", "lot1_numero")
    return (
        _with_price_m2(table, year)
        .orderBy(*[F.col(name).asc_nulls_first() for name in order])
        .limit(count)
        .select(*shown, "surface_reelle_bati", "prix_m2")
    )


def refresh_statistics(spark: SparkSession, name: str) -> None:
    """Column statistics for the optimiser, on the columns that filters and joins use."""
    columns = ", ".join(
        ("id_mutation", "date_mutation", "valeur_fonciere", "surface_reelle_bati", *LAYOUT[:2])
    )
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {columns}")


def rearrange_year(spark: SparkSession, name: str, year: int) -> None:
    """Rewrite one year along the curve, merging the files of many small loads into one."""
    numbers = [load for y, load in loads.partitions(spark, name) if y == int(year)]
    rows = spark.table(name).filter(
        (F.col("import_year") == F.lit(year).cast("short")) & F.col(LOAD).isin(numbers)
    )
    if not numbers:
        return
    with compiled_methods(spark), freed_shuffles(spark):
        rewritten = loads.write_aside(arranged(rows), name)
    if rewritten.rows:
        loads.replace_partitions(spark, name, int(year), numbers, rewritten)
