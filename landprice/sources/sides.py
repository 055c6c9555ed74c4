"""Side tables: rows derived from each load of the register table and kept beside it.

A load's files never change once they are written, so what is derived from them is derived once. It
is kept under the name of the load's folder, not its number: a rearranged year lies in a new folder
and is found to be stale, what was derived from a cleared year is no longer referred to. All loads
that lack their rows are brought up to date together, some years at a time if they are large; readers derive the rest in their own plan, so
a side table that lags behind costs time and never rows. A build counts only once its folders are
marked, after its job; of two builds of one load readers take either.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landprice.functions.prices import price, price_per_m2_or_zero, surface
from landprice.operators.filters import base_validity
from landprice.operators.price_cells import in_cells, told_again, told_once
from landprice.schema import CODEC, LOAD, MARKER_YEAR, OUTBUILDING, STORED_SCHEMA
from landprice.session import discard, folder_bytes, folder_names, freed_shuffles, make_folder
from landprice.sources.loads import partition_folder, partitions, table_folder

_KEPT_BY = ("source", "import_year")
_DONE = "_done"
#: Bytes of loads that are derived from in one job, or one year if it has more.
BYTES_AT_ONCE = 1 << 28


@dataclass(frozen=True)
class Side:
    """What is kept: ``derive`` takes stored rows and the columns to group by in addition.

    ``whole`` gives the side rows of what ``derive`` made, which may leave out what others tell.
    """

    kind: str
    schema: T.StructType
    derive: Callable[[DataFrame, tuple[str, ...]], DataFrame]
    whole: Callable[[DataFrame], DataFrame] = lambda rows: rows


def _price_cells(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    valid = rows.filter(base_validity()).select(
        *by,
        F.year("date_mutation").alias("sale_year"),
        "type_local",
        "code_postal",
        price().alias("valeur_fonciere"),
        price_per_m2_or_zero(price(), surface()).alias("prix_m2"),
    )
    places = (*by, "sale_year", "type_local", "code_postal")
    # Alike values next to each other are written small.
    cells = in_cells(valid, places).sortWithinPartitions(*places, "price_cell", "m2_cell")
    return told_once(cells)


def _outbuildings(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    held = (F.col("type_local") == F.lit(OUTBUILDING)) & F.col("id_mutation").isNotNull()
    return rows.filter(held).select(*by, "id_mutation").distinct()


def _street_grams(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    places = rows.filter(F.length("adresse_nom_voie") > 0).select(*by, "adresse_nom_voie", "code_postal")
    name = F.upper("adresse_nom_voie")
    # Up to the last letter, where grams get shorter: a text of one or two letters starts some gram.
    grams = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: name.substr(i, F.lit(GRAM)))
    each = places.distinct().withColumn("gram", F.explode(F.array_distinct(grams)))
    # Row groups of the kept files then hold few grams each.
    return each.sortWithinPartitions(*by, "gram")


#: Letters of a street name that are looked up together.
GRAM = 3
#: Counts of valid sales per sale year, type, postal code and cell of price and price per m².
PRICE_CELLS = Side(
    "price_cells",
    T.StructType(
        [
            T.StructField("sale_year", T.IntegerType()),
            T.StructField("type_local", T.StringType()),
            T.StructField("code_postal", T.StringType()),
            *[T.StructField(x, T.LongType()) for x in ("price_cell", "m2_cell", "rows")],
            *[
                T.StructField(f"{measure}_{part}", T.DoubleType())
                for measure in ("price", "m2")
                for part in ("total", "low", "high")
            ],
        ]
    ),
    _price_cells,
    told_again,
)
#: Ids of sales with an outbuilding, once for each load that brought one.
OUTBUILDINGS = Side(
    "outbuildings", T.StructType([T.StructField("id_mutation", T.StringType())]), _outbuildings
)

#: For every three letters of a street name the streets that hold them, and their postal codes.
STREETS = Side(
    "streets",
    T.StructType([T.StructField(x, T.StringType()) for x in ("gram", "adresse_nom_voie", "code_postal")]),
    _street_grams,
)


@dataclass(frozen=True)
class Snapshot:
    """The partitions of a table at one moment: number and folder of each year's loads."""

    name: str
    base: str
    parts: tuple[tuple[int, int, str], ...]

    def rows(self, spark: SparkSession) -> DataFrame:
        """The table's rows in these partitions, whatever is published meanwhile."""
        spark.catalog.refreshTable(self.name)
        here = [
            (F.col("import_year") == F.lit(year).cast("short")) & (F.col(LOAD) == F.lit(load))
            for year, load, _ in self.parts
        ]
        return spark.table(self.name).filter(reduce(or_, here, F.lit(False)))


def snapshot(spark: SparkSession, name: str) -> Snapshot:
    found = [
        (year, load, partition_folder(spark, name, year, load).split("/")[-2])
        for year, load in partitions(spark, name)
        if year != MARKER_YEAR
    ]
    return Snapshot(name, table_folder(spark, name), tuple(sorted(found)))


def _folder(base: str, side: Side) -> str:
    return f"{base}/sides/{side.kind}"


def _kept(spark: SparkSession, base: str, side: Side) -> dict[str, str]:
    """The folder of what is kept for each load folder."""
    top, out = _folder(base, side), {}
    for build in folder_names(spark, top):
        for source in folder_names(spark, f"{top}/{build}"):
            if source.startswith("source=") and _DONE in folder_names(spark, f"{top}/{build}/{source}"):
                out.setdefault(source.removeprefix("source="), f"{top}/{build}/{source}")
    return out


def _derived(spark: SparkSession, base: str, side: Side, parts: list[tuple[int, str]]) -> DataFrame:
    """The side rows of years of loads, read from the loads' own files."""
    fields = [field for field in STORED_SCHEMA if field.name != "import_year"]
    stored = spark.read.schema(T.StructType(fields)).parquet(
        *[f"{base}/loads/{source}/import_year={year}" for year, source in parts]
    )
    # Where a row lies names its load and year.
    place = "/loads/([0-9a-f]+)/import_year=(-?[0-9]+)/"
    found = F.struct(*[F.regexp_extract("_metadata.file_path", place, i).alias(f"p{i}") for i in (1, 2)])
    rows = stored.withColumn("_place", found).withColumns(
        {"source": F.col("_place.p1"), "import_year": F.col("_place.p2").cast("short")}
    )
    return side.derive(rows, _KEPT_BY)


def stale(spark: SparkSession, name: str, side: Side) -> list[int]:
    """Years of which some load has no side rows yet."""
    now = snapshot(spark, name)
    kept = _kept(spark, now.base, side)
    return sorted({year for year, _, source in now.parts if source not in kept})


def _runs(
    spark: SparkSession, base: str, parts: list[tuple[int, str]]
) -> Iterator[list[tuple[int, str]]]:
    """Years of loads, together up to ``BYTES_AT_ONCE``."""
    run, held = [], 0
    for year, source in sorted(parts):
        size = folder_bytes(spark, f"{base}/loads/{source}/import_year={year}")
        if run and held + size > BYTES_AT_ONCE:
            yield run
            run, held = [], 0
        run.append((year, source))
        held += size
    if run:
        yield run


def refresh(spark: SparkSession, name: str, side: Side) -> list[int]:
    """Derive what is missing, years of all loads together, and delete what no load refers to."""
    now = snapshot(spark, name)
    kept = _kept(spark, now.base, side)
    used = {source for _, _, source in now.parts}
    missing = [(year, source) for year, _, source in now.parts if source not in kept]
    if missing:
        build = f"{_folder(now.base, side)}/build={uuid.uuid4().hex}"
        with freed_shuffles(spark):
            for parts in _runs(spark, now.base, missing):
                rows = _derived(spark, now.base, side, parts)
                rows.write.mode("append").options(**CODEC).partitionBy(*_KEPT_BY).parquet(build)
        for source in sorted({source for _, source in missing}):
            make_folder(spark, f"{build}/source={source}/{_DONE}")
    discard(spark, *[folder for source, folder in kept.items() if source not in used])
    return sorted({year for year, _ in missing})


def side_rows(spark: SparkSession, now: Snapshot, side: Side) -> DataFrame:
    """The side rows of every load of a snapshot; those that are not kept are derived in the plan."""
    kept = _kept(spark, now.base, side)
    sources = sorted({source for _, _, source in now.parts})
    there = [kept[source] for source in sources if source in kept]
    missing = [(year, source) for year, _, source in now.parts if source not in kept]
    names = [field.name for field in side.schema]

    def current(rows: DataFrame) -> DataFrame:
        return rows.filter(reduce(or_, map(_same_part, now.parts), F.lit(False))).select(*names)

    fields = [
        *side.schema.fields,
        T.StructField("build", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("import_year", T.ShortType()),
    ]
    found = []
    if there:
        reader = spark.read.schema(T.StructType(fields)).option("basePath", _folder(now.base, side))
        found.append(current(reader.parquet(*there)))
    if missing:
        found.append(current(_derived(spark, now.base, side, missing)))
    return side.whole(reduce(DataFrame.unionByName, found)) if found else spark.createDataFrame([], side.schema)


def _same_part(part: tuple[int, int, str]) -> Column:
    year, _, source = part
    return (F.col("source") == F.lit(source)) & (F.col("import_year") == F.lit(year).cast("short"))
