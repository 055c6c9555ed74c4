"""Register files: one CSV record per physical line, header-driven column order.

Files are read as text lines and parsed with ``from_csv``, so that a line keeps its raw
form for the reject report, its position in the file, and its byte-level validity.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce
from threading import Lock
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landprice.functions.coerce import clean_value, storage_misfit, stored
from landprice.schema import DATA_SCHEMA, REGISTER_COLUMNS

# Fixed value: file name of one year below its template folder.
YEAR_FILE = "full.csv.gz"

# Every character a line is stripped of before parsing.
_BLANKS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
_MALFORMED = "_malformed"
_building = Lock()

# Position of a line in the landed files; sorts as the file reads.
POSITION = ("_file", "_block", "_line")
# Lines whose numbers differ in so many low bits only are spread together.
RUN_BITS = 8
REJECT_COLUMNS = ("reject_reason", "raw_line")


def year_path(template: str, year: int, file_name: str = YEAR_FILE) -> str:
    """The file, or folder of files, that holds one year."""
    return f"{template.format(year=year)}/{file_name}".rstrip("/")


def text_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Physical lines split at newline only, with the block each was read from."""
    reader = spark.read.option("lineSep", "\n")
    return reader.text(list(paths)).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def parse_header(line: str) -> list[str]:
    """Column names of a header line; unknown or missing key columns are an error."""
    names = next(csv.reader([line.strip()]), [])
    unknown = sorted(set(names) - set(REGISTER_COLUMNS))
    missing = sorted({"id_mutation", "date_mutation"} - set(names))
    if unknown or missing or len(set(names)) < len(names):
        raise ValueError(f"bad header: unknown {unknown}, missing {missing}, or repeated names")
    return names


def read_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The first line of every file below the paths that has any."""
    return read_group_headers(spark, {0: paths})[0]


def read_group_headers(
    spark: SparkSession, groups: Mapping[int, Sequence[str]]
) -> dict[int, dict[str, str]]:
    """The first line of every non-empty file of each group of paths, found by one job.

    Each file starts a task of its own, and so does each later block of a large file, whose first
    line is left out. Lines are read through, but leave the scan only as first ones.
    """
    # In a session of its own, because several imports read headers at the same time.
    alone = spark.newSession()
    whole = alone.conf.get("spark.sql.files.maxPartitionBytes")
    alone.conf.set("spark.sql.files.openCostInBytes", whole)
    lines = reduce(
        DataFrame.union,
        [text_lines(alone, paths).withColumn("_group", F.lit(group)) for group, paths in groups.items()],
    )

    # The low bits of the running id count the lines of a task, here those of one block.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    first = lines.withColumn("_number", number).filter("_number = 0 AND _block = 0")
    headers: dict[int, dict[str, str]] = {group: {} for group in groups}
    for row in first.collect():
        headers[row._group][unquote(row._file)] = row.value.strip()
    return headers


def by_layout(headers: Mapping[str, str]) -> dict[tuple[str, ...], list[str]]:
    """Files by the column order that their own header gives; blank headers bind none."""
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, header in sorted(headers.items()):
        if header:
            layouts.setdefault(tuple(parse_header(header)), []).append(file)
    return layouts


def numbered(lines: DataFrame) -> DataFrame:
    """Adds the running line number; call it right on a scan, before any shuffle."""
    return lines.withColumn("_line", F.monotonically_increasing_id())


def spread(lines: DataFrame) -> DataFrame:
    """One gzip file is one scan task; spread its lines before the expensive parsing.

    Short runs of lines stay together: neighbours are alike, so the shuffle and what is staged from it
    are much smaller than with single lines dealt out.
    """
    return lines.repartition("_file", "_block", F.shiftright("_line", RUN_BITS))


def raw_records(lines: DataFrame, names: Sequence[str], headers: Sequence[str]) -> DataFrame:
    """Text columns by name plus ``reject_reason``/``raw_line`` for undecodable or ragged lines.

    ``names`` is the column order of all these lines; blank lines and the header texts are
    skipped.
    """
    schema = ", ".join(f"`{name}` string" for name in [*names, _MALFORMED])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED, "escape": '"'}
    decodable = F.is_valid_utf8("value")
    line = _stripped(F.col("value"))
    kept = lines.withColumn("value", F.when(decodable, line).otherwise(F.col("value")))
    kept = kept.filter(~F.col("value").isin("", *sorted(set(headers))))
    parsed = kept.withColumn("_record", F.from_csv("value", schema, options))
    record = F.col("_record")
    reason = F.when(~decodable, F.lit("encoding")).when(
        record[_MALFORMED].isNotNull(), F.lit("fields")
    )
    present = set(names)
    return parsed.select(
        *POSITION,
        *[
            (record[name] if name in present else F.lit(None).cast("string")).alias(name)
            for name in REGISTER_COLUMNS
        ],
        reason.alias("reject_reason"),
        F.col("value").alias("raw_line"),
    )


def unbound_records(lines: DataFrame) -> DataFrame:
    """Lines of files whose header can't be used: all are rejects."""
    return lines.select(
        *POSITION,
        *[F.lit(None).cast("string").alias(name) for name in REGISTER_COLUMNS],
        F.lit("header").alias("reject_reason"),
        F.col("value").alias("raw_line"),
    )


@lru_cache(maxsize=16)
def _cleaning(application: str, others: tuple[str, ...]) -> tuple[list[Column], Column]:
    """Expressions of the cleaning step. They are some thousand calls into the JVM and the same for
    every file group, so an application builds them once."""
    cleaned = [clean_value(name, F.col(name)).alias(name) for name in REGISTER_COLUMNS]
    misfits = [
        F.when(misfit, F.lit(f"storage:{name}"))
        for name in REGISTER_COLUMNS
        if (misfit := storage_misfit(name)) is not None
    ]
    essential = F.col("id_mutation").isNull() | F.col("date_mutation").isNull()
    earlier = [F.col("reject_reason")] if "reject_reason" in others else []
    line = F.col("raw_line") if "raw_line" in others else F.lit(None).cast("string")
    reason = F.coalesce(*earlier, F.when(essential, F.lit("essential")), *misfits)
    outcome = F.struct(
        *[name for name in others if name not in REJECT_COLUMNS],
        *[stored(name) for name in REGISTER_COLUMNS],
        reason.alias("reject_reason"),
        F.when(reason.isNotNull(), line).alias("raw_line"),
    )
    return cleaned, outcome


def clean_records(raw: DataFrame) -> DataFrame:
    """Typed columns; rows that cannot be stored get a reason instead of failing the load."""
    others = tuple(name for name in raw.columns if name not in REGISTER_COLUMNS)
    with _building:
        cleaned, outcome = _cleaning(raw.sparkSession.sparkContext.applicationId, others)
    # A filter on the reason can't move below the generated row, so nothing is cleaned twice.
    return raw.select(*others, *cleaned).select(F.inline(F.array(outcome)))


def read_register(
    spark: SparkSession, paths: Sequence[str], headers: Mapping[str, str] | None = None
) -> DataFrame:
    """Cleaned rows and rejects of files, each bound by its own header, which is read if not given."""
    headers = read_headers(spark, paths) if headers is None else headers
    layouts = by_layout(headers)
    if not layouts:
        raise ValueError(f"no header in {', '.join(paths)}")

    def bound(names: tuple[str, ...], files: list[str]) -> DataFrame:
        # One layout keeps the given paths, so that a folder stays one path.
        lines = numbered(text_lines(spark, paths if len(layouts) == 1 else files))
        if any(file.endswith(".gz") for file in files):
            lines = spread(lines)
        return raw_records(lines, names, [headers[file] for file in files])

    parts = [bound(names, files) for names, files in layouts.items()]
    return clean_records(reduce(DataFrame.unionByName, parts))


def accepted(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("reject_reason").isNull()).drop(*REJECT_COLUMNS)


def rejected(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("reject_reason").isNotNull()).select(
        *[name for name in POSITION if name in cleaned.columns], *REJECT_COLUMNS
    )


def outcome_counts() -> list[Column]:
    """Rows of each outcome that cleaning can give, as aggregates over the whole input."""
    limited = [name for name in REGISTER_COLUMNS if storage_misfit(name) is not None]
    reasons = ["encoding", "fields", "header", "essential", *[f"storage:{name}" for name in limited]]
    reason = F.coalesce("reject_reason", F.lit("accepted"))
    return [F.count_if(reason == outcome).alias(outcome) for outcome in ["accepted", *reasons]]


def reject_report(cleaned: DataFrame) -> DataFrame:
    """Number of rows per outcome; accepted rows under ``accepted``."""
    return cleaned.groupBy(
        F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("rows"))


def tagged(rows: DataFrame, year: Column) -> DataFrame:
    """Import year and time; column order of the table."""
    return rows.select(
        *[name for name in rows.columns if name not in DATA_SCHEMA.names],
        *DATA_SCHEMA.names,
        F.current_timestamp().alias("import_date"),
        year.cast("short").alias("import_year"),
    )


def year_of_path(path: Column) -> Column:
    """The year folder a landed file lies in, ``2024`` or ``import_year=2024``."""
    return F.regexp_extract(path, r"/(?:import_year=)?([0-9]{4})/[^/]*$", 1).try_cast("short")
