from __future__ import annotations

import csv
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from landprice.schema import DATA_SCHEMA
from landprice.sources.register_csv import (
    accepted,
    numbered,
    parse_header,
    read_register,
    reject_report,
    rejected,
    spread,
    year_of_path,
)
from tests.samples import COLUMNS, line, record, write_file


@pytest.fixture
def load(spark, tmp_path):
    def _load(lines, header=None, name="2024/full.csv.gz"):
        return read_register(spark, [write_file(tmp_path / name, lines, header)])

    return _load


def outcomes(cleaned):
    return {row.outcome: row.rows for row in reject_report(cleaned).collect()}


def test_types_and_leading_zeros(load):
    row = accepted(load([line(code_postal="01230", valeur_fonciere="346.5")])).first()
    assert (row.code_postal, row.numero_disposition) == ("01230", "000001")
    assert row.valeur_fonciere == Decimal("346.50") and str(row.date_mutation) == "2024-01-02"
    assert row.longitude == Decimal("5.530952") and row.nom_commune == "Plateau d'Hauteville"
    assert row.lot1_numero is None


def test_accepted_schema_is_the_table_schema(load):
    frame = accepted(load([line()])).select(*DATA_SCHEMA.names)
    assert [f.dataType for f in frame.schema] == [f.dataType for f in DATA_SCHEMA]


def test_column_order_comes_from_the_header(load):
    names = list(reversed(COLUMNS))
    row = accepted(load([",".join(reversed(record(id_parcelle="x9")))], ",".join(names))).first()
    assert (row.id_parcelle, row.id_mutation) == ("x9", "m1")


def test_missing_columns_are_null(load):
    row = accepted(load(["m1,2024-01-02"], "id_mutation,date_mutation")).first()
    assert row.id_mutation == "m1" and row.valeur_fonciere is None


@pytest.mark.parametrize("header", ["id_mutation,date_mutation,extra", "id_mutation", ""])
def test_bad_headers_fail(header):
    with pytest.raises(ValueError):
        parse_header(header)


def test_ragged_and_undecodable_lines_are_rejected(load):
    good = line()
    lines = [
        good,
        "",
        "   ",
        good + ",more",
        "m1,2024-01-02",
        good.replace("Vente", '"Vente'),
        good.encode().replace(b"Vente", b"V\xffnte"),
        good.replace("Vente", "V�nte"),
    ]
    cleaned = load(lines)
    assert outcomes(cleaned) == {"accepted": 2, "fields": 3, "encoding": 1}
    assert rejected(cleaned).filter("reject_reason = 'fields'").filter(
        F.col("raw_line") == good + ",more"
    ).count() == 1


def test_counts_do_not_depend_on_the_columns_read(load):
    cleaned = load([line(), "a,b", line(id_mutation="m2")])
    assert accepted(cleaned).count() == 2
    assert accepted(cleaned).select("id_mutation").count() == 2
    assert rejected(cleaned).select("reject_reason").count() == 1


def test_quotes_and_carriage_returns(load):
    lines = [
        line(nom_commune="A, B") + "\r",
        line(nom_commune="x").replace(",x,", ',"say ""hi""",'),
        line()[: -len("45.952439")] + '"45.952439',
    ]
    rows = accepted(load(lines)).orderBy("_line").collect()
    assert [row.nom_commune for row in rows] == ["A, B", 'say "hi"', "Plateau d'Hauteville"]
    assert [row.latitude for row in rows] == [Decimal("45.952439")] * 3


@pytest.mark.parametrize("token", ["", "NaN", "nan", "NULL"])
def test_null_tokens(load, token):
    row = accepted(load([line(nom_commune=token, valeur_fonciere=token)])).first()
    assert row.nom_commune is None and row.valeur_fonciere is None


@pytest.mark.parametrize("text", ["Nan", "null", " "])
def test_other_texts_stay(load, text):
    assert accepted(load([line(nom_commune=text)])).first().nom_commune == text


@pytest.mark.parametrize(
    ("text", "stored"),
    [
        ("abc", None),
        ("-1", None),
        ("100000001", None),
        ("100000000.001", None),
        ("12d", None),
        ("inf", None),
        ("0", "0.00"),
        ("100000000", "100000000.00"),
        ("1e3", "1000.00"),
        ("2.005", "2.01"),
    ],
)
def test_price_coercion_keeps_the_row(load, text, stored):
    row = accepted(load([line(valeur_fonciere=text)])).first()
    assert row.valeur_fonciere == (None if stored is None else Decimal(stored))


@pytest.mark.parametrize(("text", "stored"), [("-1", None), ("10000001", None), ("89", "89.00")])
def test_surface_range(load, text, stored):
    cleaned = load([line(surface_reelle_bati=text, lot5_surface_carrez=text)])
    row = accepted(cleaned).first()
    expected = None if stored is None else Decimal(stored)
    assert row.surface_reelle_bati == expected and row.lot5_surface_carrez == expected


@pytest.mark.parametrize("text", ["2024-02-30", "02/01/2024", "", "2024", "2024-1-2"])
def test_rows_without_a_date_go(load, text):
    assert outcomes(load([line(date_mutation=text)])) == {"essential": 1}


def test_rows_without_an_id_go(load):
    assert outcomes(load([line(id_mutation="NULL"), line()])) == {"essential": 1, "accepted": 1}


def test_storage_misfits_carry_the_column(load):
    cleaned = load([line(code_postal="012345"), line(longitude="12345.1"), line(longitude="x")])
    assert outcomes(cleaned) == {"storage:code_postal": 1, "storage:longitude": 1, "accepted": 1}


def test_each_file_is_bound_by_its_own_header(spark, tmp_path):
    quoted = ",".join(f'"{name}"' for name in COLUMNS)
    moved = [name for name in COLUMNS if name not in ("id_parcelle", "nom_commune")]
    moved = ["nom_commune", *moved, "id_parcelle"]
    cells = dict(zip(COLUMNS, record(id_mutation="m3", id_parcelle="P3", nom_commune="Y")))
    folder = tmp_path / "2024"
    write_file(folder / "a.csv", [line(id_parcelle="P1", nom_commune="X")])
    write_file(folder / "b.csv.gz", [line(id_mutation="m2", id_parcelle="P2")], quoted)
    write_file(folder / "c.csv", [",".join(cells[name] for name in moved)], ",".join(moved))
    rows = read_register(spark, [str(folder)])
    assert outcomes(rows) == {"accepted": 3}
    found = {row.id_mutation: (row.id_parcelle, row.nom_commune) for row in accepted(rows).collect()}
    assert found["m3"] == ("P3", "Y") and found["m2"][0] == "P2" and found["m1"] == ("P1", "X")


def test_gz_files_of_a_folder_are_spread(spark, tmp_path):
    write_file(tmp_path / "2024" / "full.csv.gz", [line()])
    plan = read_register(spark, [str(tmp_path / "2024")])._jdf.queryExecution().toString()
    assert "REPARTITION" in plan


def test_short_runs_of_lines_are_spread_together(spark):
    lines = spark.range(0, 20_000, numPartitions=1).select(
        F.col("id").cast("string").alias("value"), F.lit("f").alias("_file"), F.lit(0).alias("_block")
    )
    placed = spread(numbered(lines)).withColumn("part", F.spark_partition_id())
    runs = placed.groupBy(F.floor(F.col("_line") / 256).alias("run")).agg(
        F.count_distinct("part").alias("parts"), F.min("part").alias("part"), F.count(F.lit(1)).alias("lines")
    )
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        found = runs.collect()
    finally:
        spark.conf.unset(setting)
    assert len(found) == 79 and sum(r.lines for r in found) == 20_000
    assert {r.parts for r in found} == {1} and len({r.part for r in found}) > 1


@pytest.mark.parametrize(
    ("text", "outcome"),
    [
        ("12345.5", "storage:longitude"),
        ("1e30", "storage:longitude"),
        ("-1e40", "storage:longitude"),
        ("1e400", "storage:longitude"),
        ("1e3", "accepted"),
        ("inf", "accepted"),
        ("NaN", "accepted"),
        ("east", "accepted"),
    ],
)
def test_coordinates_that_cannot_be_stored(load, text, outcome):
    assert outcomes(load([line(longitude=text)])) == {outcome: 1}


def test_cleaning_is_planned_once_below_the_filter(load):
    plan = accepted(load([line()]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1 and plan.count("from_csv") == 1
    assert plan.index("isnull(reject_reason") < plan.index("Generate inline")


def test_parsed_once(load):
    plan = load([line()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv") == 1


def test_year_of_path(spark):
    frame = spark.createDataFrame([("file:/a/2023/full.csv.gz",), ("file:/a/b.csv",)], "p string")
    years = frame.select(year_of_path(F.col("p")).alias("y")).collect()
    assert [row.y for row in years] == [2023, None]


def test_random_quoted_cells_survive(load):
    rng = random.Random(17)
    cells = ["".join(rng.choices("ab\",;' é\t\\#", k=rng.randrange(1, 9))) for _ in range(400)]
    lines = []
    for number, cell in enumerate(cells):
        out = io.StringIO()
        quoting = rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
        writer = csv.writer(out, lineterminator="", quoting=quoting)
        writer.writerow(record(id_mutation=f"m{number}", adresse_nom_voie=cell))
        lines.append(out.getvalue())
    cleaned = load(lines)
    found = {row.id_mutation: row.adresse_nom_voie for row in accepted(cleaned).collect()}
    assert found == {f"m{number}": cell for number, cell in enumerate(cells)}


def test_random_cuts_are_rejected_like_a_csv_reader_does(load):
    rng = random.Random(19)
    whole = line(nom_commune="A, B", adresse_nom_voie="C, D")
    cut = [whole[: rng.randrange(1, len(whole))] for _ in range(150)]
    expected = sum(len(next(csv.reader([text.strip()]))) == len(COLUMNS) for text in cut)
    counts = outcomes(load(cut))
    assert counts.get("accepted", 0) == expected
    assert counts.get("fields", 0) == len(cut) - expected
