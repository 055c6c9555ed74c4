"""Side tables of the register table, and the reports from them."""

from __future__ import annotations

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from landprice.operators import price_cells
from landprice.operators.filters import Filters, base_validity
from landprice.operators.price_cells import in_cells, quantiles_at, spans
from landprice.plans import kept_report
from landprice.plans.kept_report import garage_report, whole_population_summary
from landprice.plans.price_report import price_report
from landprice.schema import STORED_SCHEMA
from landprice.sources import sides
from landprice.sources import table as tables
from landprice.sources.sides import OUTBUILDINGS, PRICE_CELLS, refresh, side_rows, snapshot, stale
from tests.samples import sales


def stored(spark, rows, year):
    """Rows as a load writes them; columns that are not given are null."""
    made = sales(spark, rows).withColumn("import_year", F.lit(year))
    return made.select(
        *[
            (F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STORED_SCHEMA
        ]
    )


def random_rows(seed, count, year):
    draw = np.random.default_rng(seed)
    return [
        {
            "id_mutation": f"{year}-{seed}-{i // 3}",
            "date_mutation": datetime.date(year, 1 + i % 12, 1) if i % 50 else None,
            "code_postal": ["75001", "01230", None][i % 3],
            "type_local": ["Appartement", "Maison", "Dépendance", None][int(draw.integers(4))],
            "valeur_fonciere": round(float(np.exp(draw.normal(11, 1.5))), 2) if i % 9 else 150000.0,
            "surface_reelle_bati": float(draw.integers(0, 90)),
        }
        for i in range(count)
    ]


@pytest.fixture
def loaded(spark, table):
    tables.create_table(spark, table)
    for year, seed in ((2022, 1), (2023, 2), (2023, 3)):
        tables.append_rows(stored(spark, random_rows(seed, 400, year), year), table)
    return table


def same_as_sales(spark, name, filters=Filters()):
    found = whole_population_summary(spark, name, filters).collect()
    assert found == price_report(spark.table(name), filters).summary.collect()
    return found[0].nombre_transactions


def test_stale_years_are_found_and_answers_never_lag(spark, loaded):
    assert stale(spark, loaded, PRICE_CELLS) == [2022, 2023]
    assert same_as_sales(spark, loaded) > 100
    assert refresh(spark, loaded, PRICE_CELLS) == [2022, 2023]
    assert stale(spark, loaded, PRICE_CELLS) == [] == refresh(spark, loaded, PRICE_CELLS)
    before = same_as_sales(spark, loaded)
    # One more load, a rearranged year, a cleared one: each is noticed by its folder.
    tables.append_rows(stored(spark, random_rows(4, 300, 2024), 2024), loaded)
    assert stale(spark, loaded, PRICE_CELLS) == [2024]
    assert same_as_sales(spark, loaded) > before
    refresh(spark, loaded, PRICE_CELLS)
    tables.rearrange_year(spark, loaded, 2023)
    assert stale(spark, loaded, PRICE_CELLS) == [2023]
    same_as_sales(spark, loaded)
    tables.clear_year(spark, loaded, 2022)
    same_as_sales(spark, loaded)
    assert refresh(spark, loaded, PRICE_CELLS) == [2023]
    now = snapshot(spark, loaded)
    assert set(sides._kept(spark, now.base, PRICE_CELLS)) == {source for _, _, source in now.parts}
    same_as_sales(spark, loaded)


def test_a_build_without_its_marks_is_not_read(spark, loaded, monkeypatch):
    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(sides, "make_folder", dies)
        with pytest.raises(RuntimeError):
            refresh(spark, loaded, PRICE_CELLS)
    assert stale(spark, loaded, PRICE_CELLS) == [2022, 2023]
    refresh(spark, loaded, PRICE_CELLS)
    same_as_sales(spark, loaded)


@pytest.mark.parametrize(
    "filters",
    [
        Filters(years=[2023]),
        Filters(type_local="Maison", years=["2022", "2023"], codes_postaux=["01230"]),
        Filters(years=[0, 9999]),
        Filters(codes_postaux=["nowhere"]),
        Filters(min_surface=40),  # not told apart by the cells
        Filters(max_price=90_000),
    ],
)
def test_filtered_reports_equal_those_over_sales(spark, loaded, filters):
    refresh(spark, loaded, PRICE_CELLS)
    same_as_sales(spark, loaded, filters)


def test_empty_table_and_equal_prices(spark, table):
    tables.create_table(spark, table)
    assert stale(spark, table, PRICE_CELLS) == []
    assert same_as_sales(spark, table) == 0
    tables.append_rows(stored(spark, [{"valeur_fonciere": 5.0}] * 7, 2024), table)
    assert same_as_sales(spark, table) == 7
    tables.append_rows(stored(spark, [{"valeur_fonciere": 9_999_999.0}], 2025), table)
    assert same_as_sales(spark, table) == 8


def test_a_snapshot_does_not_see_later_loads(spark, loaded):
    refresh(spark, loaded, PRICE_CELLS)
    now = snapshot(spark, loaded)
    count = spark.table(loaded).count()
    tables.append_rows(stored(spark, random_rows(5, 100, 2025), 2025), loaded)
    assert now.rows(spark).count() == count
    kept = side_rows(spark, now, PRICE_CELLS).agg(F.sum("rows")).first()[0]
    assert kept == now.rows(spark).filter(base_validity()).count()


def test_narrowing_reaches_single_values(spark, monkeypatch):
    monkeypatch.setattr(price_cells, "GATHERED", 4)
    draw = np.random.default_rng(7)
    values = np.concatenate([np.exp(draw.normal(12, 0.01, 3000)), np.full(500, 160000.0)])
    rows = spark.createDataFrame([(float(v), float(v) / 50) for v in values], "valeur_fonciere double, prix_m2 double")
    reads = []

    def read(wanted):
        near = F.lit(False)
        for span in wanted:
            near = near | F.col("valeur_fonciere").between(span.low, span.high)
        found = rows.filter(near).select(F.col("valeur_fonciere").alias("v"))
        reads.append(found.count())
        return found

    asked = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = quantiles_at(spans(in_cells(rows), "price"), asked, read)
    assert found == pytest.approx(np.quantile(values, asked), rel=1e-12)
    assert len(reads) > 1 and reads == sorted(reads, reverse=True)


@pytest.mark.parametrize("garage", ["avec", "sans"])
def test_garage_report_reads_the_sales_once(spark, loaded, garage):
    refresh(spark, loaded, OUTBUILDINGS)
    report = garage_report(spark, loaded, garage)
    plain = price_report(spark.table(loaded), garage=garage)
    assert report.summary.collect() == plain.summary.collect()
    assert report.summary.first().nombre_transactions > 50
    places = [f for f in report.sales.inputFiles() if "/sides/" not in f]
    assert len(places) == len(set(places))
    plan = report.sales._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation spark_catalog") == 1


def test_quantiles_read_few_sales(spark, table, monkeypatch):
    """Price ranges reach the scan as decimals, so whole row groups are left out by them."""
    tables.create_table(spark, table)
    tables.append_rows(stored(spark, random_rows(9, 500, 2024), 2024), table)
    refresh(spark, table, PRICE_CELLS)
    asked = []
    plain = price_cells.trimmed_figures

    def watched(cells, read):
        def noted(ranges):
            rows = read(ranges)
            asked.append((list(ranges), rows))
            return rows

        return plain(cells, noted)

    monkeypatch.setattr(kept_report, "trimmed_figures", watched)
    same_as_sales(spark, table)
    quartiles, rows = asked[0]
    total = price_report(spark.table(table)).sales.count()
    assert len(quartiles) == 2 and rows.count() < total / 4
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = rows._jdf.queryExecution().explainString(formatted)
    scanned = re.findall(r"PushedFilters: \[(.*?)\]\n", plan)
    assert len(scanned) == 1 and "GreaterThanOrEqual(valeur_fonciere" in scanned[0]


def test_years_derived_one_at_a_time_give_the_same_report(spark, loaded, monkeypatch):
    monkeypatch.setattr(sides, "BYTES_AT_ONCE", 1)
    read, plain = [], sides._derived

    def derived(spark, base, side, parts):
        read.append([year for year, _ in parts])
        return plain(spark, base, side, parts)

    with monkeypatch.context() as patched:
        patched.setattr(sides, "_derived", derived)
        assert refresh(spark, loaded, PRICE_CELLS) == [2022, 2023]
    assert read == [[2022], [2023], [2023]]
    assert stale(spark, loaded, PRICE_CELLS) == []
    same_as_sales(spark, loaded)
    same_as_sales(spark, loaded, Filters(type_local="Maison", years=[2023]))


def test_kept_cells_leave_out_what_other_columns_tell(spark, loaded):
    refresh(spark, loaded, PRICE_CELLS)
    now = snapshot(spark, loaded)
    (kept,) = {folder.rsplit("/", 1)[0] for folder in sides._kept(spark, now.base, PRICE_CELLS).values()}
    stored_cells = spark.read.parquet(kept)
    single = stored_cells.filter("rows = 1")
    assert single.count() > 100
    for end in ("price_low", "price_high", "m2_low", "m2_high"):
        assert single.filter(F.col(end).isNotNull()).isEmpty()
    names = [field.name for field in PRICE_CELLS.schema]
    whole = side_rows(spark, now, PRICE_CELLS).select(*names)
    again = in_cells(
        now.rows(spark).filter(base_validity()).select(
            "import_year", "import_load", F.year("date_mutation").alias("sale_year"), "type_local", "code_postal",
            F.col("valeur_fonciere").cast("double").alias("valeur_fonciere"),
            (F.col("valeur_fonciere").cast("double") / F.col("surface_reelle_bati").cast("double")).alias("prix_m2"),
        ),
        ("import_year", "import_load", "sale_year", "type_local", "code_postal"),
    ).select(*names)
    exact = [name for name in names if not name.endswith("_total")]
    assert whole.count() == again.count()
    assert whole.select(*exact).exceptAll(again.select(*exact)).isEmpty()
