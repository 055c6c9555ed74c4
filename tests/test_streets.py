"""Substring search on street names through kept postings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from landprice.operators.filters import street_search
from landprice.plans import street_lookup
from landprice.plans.street_lookup import sales_in_streets
from landprice.schema import TABLE_SCHEMA
from landprice.sources import loads
from landprice.sources import table as tables
from landprice.sources.sides import STREETS, refresh, snapshot, stale
from tests.test_sides import stored

NAMES = (
    "RUE DE L'ÉGLISE", "rue de l'eglise", "RUE HAUTE", "RUE HAUTE", "Straße 1", "AV 100% _X", "A", "AB",
    "", None, "RUE 漢字", "HAUTE RUE", "AAAAAA", "rue haute", "  RUE  HAUTE",
)
CODES = ("75001", "01230", None, "69001")


def same_rows(spark, name, text):
    found = sales_in_streets(spark, name, text)
    expected = street_search(spark.table(name), text).select(*found.columns)
    got = sorted(map(str, found.collect()))
    assert got == sorted(map(str, expected.collect())), text
    return len(got)


@pytest.fixture
def streets(spark, table):
    tables.create_table(spark, table)
    for year in (2022, 2023):
        rows = [
            {"id_mutation": f"{year}-{i}", "adresse_nom_voie": NAMES[i % len(NAMES)], "code_postal": CODES[i % 4]}
            for i in range(120)
        ]
        tables.append_rows(stored(spark, rows, year), table)
    return table


TEXTS = (
    "haute", "HAUTE", "rue h", "église", "ÉGLISE", "strasse", "straße", "SS", "%", "_", "100% _x", "a", "ab",
    "aaa", "aaaa", "aaaaaaa", "漢", "漢字", " ", "  ", "nowhere", "rue de l'eglise and far beyond its end", "",
)


def test_searches_equal_a_scan(spark, streets):
    before = {text: same_rows(spark, streets, text) for text in TEXTS}  # nothing is kept yet
    assert refresh(spark, streets, STREETS) == [2022, 2023]
    assert {text: same_rows(spark, streets, text) for text in TEXTS} == before
    assert before["haute"] > before["rue h"] > 0 == before["nowhere"] == before["aaaaaaa"]
    assert before["a"] > 0 < before["漢"]


def test_postings_never_lag(spark, streets):
    refresh(spark, streets, STREETS)
    more = [{"id_mutation": "new", "adresse_nom_voie": "QUAI NEUF", "code_postal": "33000"}]
    tables.append_rows(stored(spark, more, 2024), streets)
    assert stale(spark, streets, STREETS) == [2024]
    assert same_rows(spark, streets, "neuf") == 1
    refresh(spark, streets, STREETS)
    assert same_rows(spark, streets, "neuf") == 1
    tables.clear_year(spark, streets, 2024)
    assert same_rows(spark, streets, "neuf") == 0
    tables.rearrange_year(spark, streets, 2023)
    assert same_rows(spark, streets, "haute") > 0


def test_a_text_of_many_streets_is_searched_in_the_sales(spark, streets, monkeypatch):
    monkeypatch.setattr(street_lookup, "NARROWED", 2)
    refresh(spark, streets, STREETS)
    assert same_rows(spark, streets, "rue") > same_rows(spark, streets, "église") > 0


def test_an_empty_table_has_no_streets(spark, table):
    tables.create_table(spark, table)
    for text in ("rue", "r", ""):
        assert same_rows(spark, table, text) == 0


def scanned(df):
    """Rows that scans of the sales read, after row groups and pages were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_few_sales_are_read(spark, table, monkeypatch):
    monkeypatch.setattr(loads, "ROW_GROUP_BYTES", 4_000)
    tables.create_table(spark, table)
    rows = spark.range(40_000).select(
        F.col("id").cast("string").alias("id_mutation"),
        F.expr("lpad(pmod(xxhash64(id, 3), 400), 5, '0')").alias("code_postal"),
        F.expr("element_at(array('Appartement', 'Maison', 'Dépendance'), int(1 + pmod(xxhash64(id, 4), 3)))").alias("type_local"),
        F.lit(2024).cast("short").alias("import_year"),
    )
    place = F.expr("concat('RUE ', md5(concat(code_postal, pmod(xxhash64(id_mutation, 5), 5))))")
    rows = rows.withColumn("adresse_nom_voie", place)
    for field in TABLE_SCHEMA:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    tables.append_rows(rows, table)
    refresh(spark, table, STREETS)
    text = rows.select("adresse_nom_voie").first()[0][6:14].lower()
    columns = ("id_mutation", "adresse_nom_voie")
    through = sales_in_streets(spark, table, text).select(*columns)
    plain = street_search(spark.table(table), text).select(*columns)
    assert scanned(plain) == 40_000
    assert scanned(through) < 8_000
    assert sorted(through.collect()) == sorted(plain.collect()) != []
    # Of the postings only the row groups with the text's rarest gram.
    found = street_lookup.matching_streets(spark, snapshot(spark, table), text)
    assert found.count() == 1
