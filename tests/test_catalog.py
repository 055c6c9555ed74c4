"""Every registered query against its SQL on a second engine."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from landprice import catalog
from landprice.catalog import ORACLE_SQL, QUERIES

TABLES = ("lineitem", "supplier", "nation")


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    yield connection
    connection.close()


def test_contract_has_sql_for_every_query():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE_SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, oracle, name):
    result = QUERIES[name](spark, sf_dir)
    expected = oracle.execute(ORACLE_SQL[name])
    columns = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(columns)
    rows = result.collect()
    assert bag(result.columns, rows) == bag(columns, expected.fetchall())


def test_reject_lines_of_a_file_are_bounded(spark, sf_dir, monkeypatch):
    landed, read = [], catalog.read_register
    monkeypatch.setattr(catalog, "read_register", lambda s, paths: landed.extend(paths) or read(s, paths))
    few = QUERIES["ingest_rejects"](spark, sf_dir).collect()
    monkeypatch.setattr(catalog, "_LINES_PER_FILE", 200)
    many = QUERIES["ingest_rejects"](spark, sf_dir).collect()
    assert sorted(few) == sorted(many)
    lines = spark.read.text(landed[1]).groupBy("part").count()
    assert lines.count() > 8 and lines.agg({"count": "max"}).first()[0] < 400


def test_entry(spark):
    assert contract.entry(spark).count() == 1
