from __future__ import annotations

import random
from bisect import bisect_left
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landprice.operators import sketches
from landprice.operators import dedup
from landprice.operators.dedup import insert_if_absent, keep_first, new_rows
from landprice.operators.filters import (
    Filters,
    apply_analysis_filters,
    apply_report_filters,
    garage_filter,
    keep_listed,
    usable_number,
    usable_postal_codes,
    usable_price,
    usable_values,
    usable_years,
)
from landprice.operators.outliers import sample_rows
from landprice.operators.quantiles import distribution, grouped_distribution
from landprice.operators.topn import recent_rows
from landprice.session import materialised, scratch_path
from tests.samples import sales

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


# --- filters


def test_parameter_cleaning():
    assert usable_years([2023, " 2024 ", "x", "20 24", "", "-1"]) == [2023, 2024]
    assert usable_postal_codes(["75001", "7500", "75001", "7500a", "13001"]) == ["75001", "13001"]
    assert usable_values([" a ", "", "b'c", "a", "d"]) == ["a", "d"]
    assert [usable_number(v) for v in ("12.5", "wide", None, "nan")] == [
        Decimal("12.5"),
        None,
        None,
        None,
    ]
    assert [usable_price(v) for v in (5, "7", "x", None)] == [5, 7, 10_000_000, 10_000_000]
    beyond = 10**10
    assert [usable_number(v) for v in (1e40, "-1e40", float("inf"), "inf", "-inf")] == [
        beyond, -beyond, beyond, beyond, -beyond
    ]
    assert [usable_price(v) for v in (10**20, str(10**20), float("inf"), -(10**20))] == [
        beyond, beyond, beyond, -beyond
    ]


def ids(df):
    return sorted(row.id_mutation for row in df.collect())


def test_report_filters(spark):
    df = sales(
        spark,
        [
            {"id_mutation": "ok"},
            {"id_mutation": "free", "valeur_fonciere": 0.0},
            {"id_mutation": "dear", "valeur_fonciere": 10_000_000.0},
            {"id_mutation": "dearer", "valeur_fonciere": 10_000_000.5},
            {"id_mutation": "flatless", "surface_reelle_bati": 0.0},
            {"id_mutation": "unmeasured", "surface_reelle_bati": None},
            {"id_mutation": "unpriced", "valeur_fonciere": None},
            {"id_mutation": "house", "type_local": "Maison"},
            {"id_mutation": "untyped", "type_local": None},
            {"id_mutation": "eve", "date_mutation": date(2023, 12, 31)},
            {"id_mutation": "small", "surface_reelle_bati": 9.5},
            {"id_mutation": "paris", "code_postal": "75002", "id_parcelle": "px"},
        ],
    )

    def kept(**filters):
        return ids(apply_report_filters(df, Filters(**filters)))

    plain = ["dear", "eve", "ok", "paris", "small"]
    assert kept() == plain
    assert kept(type_local="") == plain
    assert kept(type_local="Maison") == ["house"]
    assert kept(max_price=99_999) == []
    assert kept(years=["2023"]) == ["eve"]
    assert kept(years=[2023, 2024]) == plain
    assert kept(years=["never"]) == plain
    assert kept(years=[0]) == []
    assert kept(min_surface="9.5", max_surface=9.5) == ["small"]
    assert kept(min_surface="x", max_surface="y") == plain
    assert kept(parcelles=[" px "]) == ["paris"]
    assert kept(parcelles=["'", ""]) == plain
    assert kept(codes_postaux=["75002", "75003"]) == ["paris"]


def test_analysis_filters_are_all_optional(spark):
    df = sales(
        spark,
        [
            {"id_mutation": "a", "valeur_fonciere": None, "type_local": None},
            {"id_mutation": "b", "surface_reelle_bati": None},
            {"id_mutation": "c", "surface_reelle_bati": 20.0, "id_parcelle": "px"},
        ],
    )
    assert ids(apply_analysis_filters(df)) == ["a", "b", "c"]
    assert ids(apply_analysis_filters(df, min_m2=0)) == ["a", "c"]
    assert ids(apply_analysis_filters(df, max_m2=20, type_local="Appartement")) == ["c"]
    assert ids(apply_analysis_filters(df, ["px"])) == ["c"]


def test_long_lists_become_a_set_lookup(spark):
    df = sales(spark, [{"id_mutation": "a", "id_parcelle": "p7"}, {"id_mutation": "b"}])
    many = keep_listed(df, "id_parcelle", [f"p{i}" for i in range(5, 2000)])
    assert ids(many) == ["a"]
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_garage_comes_from_unfiltered_rows(spark):
    df = sales(
        spark,
        [
            {"id_mutation": "with"},
            {"id_mutation": "with", "type_local": "Dépendance", "surface_reelle_bati": None},
            {"id_mutation": "with", "type_local": "Dépendance", "surface_reelle_bati": None},
            {"id_mutation": "without"},
        ],
    )
    flats = apply_report_filters(df, Filters())
    assert ids(garage_filter(flats, df, "avec")) == ["with"]
    assert ids(garage_filter(flats, df, "sans")) == ["without"]
    assert ids(garage_filter(flats, df)) == ["with", "without"]
    with pytest.raises(ValueError):
        garage_filter(flats, df, "peut-être")


# --- quantiles


def _expected(values):
    series = pd.Series([v for v in values if v is not None], dtype=float)
    return len(series), series.mean(), list(series.quantile(PROBABILITIES))


@pytest.fixture(params=["cells", "small groups", "by size"])
def exact_distribution(request):
    if request.param == "cells":
        return distribution
    bound = {} if request.param == "small groups" else {"group_rows": 350}
    return lambda *arguments: grouped_distribution(*arguments, **bound)


def test_distribution_matches_pandas(spark, exact_distribution):
    rng = np.random.default_rng(3)
    groups = {
        "hot": list(np.round(rng.lognormal(12, 0.7, 6000), 2)),
        "tied": [250000.0] * 500 + [1.0, 2.0],
        "signed": list(rng.normal(0, 1e4, 300)),
        "close": list(3000 + rng.random(400) * 1e-9),
        "one": [7.25],
        "none": [None, None],
        None: [1.0, None, 2.0],
    }
    rows = [(key, value, i) for key, values in groups.items() for i, value in enumerate(values)]
    df = spark.createDataFrame(
        [(k, None if v is None else float(v), i) for k, v, i in rows], "k string, v double, i int"
    )
    measures = {"a": F.col("v"), "b": F.when(F.col("i") > 0, F.col("v") * 2)}
    found = {
        row.k: row for row in exact_distribution(df, measures, PROBABILITIES, ["k"]).collect()
    }
    assert set(found) == set(groups)
    for key, values in groups.items():
        assert found[key].rows == len(values)
        for name, kept in (("a", values), ("b", [v and v * 2 for v in values[1:]])):
            n, mean, quantiles = _expected(kept)
            got = found[key][name]
            assert got.n == n
            if n:
                assert got.mean == pytest.approx(mean, rel=1e-12, abs=1e-9)
                assert got.q == pytest.approx(quantiles, rel=1e-14, abs=1e-12)
                present = [v for v in kept if v is not None]
                assert (got.low, got.high) == (min(present), max(present))
            else:
                assert got.mean is None and got.q == [None] * len(PROBABILITIES)


def test_distribution_of_nothing_is_one_row(spark):
    row = distribution(spark.range(0).toDF("x"), {"a": F.col("x")}, [0.5]).collect()
    assert len(row) == 1 and row[0].rows == 0 and row[0].a is None


def test_distribution_never_uses_the_one_task_percentile(spark):
    df = spark.range(10).toDF("x")
    plan = distribution(df, {"a": F.col("x")}, [0.5], ["x"])._jdf.queryExecution()
    assert "percentile" not in plan.optimizedPlan().toString().lower()


def test_grouped_distribution_of_nothing_is_empty(spark):
    empty = spark.range(0).select("id", F.lit(1.0).alias("v"))
    assert grouped_distribution(empty, {"a": F.col("v")}, [0.5], ["id"]).collect() == []


# --- top n


def _recent_sample(spark):
    rng = np.random.default_rng(5)
    return sales(
        spark,
        [
            {
                "date_mutation": date(2024, 1, 1) + timedelta(days=int(rng.integers(0, 4))),
                "valeur_fonciere": float(rng.choice([1e5, 1.001e5, 1.5e5, 0.5])),
                "id_mutation": f"m{i % 50:03d}",
            }
            for i in range(400)
        ],
    )


@pytest.mark.parametrize("limit", [1, 57, 399, 400, 199_999, 200_001, 10**12, None])
def test_recent_rows_equal_a_plain_top_n(spark, limit):
    df = _recent_sample(spark)
    undated = df.withColumn("date_mutation", F.when(F.col("id_mutation") > "m005", F.col("date_mutation")))
    for rows in (df, undated):
        pdf = rows.toPandas().sort_values(
            ["date_mutation", "valeur_fonciere", "id_mutation", "id_parcelle"],
            ascending=[False, False, True, True],
        )
        found = recent_rows(rows, limit).toPandas()
        assert list(found.id_parcelle) == list(pdf.id_parcelle[:limit])


# --- keys


def test_keep_first_ignores_null_keys(spark):
    df = spark.createDataFrame(
        [("a", 1, 3), ("a", 1, 1), ("a", None, 2), ("a", None, 2), (None, None, 0)],
        "k string, l int, pos int",
    )
    kept = keep_first(df, [F.col("pos")], ("k", "l")).collect()
    assert sorted((r.k or "", r.l or 0, r.pos) for r in kept) == [
        ("", 0, 0),
        ("a", 0, 2),
        ("a", 0, 2),
        ("a", 1, 1),
    ]


def test_insert_if_absent_and_new_rows(spark):
    schema = "k string, l int, pos int"
    batch = spark.createDataFrame(
        [("a", 1, 1), ("a", 1, 2), ("b", 1, 4), ("b", 1, 3), ("b", None, 5)], schema
    )
    table = spark.createDataFrame([("a", 1, 0), ("b", None, 0), ("0", 9, 0)], schema)
    absent = insert_if_absent(batch, table, ("k", "l"))
    assert sorted(r.pos for r in absent.collect()) == [3, 4, 5]
    fresh = new_rows(batch, table, [F.col("pos")], ("k", "l"))
    assert sorted(r.pos for r in fresh.collect()) == [3, 5]
    into_empty = new_rows(batch, table.limit(0), [F.col("pos")], ("k", "l"))
    assert sorted(r.pos for r in into_empty.collect()) == [1, 3, 5]


@pytest.mark.parametrize("broadcast", [dedup.BROADCAST_KEYS, 0])
def test_rows_without_a_conflict_are_not_shuffled(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dedup, "BROADCAST_KEYS", broadcast)
    numbers = spark.range(3000).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.least(F.col("id"), F.lit(2000)))).alias("k"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("int")).alias("l"),
        F.col("id").alias("pos"),
    )
    batch = numbers.unionByName(numbers.filter("pos % 9 = 0").withColumn("pos", F.col("pos") - 5000))
    table = numbers.filter("pos % 11 = 0 OR pos > 2990").select("k", "l")
    key = ("k", "l")
    conflicts = dedup.conflicting_keys(batch, table, key).cache()
    found = dedup.without_conflicts(batch, conflicts, ["pos"], key)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" not in plan) or not broadcast
    expected = new_rows(batch, table, [F.col("pos")], key)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert conflicts.filter("held").count() > 0 and conflicts.filter("NOT held").count() > 0


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 1).alias("k"), F.col("id").alias("pos"))
    kept = keep_first(df, [F.col("pos")], ("k",))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert [r.pos for r in kept.collect()] == [0]


# --- samples and scratch data


def test_sample_is_reproducible(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    first = [r.k for r in sample_rows(df, ["k"], 5, 1).collect()]
    assert first == [r.k for r in sample_rows(df.repartition(7), ["k"], 5, 1).collect()]
    assert first != [r.k for r in sample_rows(df, ["k"], 5, 2).collect()]
    assert sample_rows(df.limit(3), ["k"]).count() == 3


def test_scratch_lies_in_the_checkpoint_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert sorted(r.id for r in materialised(spark.range(3), "x").collect()) == [0, 1, 2]


# --- sketches


def test_merged_sketches_answer_like_one_sketch(spark):
    rng = random.Random(5)
    rows = [(f"g{i % 3}", i % 40, rng.lognormvariate(10, 2)) for i in range(30_000)]
    rows += [("none", 1, None), ("none", 2, float("nan")), ("one", 1, 5.0), (None, 1, 7.0), (None, 2, 9.0)]
    df = spark.createDataFrame(rows, "g string, part int, v double")
    probabilities = (0.0, 0.1, 0.5, 0.9, 1.0)
    cells = sketches.sketched(df, {"v": F.col("v")}, ["g", "part"])
    found = {
        r.g: r for r in sketches.approximate_distribution(
            sketches.merged(cells, ["v"], ["g"]), ["v"], probabilities, ["g"]).collect()
    }
    assert found["none"].rows == 2 and tuple(found["none"].v) == (0, None, None, None, None)
    assert tuple(found["one"].v) == (1, 5.0, 5.0, 5.0, [5.0] * 5)
    assert found[None].v.q[0] == 7.0 and found[None].v.q[-1] == 9.0 and found[None].rows == 2
    for g in ("g0", "g1", "g2"):
        values = sorted(v for x, _, v in rows if x == g)
        for p, q in zip(probabilities, found[g].v.q):
            assert abs(bisect_left(values, q) - p * len(values)) <= sketches.RANK_ERROR * len(values) + 1
        assert (found[g].v.low, found[g].v.high, found[g].v.n) == (values[0], values[-1], len(values))
    # A further load is one more cell; without sales there is one empty row.
    more = cells.unionByName(sketches.sketched(df.filter("g = 'one'"), {"v": F.col("v")}, ["g", "part"]))
    assert sketches.merged(more, ["v"], ["g"]).filter("g = 'one'").first().v.n == 2
    empty = sketches.merged(cells.limit(0), ["v"])
    assert [(r.rows, r.v.n, r.v.q) for r in sketches.approximate_distribution(empty, ["v"], probabilities).collect()] == [(0, 0, None)]


def test_sketches_shuffle_no_value(spark):
    df = spark.range(100_000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("v"))
    plan = sketches.sketched(df, {"v": F.col("v")}, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("partial_kll") > plan.index("Exchange")
