from __future__ import annotations

import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from landprice.functions.prices import band_floor, band_label, half_up, price_per_m2, truncated
from landprice.operators.filters import Filters
from landprice.plans.analysis import (
    analyse_by_parcel,
    analyse_prices,
    count_transactions,
    mean_price_by_type,
    mean_price_m2,
)
from landprice.plans.price_report import outlier_report, price_report
from landprice.plans.trends import daily_prices, mean_surface, surface_histogram
from tests.samples import sales

STATISTICS = ["prix_moyen", "prix_median", "prix_m2_moyen", "prix_m2_median"]


@pytest.fixture(scope="module")
def market(spark):
    """Flats with a few absurd prices, spread over two years, some with an outbuilding."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        value = float(np.round(rng.normal(200_000, 30_000), 2))
        rows.append(
            {
                "id_mutation": f"m{i:03d}",
                "id_parcelle": f"p{i % 7}",
                "date_mutation": date(2023 + i % 2, 1 + i % 12, 1 + i % 28),
                "valeur_fonciere": value * (20 if i % 50 == 0 else 1),
                "surface_reelle_bati": [float(20 + i % 60), None, 0.0][0 if i % 10 else i % 3],
                "adresse_numero": [" 12 ", " ", None][i % 3],
            }
        )
        if i % 4 == 0:
            rows.append(
                {"id_mutation": f"m{i:03d}", "type_local": "Dépendance", "surface_reelle_bati": None}
            )
    return sales(spark, rows)


def pandas_report(pdf, limit=None, garage=None):
    flats = pdf[
        (pdf.type_local == "Appartement")
        & (pdf.valeur_fonciere > 0)
        & (pdf.valeur_fonciere <= 1e7)
        & (pdf.surface_reelle_bati > 0)
    ]
    if garage is not None:
        with_garage = flats.id_mutation.isin(pdf[pdf.type_local == "Dépendance"].id_mutation)
        flats = flats[with_garage if garage == "avec" else ~with_garage]
    flats = flats.sort_values(
        ["date_mutation", "valeur_fonciere", "id_mutation"], ascending=[False, False, True]
    )[:limit].assign(m2=lambda f: f.valeur_fonciere / f.surface_reelle_bati)
    q1, q3 = flats.valeur_fonciere.quantile([0.25, 0.75])
    kept = flats[
        flats.valeur_fonciere.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    ]
    stats = [
        kept.valeur_fonciere.mean(),
        kept.valeur_fonciere.median(),
        kept.m2.mean(),
        kept.m2.median(),
    ]
    return flats, kept, [int(s) for s in stats]


@pytest.mark.parametrize("garage", [None, "avec", "sans"])
@pytest.mark.parametrize("limit", [50, None])
def test_report_matches_pandas(market, limit, garage):
    flats, kept, stats = pandas_report(market.toPandas(), limit, garage)
    row = price_report(market, limit=limit, garage=garage or "tous").summary.first()
    assert row.nombre_transactions == row.nombre_transactions_affiches == len(flats)
    assert [row[name] for name in STATISTICS] == stats
    assert len(kept) <= len(flats)


@pytest.mark.parametrize("limit", [199_999, 200_001, None])
def test_every_limit_has_one_contract(market, limit):
    flats, _, stats = pandas_report(market.toPandas())
    report = price_report(market, limit=limit)
    assert [report.summary.first()[name] for name in STATISTICS] == stats
    assert [r.prix for r in report.transactions.collect()] == [int(v) for v in flats.valeur_fonciere]


def test_undated_sales_count_alike_with_and_without_a_limit(market):
    undated = market.withColumn("date_mutation", F.when(F.col("id_mutation") > "m010", F.col("date_mutation")))
    counts = {
        price_report(undated, limit=limit).summary.first().nombre_transactions
        for limit in (10_000, None)
    }
    assert len(counts) == 1


def test_reports_run_nothing_before_they_are_used(spark, market):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("construction", "reports")
    try:
        for garage in ("tous", "avec"):
            for limit in (10, 10**9, None):
                price_report(market, limit=limit, garage=garage)
                outlier_report(market, limit=limit, garage=garage)
        assert list(tracker.getJobIdsForGroup("construction")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_transactions_are_untrimmed_and_ordered(market):
    report = price_report(market, limit=60)
    rows = report.transactions.collect()
    flats, kept, _ = pandas_report(market.toPandas(), 60)
    assert len(rows) == len(flats) > len(kept)
    assert [r.prix for r in rows] == [int(v) for v in flats.valeur_fonciere]
    assert all(re.fullmatch(r"\d\d/\d\d/\d{4}", r.date) for r in rows)
    for row in rows:
        if row.numero is None:
            assert row.adresse_complete is None
        else:
            assert (row.numero, row.adresse_complete) == ("12", "12 RUE HAUTE")


def test_empty_report_is_zeros(market):
    for limit in (10_000, None):
        row = price_report(market, Filters(years=[1999]), limit=limit).summary.first()
        assert list(row) == [0] * 6


def test_report_without_optional_columns(market):
    narrow = market.select(
        "id_mutation",
        "date_mutation",
        "id_parcelle",
        "valeur_fonciere",
        "type_local",
        "surface_reelle_bati",
    )
    row = price_report(narrow, limit=5).transactions.first()
    assert row.adresse is None and row.commune is None and row.prix > 0


@pytest.mark.parametrize("limit", [100, None])
def test_outlier_report_adds_up(market, limit):
    flats, kept, _ = pandas_report(market.toPandas(), limit)
    report = outlier_report(market, limit=limit)
    row = report.statistics.first()
    assert (row.total, row.kept, row.outliers) == (len(flats), len(kept), len(flats) - len(kept))
    assert row.kept + row.outliers == row.total
    assert (row.min_after, row.max_after) == (
        kept.valeur_fonciere.min(),
        kept.valeur_fonciere.max(),
    )
    assert row.q1 == pytest.approx(flats.valeur_fonciere.quantile(0.25))
    assert report.outliers.count() == row.outliers
    assert report.sample.count() == min(5, row.outliers)


def test_trend_counts_add_up(market):
    transactions = price_report(market).transactions
    total = transactions.count()
    bands = surface_histogram(transactions).collect()
    assert sum(r["count"] for r in bands) == total
    assert bands[0].range == "20-29m²" and bands == sorted(bands, key=lambda r: int(r.range[:2]))
    days = [r.date for r in daily_prices(transactions).collect()]
    assert days == sorted(days, key=lambda d: (d[6:], d[3:5], d[:2]))
    assert len(days) == transactions.select("date").distinct().count()
    areas = [r.surface for r in transactions.collect()]
    assert mean_surface(transactions).first()[0] == int(np.floor(np.mean(areas) + 0.5))
    assert mean_surface(transactions.limit(0)).first()[0] is None


def test_analysis_matches_pandas(market):
    pdf = market.toPandas()
    row = analyse_prices(market, type_local="Appartement").first()
    flats = pdf[pdf.type_local == "Appartement"]
    sized = flats[flats.surface_reelle_bati > 0]
    m2 = sized.valeur_fonciere / sized.surface_reelle_bati
    assert row.nombre_transactions == len(flats)
    assert [row[name] for name in STATISTICS] == pytest.approx(
        [flats.valeur_fonciere.mean(), flats.valeur_fonciere.median(), m2.mean(), m2.median()]
    )
    assert count_transactions(market).first()[0] == len(pdf)


def test_analysis_of_nothing(market):
    row = analyse_prices(market, ["nowhere"]).first()
    assert row.nombre_transactions == 0 and [row[name] for name in STATISTICS] == [None] * 4


def test_analysis_without_surfaces_has_no_price_per_m2(market):
    row = analyse_prices(market, type_local="Dépendance").first()
    assert row.prix_moyen is not None and row.prix_m2_moyen is None and row.prix_m2_median is None


def test_garage_choices_split_the_whole(market):
    whole, some, none = (
        analyse_prices(market, type_local="Appartement", garage=g).first().nombre_transactions
        for g in ("tous", "avec", "sans")
    )
    assert whole == some + none and some and none


def test_parcels_sum_to_global(market):
    rows = {
        r.parcelle: r
        for r in analyse_by_parcel(market, ["p1", "p2", "zz", "p1"], "Appartement").collect()
    }
    assert set(rows) == {"global", "p1", "p2", "zz"}
    counts = {k: r.nombre_transactions for k, r in rows.items()}
    assert counts["global"] == counts["p1"] + counts["p2"] and counts["zz"] == 0
    assert rows["zz"].prix_moyen is None
    alone = analyse_prices(market, ["p2"], "Appartement").first()
    assert [rows["p2"][name] for name in STATISTICS] == pytest.approx(
        [alone[name] for name in STATISTICS]
    )
    shown = analyse_by_parcel(market, ["p1", "zz"], hide_empty=True)
    assert [r.parcelle for r in shown.collect()] == ["global", "p1"]
    only = analyse_by_parcel(market, []).collect()
    assert [r.parcelle for r in only] == ["global"]
    assert only[0].nombre_transactions == market.count()


def test_mean_price_by_type_orders_nulls_first(spark):
    df = sales(
        spark,
        [
            {"valeur_fonciere": 10.0},
            {"valeur_fonciere": 30.0, "type_local": "Maison"},
            {"valeur_fonciere": None, "type_local": None},
        ],
    )
    rows = [tuple(r) for r in mean_price_by_type(df).collect()]
    assert rows == [(None, None), ("Maison", 30.0), ("Appartement", 10.0)]


def test_mean_price_m2_skips_zero_surfaces(spark):
    df = sales(
        spark,
        [
            {"valeur_fonciere": 100.0, "surface_reelle_bati": 50.0},
            {"surface_reelle_bati": 0.0},
            {"code_postal": "13001", "surface_reelle_bati": 1.0},
        ],
    )
    assert mean_price_m2(df, prefix="75").first()[0] == 2.0


def test_scalar_functions(spark):
    df = spark.createDataFrame([(2.5, 0.0), (-2.5, 10.0), (None, 5.0)], "a double, b double")
    rows = df.select(
        truncated(F.col("a")), half_up(F.col("a")), price_per_m2(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(r) for r in rows] == [(2, 3, None), (-2, -2, -0.25), (0, None, None)]
    label = spark.range(1).select(band_label(band_floor(F.lit(19.9)))).first()[0]
    assert label == "10-19m²"


def test_decimal_table_columns_give_double_statistics(spark, market):
    stored = market.withColumn("valeur_fonciere", F.col("valeur_fonciere").cast("decimal(12,2)"))
    stored = stored.withColumn(
        "surface_reelle_bati", F.col("surface_reelle_bati").cast("decimal(12,2)")
    )
    assert price_report(stored).summary.first() == price_report(market).summary.first()
    assert isinstance(analyse_prices(stored).first().prix_moyen, float)
