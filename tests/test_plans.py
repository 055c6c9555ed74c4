"""Physical plans: what reaches the scan, what is shuffled, what is broadcast."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from landprice.operators.dedup import new_rows
from landprice.operators.quantiles import distribution, grouped_distribution
from landprice.operators.filters import Filters, apply_report_filters, garage_filter
from landprice.plans.analysis import mean_price_m2
from landprice.plans.price_report import price_report
from landprice.plans.trends import daily_prices
from landprice.schema import DATA_SCHEMA
from landprice.sources.star_view import sales_view
from landprice.sources.table import append_rows, create_table


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    """The sales view written as a register table."""
    name = "stored_sales"
    create_table(spark, name)
    view = sales_view(spark, sf_dir)
    rows = view.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in view.columns else F.lit(None).cast(f.dataType))
            .alias(f.name)
            for f in DATA_SCHEMA
        ],
        F.current_timestamp().alias("import_date"),
        "import_year",
    )
    append_rows(rows, name)
    yield spark.table(name)
    spark.sql(f"DROP TABLE {name}")


def pushed(text: str) -> str:
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\]\n", text))


def test_every_report_filter_reaches_the_scan(stored):
    filters = Filters(
        years=[1996, 1998],
        parcelles=["P000001"],
        codes_postaux=["00001"],
        min_surface="10.5",
        max_surface=40,
    )
    found = pushed(plan(apply_report_filters(stored, filters)))
    for part in (
        "GreaterThan(valeur_fonciere,0.00)",
        "LessThanOrEqual(valeur_fonciere,10000000.00)",
        "GreaterThanOrEqual(surface_reelle_bati,10.50)",
        "LessThanOrEqual(surface_reelle_bati,40.00)",
        "EqualTo(type_local,Appartement)",
        "id_parcelle",
        "code_postal",
        "GreaterThanOrEqual(date_mutation,1996-01-01)",
        "LessThan(date_mutation,1999-01-01)",
    ):
        assert part in found, (part, found)


def test_summary_reads_narrow_columns_and_has_no_join(stored):
    text = plan(price_report(stored, limit=10_000).summary)
    read = re.findall(r"ReadSchema: struct<(.*?)>\n", text)
    wide = {"nature_mutation", "adresse_nom_voie", "longitude", "nom_commune"}
    assert read and not any(wide & {c.split(":")[0] for c in r.split(",")} for r in read)
    assert "Join" not in text and "CartesianProduct" not in text


def test_top_n_cutoff_date_reaches_the_scan(stored):
    text = plan(price_report(stored, limit=10_000).transactions)
    assert "TakeOrderedAndProject" in text
    assert re.search(r"GreaterThanOrEqual\(date_mutation,ScalarSubquery", pushed(text))


def test_postal_prefix_reaches_the_scan(stored):
    assert "StringStartsWith(code_postal,75)" in pushed(plan(mean_price_m2(stored, prefix="75")))


def test_year_partition_is_pruned(stored):
    text = plan(stored.filter("import_year = 1996").select("id_mutation"))
    assert re.search(r"PartitionFilters: .*import_year", text)


def test_garage_side_is_distinct_and_narrow(stored):
    text = plan(garage_filter(apply_report_filters(stored, Filters()), stored, "avec"))
    assert "LeftSemi" in text
    assert re.search(r"ReadSchema: struct<id_mutation:string,type_local:string>", text)


def test_daily_means_combine_before_the_shuffle(stored):
    text = plan(daily_prices(price_report(stored, limit=10_000).transactions))
    assert "partial_sum" in text


def test_insert_reads_only_keys_and_skips_far_ids(stored):
    text = plan(new_rows(stored, stored, [F.col("date_mutation")]))
    narrow = (
        "ReadSchema: struct<id_mutation:string,numero_disposition:string,"
        "id_parcelle:string,lot1_numero:string>"
    )
    assert narrow in text
    found = pushed(text)
    assert re.search(r"GreaterThanOrEqual\(id_mutation,ScalarSubquery", found)
    assert re.search(r"LessThanOrEqual\(id_mutation,ScalarSubquery", found)
    # The window and the anti join share one shuffle of the batch.
    assert text.count("LeftAnti") >= 1


def ran(df) -> str:
    """The final plan after the run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [[], ["code_postal"]])
def test_quantiles_shuffle_no_values(stored, by):
    price = F.col("valeur_fonciere")
    text = ran(distribution(stored, {"price": price}, [0.25, 0.5], by))
    # The values meet the picked cells in the scan's own stage; later joins see counts only.
    assert re.search(r"BroadcastHashJoin .*LeftSemi", text)
    assert not re.search(r"SortMergeJoin .*LeftSemi", text)
    scan = text[: text.rindex("FileScan parquet")]
    assert "partial_count" in scan[scan.rindex("Exchange hashpartitioning") :]


def test_quantiles_of_many_groups_join_no_values(spark):
    sales = spark.range(300_000).select(
        (F.col("id") % 100_000).alias("place"), F.col("id").cast("double").alias("price")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = grouped_distribution(sales, {"price": F.col("price")}, [0.5], ["place"])
        text = ran(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count() == 100_000
    assert found.filter(F.col("price.q")[0] != F.col("place") + 100_000).isEmpty()
    final = text[: text.index("Initial Plan")]
    assert "Join" not in final and final.count("Exchange") == 1


def test_long_lists_shuffle_nothing(stored):
    filters = Filters(parcelles=[f"P{i:06d}" for i in range(1500)])
    text = plan(apply_report_filters(stored, filters))
    assert "Exchange" not in text and "Join" not in text
    assert "GreaterThanOrEqual(id_parcelle,P000000)" in pushed(text)


def test_no_python_in_any_plan(stored):
    for df in (price_report(stored, limit=10_000).summary, price_report(stored, limit=10_000).transactions):
        text = plan(df)
        assert "Python" not in text and "Pandas" not in text
