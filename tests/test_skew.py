"""One key, place or value holding a third of all rows: plans split it, results stay whole."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from landprice.operators.filters import garage_filter
from landprice.operators.quantiles import distribution
from landprice.sources.table import arranged

ROWS = 60_000


@contextmanager
def settings(spark, **values):
    names = {key.replace("__", "."): value for key, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def skewed(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, ROWS, 1, 8).select(
        F.when(hot, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id_mutation"),
        F.when(F.col("id") % 6 == 0, F.lit("Dépendance")).otherwise(F.lit("Maison"))
        .alias("type_local"),
        F.when(hot, F.lit(100.0)).otherwise(F.col("id").cast("double")).alias("v"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )



@pytest.mark.parametrize("option", ["avec", "sans"])
def test_hot_sale_is_split_in_the_garage_join(spark, skewed, option):
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="8",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    ):
        joined = garage_filter(skewed, skewed, option).select("id_mutation", "payload")
        counted = joined.agg(F.count("payload").alias("rows"))
        rows = counted.collect()[0].rows
        plan = counted._jdf.queryExecution().executedPlan().toString()
    assert rows == (ROWS // 3 if option == "avec" else ROWS - ROWS // 3)
    assert "isSkew=true" in plan or "skewed" in plan
    assert "HashAggregate" in plan


def test_hot_value_is_counted_before_the_shuffle(spark, skewed):
    expected = skewed.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5)))).first()[0]
    row = distribution(skewed, {"v": F.col("v")}, [0.25, 0.5]).first()
    assert row.v.q == pytest.approx(expected) and row.rows == ROWS
    grouped = distribution(skewed, {"v": F.col("v")}, [0.5], ["type_local"])
    assert {r.type_local: r.v.n for r in grouped.collect()} == {
        "Dépendance": ROWS // 6,
        "Maison": ROWS - ROWS // 6,
    }


def test_hot_place_is_cut_into_several_ranges(spark, skewed):
    rows = skewed.select(
        "*",
        F.lit("75001").alias("code_postal"),
        F.lit(None).cast("date").alias("date_mutation"),
        F.lit("p").alias("id_parcelle"),
        F.lit("f").alias("_file"),
        F.lit(0).alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ).filter("id_mutation = 'hot' and type_local = 'Maison'")
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        sizes = (
            arranged(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < sum(r["count"] for r in sizes) * 0.6
