"""Chart series over the transactions of a price report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landprice.functions.prices import band_floor, band_label, half_up


def _rounded_mean(column: str) -> Column:
    return half_up(F.sum(column).cast("double") / F.count(F.lit(1)))


def daily_prices(transactions: DataFrame) -> DataFrame:
    """Rounded daily means of the truncated row values, in calendar order."""
    return (
        transactions.groupBy("date")
        .agg(_rounded_mean("prix").alias("prix"), _rounded_mean("prix_m2").alias("prix_m2"))
        .orderBy(F.to_date("date", "dd/MM/yyyy"))
    )


def surface_histogram(transactions: DataFrame) -> DataFrame:
    """Number of sales per ten-square-metre band, by lower edge."""
    return (
        transactions.groupBy(band_floor(F.col("surface")).alias("lower"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("lower")
        .select(band_label(F.col("lower")).alias("range"), "count")
    )


def mean_surface(transactions: DataFrame) -> DataFrame:
    """Null on no rows."""
    return transactions.agg(
        half_up(F.sum("surface").cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias(
            "surface_moyenne"
        )
    )
