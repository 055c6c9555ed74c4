"""Untrimmed price analyses: whole selection, per parcel, per property type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landprice.functions.prices import (
    price,
    price_per_m2,
    price_per_m2_with_surface,
    surface,
)
from landprice.operators.filters import apply_analysis_filters, garage_filter, postal_prefix
from landprice.operators.outliers import MEDIAN
from landprice.operators.quantiles import distribution, grouped_distribution
from landprice.schema import FLAT
from landprice.session import materialised

GLOBAL = "global"


def _measures() -> dict[str, Column]:
    return {"price": price(), "price_m2": price_per_m2_with_surface(price(), surface())}


def _statistics() -> list[Column]:
    return [
        F.col("price.mean").alias("prix_moyen"),
        F.col("price.q")[0].alias("prix_median"),
        F.col("price_m2.mean").alias("prix_m2_moyen"),
        F.col("price_m2.q")[0].alias("prix_m2_median"),
    ]


def _selected(
    df: DataFrame,
    parcelles: Sequence[str] | None,
    type_local: str | None,
    min_m2: float | None,
    max_m2: float | None,
    garage: str,
) -> DataFrame:
    """The columns an analysis reads. A garage join is run once, not in each of its passes."""
    filtered = apply_analysis_filters(df, parcelles, type_local, min_m2, max_m2)
    rows = garage_filter(filtered, df, garage).select(
        "id_parcelle", "valeur_fonciere", "surface_reelle_bati"
    )
    return rows if garage == "tous" else materialised(rows, "garage")


def count_transactions(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("nombre_transactions"))


def analyse_prices(
    df: DataFrame,
    parcelles: Sequence[str] | None = None,
    type_local: str | None = None,
    min_m2: float | None = None,
    max_m2: float | None = None,
    garage: str = "tous",
) -> DataFrame:
    """One row of means and medians; on no rows the count is 0 and the rest null."""
    rows = _selected(df, parcelles, type_local, min_m2, max_m2, garage)
    summary = distribution(rows, _measures(), [MEDIAN])
    return summary.select(F.col("rows").alias("nombre_transactions"), *_statistics())


def analyse_by_parcel(
    df: DataFrame,
    parcelles: Sequence[str],
    type_local: str | None = None,
    min_m2: float | None = None,
    max_m2: float | None = None,
    garage: str = "tous",
    hide_empty: bool = False,
) -> DataFrame:
    """A ``global`` row over all requested parcels, then one row per requested parcel.

    Each row counts once for its parcel and once for the global level, so both levels come
    from the same passes over the data.
    """
    requested = list(dict.fromkeys(parcelles))
    rows = _selected(df, requested, type_local, min_m2, max_m2, garage)
    levels = [F.struct(F.lit(0).alias("niveau"), F.lit(None).cast("string").alias("parcelle"))]
    if requested:
        levels.append(F.struct(F.lit(1).alias("niveau"), F.col("id_parcelle").alias("parcelle")))
    leveled = rows.select(
        "valeur_fonciere", "surface_reelle_bati", F.inline(F.array(*levels))
    )
    found = grouped_distribution(
        leveled,
        _measures(),
        [MEDIAN],
        by=["niveau", "parcelle"],
    ).select(
        "niveau",
        F.when(F.col("niveau") == 0, F.lit(GLOBAL))
        .otherwise(F.col("parcelle"))
        .alias("parcelle"),
        "rows",
        *_statistics(),
    )
    wanted = df.sparkSession.createDataFrame(
        [(0, GLOBAL), *[(1, parcel) for parcel in requested]], "niveau int, parcelle string"
    )
    result = wanted.join(found, ["niveau", "parcelle"], "left").select(
        "niveau",
        "parcelle",
        F.coalesce("rows", F.lit(0).cast("bigint")).alias("nombre_transactions"),
        "prix_moyen",
        "prix_median",
        "prix_m2_moyen",
        "prix_m2_median",
    )
    if hide_empty:
        result = result.filter((F.col("niveau") == 0) | (F.col("nombre_transactions") > 0))
    return result.orderBy("niveau", "parcelle").drop("niveau")


def analyse_every_parcel(df: DataFrame, type_local: str | None = None) -> DataFrame:
    """The analysis of each parcel of the register, however many there are."""
    rows = apply_analysis_filters(df, type_local=type_local).filter(F.col("id_parcelle").isNotNull())
    found = grouped_distribution(rows, _measures(), [MEDIAN], ["id_parcelle"])
    return found.select(
        F.col("id_parcelle").alias("parcelle"),
        F.col("rows").alias("nombre_transactions"),
        *_statistics(),
    )


def mean_price_by_type(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("type_local")
        .agg(F.avg(price()).alias("prix_moyen"))
        .orderBy(F.col("prix_moyen").desc_nulls_first())
    )


def mean_price_m2(df: DataFrame, type_local: str = FLAT, prefix: str = "") -> DataFrame:
    """Mean price per square metre of one type in a postal area."""
    rows = postal_prefix(df.filter(F.col("type_local") == F.lit(type_local)), prefix)
    return rows.agg(F.avg(price_per_m2(price(), surface())).alias("prix_m2_moyen"))
