"""Price, rounding, banding and address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price() -> Column:
    """Analysis type is double, also where the stored column is a decimal."""
    return F.col("valeur_fonciere").cast("double")


def surface() -> Column:
    return F.col("surface_reelle_bati").cast("double")


def price_per_m2_or_zero(amount: Column, area: Column) -> Column:
    """Report form: 0 where either side is missing or not positive."""
    return F.when((amount > 0) & (area > 0), amount / area).otherwise(F.lit(0.0))


def price_per_m2_with_surface(amount: Column, area: Column) -> Column:
    """Analysis form: null (ignored by aggregates) unless the surface is positive."""
    return F.when(area > 0, amount / area)


def price_per_m2(amount: Column, area: Column) -> Column:
    """SQL form: null on a zero surface."""
    return F.try_divide(amount, area)


def truncated(value: Column) -> Column:
    """Toward zero, null as 0."""
    return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))


def half_up(value: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def french_date(value: Column) -> Column:
    return F.date_format(value, "dd/MM/yyyy")


def street_number(value: Column) -> Column:
    """Trimmed; blank means absent.

    ``nullif`` would plan its argument as a projection of its own, and a second projection
    above a limit keeps Spark from planning sort and limit as one top-n operator.
    """
    return F.when(F.trim(value) != F.lit(""), F.trim(value))


def full_address(number: Column, street: Column) -> Column:
    return F.when(number.isNotNull() & street.isNotNull(), F.concat_ws(" ", number, street))


def band_floor(area: Column) -> Column:
    return (F.floor(area / F.lit(10)) * F.lit(10)).cast("bigint")


def band_label(lower: Column) -> Column:
    return F.concat(
        lower.cast("string"), F.lit("-"), (lower + F.lit(9)).cast("string"), F.lit("m²")
    )
