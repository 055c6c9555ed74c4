"""Approximate quantiles of any number of groups from mergeable KLL sketches, as an opt-in.

A sketch is built in one pass with map-side combine and has a bounded size, whatever the number of
values, so no value is shuffled. The sketches of cells (say year, type and postal code) can be kept
in a table and merged later for any coarser grouping, without reading a sale again. Reports stay
exact unless these functions are called.

With ``k`` = 200 an approximate quantile's rank is off by at most about 1.7 % of the group's
values, with 99 % probability (``k`` = 800: about 0.5 %). Answers are values of the group, not interpolated ones.
Groups of up to ``k`` values are exact up to the interpolation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; the error falls about in proportion.
SKETCH_SIZE = 800
#: Largest error of a rank, as a share of the group's values, that such a sketch shows.
RANK_ERROR = 0.01


def _number(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def sketched(
    df: DataFrame, measures: Mapping[str, Column], by: Sequence[str] = (), size: int = SKETCH_SIZE
) -> DataFrame:
    """The ``by`` columns, ``rows``, and per measure a struct of ``n``, ``total``, ``low``, ``high``
    and ``sketch``. Nulls and NaN are ignored."""
    values = df.select(*by, *[_number(column).alias(name) for name, column in measures.items()])
    return values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.struct(
                F.count(name).alias("n"),
                F.sum(name).alias("total"),
                F.min(name).alias("low"),
                F.max(name).alias("high"),
                F.kll_sketch_agg_double(name, F.lit(size)).alias("sketch"),
            ).alias(name)
            for name in measures
        ],
    )


def merged(cells: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sketched cells of a coarser grouping, or of one more load, from finer ones."""
    return cells.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("rows"),
        *[
            F.struct(
                F.coalesce(F.sum(f"{name}.n"), F.lit(0).cast("bigint")).alias("n"),
                F.sum(f"{name}.total").alias("total"),
                F.min(f"{name}.low").alias("low"),
                F.max(f"{name}.high").alias("high"),
                F.kll_merge_agg_double(F.col(f"{name}.sketch")).alias("sketch"),
            ).alias(name)
            for name in measures
        ],
    )


def approximate_distribution(
    cells: DataFrame, measures: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Like ``quantiles.distribution``, with approximate ``q``; null for a group without values."""
    at = F.array(*[F.lit(float(p)) for p in probabilities])

    def summary(name: str) -> Column:
        n = F.col(f"{name}.n")
        quantiles = F.kll_sketch_get_quantile_double(F.col(f"{name}.sketch"), at)
        return F.struct(
            n.alias("n"),
            (F.col(f"{name}.total") / F.when(n > 0, n)).alias("mean"),
            F.col(f"{name}.low").alias("low"),
            F.col(f"{name}.high").alias("high"),
            F.when(n > 0, quantiles).alias("q"),
        ).alias(name)

    return cells.select(*by, "rows", *[summary(name) for name in measures])
