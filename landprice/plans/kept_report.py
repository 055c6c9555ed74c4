"""Reports over the stored register table that use what is kept beside its loads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landprice.functions.prices import truncated
from landprice.operators.filters import Filters, keep_listed, usable_number, usable_values, usable_years
from landprice.operators.price_cells import trimmed_figures
from landprice.plans.price_report import PriceReport, filtered_sales, price_report
from landprice.schema import FLAT
from landprice.sources.sides import OUTBUILDINGS, PRICE_CELLS, side_rows, snapshot

#: Parameters that the kept cells tell apart.
_IN_CELLS = ("type_local", "years", "codes_postaux")


def counted_in_cells(filters: Filters) -> bool:
    """Whether the kept cells can answer a report with these filters."""
    plain = replace(filters, **{name: getattr(Filters(), name) for name in _IN_CELLS})
    return plain == Filters()


def whole_population_summary(
    spark: SparkSession, name: str, filters: Filters = Filters()
) -> DataFrame:
    """``price_report(…, limit=None).summary`` of a register table, from its price cells.

    Sales are read only where a wanted rank or a bound lies. Loads without kept cells are counted
    in the plan. Filters that the cells do not tell apart take the report over the sales.
    """
    now = snapshot(spark, name)
    sales = now.rows(spark)
    if not counted_in_cells(filters):
        return price_report(sales, filters).summary
    cells = side_rows(spark, now, PRICE_CELLS)
    cells = cells.filter(F.col("type_local") == F.lit(filters.type_local or FLAT))
    if years := usable_years(filters.years):
        cells = cells.filter(F.col("sale_year").isin([y for y in years if 1 <= y <= 9998]))
    cells = keep_listed(cells, "code_postal", usable_values(filters.codes_postaux))

    def within(ranges: Sequence[tuple[float, float]]) -> DataFrame:
        # On the stored decimals, so that the scan skips by them.
        price = F.col("valeur_fonciere")
        wanted = [
            (price >= F.lit(usable_number(low))) & (price <= F.lit(usable_number(high)))
            for low, high in ranges
        ]
        return filtered_sales(sales.filter(reduce(or_, wanted)), filters)

    found = trimmed_figures(cells, within)
    figures = {
        "prix_moyen": found.price_mean,
        "prix_median": found.price_median,
        "prix_m2_moyen": found.m2_mean,
        "prix_m2_median": found.m2_median,
    }
    return spark.range(1).select(
        # Output names of the summary.
        *[F.lit(found.rows).cast("bigint").alias(x) for x in ("nombre_transactions", "nombre_transactions_affiches")],
        *[truncated(F.lit(value).cast("double")).alias(x) for x, value in figures.items()],
    )


def garage_report(
    spark: SparkSession,
    name: str,
    garage: str,
    filters: Filters = Filters(),
    limit: int | None = None,
) -> PriceReport:
    """``price_report`` of a register table with the kept ids of sales with an outbuilding.

    The sales are scanned once; the ids of one load are distinct already.
    """
    now = snapshot(spark, name)
    held = side_rows(spark, now, OUTBUILDINGS)
    return price_report(now.rows(spark), filters, limit, garage, held)
