"""The filtered price report: trimmed summary plus the transactions behind it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landprice.functions.prices import (
    french_date,
    full_address,
    price,
    price_per_m2_or_zero,
    street_number,
    surface,
    truncated,
)
from landprice.operators.filters import Filters, apply_report_filters, garage_filter
from landprice.operators.outliers import (
    outlier_rows,
    outlier_statistics,
    sample_rows,
    trimmed_summary,
    with_bounds,
)
from landprice.operators.topn import recent_first, recent_rows
from landprice.schema import KEY
from landprice.session import materialised

# The columns a report needs and those it shows when present.
NEEDED = (
    "id_mutation",
    "date_mutation",
    "id_parcelle",
    "valeur_fonciere",
    "type_local",
    "surface_reelle_bati",
)
OPTIONAL = ("code_postal", "adresse_nom_voie", "nom_commune", "adresse_numero")


@dataclass(frozen=True)
class PriceReport:
    """The reported sales and, planned on first use, their summary and output records."""

    sales: DataFrame
    limit: int | None
    joined: bool

    @cached_property
    def rows(self) -> DataFrame:
        """The population of the statistics; a garage join runs once for its several passes."""
        if self.limit is not None:
            return self.recent
        return materialised(self.sales, "garage") if self.joined else self.sales

    @cached_property
    def recent(self) -> DataFrame:
        return recent_rows(self.sales, self.limit)

    @cached_property
    def summary(self) -> DataFrame:
        rows = self.rows.select("valeur_fonciere", "prix_m2")
        if self.limit is not None:
            # The bounds and the statistics both need the limited rows.
            rows = materialised(rows, "recent")
        return trimmed_summary(rows, self.limit)

    @cached_property
    def transactions(self) -> DataFrame:
        return sale_records(self.recent)


def filtered_sales(
    df: DataFrame,
    filters: Filters,
    garage: str = "tous",
    outbuildings: DataFrame | None = None,
) -> DataFrame:
    """Filtered and projected sales as doubles, with the price per square metre."""
    rows = garage_filter(apply_report_filters(df, filters), df, garage, outbuildings)
    present = set(df.columns)
    doubles = {"valeur_fonciere": price(), "surface_reelle_bati": surface()}
    shown = dict.fromkeys(name for name in (*NEEDED, *OPTIONAL, *KEY) if name in present)
    return rows.select(
        *[doubles[name].alias(name) if name in doubles else name for name in shown],
        price_per_m2_or_zero(price(), surface()).alias("prix_m2"),
    )


def sale_records(rows: DataFrame) -> DataFrame:
    """The output record of each sale; an absent optional field is null."""

    present = set(rows.columns)

    def optional(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast("string")

    number = street_number(optional("adresse_numero"))
    street = optional("adresse_nom_voie")
    return rows.select(
        french_date(F.col("date_mutation")).alias("date"),
        truncated(F.col("valeur_fonciere")).alias("prix"),
        truncated(F.col("surface_reelle_bati")).alias("surface"),
        truncated(F.col("prix_m2")).alias("prix_m2"),
        optional("code_postal").alias("code_postal"),
        street.alias("adresse"),
        number.alias("numero"),
        full_address(number, street).alias("adresse_complete"),
        optional("nom_commune").alias("commune"),
    )


def as_json(records: DataFrame) -> DataFrame:
    """One JSON object per record; absent fields are left out."""
    return records.select(F.to_json(F.struct("*")).alias("json"))


def price_report(
    df: DataFrame,
    filters: Filters = Filters(),
    limit: int | None = None,
    garage: str = "tous",
    outbuildings: DataFrame | None = None,
) -> PriceReport:
    """Statistics run on the whole population, or on its ``limit`` most recent rows.

    ``outbuildings`` holds the ids of all sales with an outbuilding, if they are kept somewhere.
    """
    sales = filtered_sales(df, filters, garage, outbuildings)
    return PriceReport(sales, limit, garage != "tous")


@dataclass(frozen=True)
class OutlierReport:
    """What the trimming removed; the bounds are found once, on first use."""

    report: PriceReport
    sample_size: int
    seed: int

    @cached_property
    def _bounded(self) -> DataFrame:
        rows = self.report.rows
        if self.report.limit is not None:
            rows = materialised(rows, "recent")
        return with_bounds(rows, self.report.limit)

    @cached_property
    def statistics(self) -> DataFrame:
        return outlier_statistics(self._bounded)

    @cached_property
    def _found(self) -> DataFrame:
        return outlier_rows(self._bounded).select(*self.report.rows.columns)

    @cached_property
    def outliers(self) -> DataFrame:
        return self._found.orderBy(*recent_first(self._found))

    @cached_property
    def sample(self) -> DataFrame:
        shown = self._found.columns
        keys = [name for name in (*KEY, "date_mutation", "code_postal") if name in shown]
        return sample_rows(self._found, keys, self.sample_size, self.seed)


def outlier_report(
    df: DataFrame,
    filters: Filters = Filters(),
    limit: int | None = None,
    garage: str = "tous",
    sample_size: int = 5,
    seed: int = 0,
) -> OutlierReport:
    """What the trimming removed, over the same rows as the report."""
    return OutlierReport(price_report(df, filters, limit, garage), sample_size, seed)
