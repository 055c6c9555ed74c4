"""Row filters: parameter sets become Column predicates that reach the Parquet scan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import reduce
from math import copysign, isnan
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landprice.schema import DEFAULT_MAX_PRICE, FLAT, OUTBUILDING, PRICE

GARAGE_OPTIONS = ("tous", "avec", "sans")
# No stored price or surface reaches this; bounds beyond it on either side mean the same.
_BEYOND = Decimal(10) ** (PRICE.precision - PRICE.scale)
# Places that a decimal literal has room for next to the whole part.
_LITERAL_SCALE = 20


@dataclass(frozen=True)
class Filters:
    """Parameters of the price report. Lists hold raw user values; bad entries are skipped."""

    type_local: str | None = FLAT
    years: Sequence[str | int] = ()
    parcelles: Sequence[str] = ()
    codes_postaux: Sequence[str] = ()
    min_surface: float | str | None = None
    max_surface: float | str | None = None
    max_price: int | str | None = DEFAULT_MAX_PRICE


def usable_values(values: Iterable[str]) -> list[str]:
    """Trimmed values without empties, quotes and repeats."""
    trimmed = (value.strip() for value in values)
    return list(dict.fromkeys(value for value in trimmed if value and "'" not in value))


def usable_years(values: Iterable[str | int]) -> list[int]:
    """Plain digits, optionally blank-padded; everything else is skipped."""
    texts = (str(value).strip() for value in values)
    return sorted({int(text) for text in texts if re.fullmatch(r"[0-9]+", text)})


def usable_number(value: float | str | None) -> Decimal | None:
    """A number as a decimal literal, which the scan can compare without a cast.

    Numbers no stored value can reach, infinities included, become the nearest such bound.
    """
    try:
        number = None if value is None else float(value)
    except (TypeError, ValueError, OverflowError):
        return None
    if number is None or isnan(number):
        return None
    if abs(number) >= _BEYOND:
        return _BEYOND.copy_sign(Decimal(int(copysign(1, number))))
    exact = Decimal(repr(number))
    return exact if exact.as_tuple().exponent >= -_LITERAL_SCALE else round(exact, _LITERAL_SCALE)


def usable_price(value: int | str | None) -> Decimal:
    """A whole upper bound; text that is no number means the default."""
    try:
        bound = DEFAULT_MAX_PRICE if value is None else int(value)
    except (TypeError, ValueError):
        bound = DEFAULT_MAX_PRICE
    except OverflowError:  # infinity
        bound = int(_BEYOND) if value > 0 else -int(_BEYOND)
    return min(max(Decimal(bound), -_BEYOND), _BEYOND)


def in_years(years: Sequence[int], column: str = "date_mutation") -> Column:
    """Half-open date ranges, because year(column) is not pushed to the scan."""

    def one_year(year: int) -> Column:
        if not 1 <= year <= 9998:
            return F.lit(False)
        start, end = F.lit(date(year, 1, 1)), F.lit(date(year + 1, 1, 1))
        return (F.col(column) >= start) & (F.col(column) < end)

    return reduce(or_, [one_year(year) for year in years])


def base_validity(max_price: int | str | None = DEFAULT_MAX_PRICE) -> Column:
    price = F.col("valeur_fonciere")
    return (price > 0) & (price <= F.lit(usable_price(max_price))) & (F.col("surface_reelle_bati") > 0)


def surface_between(
    lower: float | str | None, upper: float | str | None
) -> list[Column]:
    surface = F.col("surface_reelle_bati")
    low, high = usable_number(lower), usable_number(upper)
    predicates = []
    if low is not None:
        predicates.append(surface >= F.lit(low))
    if high is not None:
        predicates.append(surface <= F.lit(high))
    return predicates


def keep_listed(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Keep rows whose column is in a driver-side list; an empty list keeps everything.

    A long list is one hash set in the filter, and its ends are pushed to the scan.
    """
    if not values:
        return df
    listed = F.col(column).isin(list(values))
    return df.filter(listed & F.col(column).between(min(values), max(values)))


def apply_report_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Base validity plus every filter of the set that has at least one usable value."""
    predicates = [
        base_validity(filters.max_price),
        F.col("type_local") == F.lit(filters.type_local or FLAT),
        *surface_between(filters.min_surface, filters.max_surface),
    ]
    years = usable_years(filters.years)
    if years:
        predicates.append(in_years(years))
    kept = df.filter(reduce(and_, predicates))
    kept = keep_listed(kept, "id_parcelle", usable_values(filters.parcelles))
    return keep_listed(kept, "code_postal", usable_values(filters.codes_postaux))


def apply_analysis_filters(
    df: DataFrame,
    parcelles: Sequence[str] | None = None,
    type_local: str | None = None,
    min_m2: float | None = None,
    max_m2: float | None = None,
) -> DataFrame:
    """Each filter optional, no default type and no base validity."""
    kept = keep_listed(df, "id_parcelle", list(dict.fromkeys(parcelles or ())))
    if type_local:
        kept = kept.filter(F.col("type_local") == F.lit(type_local))
    for predicate in surface_between(min_m2, max_m2):
        kept = kept.filter(predicate)
    return kept


def garage_filter(
    rows: DataFrame,
    unfiltered: DataFrame,
    option: str = "tous",
    outbuildings: DataFrame | None = None,
) -> DataFrame:
    """Keep sales with ("avec") or without ("sans") an outbuilding row.

    The outbuildings come from the unfiltered data: they have no built surface, so the
    report filters would remove them all. Their ids are made distinct before the join,
    so a sale with many outbuildings is one row on that side. The distinct also groups by
    a hash of the id: its shuffle is then not the one the join needs, the join gets its
    own on both sides, and adaptive execution can split a sale with very many rows.
    Where the ids of sales with an outbuilding are at hand, ``unfiltered`` is not read.
    """
    if option not in GARAGE_OPTIONS:
        raise ValueError(f"garage option must be one of {GARAGE_OPTIONS}, not {option!r}")
    if option == "tous":
        return rows
    with_garage = outbuildings if outbuildings is not None else (
        unfiltered.filter(F.col("type_local") == F.lit(OUTBUILDING))
        .select("id_mutation", F.xxhash64("id_mutation").alias("_hash"))
        .distinct()
        .select("id_mutation")
    )
    return rows.join(with_garage, "id_mutation", "left_semi" if option == "avec" else "left_anti")


def postal_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(F.col("code_postal").startswith(prefix))


def usable_postal_codes(values: Iterable[str]) -> list[str]:
    """Well-formed postal codes of a parameter list, each once."""
    return [value for value in dict.fromkeys(values) if re.fullmatch(r"[0-9]{5}", value)]


def is_postal_code(column: str = "code_postal") -> Column:
    return F.col(column).rlike("^[0-9]{5}$")


def valid_postal_codes(df: DataFrame, column: str = "code_postal") -> DataFrame:
    """The distinct well-formed codes of a column."""
    return df.select(column).filter(is_postal_code(column)).distinct()


def street_search(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring search on the street name."""
    return df.filter(F.contains(F.upper("adresse_nom_voie"), F.upper(F.lit(text))))
