"""Cleaning expressions that turn register text into storage types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landprice.schema import (
    COORDINATE,
    COORDINATE_COLUMNS,
    MAX_STORED_PRICE,
    MAX_STORED_SURFACE,
    NULL_TOKENS,
    PRICE,
    PRICE_COLUMN,
    SURFACE_COLUMNS,
    TEXT_LENGTHS,
)

# Wide enough to range-check before rounding to the storage scale.
_WIDE_NUMBER = "decimal(38,12)"


def null_tokens(value: Column) -> Column:
    """Whole-cell, case-sensitive null tokens become null."""
    return F.when(~value.isin(*NULL_TOKENS), value)


def to_date(value: Column) -> Column:
    """ISO dates only; anything else is null (a bare cast would take ``2024`` for a date)."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def to_number(value: Column) -> Column:
    """Numeric text as a wide decimal, bad text as null (never NaN or infinity)."""
    return value.try_cast(_WIDE_NUMBER)


def is_number(value: Column) -> Column:
    """Whether text is a finite number of any size."""
    number = value.try_cast("double")
    # Text too large for a double is infinite, but not by that name.
    named = F.lower(F.trim(value)).rlike("^[+-]?(inf|nan)")
    return number.isNotNull() & ~F.isnan(number) & ~named


def in_range(number: Column, upper: int) -> Column:
    """Values outside 0..upper become null, the row stays."""
    return F.when(number.between(0, upper), number)


def clean_value(name: str, value: Column) -> Column:
    """One register column from its raw text; coordinates stay text until they are stored."""
    text = null_tokens(value)
    if name == "date_mutation":
        return to_date(text)
    if name == PRICE_COLUMN:
        return in_range(to_number(text), MAX_STORED_PRICE).cast(PRICE)
    if name in SURFACE_COLUMNS:
        return in_range(to_number(text), MAX_STORED_SURFACE).cast(PRICE)
    if name in COORDINATE_COLUMNS:
        return F.when(is_number(text), text)
    return text


def storage_misfit(name: str) -> Column | None:
    """True where the cleaned column cannot be stored; None for columns that always fit."""
    value = F.col(name)
    if name in TEXT_LENGTHS:
        return F.char_length(value) > TEXT_LENGTHS[name]
    if name in COORDINATE_COLUMNS:
        return value.isNotNull() & to_number(value).try_cast(COORDINATE).isNull()
    return None


def stored(name: str) -> Column:
    """The cleaned column in its storage type."""
    value = F.col(name)
    return to_number(value).try_cast(COORDINATE).alias(name) if name in COORDINATE_COLUMNS else value
