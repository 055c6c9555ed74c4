"""Mergeable counts of prices, and the exact trimmed summary from them.

Sales are counted per cell of a logarithmic scale of price and price per square metre. Counts of any
loads, years or places add up. A wanted rank lies in one cell, so an exact quantile reads the sales
of that cell alone, and trimming at given bounds reads those of the two cells that the bounds cut.
Only merged cells (at most some hundred for each measure) and single values come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landprice.operators.outliers import HIGH_QUARTILE, IQR_FACTOR, LOW_QUARTILE, MEDIAN
from landprice.session import discard_rows, materialised

#: Cells for each factor of e: a cell spans about six percent of its value.
STEPS = 16
#: A cell is cut into so many finer ones as long as it holds more rows than are gathered.
FINER = 1 << 10
GATHERED = 1 << 14
#: Beyond this fineness a cell has room for few different doubles.
FINEST = STEPS * FINER**3


@dataclass(frozen=True)
class Span:
    """A cell in rank order: positions ``start`` up to ``stop`` and its least and greatest value."""

    cell: int
    start: int
    stop: int
    low: float
    high: float


def cell_of(value: Column, steps: int = STEPS) -> Column:
    return F.floor(F.log1p(value) * F.lit(float(steps))).cast("bigint")


def in_cells(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, sums and ends per cell of ``valeur_fonciere`` and ``prix_m2``, both positive."""
    named = {"price": F.col("valeur_fonciere"), "m2": F.col("prix_m2")}
    return (
        sales.select(*by, *[value.alias(name) for name, value in named.items()])
        .groupBy(*by, *[cell_of(F.col(name)).alias(f"{name}_cell") for name in named])
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[
                how(name).alias(f"{name}_{part}")
                for name in named
                for part, how in (("total", F.sum), ("low", F.min), ("high", F.max))
            ],
        )
    )


def told_once(cells: DataFrame) -> DataFrame:
    """Cells without what their other columns tell: the ends of one row's cell, an end like the other."""
    ends = {}
    for name in ("price", "m2"):
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        ends |= {f"{name}_low": F.when(F.col("rows") > 1, low), f"{name}_high": F.when(low < high, high)}
    return cells.withColumns(ends)


def told_again(cells: DataFrame) -> DataFrame:
    """The cells of ``told_once`` with all their ends; a sum of one value is that value."""
    ends = {}
    for name in ("price", "m2"):
        low = F.coalesce(f"{name}_low", f"{name}_total")
        ends |= {f"{name}_low": low, f"{name}_high": F.coalesce(F.col(f"{name}_high"), low)}
    return cells.withColumns(ends)


def spans(cells: DataFrame, measure: str) -> list[Span]:
    """Merged cells of a measure in rank order."""
    merged = cells.groupBy(f"{measure}_cell").agg(
        F.sum("rows").alias("rows"),
        F.min(f"{measure}_low").alias("low"),
        F.max(f"{measure}_high").alias("high"),
    )
    return _ranked([(r[0], r.rows, r.low, r.high) for r in merged.collect()])


def _ranked(rows: Sequence[tuple[int, int, float, float]]) -> list[Span]:
    out, before = [], 0
    for cell, count, low, high in sorted(rows):
        out.append(Span(cell, before, before + count, low, high))
        before += count
    return out


def values_at(
    ordered: Sequence[Span], ranks: Sequence[int], read: Callable[[Sequence[Span]], DataFrame]
) -> dict[int, float]:
    """The value at each rank. ``read`` gives the values (column ``v``) between the spans' ends."""
    found: dict[int, float] = {}
    steps = STEPS
    while True:
        holding = [s for s in ordered if any(s.start <= r < s.stop for r in ranks if r not in found)]
        for span in holding:
            if span.low == span.high:
                found |= {r: span.low for r in ranks if span.start <= r < span.stop}
        open_spans = [span for span in holding if span.low != span.high]
        if not open_spans:
            return found
        values = read(open_spans)
        rows = sum(span.stop - span.start for span in open_spans)
        steps *= FINER
        single = rows <= GATHERED or steps > FINEST
        # The span that a value lies in keeps ranks apart; spans do not overlap.
        of_span = F.coalesce(
            *[F.when(F.col("v").between(s.low, s.high), F.lit(i)) for i, s in enumerate(open_spans)]
        )
        cell = F.lit(0).cast("bigint") if single else cell_of(F.col("v"), steps)
        finer = values.select("v", of_span.alias("span"), cell.alias("cell"))
        keys = ["span", "v"] if single else ["span", "cell"]
        counted = finer.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        ordered = []
        parts: dict[int, list] = {}
        for r in counted.collect():
            parts.setdefault(r.span, []).append((r[1], r.rows, r.low, r.high))
        for i, span in enumerate(open_spans):
            ordered += [
                Span(s.cell, s.start + span.start, s.stop + span.start, s.low, s.high)
                for s in _ranked(parts.get(i, []))
            ]


def quantiles_at(
    ordered: Sequence[Span],
    probabilities: Sequence[float],
    read: Callable[[Sequence[Span]], DataFrame],
) -> list[float | None]:
    """Exact interpolated quantiles; None without values."""
    n = ordered[-1].stop if ordered else 0
    if not n:
        return [None] * len(probabilities)
    places = [(n - 1) * p for p in probabilities]
    ranks = sorted({end for place in places for end in (floor(place), ceil(place))})
    value = values_at(ordered, ranks, read)
    return [
        value[floor(x)] if floor(x) == ceil(x)
        else (ceil(x) - x) * value[floor(x)] + (x - floor(x)) * value[ceil(x)]
        for x in places
    ]


@dataclass(frozen=True)
class TrimmedFigures:
    """Count of all rows, and mean and median of the rows within the bounds; None if empty."""

    rows: int
    price_mean: float | None = None
    price_median: float | None = None
    m2_mean: float | None = None
    m2_median: float | None = None


def trimmed_figures(
    cells: DataFrame, read_prices: Callable[[Sequence[tuple[float, float]]], DataFrame]
) -> TrimmedFigures:
    """The trimmed summary of the sales that ``cells`` count.

    ``read_prices`` gives these sales (``valeur_fonciere``, ``prix_m2``) within closed ranges of price.
    """

    def prices(wanted: Sequence[Span]) -> DataFrame:
        rows = read_prices([(span.low, span.high) for span in wanted])
        return rows.select(F.col("valeur_fonciere").alias("v"))

    whole = spans(cells, "price")
    if not whole:
        return TrimmedFigures(0)
    low, high = quantiles_at(whole, (LOW_QUARTILE, HIGH_QUARTILE), prices)
    lower, upper = low - IQR_FACTOR * (high - low), high + IQR_FACTOR * (high - low)
    inside = [s.cell for s in whole if lower <= s.low and s.high <= upper]
    cut = [s for s in whole if s.cell not in set(inside) and s.low <= upper and lower <= s.high]
    # Cells inside the bounds follow each other.
    kept = cells.filter(F.col("price_cell").between(min(inside), max(inside))) if inside else None
    at_ends = None
    if cut:
        rows = read_prices([(max(s.low, lower), min(s.high, upper)) for s in cut])
        at_ends = materialised(in_cells(rows), "cells")
        kept = at_ends if kept is None else kept.select(*at_ends.columns).unionByName(at_ends)
    totals = kept.agg(F.sum("rows"), F.sum("price_total"), F.sum("m2_total")).first()

    def per_m2(wanted: Sequence[Span]) -> DataFrame:
        rows = read_prices([(lower, upper)]).select(F.col("prix_m2").alias("v"))
        near = F.lit(False)
        for span in wanted:
            near = near | F.col("v").between(span.low, span.high)
        return rows.filter(near)

    (price_median,) = quantiles_at(spans(kept, "price"), (MEDIAN,), prices)
    (m2_median,) = quantiles_at(spans(kept, "m2"), (MEDIAN,), per_m2)
    if at_ends is not None:
        discard_rows(at_ends)
    n = totals[0]
    return TrimmedFigures(
        whole[-1].stop, totals[1] / n if n else None, price_median, totals[2] / n if n else None, m2_median
    )
