"""Exact statistics of unbounded groups, without gathering a group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one hash map.
Here the ranks are narrowed instead: a first pass counts values per coarse cell of a
logarithmic scale (a map-side aggregate of bounded size), the few cells that hold a wanted
rank are read again, and inside them a finer scale and finally the values themselves give
the answer. Each step sorts only a bounded number of cells or values in one task: at most
the coarse cells of a group, then the fine cells of one coarse cell, then the distinct
doubles of one fine cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from landprice.session import materialised

_COARSE = 1 << 14
_FINE = 1 << 30
#: Groups of up to this many rows fit in one task's aggregate, also many at a time.
GROUP_ROWS = 1 << 16


def interpolated(low: Column, high: Column, position: Column) -> Column:
    """Linear interpolation between the two values around a fractional rank."""
    lower, upper = F.floor(position), F.ceil(position)
    return F.when(lower == upper, low).otherwise(
        (upper - position) * low + (position - lower) * high
    )


def _number(column: Column) -> Column:
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def _scaled(value: Column, steps: int) -> Column:
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(float(steps))).cast("bigint")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(and_, [left[key].eqNullSafe(right[key]) for key in keys])


def distribution(
    df: DataFrame,
    measures: Mapping[str, Column],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group (exactly one without ``by``).

    Columns: the ``by`` columns, ``rows``, and per measure a struct with ``n``, ``mean``,
    ``low``, ``high`` and the array ``q`` of exact interpolated quantiles; nulls are
    ignored as in any aggregate. The first pass runs at once and its picked cells are written,
    so that the second is planned with a table of known size, which the planner broadcasts
    if that size allows it. Without ``by`` the few picked cells also bound the measures'
    values in the second scan.
    """
    by = list(by)
    keys = [*by, "measure"]

    named = [
        F.struct(F.lit(name).alias("measure"), _number(column).alias("v"))
        for name, column in measures.items()
    ]

    def measured(rows: DataFrame) -> DataFrame:
        found = rows.select(*by, F.inline(F.array(*named)))
        return found.withColumn("coarse", _scaled(F.col("v"), _COARSE))

    values = measured(df)

    cells = values.groupBy(*keys, "coarse").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("v").alias("total"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    )
    group = W.partitionBy(*keys)
    filled = F.when(F.col("coarse").isNotNull(), F.col("c")).otherwise(F.lit(0))
    upto = F.sum(filled).over(group.orderBy("coarse").rowsBetween(W.unboundedPreceding, 0))
    cells = cells.select(
        *keys,
        "coarse",
        (upto - filled).alias("start"),
        upto.alias("stop"),
        F.sum(filled).over(group).alias("n"),
        F.sum("c").over(group).alias("rows"),
        F.sum("total").over(group).alias("total"),
        F.min("low").over(group).alias("low"),
        F.max("high").over(group).alias("high"),
        F.col("low").alias("cell_low"),
        F.col("high").alias("cell_high"),
    )
    positions = [(F.col("n") - F.lit(1)) * F.lit(float(p)) for p in probabilities]
    ranks = [rank.cast("bigint") for p in positions for rank in (F.floor(p), F.ceil(p))]

    def holds(rank: Column) -> Column:
        return (rank >= F.col("start")) & (rank < F.col("stop"))

    wanted = reduce(or_, [holds(rank) for rank in ranks])
    picked = cells.filter(wanted | (F.col("n") == 0))
    picked = materialised(picked, "cells")
    if not by:
        # Two cells for each probability and measure at most.
        ends = picked.filter("cell_low is not null").select("measure", "cell_low", "cell_high")
        ranges = [
            _number(measures[row.measure]).between(row.cell_low, row.cell_high)
            for row in ends.collect()
        ]
        values = measured(df.filter(reduce(or_, ranges, F.lit(False))))

    coarse_keys = [*keys, "coarse"]
    marks = picked.select(*coarse_keys)
    near = values.join(marks, _same(values, marks, coarse_keys), "left_semi")
    near = near.groupBy(*coarse_keys, "v").agg(F.count(F.lit(1)).alias("c"))
    near = near.withColumn("fine", _scaled(F.col("v"), _FINE))

    picked_fine = _narrow(
        near.groupBy(*coarse_keys, "fine").agg(F.sum("c").alias("c")),
        picked,
        coarse_keys,
        "fine",
    ).filter(wanted | (F.col("n") == 0))
    found = _narrow(near, picked_fine, [*coarse_keys, "fine"], "v")

    per_measure = found.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in ("n", "rows", "total", "low", "high")],
        *[F.max(F.when(holds(rank), F.col("v"))).alias(f"r{i}") for i, rank in enumerate(ranks)],
    )
    quantiles = F.array(
        *[
            interpolated(F.col(f"r{2 * i}"), F.col(f"r{2 * i + 1}"), position)
            for i, position in enumerate(positions)
        ]
    )
    summary = per_measure.select(
        *by,
        "measure",
        "rows",
        F.struct(
            "n",
            (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("mean"),
            "low",
            "high",
            quantiles.alias("q"),
        ).alias("s"),
    )
    return summary.groupBy(*by).agg(
        F.coalesce(F.max("rows"), F.lit(0).cast("bigint")).alias("rows"),
        *[
            F.first(F.when(F.col("measure") == name, F.col("s")), ignorenulls=True).alias(name)
            for name in measures
        ],
    )


def grouped_distribution(
    df: DataFrame,
    measures: Mapping[str, Column],
    probabilities: Sequence[float],
    by: Sequence[str],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``distribution`` for any number of groups, most of them small.

    A first pass counts rows per group with map-side combine and keeps the groups over
    ``group_rows``; there are at most rows / ``group_rows`` of them. All others take the built-in
    percentile, whose state such a group bounds: one aggregate, whose shuffle carries each distinct
    value of a group once per map task, and no join. The large groups go through ``distribution``.
    They are written first, so the plan knows their size, and only if there are any are the rows
    told apart, by a join with that short list.
    """
    by = list(by)
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    large = materialised(counted.filter(F.col("_rows") > F.lit(group_rows)).select(*by), "groups")
    found = not large.isEmpty()
    small = df.join(large, _same(df, large, by), "left_anti") if found else df
    values = small.select(
        *by, *[_number(column).alias(f"_v{i}") for i, column in enumerate(measures.values())]
    )
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    nothing = F.array(*[F.lit(None).cast("double") for _ in probabilities])

    def summary(name: str, value: str) -> Column:
        n = F.count(value)
        return F.struct(
            n.alias("n"),
            (F.sum(value) / F.when(n > 0, n)).alias("mean"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            F.coalesce(F.percentile(value, at), nothing).alias("q"),
        ).alias(name)

    grouped = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[summary(name, f"_v{i}") for i, name in enumerate(measures)],
    )
    if not found:
        return grouped
    rest = df.join(large, _same(df, large, by), "left_semi")
    return grouped.unionByName(distribution(rest, measures, probabilities, by))


def _narrow(counts: DataFrame, picked: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """Rank ranges of the next finer step inside the picked cells."""
    joined = picked.join(
        counts.select(*[F.col(key).alias(f"_{key}") for key in keys], step, "c"),
        reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]),
        "inner",
    )
    order = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("start") + F.sum("c").over(order)
    return joined.select(
        *keys,
        step,
        (upto - F.col("c")).alias("start"),
        upto.alias("stop"),
        "n",
        "rows",
        "total",
        "low",
        "high",
    )
