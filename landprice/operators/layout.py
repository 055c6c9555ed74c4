"""Clustering by several columns at once along a space-filling curve.

A linear sort serves its first column and little else. Here every column is replaced by its rank
among bounds that cut a sample into equal parts, and the bits of the ranks are interleaved: rows
that are near in every column get near curve positions, so the minima and maxima of a row group
are narrow in all of them and lookups by any one column skip most groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of a column are below 2 to this power.
RANK_BITS = 4
#: Rows whose values set the bounds; a bounded sample, whatever the size of the table.
SAMPLE_ROWS = 4096

Bounds = dict[str, list]


def rank_bounds(rows: DataFrame, columns: Sequence[str], bits: int = RANK_BITS) -> Bounds:
    """For each column the ``2 ** bits - 1`` values that cut a sample into equal parts.

    Nulls rank first and are not in the sample's cut. Fewer distinct values give repeated bounds,
    which only leave ranks unused.
    """
    total = rows.count()
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, total))
    drawn = F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    wanted = rows.select(*columns).filter(drawn | F.lit(share == 1.0)).limit(SAMPLE_ROWS)
    sample = wanted.collect()  # bounded by the sample's size
    ranks = (1 << bits) - 1
    out = {}
    for column in columns:
        values = sorted(row[column] for row in sample if row[column] is not None)
        cuts = [values[len(values) * (i + 1) // (ranks + 1)] for i in range(ranks)] if values else []
        # One value in most rows would use up most ranks: each bound is kept once.
        out[column] = sorted(set(cuts))
    return out


def rank(column: Column, cuts: Sequence) -> Column:
    """How many bounds are at or below the value; null is 0. A few compiled comparisons."""
    passed = [(column >= F.lit(cut)).cast("int") for cut in cuts]
    return F.coalesce(reduce(Column.__add__, passed), F.lit(0)) if passed else F.lit(0)


def with_curve_position(rows: DataFrame, bounds: Bounds, name: str, bits: int = RANK_BITS) -> DataFrame:
    """``rows`` with the interleaved bits of all columns' ranks, the highest bits first."""
    ranks = {
        f"{name}_{number}": rank(F.col(column), cuts)
        for number, (column, cuts) in enumerate(bounds.items())
    }
    # Ranks of a column with few bounds are spread over all bits, else they would only ever
    # set the low ones and count for nothing.
    spread = [max(0, bits - len(cuts).bit_length()) for cuts in bounds.values()]
    position = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for column, shift in zip(ranks, spread):
            one = F.shiftright(F.shiftleft(column, shift), bit).bitwiseAND(F.lit(1)).cast("long")
            position = F.shiftleft(position, 1).bitwiseOR(one)
    return rows.withColumns(ranks).withColumn(name, position).drop(*ranks)
