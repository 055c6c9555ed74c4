"""The newest, dearest n rows under a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from landprice.schema import RECENT_FIRST_TIES

# Price bands per doubling, and the room reserved for them next to the day number.
_BANDS_PER_DOUBLING = 32
_BANDS = 1 << 16
# Cell of the rows without a date, which come last.
_UNDATED = -(1 << 60)
# First day of the calendar's year 1, as a day number.
_FIRST_DAY = -719162
# All days of ten thousand years with all their bands are fewer.
_MOST_CELLS = (1 << 31) - 1


def recent_first(df: DataFrame) -> list[Column]:
    """Date and price descending, then whichever key columns exist as tie-breakers."""
    ties = [F.col(name).asc_nulls_first() for name in RECENT_FIRST_TIES if name in df.columns]
    return [F.col("date_mutation").desc(), F.col("valeur_fonciere").desc(), *ties]


def _cell() -> Column:
    """Day and price band as one number that never decreases along (date, price)."""
    return F.expr(
        f"COALESCE(CAST(unix_date(date_mutation) AS BIGINT) * {_BANDS} + CASE WHEN "
        f"valeur_fonciere >= 0 THEN FLOOR(log2(CAST(valeur_fonciere AS DOUBLE) + 1) * "
        f"{_BANDS_PER_DOUBLING}) + 1 ELSE 0 END, {_UNDATED})"
    )


def recent_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """``ORDER BY date DESC, price DESC LIMIT n`` without n rows per input partition.

    A plain top-n lets every scan task send n rows to one reducer, which at many
    thousands of tasks is the whole query. Counting rows per (day, price band) first is
    a small map-side aggregate; the lowest cell that is still needed becomes a scalar
    subquery, and the date part of it is pushed into the scan. Only that cell is cut by
    rank; the kept rows are sorted in as many tasks as they fill. Rows without a date are
    last. Nothing runs before the result is asked for, whatever the limit.
    """
    order = recent_first(df)
    if limit is None:
        return df.orderBy(*order)
    cells = df.groupBy(_cell().alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    # No cell is empty, so the highest n cells hold at least n rows.
    cells = cells.orderBy(F.col("cell").desc()).limit(min(limit, _MOST_CELLS))
    newer = F.sum("rows").over(W.orderBy(F.col("cell").desc())) - F.col("rows")
    needed_cells = cells.select("cell", newer.alias("newer")).filter(F.col("newer") < limit)
    last_cell = needed_cells.agg(F.min("cell").alias("cell"))
    newer_rows = needed_cells.agg(F.max("newer").alias("newer"))
    # Not written as an aggregate: Spark fuses alike subqueries into one struct, whose
    # fields it does not push down.
    lowest_needed = needed_cells.select("cell").orderBy("cell").limit(1)
    last_day = lowest_needed.select(
        F.date_from_unix_date(
            F.greatest(F.floor(F.col("cell") / F.lit(_BANDS)), F.lit(_FIRST_DAY)).cast("int")
        )
    )
    recent = df.filter((F.col("date_mutation") >= last_day.scalar()) | F.isnull("date_mutation"))
    rank = F.row_number().over(W.partitionBy("_cell").orderBy(*order))
    ranked = (
        recent.withColumn("_cell", _cell())
        .filter(F.col("_cell") >= last_cell.scalar())
        .withColumn("_rank", rank)
        # Newer cells hold fewer than n rows; stated so that map tasks can drop the rest.
        .filter(F.col("_rank") <= limit)
        .filter((F.col("_cell") > last_cell.scalar()) | (F.col("_rank") + newer_rows.scalar() <= limit))
    )
    return ranked.drop("_rank", "_cell").orderBy(*order)
