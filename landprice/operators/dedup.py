"""Key uniqueness where a null key part never equals anything."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from landprice.schema import KEY

#: Conflicting keys that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def complete_key(key: Sequence[str] = KEY) -> Column:
    return reduce(and_, [F.col(part).isNotNull() for part in key])


def _first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # A bare "rank = 1" filter lets Spark keep one row per key in each map task, before the
    # shuffle, so a key that fills a third of the input does not reach one reducer.
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def _near_keys(existing: DataFrame, key: Sequence[str], source: DataFrame) -> DataFrame:
    # Only existing keys between the smallest and largest first key part of the batch can
    # conflict. The bounds are scalar subqueries that reach the Parquet scan, so files whose
    # ids lie elsewhere (ids usually start with the year) are skipped, not shuffled. They are
    # written in two ways on purpose: Spark fuses alike subqueries into one struct, whose
    # fields it does not push down.
    lead = key[0]
    lowest = source.agg(F.min(lead)).scalar()
    highest = source.select(lead).orderBy(F.col(lead).desc()).limit(1).scalar()
    near = F.col(lead).between(lowest, highest)
    return existing.select(*key).filter(complete_key(key) & near)


def _absent(
    df: DataFrame, existing: DataFrame, key: Sequence[str], source: DataFrame
) -> DataFrame:
    return df.join(_near_keys(existing, key, source), list(key), "left_anti")


def keep_first(
    df: DataFrame, order: Sequence[Column], key: Sequence[str] = KEY
) -> DataFrame:
    """First row per key in the given order; rows with a null key part all stay.

    Those rows skip the window: they are most of a register, and grouping them would put
    each null pattern in one partition.
    """
    complete = complete_key(key)
    first = _first_per_key(df.filter(complete), key, order)
    return df.filter(~complete).unionByName(first)


def insert_if_absent(
    df: DataFrame, existing: DataFrame, key: Sequence[str] = KEY
) -> DataFrame:
    """Rows whose key is not in ``existing``; a null key part never conflicts."""
    complete = complete_key(key)
    keyed = df.filter(complete)
    fresh = _absent(keyed, existing, key, keyed)
    return df.filter(~complete).unionByName(fresh.select(*df.columns))


def new_rows(
    batch: DataFrame, existing: DataFrame, order: Sequence[Column], key: Sequence[str] = KEY
) -> DataFrame:
    """``keep_first`` then ``insert_if_absent``; the anti join reuses the window's shuffle."""
    complete = complete_key(key)
    keyed = batch.filter(complete)
    fresh = _absent(_first_per_key(keyed, key, order), existing, key, keyed)
    return batch.filter(~complete).unionByName(fresh.select(*batch.columns))


def conflicting_keys(
    batch: DataFrame, existing: DataFrame, key: Sequence[str] = KEY
) -> DataFrame:
    """Keys that the batch repeats or the table holds, ``held`` or not: usually few.

    Only keys are counted, in map tasks first, so neither wide rows nor a hot key are shuffled.
    """
    keyed = batch.filter(complete_key(key))
    here = keyed.select(*key, F.lit(1).alias("_own"), F.lit(0).alias("_held"))
    there = _near_keys(existing, key, keyed).select(*key, F.lit(0).alias("_own"), F.lit(1).alias("_held"))
    counts = here.unionByName(there).groupBy(*key).agg(
        F.sum("_own").alias("_own"), F.max("_held").alias("_held")
    )
    conflict = (F.col("_own") > 1) | ((F.col("_own") == 1) & (F.col("_held") == 1))
    return counts.filter(conflict).select(*key, (F.col("_held") == 1).alias("held"))


def without_conflicts(
    batch: DataFrame,
    conflicts: DataFrame,
    order: Sequence[str],
    key: Sequence[str] = KEY,
    kept: Callable[[DataFrame], DataFrame] = lambda first: first,
) -> DataFrame:
    """The rows of ``new_rows``, by the conflicts, which should be stored.

    Up to ``BROADCAST_KEYS`` of them are broadcast: the batch is scanned once for the rows without a
    conflict and none of these is sorted or shuffled. More of them are joined. ``kept`` may store the
    first rows of repeated keys, for a caller that takes the result in several jobs.
    """
    complete = complete_key(key)
    keyed = batch.filter(complete)
    few = conflicts.count() <= BROADCAST_KEYS
    side = F.broadcast(conflicts) if few else conflicts
    taken = side.select(*key)
    if few:  # a null key part equals nothing
        rest = batch.join(taken, list(key), "left_anti").select(*batch.columns)
    else:
        alone = keyed.join(taken, list(key), "left_anti").select(*batch.columns)
        rest = batch.filter(~complete).unionByName(alone)
    repeated = side.filter(~F.col("held")).select(*key)
    # Spread by place first, or one task would get all rows of a hot key from a shuffled join.
    again = keyed.join(repeated, list(key), "left_semi").select(*batch.columns).repartition(*order)
    first = _first_per_key(again, key, [F.col(part) for part in order])
    return rest.unionByName(kept(first.select(*batch.columns)))
