"""Interquartile-range trimming and the summaries built on it.

A limited population takes the built-in exact percentiles, which keep at most its distinct
prices; an unlimited one goes through the distributed exact quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landprice.functions.prices import truncated
from landprice.operators.quantiles import distribution

# Quantiles and the trimming factor of the report.
LOW_DECILE, LOW_QUARTILE, HIGH_QUARTILE, HIGH_DECILE = 0.1, 0.25, 0.75, 0.9
IQR_FACTOR = 1.5
MEDIAN = 0.5
_PROBABILITIES = (LOW_DECILE, LOW_QUARTILE, HIGH_QUARTILE, HIGH_DECILE)

_PRICE = "valeur_fonciere"
_PRICE_M2 = "prix_m2"


def iqr_bounds(low_quartile: Column, high_quartile: Column) -> tuple[Column, Column]:
    spread = high_quartile - low_quartile
    return (
        low_quartile - F.lit(IQR_FACTOR) * spread,
        high_quartile + F.lit(IQR_FACTOR) * spread,
    )


def within(lower: Column, upper: Column) -> Column:
    """Both ends inclusive."""
    return F.col(_PRICE).between(lower, upper)


def _bounded(rows: DataFrame, quantiles: Column) -> DataFrame:
    with_q = rows.withColumn("q", quantiles)
    lower, upper = iqr_bounds(F.col("q")[1], F.col("q")[2])
    return with_q.withColumns({"lower": lower, "upper": upper})


def _bounded_within_plan(rows: DataFrame) -> DataFrame:
    """Quantiles enter the plan as a scalar subquery; nothing runs yet."""
    wanted = F.array(*[F.lit(p) for p in _PROBABILITIES])
    return _bounded(rows, rows.agg(F.percentile(_PRICE, wanted)).scalar())


def _bounded_at_scale(rows: DataFrame) -> tuple[DataFrame, int]:
    """Quantiles are computed at once and enter the plan as literals; also the row count."""
    whole = distribution(rows, {"price": F.col(_PRICE)}, _PROBABILITIES).first()
    found = whole.price.q if whole.price else [None] * len(_PROBABILITIES)
    quantiles = F.array(*[F.lit(q).cast("double") for q in found])
    return _bounded(rows, quantiles), whole.rows


def with_bounds(rows: DataFrame, limit: int | None) -> DataFrame:
    """Adds the price quantiles ``q`` and the bounds ``lower``/``upper`` to every row."""
    return _bounded_at_scale(rows)[0] if limit is None else _bounded_within_plan(rows)


def kept_rows(bounded: DataFrame) -> DataFrame:
    return bounded.filter(within(F.col("lower"), F.col("upper")))


def outlier_rows(bounded: DataFrame) -> DataFrame:
    """The complement of the kept rows; needs no join."""
    return bounded.filter(~within(F.col("lower"), F.col("upper")))


def trimmed_summary(rows: DataFrame, limit: int | None) -> DataFrame:
    """One row: all rows counted, price statistics without outliers, integers, 0 if empty.

    Trimming looks at the price only; the price per square metre uses the same rows.
    """
    if limit is not None:
        bounded = _bounded_within_plan(rows)
        inside = within(F.col("lower"), F.col("upper"))
        price, price_m2 = F.when(inside, F.col(_PRICE)), F.when(inside, F.col(_PRICE_M2))
        statistics = bounded.agg(
            F.count(F.lit(1)).alias("nombre_transactions"),
            F.avg(price).alias("prix_moyen"),
            F.percentile(price, F.lit(MEDIAN)).alias("prix_median"),
            F.avg(price_m2).alias("prix_m2_moyen"),
            F.percentile(price_m2, F.lit(MEDIAN)).alias("prix_m2_median"),
        )
    else:
        bounded, total = _bounded_at_scale(rows)
        statistics = distribution(
            kept_rows(bounded), {"price": F.col(_PRICE), "price_m2": F.col(_PRICE_M2)}, [MEDIAN]
        ).select(
            F.lit(total).cast("bigint").alias("nombre_transactions"),
            F.col("price.mean").alias("prix_moyen"),
            F.col("price.q")[0].alias("prix_median"),
            F.col("price_m2.mean").alias("prix_m2_moyen"),
            F.col("price_m2.q")[0].alias("prix_m2_median"),
        )
    return statistics.select(
        # Output names of the summary.
        "nombre_transactions",
        F.col("nombre_transactions").alias("nombre_transactions_affiches"),
        *[
            truncated(F.col(name)).alias(name)
            for name in ("prix_moyen", "prix_median", "prix_m2_moyen", "prix_m2_median")
        ],
    )


def outlier_statistics(bounded: DataFrame) -> DataFrame:
    """One row about rows with their bounds: deciles, quartiles, bounds, and counts and price range before and after."""
    inside = within(F.col("lower"), F.col("upper"))
    kept_price = F.when(inside, F.col(_PRICE))
    return bounded.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(inside).alias("kept"),
        F.count_if(~inside).alias("outliers"),
        F.min(_PRICE).alias("min_before"),
        F.max(_PRICE).alias("max_before"),
        F.min(kept_price).alias("min_after"),
        F.max(kept_price).alias("max_after"),
        *[
            F.max(F.col("q")[i]).alias(name)
            for i, name in enumerate(("decile_low", "q1", "q3", "decile_high"))
        ],
        F.max("lower").alias("lower_bound"),
        F.max("upper").alias("upper_bound"),
    )


def sample_rows(df: DataFrame, keys: Sequence[str], count: int = 5, seed: int = 0) -> DataFrame:
    """A reproducible random sample: the rows with the smallest seeded key hashes."""
    texts = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)), *keys).limit(count)
