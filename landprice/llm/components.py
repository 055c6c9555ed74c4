"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landprice.session import materialised


def _smallest(links: DataFrame) -> DataFrame:
    """For each node, its smallest neighbour or itself; minima are combined before the shuffle."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to, for all nodes but the roots.

    ``links`` has two columns of one type. Each round ties larger neighbours of a node, then
    its smaller ones, to the smallest; it ends when every class is a star. A node with many
    links only meets minima, and the joins are ones that adaptive execution splits. Rounds
    are written to the shared folder, so a lost executor costs one round.
    """
    a, b = links.columns
    stars = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    stars = materialised(stars.distinct(), "stars")
    state = _state(stars)
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = (
            both.join(_smallest(both), "u")
            .filter("v > u and v <> low")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        larger = materialised(larger, "stars")
        low = _smallest(larger)
        smaller = larger.join(low, "u").filter("v <> low").select("v", "low").union(low)
        stars = materialised(smaller.toDF("u", "v").distinct(), "stars")
        before, state = state, _state(stars)
        if state == before:
            return stars.toDF("node", "root")
