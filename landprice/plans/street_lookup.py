"""Substring search on street names through the three-letter postings kept beside the loads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landprice.operators.filters import keep_listed, street_search
from landprice.sources.sides import GRAM, STREETS, Snapshot, side_rows, snapshot

#: A search that finds more streets, each counted once per postal code, scans the sales instead.
NARROWED = 1_000
#: Grams of a text that are compared; few enough for the scan to skip by each of them.
COMPARED = 8
#: Ranges of postal codes handed to the scan.
RANGES = 16


def _evenly(values: Sequence[str], most: int) -> list[list[str]]:
    """Consecutive parts, at most so many, of about equal size."""
    count = min(most, len(values))
    ends = [round(i * len(values) / count) for i in range(count + 1)] if count else []
    return [list(values[a:b]) for a, b in zip(ends, ends[1:])]


def matching_streets(spark: SparkSession, now: Snapshot, text: str) -> DataFrame:
    """``adresse_nom_voie`` and ``code_postal`` of every street that holds the text.

    Read are the postings of one gram, the rarest of those compared, and verified on the name.
    """
    postings = side_rows(spark, now, STREETS)
    # Upper case as Spark understands it, like the names.
    upper = spark.range(1).select(F.upper(F.lit(text))).first()[0]
    if len(upper) < GRAM:
        near = postings.filter(F.col("gram").startswith(upper))
    else:
        grams = sorted({upper[i : i + GRAM] for i in range(len(upper) - GRAM + 1)})
        asked = [part[0] for part in _evenly(grams, COMPARED)]
        held = postings.filter(F.col("gram").isin(asked)).groupBy("gram").count().collect()
        rows = {row["gram"]: row["count"] for row in held}
        rarest = min(asked, key=lambda gram: (rows.get(gram, 0), gram))
        near = postings.filter(F.col("gram") == F.lit(rarest))
    return street_search(near, text).select("adresse_nom_voie", "code_postal").distinct()


def _in_codes(codes: Sequence[str | None]) -> Column:
    """A predicate that the scan can skip by; true for these codes, perhaps for some between."""
    known = sorted({code for code in codes if code is not None})
    ranges = [F.col("code_postal").between(x[0], x[-1]) for x in _evenly(known, RANGES)]
    if None in codes:
        ranges.append(F.col("code_postal").isNull())
    return reduce(or_, ranges, F.lit(False))


def sales_in_streets(spark: SparkSession, name: str, text: str) -> DataFrame:
    """``street_search`` of a register table: the same rows, of which few others are read.

    The streets that hold the text are found first; their names and postal codes reach the scan.
    Loads without kept postings are looked through in the plan. Empty text, which every name
    holds, and a text of more than ``NARROWED`` streets are searched in the sales.
    """
    now = snapshot(spark, name)
    sales = now.rows(spark)
    found = matching_streets(spark, now, text).limit(NARROWED + 1).collect() if text else []
    if not text or len(found) > NARROWED:
        return street_search(sales, text)
    if not found:
        return sales.filter(F.lit(False))
    near = sales.filter(_in_codes([row["code_postal"] for row in found]))
    return keep_listed(near, "adresse_nom_voie", sorted({row["adresse_nom_voie"] for row in found}))
