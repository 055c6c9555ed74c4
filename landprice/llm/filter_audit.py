"""How five document filters interact, over every order in which they can be applied.

A document's five outcomes are one of 32 cells, so each part of the table is a count tensor of
shape 2x2x2x2x2, one axis per filter with pass at 0 and fail at 1. Every step of every order is a
contraction of that tensor: each axis is met with "pass", "fail" or "all". Spark counts the cells;
the tensors are all that is left to contract, whatever the number of documents.

Filters (words are maximal runs without the six ASCII white spaces): A fewer than 200 words; B
fewer distinct words than half the words; C more than 2 % of the characters are ``A-Z``; D holds
one of ``#$%&*|``; E identical to the text of a smaller id anywhere in the table.

Defined results: a null text is empty and so identical to other empty texts; a null part is the
empty string; a row without an id is never E and has no labels; rows repeated with one id are
counted each, and none of them is smaller than the other; a document is good or toxic if any row
of ``labels`` with its id says so; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landprice.llm.batches import map_batches
from landprice.session import materialised

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Least share of distinct words and largest share of capitals, in percent.
MIN_DISTINCT, MAX_CAPITALS = 50, 2
SYMBOLS = "[#$%&*|]"
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: What is counted in a cell; each is an own slice of the tensor.
MEASURES = ("documents", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose tensors are contracted at once.
_PARTS = 64

ORDERS = ["".join(order) for order in permutations(FILTERS)]
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in COUNTS)


def text_outcomes(text: Column) -> Column:
    """Filters A to D of a text as bits 0 to 3."""
    words = F.array_remove(F.split(text, WHITE_SPACE), "")

    def bits(words: Column) -> Column:
        failed = (
            F.size(words) < MIN_WORDS,
            100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
            100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", "")))
            > MAX_CAPITALS * F.length(text),
            text.rlike(SYMBOLS),
        )
        return reduce(
            Column.__add__, [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)]
        )

    # One lambda variable, so that the text is cut into words once.
    return F.element_at(F.transform(F.array(words), bits), 1)


def cell_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``cell`` (bits A to E) and how many documents, good and toxic ones it holds.

    Texts are replaced by a digest in the scan and nothing longer is shuffled. Every grouping
    combines before its shuffle and the first id of a text is joined to counts, not to documents,
    so a text, part or id that fills a third of the table is a few rows in each join.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("id"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text_outcomes(text).alias("bits"),
    )
    counted = materialised(
        rows.groupBy("id", "part", "digest", "bits").agg(F.count("*").alias("n")), "outcomes"
    )
    marks = (
        labels.select(
            labels["doc_id"].cast("long").alias("id"),
            (labels["quality"] == 1).alias("good"),
            (labels["toxic"] == 1).alias("toxic"),
        )
        .filter("id IS NOT NULL")
        .groupBy("id")
        .agg(*[F.coalesce(F.max(x), F.lit(False)).alias(x) for x in MEASURES[1:]])
    )
    named = counted.filter("id IS NOT NULL").join(marks, "id", "left")
    group = ("digest", "bits", "part", "good", "toxic")
    sums = (
        named.select(
            "id", "n", *group[:3], *[F.coalesce(x, F.lit(False)).alias(x) for x in MEASURES[1:]]
        )
        .groupBy(*group)
        .agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    )
    sums = materialised(sums, "outcomes")
    firsts = sums.groupBy("digest").agg(F.min("first.id").alias("first_id"))
    originals = F.when(F.col("first.id") == F.col("first_id"), F.col("first.n")).otherwise(0)
    split = sums.join(firsts, "digest").select(
        "part", "bits", "good", "toxic",
        F.explode(F.array(
            F.struct(F.lit(0).alias("copy"), originals.alias("n")),
            F.struct(F.lit(1).alias("copy"), (F.col("n") - originals).alias("n")),
        )).alias("x"),
    )
    known = split.select(
        "part", (F.col("bits") + 16 * F.col("x.copy")).alias("cell"), "x.n", "good", "toxic"
    )
    nameless = counted.filter("id IS NULL").select(
        "part", F.col("bits").alias("cell"), "n",
        F.lit(False).alias("good"), F.lit(False).alias("toxic"),
    )
    measures = [
        F.sum("n").alias("documents"),
        *[F.sum(F.when(F.col(x), F.col("n")).otherwise(0)).alias(x) for x in MEASURES[1:]],
    ]
    return known.unionByName(nameless).groupBy("part", "cell").agg(*measures)


def _selectors() -> dict[str, np.ndarray]:
    """For every step of every order and each axis: which outcomes each count takes in.

    A step keeps what passes its filter and all before, removes what fails it after passing those
    before; later filters do not matter. What fails it anyway, and what fails nothing else, do
    not depend on the order.
    """
    out: dict[str, list] = {"kept": [], "removed": [], "failing": [], "alone": []}
    for order in ORDERS:
        for step, own in enumerate(order):
            before = order[:step]
            out["kept"].append([_PASS if x in before or x == own else _ALL for x in FILTERS])
            out["removed"].append(
                [_FAIL if x == own else _PASS if x in before else _ALL for x in FILTERS]
            )
            out["failing"].append([_FAIL if x == own else _ALL for x in FILTERS])
            out["alone"].append([_FAIL if x == own else _PASS for x in FILTERS])
    return {name: np.array(x, np.int64) for name, x in out.items()}


def contracted(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by part (first axis) and step of each order, from tensors of shape
    (parts, 2, 2, 2, 2, 2, measures)."""

    def meet(selectors: np.ndarray) -> np.ndarray:
        axes = [selectors[:, axis] for axis in range(len(FILTERS))]
        return np.einsum("pabcdem,sa,sb,sc,sd,se->psm", tensors, *axes, optimize=True)

    chosen = _selectors()
    removed = meet(chosen["removed"])
    out = {
        "kept": meet(chosen["kept"])[..., 0],
        "removed": removed[..., 0],
        "redundant": meet(chosen["failing"])[..., 0] - removed[..., 0],
        "unique_fails": meet(chosen["alone"])[..., 0],
        "good_lost": removed[..., 1],
        "toxic_lost": removed[..., 2],
    }
    letters = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    each = np.eye(len(FILTERS), dtype=np.int64)[letters]
    out["shapley"] = np.einsum("ps,sf,tf->pt", out["removed"], each, each, optimize=True)
    return out


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = [order for order in ORDERS for _ in FILTERS]
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    for whole in batches:
        for start in range(0, whole.num_rows, _PARTS):
            batch = whole.slice(start, _PARTS)
            parts = batch.num_rows
            tensors = np.zeros((parts, 32, len(MEASURES)), np.int64)
            for row, cells in enumerate(batch.column("cells").to_pylist()):
                for x in cells:
                    tensors[row, x["cell"]] = [x[name] for name in MEASURES]
            # The lowest bit of a cell is filter A, the first axis.
            shaped = tensors.reshape(parts, 2, 2, 2, 2, 2, -1).transpose(0, 5, 4, 3, 2, 1, 6)
            counts = contracted(shaped)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": batch.column("part").take(pa.array(np.repeat(np.arange(parts), len(steps)))),
                    "filter_order": pa.array(orders * parts),
                    "step": pa.array(np.tile(steps, parts)),
                    **{name: pa.array(counts[name].ravel()) for name in COUNTS},
                }
            )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    cells = cell_counts(docs, labels)
    parts = cells.groupBy("part").agg(
        F.collect_list(F.struct("cell", *MEASURES)).alias("cells")  # 32 at most
    )
    return map_batches(parts, _audited, _SCHEMA)


def oracle_sql() -> str:
    """The same counts from plain SQL: each order is walked document class by document class."""
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))
    fails = " + ".join(
        f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END"
        for i, condition in enumerate((
            f"len(words) < {MIN_WORDS}",
            f"100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words)",
            f"100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text)",
            f"regexp_matches(text, '{SYMBOLS}')",
            "doc_id > first_id",
        ))
    )
    return rf"""
WITH filters(letter, bit) AS (VALUES {letters}),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM filters a, filters b, filters c, filters d, filters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, own.letter, own.bit,
           CAST(coalesce((SELECT sum(x.bit) FROM filters x
               WHERE instr(filter_order, x.letter) < step), 0) AS INTEGER) AS earlier
    FROM orders, range(1, 6) s(step), filters own
    WHERE substr(filter_order, step, 1) = own.letter
), texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
    FROM documents
), marks AS (
    SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, {fails} AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM texts LEFT JOIN marks USING (doc_id)
), classes AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM failed GROUP BY part, mask
), counts AS (
    SELECT part, filter_order, step, letter,
           sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM classes, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counts
"""
