"""Exact top-k inner products by columnar branch and bound.

Queries and candidates meet in blocks. A block's vectors are kept by dimension; scores grow
one group of dimensions at a time. What the remaining dimensions can add is at most the product
of the remaining lengths, so candidates that cannot reach a query's k-th score drop out and the
columns of the others are compacted.

Defined results: vectors that are null or hold null or non-finite components take no part; of
equal scores the smaller id is first; a query with fewer candidates returns them all; a
candidate with the query's own id is its own row and never returned; rows repeated with one id
are one vector (the smallest); vectors of different lengths are compared as if filled up with
zeros; rows with a null id take no part; an empty table gives no rows. Scores are exact
integers; one beyond 64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landprice.llm.batches import ship
from landprice.session import materialised

NEIGHBOURS = 5
#: Vectors of a block; a task holds one block of queries and one of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 4_096, 16_384
#: Candidates that are scored together, and dimensions that are added at a time.
_ROWS, _DIMENSIONS = 2_048, 16
_EXACT = float(1 << 53)


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of whole doubles, ``floor(256 * x)``, filled up with zeros."""
    lists = vectors.combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False))
    return out


def _lengths_after(values: np.ndarray) -> np.ndarray:
    """Length of what remains of each row from each dimension group on, rounded up."""
    starts = range(0, max(1, values.shape[1]), _DIMENSIONS)
    sums = [np.sqrt((values[:, s:].astype(np.float64) ** 2).sum(axis=1)) for s in starts]
    return np.array([*sums, np.zeros(len(values))]) * (1 + 1e-9)


def best_scores(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """The k best (query id, id, score) of each query among the candidates of a block."""
    if not len(ids) or not len(query_ids):
        return []
    largest = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0)
    if largest * max(1, queries.shape[1]) >= _EXACT:
        # Too large for exact doubles: whole integers, all pairs of the block.
        whole_q = [[int(v) for v in row] for row in queries]
        whole_c = [[int(v) for v in row] for row in vectors]
        out = []
        for own, q in zip(query_ids.tolist(), whole_q):
            found = [(-sum(a * b for a, b in zip(q, c)), i)
                     for i, c in zip(ids.tolist(), whole_c) if i != own]
            out += [(own, i, -score) for score, i in sorted(found)[:k]]
        return out
    # The longest vectors first, so that the k-th scores rise early.
    tail = _lengths_after(vectors)
    order = np.argsort(-tail[0], kind="stable")
    ids, vectors, tail = ids[order], vectors[order], tail[:, order]
    query_tail = _lengths_after(queries)
    groups = [slice(s, s + _DIMENSIONS) for s in range(0, max(1, queries.shape[1]), _DIMENSIONS)]
    kept_ids = [np.empty(0, np.int64)] * len(query_ids)
    kept_scores = [np.empty(0)] * len(query_ids)
    least = np.full(len(query_ids), -np.inf)
    for start in range(0, len(ids), _ROWS):
        part = slice(start, start + _ROWS)
        columns = np.ascontiguousarray(vectors[part].T)
        part_ids, part_tail = ids[part], tail[:, part]
        hopeful = np.flatnonzero(query_tail[0] * part_tail[0].max() >= least)
        if not len(hopeful):
            break
        first = queries[hopeful][:, groups[0]] @ columns[groups[0]]
        for row, q in enumerate(hopeful.tolist()):
            score = first[row]
            at = np.flatnonzero(score + query_tail[1, q] * part_tail[1] >= least[q])
            score = score[at]
            for g, group in enumerate(groups[1:], 2):
                if not len(at):
                    break
                score = score + queries[q, group] @ columns[group][:, at]
                alive = np.flatnonzero(score + query_tail[g, q] * part_tail[g, at] >= least[q])
                if len(alive) < len(at):
                    at, score = at[alive], score[alive]
            own = part_ids[at] != query_ids[q]
            if not own.any():
                continue
            score = np.concatenate([kept_scores[q], score[own]])
            names = np.concatenate([kept_ids[q], part_ids[at[own]]])
            best = np.lexsort((names, -score))[:k]
            kept_scores[q], kept_ids[q] = score[best], names[best]
            if len(best) == k:
                least[q] = score[best[-1]]
    return [
        (int(own), int(i), int(s))
        for own, names, scores in zip(query_ids, kept_ids, kept_scores)
        for i, s in zip(names, scores)
    ]


def _block_pair(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = left["vector"], right["vector"]
        width = max(pc.max(pc.list_value_length(x)).as_py() or 0 for x in (q, c))
        found = best_scores(
            left["id"].to_numpy(), _matrix(q, width), right["id"].to_numpy(), _matrix(c, width), k
        )
        fields = list(zip(*found)) if found else [[]] * 3
        names = ("query_id", "vec_id", "score")
        return pa.table({n: pa.array(list(x), pa.int64()) for n, x in zip(names, fields)})

    return run


def nearest(
    vectors: DataFrame, is_query: Column, id_column: str, vector: str, k: int = NEIGHBOURS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best of each query row.

    Every block of queries goes to every block of candidates, so a task's memory is set by the
    block sizes, and only k rows per query and block are shuffled on. Blocks are dealt by a
    hash of the id, so equal vectors are spread.
    """
    ship(vectors)
    value = vectors[vector]
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(value.isNotNull() & finite & vectors[id_column].isNotNull()).select(
        vectors[id_column].cast("long").alias("id"),
        value.cast("array<double>").alias("vector"),
        is_query.alias("asks"),
    )
    usable = usable.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    usable = materialised(usable, "vectors")
    counts = usable.agg(F.count("*").alias("all"), F.count_if("asks").alias("asking")).first()
    query_blocks = max(1, -(-counts["asking"] // QUERY_BLOCK))
    # At least one block for each task.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-counts["all"] // CANDIDATE_BLOCK), -(-parts // query_blocks))

    def block(number: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    asking = usable.filter("asks").select(
        "id", "vector", block(query_blocks).alias("q"), every(blocks).alias("c")
    )
    others = usable.select("id", "vector", block(blocks).alias("c"), every(query_blocks).alias("q"))
    found = (
        asking.groupBy("q", "c")
        .cogroup(others.groupBy("q", "c"))
        .applyInArrow(_block_pair(k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
