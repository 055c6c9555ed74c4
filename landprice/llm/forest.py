"""Approximate nearest neighbours by a forest of random-projection trees.

A tree projects vectors on random orthogonal directions, one per level, and cuts each node at the
median of a bounded sample. A query walks all trees through one priority queue: the next node is
the one that most probably holds a neighbour, by a normal model of the neighbours' projections
given their inner product with the query. It stops when the leaves taken hold a neighbour with
probability ``TARGET``, so the share of leaves read follows the data and not a fixed cap. The rows
of these leaves are then scored exactly.

Leaves are gathered in shards of bounded size, a shard is one partition: its candidates come first
and stay, queries stream past them with the list of leaves they want. Candidates are shuffled once
per tree, queries once per shard they visit.

Defined results: vectors that are null, zero or hold null or non-finite components take no part;
rows with a null id take no part; rows repeated with one id are one vector (the smallest); equal
vectors are one candidate that keeps the ids that can be returned (the ``k + 1`` smallest), so a
vector that fills a third of the table is one row of its leaf and none of its ids is lost; of equal
scores the smaller id is first; vectors of different lengths are compared as if filled up with
zeros; a query with fewer candidates returns all; an empty table gives no rows. The score is the
sum of products in the order of the components, in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landprice.llm.batches import map_batches
from landprice.session import materialised

NEIGHBOURS = 20
TREES = 4
#: Rows of a leaf, while the sample can tell so many leaves apart.
LEAF_ROWS = 256
#: Vectors that the trees are fitted on; every vector is indexed. A leaf has this many of them.
SAMPLE_ROWS, SAMPLE_LEAF = 16_384, 16
#: Probability, under the model, with which each neighbour lies in a leaf that is read.
TARGET = 0.96
#: Candidates of a shard.
SHARD_ROWS = 65_536
#: Queries that are searched or scored at a time.
_QUERIES = 512
_SMALL = 1e-9


@dataclass(frozen=True)
class Forest:
    """``directions``: tree, level, component. ``cuts``: tree, inner node (root at 1)."""

    directions: np.ndarray
    cuts: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray
    sample: np.ndarray
    rows: int

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def projections(self, vectors: np.ndarray) -> np.ndarray:
        """Row, tree, level."""
        return np.einsum("nd,tld->ntl", vectors, self.directions, optimize=True)

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        heights = self.projections(vectors)
        node = np.ones(heights.shape[:2], np.int64)
        tree = np.arange(TREES)
        for level in range(self.depth):
            node = 2 * node + (heights[:, :, level] > self.cuts[tree, node])
        return node - self.leaves


def fit(sample: np.ndarray, rows: int, seed: int = 7) -> Forest:
    """Trees for ``rows`` vectors from a sample of them."""
    width = sample.shape[1]
    most = min(rows / LEAF_ROWS, len(sample) / SAMPLE_LEAF)
    depth = min(width, max(0, int(np.log2(max(1.0, most)))))
    random = np.random.default_rng(seed)
    directions = np.empty((TREES, depth, width))
    for tree in range(TREES):
        directions[tree] = np.linalg.qr(random.normal(size=(width, max(1, depth))))[0].T[:depth]
    cuts = np.zeros((TREES, 1 << depth))
    for tree in range(TREES):
        node = np.ones(len(sample), np.int64)
        for level in range(depth):
            heights = sample @ directions[tree, level]
            order = np.lexsort((heights, node))
            first = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
            for n, (a, b) in enumerate(zip(first[:-1], first[1:]), 1 << level):
                if b > a:
                    cuts[tree, n] = np.median(heights[order[a:b]])
            node = 2 * node + (heights > cuts[tree, node])
    mean = sample.mean(axis=0)
    centred = sample - mean
    covariance = centred.T @ centred / len(sample)
    return Forest(directions, cuts, mean, covariance, sample[: SAMPLE_ROWS // 4], rows)


def _reached(forest: Forest, queries: np.ndarray, k: int) -> np.ndarray:
    """About the k-th best score of each query among all rows.

    The k-th best in the sample is a lower bound. Beyond the sample a normal tail is followed,
    bent so that no score passes the product of the lengths.
    """
    scores = queries @ forest.sample.T
    share = min(0.5, k / max(k + 1, forest.rows))
    best = np.partition(scores, -min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])]
    spread = scores.std(axis=1) + _SMALL
    lengths = np.linalg.norm(queries, axis=1) * np.sqrt((forest.sample**2).sum(axis=1).mean())
    freedom = np.maximum(1.0, (lengths / spread) ** 2)
    z = NormalDist().inv_cdf(1 - share)
    tail = scores.mean(axis=1) + spread * np.sqrt(freedom * -np.expm1(-(z**2) / freedom))
    return np.maximum(best, tail)


def _upward(forest: Forest, queries: np.ndarray, k: int) -> np.ndarray:
    """Probability that a neighbour which comes to a node goes to its upper side."""
    reached = _reached(forest, queries, k)
    seen = queries @ forest.covariance  # covariance of each component with the score
    variance = (seen * queries).sum(axis=1) + _SMALL
    excess = (reached - queries @ forest.mean) / variance
    shared = np.einsum("qd,tld->qtl", seen, forest.directions, optimize=True)
    height = np.einsum("d,tld->tl", forest.mean, forest.directions) + shared * excess[:, None, None]
    own = np.einsum("tld,de,tle->tl", forest.directions, forest.covariance, forest.directions)
    spread = np.sqrt(np.maximum(own - shared**2 / variance[:, None, None], 0.02 * own) + _SMALL)
    level = np.frexp(np.arange(forest.leaves))[1] - 1  # of each inner node
    level[0] = 0
    # 1.702 makes the logistic curve a close stand-in for the normal one.
    x = 1.702 * (height[:, :, level] - forest.cuts) / spread[:, :, level]
    return np.clip(1 / (1 + np.exp(-np.clip(x, -40, 40))), _SMALL, 1 - _SMALL)


def wanted_leaves(forest: Forest, queries: np.ndarray, k: int, target: float) -> list[list[tuple[int, int]]]:
    """The (tree, leaf) pairs that each query reads, likeliest first."""
    if not forest.depth:
        return [[(0, 0)]] * len(queries)
    up = _upward(forest, queries, k)
    log_up, log_down = -np.log(up), -np.log1p(-up)
    leaves = forest.leaves
    out = []
    for high, low in zip(log_up, log_down):
        high, low = high.tolist(), low.tolist()
        queue = [(0.0, tree, 1) for tree in range(TREES)]
        missed, taken = [1.0] * TREES, []
        while queue:
            cost, tree, node = heapq.heappop(queue)
            above, below = high[tree], low[tree]
            while node < leaves:
                a, b = above[node], below[node]
                node *= 2
                if a < b:
                    heapq.heappush(queue, (cost + b, tree, node))
                    cost, node = cost + a, node + 1
                else:
                    heapq.heappush(queue, (cost + a, tree, node + 1))
                    cost += b
            taken.append((tree, node - leaves))
            missed[tree] -= np.exp(-cost)
            left = 1.0
            for x in missed:
                left *= max(x, 0.0)
            if left <= 1 - target:
                break
        out.append(taken)
    return out


@dataclass(frozen=True)
class Shards:
    """Shards of whole leaves, or of blocks of one leaf where leaves are larger than a shard."""

    per_tree: int
    leaves: int

    @property
    def blocks(self) -> int:
        return max(1, -(-self.per_tree // self.leaves))

    @property
    def count(self) -> int:
        return TREES * (self.leaves * self.blocks if self.blocks > 1 else self.per_tree)

    def first(self, tree: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The shard of a leaf, the first of its blocks."""
        if self.blocks > 1:
            return (tree * self.leaves + leaf) * self.blocks
        return tree * self.per_tree + leaf * self.per_tree // self.leaves


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _wide(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


_ROUTED = "shard int, asks boolean, leaves array<int>, id long, ids array<long>, vector array<double>"
_FOUND = "query_id long, vec_id long, score double"


def _dealt(forest: Forest, shards: Shards, width: int, k: int, target: float):
    """Routes distinct vectors: each to its shard in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = np.arange(TREES) if forest.depth else np.arange(1)
        for whole in batches:
            for start in range(0, whole.num_rows, 4 * _QUERIES):
                batch = whole.slice(start, 4 * _QUERIES)
                vectors = _matrix(batch.column("vector"), width)
                leaf = forest.leaves_of(vectors)[:, : len(trees)]
                block = np.array(batch.column("id").to_numpy() % shards.blocks)
                shard = shards.first(trees, leaf) + block[:, None]
                rows = np.repeat(np.arange(batch.num_rows), len(trees))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(shard.ravel().astype(np.int32)),
                    "asks": pa.array(np.zeros(len(rows), bool)),
                    "leaves": _wide(leaf.reshape(-1, 1).astype(np.int32)),
                    "id": batch.column("id").take(pa.array(rows)),
                    "ids": batch.column("ids").take(pa.array(rows)),
                    "vector": _wide(vectors[rows]),
                })

    return run


def _asked(forest: Forest, shards: Shards, width: int, k: int, target: float):
    """Routes queries: each to all shards that hold a leaf it wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _QUERIES):
                batch = whole.slice(start, _QUERIES)
                vectors = _matrix(batch.column("vector"), width)
                rows, places, lists = [], [], []
                for row, taken in enumerate(wanted_leaves(forest, vectors, k, target)):
                    tree, leaf = np.array(taken).T
                    by_shard: dict[int, list[int]] = {}
                    for first, name in zip(shards.first(tree, leaf).tolist(), leaf.tolist()):
                        for block in range(shards.blocks):
                            by_shard.setdefault(first + block, []).append(name)
                    rows += [row] * len(by_shard)
                    places += by_shard
                    lists += by_shard.values()
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(places, pa.int32()),
                    "asks": pa.array(np.ones(len(rows), bool)),
                    "leaves": pa.array(lists, pa.list_(pa.int32())),
                    "id": batch.column("id").take(pa.array(rows, pa.int64())),
                    "ids": pa.nulls(len(rows), pa.list_(pa.int64())),
                    "vector": _wide(vectors[rows]),
                })

    return run


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows, added in the order of the components."""
    out = np.zeros(len(left))
    for a, b in zip(left.T, right.T):
        out += a * b
    return out


def best_in_leaves(
    queries: np.ndarray, wants: list[list[int]], leaf: np.ndarray, vectors: np.ndarray,
    smallest: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best candidates of each query in its leaves.

    ``leaf`` is sorted. Fast products choose with room for their rounding, exact ones rank.
    """
    asking: dict[int, list[int]] = {}
    for row, names in enumerate(wants):
        for name in names:
            asking.setdefault(name, []).append(row)
    room = 1e-12 * (np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1])
    least = np.full(len(queries), -np.inf)
    rows, columns, scores = [], [], []
    for name, asks in asking.items():
        a, b = np.searchsorted(leaf, (name, name + 1))
        if a == b:
            continue
        asks = np.array(asks)
        product = queries[asks] @ vectors[a:b].T
        if b - a >= k:
            reached = np.partition(product, b - a - k, axis=1)[:, b - a - k]
            least[asks] = np.maximum(least[asks], reached)
        row, column = np.nonzero(product >= least[asks, None] - room)
        rows.append(asks[row])
        columns.append(column + a)
        scores.append(product[row, column])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, column, score = (np.concatenate(x) for x in (rows, columns, scores))
    hopeful = score >= least[row] - room
    row, column = row[hopeful], column[hopeful]
    score = exact_scores(queries[row], vectors[column])
    order = np.lexsort((smallest[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k], score[rank < k]


def _searched(width: int, k: int):
    """One partition is one shard: candidates by leaf, then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index = None
        for whole in batches:
            asks = whole.column("asks").to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(asks, True))
            if split:
                held.append(whole.slice(0, split))
            if split == whole.num_rows or not held:
                continue
            if index is None:
                table = pa.Table.from_batches(held).combine_chunks()
                leaf = table["leaves"].combine_chunks().flatten().to_numpy()
                order = np.argsort(leaf, kind="stable")
                table = table.take(pa.array(order))
                index = (
                    leaf[order], _matrix(table["vector"].combine_chunks(), width),
                    table["id"].to_numpy(), table["ids"].combine_chunks(),
                )
            leaf, vectors, smallest, ids = index
            for start in range(split, whole.num_rows, _QUERIES):
                batch = whole.slice(start, _QUERIES)
                row, column, score = best_in_leaves(
                    _matrix(batch.column("vector"), width), batch.column("leaves").to_pylist(),
                    leaf, vectors, smallest, k,
                )
                lists = ids.take(pa.array(column))
                each = np.repeat(np.arange(len(row)), np.diff(lists.offsets.to_numpy()))
                query = batch.column("id").to_numpy()[row][each]
                found = lists.flatten().to_numpy()
                other = query != found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[other]) for x in (query, found, score[each])],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def usable_vectors(df: DataFrame, is_query: Column, id_column: str, vector: str) -> DataFrame:
    """``id``, ``vector`` (doubles) and ``asks`` of the rows that take part, one for each id."""
    value = df[vector]
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists(value, lambda x: x != 0) & df[id_column].isNotNull()
    rows = df.filter(value.isNotNull() & usable).select(
        df[id_column].cast("long").alias("id"),
        value.cast("array<double>").alias("vector"),
        is_query.alias("asks"),
    )
    return rows.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))


def _sampled(rows: DataFrame, total: int, width: int) -> np.ndarray:
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(1, total))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    table = rows.filter(drawn).select("vector").limit(SAMPLE_ROWS).toArrow()
    lists = table["vector"].combine_chunks()
    return _matrix(lists, width)


def nearest(
    df: DataFrame, is_query: Column, id_column: str, vector: str,
    k: int = NEIGHBOURS, target: float = TARGET,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best found for each query row."""
    spark = df.sparkSession
    usable = materialised(usable_vectors(df, is_query, id_column, vector), "vectors")
    # A bare rank filter keeps k + 1 rows of a vector in each map task, before the shuffle.
    same = Window.partitionBy("vector").orderBy("id")
    first = usable.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    distinct = first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = distinct.select(F.col("ids")[0].alias("id"), "ids", "vector")
    distinct = materialised(distinct, "vectors")
    size = distinct.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("width")).first()
    if not size["rows"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = size["width"]
    forest = fit(_sampled(distinct, size["rows"], width), size["rows"])
    # At least one shard for each task, as far as there are leaves.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(-(-size["rows"] // SHARD_ROWS), min(forest.leaves, -(-parts // TREES)))
    shards = Shards(wanted, forest.leaves)
    options = (forest, shards, width, k + 1, target)
    candidates = map_batches(distinct, _dealt(*options), _ROUTED)
    asking = usable.filter("asks").select("id", "vector")
    queries = map_batches(asking, _asked(*options), _ROUTED)
    # The shard is the partition: no two shards meet in one task, none is merged with another.
    routed = candidates.unionByName(queries).repartitionById(shards.count, F.col("shard"))
    found = map_batches(routed.sortWithinPartitions("asks"), _searched(width, k + 1), _FOUND)
    # Trees find a candidate again, with the same score: equal ranks are one result.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= k)
    return ranked.dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")
