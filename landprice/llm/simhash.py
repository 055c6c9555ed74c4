"""SimHash near-duplicates with bit-sliced distance counting.

Two fingerprints within the radius agree on whole blocks of bits, so rows meet in buckets keyed
by those blocks. Inside a bucket bits are stored as planes, one per bit position; one bitwise
step compares thousands of pairs at that position and carry-save counters keep their distances.

Defined results: null or wordless text has fingerprint zero and links like any other; equal
fingerprints are one class; ``component_id`` is the smallest non-null id of the class (null if
all are null); a repeated row gives a repeated row; an empty table gives no rows; other columns
are not read. Buckets of any size are compared in full: a large one is split by further blocks
of its open bits, which loses no link, until its size is bounded by its few open bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from landprice.llm.batches import free_name, map_batches, raw_texts, sliced
from landprice.llm.components import components
from landprice.session import materialised

#: Differing bits up to which two fingerprints are linked.
RADIUS = 2
SHINGLE_WORDS = 3
HASH_SEED = 42
#: A bucket with more fingerprints is split by further bits before it is compared.
BUCKET_ROWS = 1024
_STEP = 1 << 15
_ALL = np.uint8(255)


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """Bits that are set in over half of the hashes of the word shingles."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six white spaces
    if not words:
        return 0
    if len(words) < words_each:
        return xxh64_intdigest(b" ".join(words), HASH_SEED)
    total = len(words) - words_each + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, total, _STEP):
        part = words[start : start + _STEP + words_each - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words_each))))
        hashes = np.fromiter((xxh64_intdigest(x, HASH_SEED) for x in shingles), np.uint64)
        counts += _bits(hashes).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * counts[i] > total)


def _bits(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per value, the lowest bit first."""
    little = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(little, axis=1, bitorder="little")


def _planes(values: np.ndarray) -> np.ndarray:
    """Plane p holds bit p of every value, eight values to a byte."""
    return np.packbits(_bits(values), axis=0, bitorder="little").T.copy()


def _later(planes: np.ndarray, by: int) -> np.ndarray:
    """Planes in which each place holds the value ``by`` places on."""
    whole, rest = divmod(by, 8)
    moved = planes[:, whole:]
    if rest:
        moved = moved >> rest
        moved[:, :-1] |= planes[:, whole + 1 :] << (8 - rest)
    return moved


def _within(planes: np.ndarray, by: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Places, as bits, whose value is within the radius of the value ``by`` places on.

    ``alive`` marks the places to compare. Counters are bit-sliced: digit k of all distances
    is one array. Every eight planes, bytes in which all distances exceed the radius drop out.
    """
    moved = _later(planes, by)
    size = moved.shape[1]
    at = np.flatnonzero(alive[:size])
    here, there, open_ = planes[:, at], moved[:, at], alive[at]
    digits = [np.zeros(len(at), np.uint8) for _ in range(radius.bit_length())]
    for plane in range(64):
        carry = here[plane] ^ there[plane]
        for k, digit in enumerate(digits):
            digits[k], carry = digit ^ carry, digit & carry
        over = carry | _exceeds(digits, radius)
        open_ = open_ & ~over
        if plane % 8 == 7:
            left = np.flatnonzero(open_)
            if len(left) < len(at):
                at, here, there = at[left], here[:, left], there[:, left]
                open_, digits = open_[left], [x[left] for x in digits]
            if not len(at):
                break
    found = np.zeros(planes.shape[1], np.uint8)
    found[at] = open_
    return found


def _exceeds(digits: list[np.ndarray], limit: int) -> np.ndarray:
    """Where the number with these bit-sliced digits is over the limit."""
    over, equal = np.uint8(0), _ALL
    for k in reversed(range(len(digits))):
        if limit >> k & 1:
            equal = equal & digits[k]
        else:
            over, equal = over | equal & digits[k], equal & ~digits[k]
    return over


def linked_roots(values: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each value, the place of the first value of its class inside its run.

    ``run`` numbers the buckets; the rows of a bucket follow each other.
    """
    n = len(values)
    root = np.arange(n)
    ends = np.searchsorted(run, run, side="right")
    at = np.flatnonzero(ends - np.arange(n) > 1 - (np.arange(n) > np.searchsorted(run, run)))
    by, planes, places = 1, None, at
    while len(places):
        if planes is None:
            part = values[places]
            limit = np.searchsorted(run[places], run[places], side="right")
            planes = _planes(part)
        live = np.arange(len(part)) + by < limit
        if not live.any():
            break
        found = _within(planes, by, np.packbits(live, bitorder="little"), radius)
        near = np.flatnonzero(np.unpackbits(found, bitorder="little", count=len(part)))
        _join(root, places[near], places[near + by])
        by += 1
        longer = limit - np.searchsorted(run[places], run[places]) > by
        if 2 * longer.sum() < len(part):
            places, planes = places[longer], None
    return root


def _join(root: np.ndarray, one: np.ndarray, other: np.ndarray) -> None:
    """Merge the classes of linked places; the smallest place stays the root."""
    while len(one):
        a, b = root[one], root[other]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return
        one, other, low, high = one[apart], other[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while not np.array_equal(root[root], root):
            root[:] = root[root]


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``text_key`` (a hash of the text) and ``fp`` (the fingerprint's bits as a signed
    long) of each row."""

    def run(batches):
        for batch in sliced(batches, "text"):
            values = np.array([fingerprint(x) for x in raw_texts(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("id", "text_key")), pa.array(values.view(np.int64))],
                ["id", "text_key", "fp"],
            )

    rows = df.select(
        df[id_column].cast("long").alias("id"), text_key(df[text]).alias("text_key"),
        df[text].cast("string").alias("text"),
    )
    return map_batches(rows, run, "id long, text_key long, fp long")


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _masks(open_bits: list[int]) -> list[tuple[int, list[int]]]:
    """Pairs of quarters of the open bits: two of four must agree if two bits may differ."""
    size = len(open_bits) // (RADIUS + 2)
    parts = [open_bits[i * size : (i + 1) * size] for i in range(RADIUS + 2)]
    chosen = []
    for pair in combinations(range(RADIUS + 2), 2):
        fixed = {bit for i in pair for bit in parts[i]}
        chosen.append((sum(1 << b for b in fixed), [b for b in open_bits if b not in fixed]))
    return chosen


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def buckets(distinct: DataFrame) -> list[DataFrame]:
    """``tag``, ``bits``, ``fp``: each pair within the radius meets in a bucket of some table.

    The tables differ by level. A bucket over the bound goes to the next level, where 16 and
    then 8 more of its bits are fixed; at the last level eight open bits leave 256 values.
    """
    tables: list[DataFrame] = []
    todo = distinct.select("fp", F.lit(0).alias("tag"))
    levels = {0: (0, list(range(64)))}
    for level in range(3):
        finer, choices = {}, []
        for tag, (mask, open_bits) in levels.items():
            for part, left in _masks(open_bits):
                finer[len(finer) + 1] = (mask | part, left)
                choices.append((tag, len(finer), _signed(mask | part)))
        by_tag: dict[int, list] = {}
        for tag, new, mask in choices:
            by_tag.setdefault(tag, []).append(
                F.struct(F.lit(new).alias("tag"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits"))
            )
        options = reduce(
            lambda rest, item: F.when(F.col("tag") == item[0], F.array(*item[1])).otherwise(rest),
            by_tag.items(),
            F.array().cast("array<struct<tag:int,bits:bigint>>"),
        )
        rows = todo.select("fp", F.inline(options))
        if level == 2:
            tables.append(rows)
            break
        rows = materialised(rows, "buckets")
        large = rows.groupBy("tag", "bits").count().filter(F.col("count") > BUCKET_ROWS).drop("count")
        large = materialised(large, "large")
        if large.isEmpty():
            tables.append(rows)
            break
        tables.append(rows.join(large, ["tag", "bits"], "left_anti"))
        todo = rows.join(large, ["tag", "bits"], "left_semi").select("fp", "tag")
        levels = finer
    return tables


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted bucket rows; a bucket may go on in the next batch."""
    kept = [np.empty(0, np.int64)] * 3
    for batch in chain(batches, [None]):
        if batch is None:
            full, kept = kept, None
        else:
            new = [batch.column(x).to_numpy() for x in ("tag", "bits", "fp")]
            full = [np.concatenate(x) for x in zip(kept, new)]
            if not len(full[0]):
                continue
            last = (full[0] == full[0][-1]) & (full[1] == full[1][-1])
            cut = len(last) - int(last.sum())
            full, kept = [x[:cut] for x in full], [x[cut:] for x in full]
        tag, bits, fp = full
        if len(fp) < 2:
            continue
        start = np.ones(len(fp), bool)
        start[1:] = (tag[1:] != tag[:-1]) | (bits[1:] != bits[:-1])
        root = linked_roots(fp.view(np.uint64), np.cumsum(start))
        moved = root != np.arange(len(fp))
        a, b = fp[moved], fp[root[moved]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]
        )


def links(distinct: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints that span the classes of every bucket."""
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = [
        map_batches(
            table.repartition(parts, "tag", "bits").sortWithinPartitions("tag", "bits", "fp"),
            _bucket_links,
            "a long, b long",
        )
        for table in buckets(distinct)
    ]
    return reduce(DataFrame.union, found).distinct()


def class_roots(rows: DataFrame) -> DataFrame:
    """``fp`` and ``root``, its class, of the distinct fingerprints in ``rows``."""
    distinct = materialised(rows.select("fp").distinct(), "distinct")
    roots = components(materialised(links(distinct), "links"))
    return distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of each row."""
    rows = materialised(fingerprints(df, id_column, text), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    classes = materialised(class_roots(rows).join(firsts, "fp"), "classes")
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_of_each(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` of each class: of its smallest id, and of rows with that id one whose
    text has the smallest hash. Nulls come last among ids."""
    rows = materialised(fingerprints(df, id_column, text), "fingerprints")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("best")
    firsts = rows.groupBy("fp").agg(best)
    kept = class_roots(rows).join(firsts, "fp").groupBy("root").agg(F.min("best").alias("best"))
    return only(df, kept.select("best"), id_column, text)


def only(df: DataFrame, kept: DataFrame, id_column: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` that ``best`` in ``kept`` names, each once. ``keep``: columns of ``kept``
    that are added."""
    names = [free_name(df, f"_kept_{i}") for i in range(3)]
    kept = materialised(kept.select(
        F.coalesce("best.id", F.lit(0)).alias(names[0]), F.col("best.none").alias(names[1]),
        F.col("best.text_key").alias(names[2]), *keep,
    ), "kept")
    own = (
        F.coalesce(df[id_column].cast("long"), F.lit(0)), df[id_column].isNull(), text_key(df[text])
    )
    keys = {free_name(df, f"_own_{i}"): x for i, x in enumerate(own)}
    on = [F.col(x) == F.col(y) for x, y in zip(keys, names)]
    # The texts are shuffled once; rows repeated as a whole meet in the join's own partition.
    named = df.withColumns(keys).join(kept, on, "inner" if keep else "left_semi")
    return named.dropDuplicates([*keys]).drop(*keys).select(*df.columns, *keep)
