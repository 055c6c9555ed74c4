"""Periodic runs of words, found by uniting suffix classes in descending order of their LCP.

The suffixes of a text are sorted; neighbours in that order share a longest common prefix (LCP).
Going through these from the longest down, union-find joins neighbouring classes, and each class
keeps the ordered set of its positions. When two classes meet at level ``l``, positions that
become neighbours in the joined set, ``i`` and ``i + q``, share exactly ``l`` words: a stretch of
``l + q`` words with period ``q``. It is a run if no word before ``i`` extends it. No position
lies between the two, so no smaller period fits, and each run is met once.

Runs have at least four periods and six words, so LCPs under five words seed none and are left out.

Defined results: words are maximal runs of bytes other than the six ASCII white spaces; a null,
empty or blank text has no words and no runs; a text's result does not depend on other rows, so
repeated rows repeat it; a text of any length is taken whole, a task holds about ten numbers a
word of a slice of texts or of its longest text; an empty table gives no rows; other columns are
not read. A row without an id gets no planted repetition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landprice.llm.batches import map_batches, raw_texts, sliced

#: A run has at least this many words and this many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: The least LCP that can seed a run: the smallest of ``max(6, 4q) - q``.
_LEAST_LCP = min(max(MIN_WORDS, MIN_PERIODS * q) - q for q in range(1, MIN_WORDS + 1))
#: Words that pairs are compared by at a time.
_STRIDE = 16
#: A slice of texts; a longer text is a slice of its own.
_BYTES = 2 << 20

Run = tuple[int, int, int]


def word_numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, equal for equal words of one text only, each text followed by a
    number of its own; and where each text starts, with the end of the last."""
    numbers: list[int] = []
    starts = [0]
    following = count()
    for words in texts:
        known: defaultdict[bytes, int] = defaultdict(following.__next__)
        numbers.extend(map(known.__getitem__, words))
        numbers.append(next(following))
        starts.append(len(numbers))
    return np.array(numbers, np.int64), np.array(starts, np.int64)


def suffix_ranks(numbers: np.ndarray) -> np.ndarray:
    """Rank of each suffix by prefix doubling; a rank that is unique is not sorted again."""
    total = len(numbers)
    counts = np.bincount(numbers)
    ranks = (np.cumsum(counts) - counts)[numbers]
    open_ = np.flatnonzero(counts[numbers] > 1)
    width = 1
    while len(open_):
        # Suffixes of one rank share ``width`` words of one text, so the text's own end is at
        # most at the next place and nothing is read beyond the last text.
        keys = ranks[open_] * (total + 1) + ranks[open_ + width]
        order = np.argsort(keys, kind="stable")
        open_, keys = open_[order], keys[order]
        old = ranks[open_]
        place = np.arange(len(open_))
        new_group = np.ones(len(open_), bool)
        new_group[1:] = old[1:] != old[:-1]
        new_key = np.ones(len(open_), bool)
        new_key[1:] = keys[1:] != keys[:-1]
        group_start = np.maximum.accumulate(np.where(new_group, place, 0))
        key_start = np.maximum.accumulate(np.where(new_key, place, 0))
        ranks[open_] = old + key_start - group_start
        alone = new_key & np.append(new_key[1:], True)
        open_ = open_[~alone]
        width *= 2
    return ranks


def _common(numbers: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Words that the suffixes at each pair of places share, a stride of words at a time."""
    # The last text's own number ends every comparison; padding only makes strides readable.
    padded = np.append(numbers, np.full(_STRIDE, -1))
    stride = np.arange(_STRIDE)
    out = np.zeros(len(left), np.int64)
    todo = np.arange(len(left))
    while len(todo):
        done = out[todo]
        i, j = left[todo] + done, right[todo] + done
        differs = padded[i[:, None] + stride] != padded[j[:, None] + stride]
        first = differs.argmax(axis=1)
        whole = ~differs.any(axis=1)
        out[todo] = done + np.where(whole, _STRIDE, first)
        todo = todo[whole]
    return out


def neighbour_lcps(
    numbers: np.ndarray, ranks: np.ndarray, least: int = _LEAST_LCP
) -> tuple[np.ndarray, np.ndarray]:
    """Ranks whose suffix shares ``least`` words or more with the one before, and how many.

    If the words before both places are equal too, the pair of places before is a neighbouring
    pair with one word more. Only the other pairs are compared word by word; their LCPs sum to
    ``n log n`` at most.
    """
    places = np.empty(len(ranks), np.int64)
    places[ranks] = np.arange(len(ranks))
    at = np.arange(1, len(ranks))
    for step in range(least):
        at = at[numbers[places[at] + step] == numbers[places[at - 1] + step]]
    right, left = places[at], places[at - 1]
    order = np.argsort(right)
    at, right, left = at[order], right[order], left[order]
    first = (np.minimum(left, right) == 0) | (numbers[right - 1] != numbers[left - 1])
    base = np.flatnonzero(first)
    shared = np.zeros(len(at), np.int64)
    shared[base] = _common(numbers, left[base], right[base])
    source = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return at, shared[source] - (right - right[source])


def _united(
    small: list[int], large: list[int], level: int, numbers: list[int], found: list[Run]
) -> list[int]:
    """Both position sets as one; runs seeded by newly adjacent positions go to ``found``."""
    for k, x in enumerate(small):
        at = bisect_left(large, x)
        pairs = []
        if at and (k == 0 or small[k - 1] < large[at - 1]):
            pairs.append((large[at - 1], x))
        if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
            pairs.append((x, large[at]))
        for i, j in pairs:
            period = j - i
            if level + period >= max(MIN_WORDS, MIN_PERIODS * period) and (
                i == 0 or numbers[i - 1] != numbers[j - 1]
            ):
                found.append((i, level + period, period))
    if 16 * len(small) < len(large):
        for x in small:
            insort(large, x)
    else:
        large += small
        large.sort()
    return large


def all_runs(numbers: np.ndarray) -> list[Run]:
    """(start, length, period) of each run in texts numbered by ``word_numbers``."""
    ranks = suffix_ranks(numbers)
    at, shared = neighbour_lcps(numbers, ranks)
    if not len(at):
        return []
    places = np.empty(len(ranks), np.int64)
    places[ranks] = np.arange(len(ranks))
    order = np.argsort(-shared, kind="stable")
    words = numbers.tolist()
    sets: dict[int, list[int]] = {}
    parent: dict[int, int] = {}

    def root(rank: int) -> int:
        while (above := parent.setdefault(rank, rank)) != rank:
            parent[rank] = parent[above]
            rank = above
        return rank

    found: list[Run] = []
    for rank, level, here, before in zip(
        at[order].tolist(), shared[order].tolist(),
        places[at[order]].tolist(), places[at[order] - 1].tolist(),
    ):
        a, b = root(rank), root(rank - 1)
        one, other = sets.pop(a, None) or [here], sets.pop(b, None) or [before]
        if len(one) > len(other):
            a, b, one, other = b, a, other, one
        parent[a] = b
        sets[b] = _united(one, other, level, words, found)
    return found


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text by start, then period."""
    numbers, starts = word_numbers(texts)
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, period in sorted(all_runs(numbers)) if len(texts) else ():
        text = int(np.searchsorted(starts, start, side="right")) - 1
        out[text].append((start - int(starts[text]), length, period))
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period : start + length] = b"\x01" * (length - period)
    return [word for word, gone in zip(words, dropped) if not gone] if runs else words


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, from some place on repeated with one period in a tenth of the documents."""
    if doc_id is None or not words:
        return words
    number = zlib.crc32(str(doc_id).encode())
    if number % 10:
        return words
    rest = number // 10
    start = rest % len(words)
    period = 1 + (len(words) - start) // (3 + rest % 8)
    piece = words[start : start + period]
    left = len(words) - start
    return words[:start] + (piece * (left // period + 1))[:left]


_REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _found(batches: Iterator[pa.RecordBatch], plant: bool):
    for batch in sliced(batches, "text", _BYTES):
        ids = batch.column("id").to_pylist()
        texts = [text.split() for text in raw_texts(batch, "text")]  # of bytes: six white spaces
        if plant:
            texts = [planted(i, words) for i, words in zip(ids, texts)]
        yield ids, texts, runs_of_texts(texts)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    for ids, texts, runs in _found(batches, plant=False):
        named = [[dict(zip(("start", "length", "period"), run)) for run in each] for each in runs]
        kept = [b" ".join(collapsed(words, each)) for words, each in zip(texts, runs)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "runs": pa.array(named, kind),
            "collapsed": pa.array([x.decode("utf-8", "replace") for x in kept]),
        })


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, runs in _found(batches, plant=True):
        rows = []
        for doc_id, words, each in zip(ids, texts, runs):
            longest = min(each, key=lambda run: (-run[1], run[0], run[2]), default=None)
            start, length, period = longest or (None, None, None)
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in each)
            rows.append((
                doc_id, len(each), start, length, period,
                1000 * length // period if longest else None,
                sha256(lines.encode()).hexdigest(),
                sha256(b" ".join(collapsed(words, each))).hexdigest(),
            ))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        columns = zip(*rows)
        names = [field.split()[0] for field in _REPORT.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(columns, kinds)], names=names
        )


def _texts(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return df.select(df[id_column].cast("long").alias("id"), F.col(text).alias("text"))


def find_runs(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``runs`` (structs of start, length, period) and ``collapsed``, the text's words
    without the repetitions, joined by blanks. No shuffle."""
    schema = (
        "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
    return map_batches(_texts(df, id_column, text), _runs, schema)


def run_digests(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The longest run and digests of all runs and of the collapsed text of each row, after
    repetitions were planted in a tenth of the documents. No shuffle."""
    return map_batches(_texts(df, id_column, text), _report, _REPORT)
