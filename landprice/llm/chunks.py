"""Document fingerprints: content-defined chunks as length-weighted digest sets.

A gear hash over the last 32 bytes marks cut points, so a cut depends only on the text around
it and an edit moves few of them. Normalised chunking uses a strict mask up to the usual chunk
size and a loose one after it. A fingerprint is the set of chunk digests with chunk lengths;
containment is the share of one set's length that the other also holds.

Defined results: null text is empty; an empty text has an empty fingerprint, and two empty
texts are alike (1.0), an empty and another are not (0.0); texts of any length are read whole;
an empty table gives no rows; other columns are not read. Rows are ordered by ``doc_id`` and
then text (null ids after all others): with repeated rows, the next row is the next document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from landprice.llm.batches import map_batches, sliced, texts

#: Chunk sizes in bytes: no cut before the least, a strict mask up to the usual size.
LEAST, USUAL, MOST = 24, 48, 192
#: Bits that must be zero at a cut: before and after the usual size.
STRICT_BITS, LOOSE_BITS = 8, 4
_WINDOW = 32
_SEGMENT = 1 << 20
_LAST_ID = (1 << 63) - 1


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """A random-looking number for each byte, from a fixed rule."""
    digests = (hashlib.sha256(b"gear %d" % b).digest()[:4] for b in range(256))
    return np.frombuffer(b"".join(digests), "<u4").copy()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes up to each byte: each step doubles the bytes it covers."""
    out = gear()[data]
    covered = 1
    while covered < _WINDOW:
        out[covered:] += out[:-covered] << np.uint32(covered)
        covered *= 2
    return out


def _cuts(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of possible chunks under the strict and under the loose mask."""
    strict, loose = [], []
    for start in range(0, len(data), _SEGMENT):
        skip = min(start, _WINDOW - 1)
        hashes = gear_hashes(data[start - skip : start + _SEGMENT])[skip:]
        after = data[start + 1 : start + 1 + len(hashes)]
        ends = np.ones(len(hashes), bool)
        ends[: len(after)] = after & 0xC0 != 0x80  # only between characters
        found = np.flatnonzero((hashes >> np.uint32(32 - LOOSE_BITS) == 0) & ends)
        loose.append(found + start + 1)
        strict.append(found[hashes[found] >> np.uint32(32 - STRICT_BITS) == 0] + start + 1)
    return np.concatenate(strict).tolist(), np.concatenate(loose).tolist()


def chunk_ends(text: bytes) -> list[int]:
    """End offset of each chunk of a UTF-8 text; together they cover it."""
    size = len(text)
    if not size:
        return []
    strict, loose = _cuts(np.frombuffer(text, np.uint8))
    ends, start = [], 0
    while size - start > LEAST:
        at = bisect_left(strict, start + LEAST)
        if at < len(strict) and strict[at] <= start + USUAL:
            end = strict[at]
        else:
            at = bisect_right(loose, start + USUAL)
            if at < len(loose) and loose[at] <= start + MOST:
                end = loose[at]
            elif size - start <= MOST:
                break
            else:
                end = start + MOST
                while text[end] & 0xC0 == 0x80:
                    end -= 1
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def fingerprint(text: bytes) -> np.ndarray:
    """Distinct chunks in order of digest: 8 bytes of digest, 2 of length."""
    ends = chunk_ends(text)
    out = np.empty(len(ends), [("digest", ">u8"), ("length", ">u2")])
    starts = [0, *ends[:-1]]
    out["digest"] = [xxh3_64_intdigest(text[a:b]) for a, b in zip(starts, ends)]
    out["length"] = np.diff(ends, prepend=0)
    digests = out["digest"].astype(np.uint64)
    order = np.argsort(digests, kind="stable")
    digests = digests[order]
    return out[order[np.concatenate([[True], digests[1:] != digests[:-1]])]] if ends else out


def containment(one: np.ndarray, other: np.ndarray) -> float:
    """Share of the length of ``one`` whose chunks ``other`` holds too."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    mine, theirs = one["digest"].astype(np.uint64), other["digest"].astype(np.uint64)
    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
    lengths = one["length"].astype(np.int64)
    return float(lengths[theirs[at] == mine].sum() / lengths.sum())


def document_chunks(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunks themselves: ``id``, ``start``, ``end`` (UTF-8 bytes) and ``digest``."""

    def run(batches):
        for batch in sliced(batches, "text"):
            ids, starts, ends, digests = [], [], [], []
            for key, value in zip(batch.column("id").to_pylist(), texts(batch, "text")):
                data = value.encode()
                to = chunk_ends(data)
                since = [0, *to[:-1]]
                ids += [key] * len(to)
                starts += since
                ends += to
                digests += [f"{xxh3_64_intdigest(data[a:b]):016x}" for a, b in zip(since, to)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()),
                 pa.array(ends, pa.int64()), pa.array(digests, pa.string())],
                ["id", "start", "end", "digest"],
            )

    rows = df.select(df[id_column].cast("long").alias("id"), df[text].cast("string").alias("text"))
    return map_batches(rows, run, "id long, start long, end long, digest string")


def _ranges(ids: DataFrame, parts: int) -> list[int]:
    """First ids of about ``parts`` ranges with as many rows each; every one is a real id."""
    steps = [i / parts for i in range(parts)]
    found = ids.agg(
        F.percentile_approx("id", steps, max(10_000, 10 * parts)).alias("steps"),
        F.min("id").alias("first"),
    ).first()
    return sorted({found["first"], *(found["steps"] or [])} - {None})


def with_next(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``range``, ``guest``, ``id``, ``text`` in runs of rows that follow each other.

    Rows are dealt by ranges of ids; the first row of a range also goes, as a guest, to the end
    of the range before it (of the first range: to the last). So every row finds its successor
    in its own task, texts are shuffled once and no task sees more than a range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(df[id_column].cast("long"), F.lit(_LAST_ID)).alias("id")
    firsts = np.array(_ranges(df.select(key), parts), np.int64)

    def deal(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            own = np.searchsorted(firsts, ids, side="right") - 1
            first = np.flatnonzero(firsts[own] == ids) if len(ids) else own
            take = np.concatenate([np.arange(len(ids)), first])
            ranges = np.concatenate([own, (own[first] - 1) % max(1, len(firsts))])
            guest = np.repeat([False, True], [len(ids), len(first)])
            rows = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges.astype(np.int32)), pa.array(guest), *rows.columns],
                ["range", "guest", *rows.schema.names],
            )

    rows = df.select(
        key, df[id_column].isNull().alias("no_id"), df[text].cast("string").alias("text")
    )
    schema = "range int, guest boolean, id long, no_id boolean, text string"
    dealt = map_batches(rows, deal, schema)
    order = ("range", "guest", "id", "text")
    return dealt.repartitionById(parts, F.col("range") % parts).sortWithinPartitions(*order)


def compare_with_edited(
    df: DataFrame, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and how alike they are.

    The edited text has the last half of the characters replaced by as many of the first of
    the next row. ``near_edited`` and ``near_next`` are containments of the row's fingerprint.
    """

    def row(now, after):
        key, no_id, whole, print_ = now
        keep = len(whole) - len(whole) // 2
        edited = (whole[:keep] + after[2][: len(whole) // 2]).encode()
        changed = fingerprint(edited)
        return (
            None if no_id else key, len(whole), hashlib.sha256(edited).hexdigest(),
            print_.tobytes().hex(), changed.tobytes().hex(),
            containment(print_, changed), containment(print_, after[3]),
        )

    names = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(),
             "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
             "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches):
        now, range_ = None, None
        for batch in sliced(batches, "text"):
            out = []
            columns = (batch.column(x).to_pylist() for x in ("range", "guest", "id", "no_id"))
            for in_range, guest, key, no_id, whole in zip(*columns, texts(batch, "text")):
                if in_range != range_:
                    now, range_ = None, in_range
                elif now is None:
                    continue  # further guests of a range that has met its successor
                after = (key, no_id, whole, fingerprint(whole.encode()))
                if now is not None:
                    out.append(row(now, after))
                now = None if guest else after
            fields = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(fields, names.values())], list(names)
            )

    return map_batches(
        with_next(df, id_column, text),
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
