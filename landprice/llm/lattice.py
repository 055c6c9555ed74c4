"""Marginal probability of texts from a subword lattice.

Every way to spell a text in pieces of an existing vocabulary is a path of its lattice; a
forward recursion in log space sums all paths. No piece spans words, so the sum over a text is
the product of the sums over its words, each with the space before it. The vocabulary's scores
are the first weights. They are re-estimated from the expected uses of each piece in the training
texts and keep a fixed share of the weight, whatever the number of texts. After a piece comes one
that goes on with the word, one that opens a word, or the end; a text opens with one of the last
two, so its probability is ``product of words * end / (opening + end)``: a distribution over all
texts. That is the score.

Beside it stands a mixture with word counts, which gives a word ``(c + T * Q) / (N + T)``: ``c``
its count, ``N`` all tokens, ``T`` the number of distinct tokens, ``Q`` the lattice's probability
of the word once a word is opened. An end is a token of its own.

Defined results: null text is empty and holds one token, its end; a repeated row gives a
repeated row; an empty table gives no rows; without training texts the vocabulary's own scores decide;
bytes that are in no piece are spelled by the vocabulary's byte pieces.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landprice.llm.batches import map_batches, raw_texts, sliced
from landprice.session import materialised

#: The most frequent words, sent to all tasks; a bound on what is broadcast.
COMMON_WORDS = 1 << 16
#: Rounds of re-estimation.
ROUNDS = 2
#: Weight of the vocabulary's own scores for each expected use of a piece.
PRIOR = 0.01
#: A word with more bytes is summed on its own.
_LONG = 64
_COUNTED_WORDS = 300_000
#: Stands for the end of a text among words; no word holds a space.
END = b" "


@dataclass
class Lattice:
    """Pieces of a vocabulary and their log probabilities; the last weight is the text's end."""

    pieces: list[bytes]
    weights: np.ndarray

    @cached_property
    def opening(self) -> float:
        """Log probability that a piece opens a word."""
        opens = [piece.startswith(b" ") for piece in self.pieces]
        return float(np.logaddexp.reduce(self.weights[:-1][opens]))

    @cached_property
    def boundary(self) -> float:
        """Log probability that a word is over: another opens or the text ends."""
        return float(np.logaddexp(self.opening, self.weights[-1]))

    @cached_property
    def _numbers(self) -> dict[bytes, int]:
        return {piece: i for i, piece in enumerate(self.pieces)}

    @cached_property
    def _longest(self) -> int:
        return max(map(len, self.pieces))

    @cached_property
    def _keys(self):
        """Sorted hashes of the pieces, their numbers, and a bitmap that rules out most others."""
        codes = b"".join(hashlib.sha256(b"byte %d" % b).digest()[:8] for b in range(256))
        codes = np.frombuffer(codes, "<u8").copy()
        base = np.uint64(0x9E3779B97F4A7C15)
        powers = np.cumprod(np.full(self._longest + 1, base, np.uint64)) * np.uint64(1)
        powers = np.concatenate([np.ones(1, np.uint64), powers])
        hashes = np.zeros(len(self.pieces), np.uint64)
        for i, piece in enumerate(self.pieces):
            own = codes[np.frombuffer(piece, np.uint8)]
            hashes[i] = (own * powers[: len(piece)][::-1]).sum(dtype=np.uint64)
        order = np.argsort(hashes)
        seen = np.zeros(1 << 20, bool)
        seen[hashes >> np.uint64(44)] = True
        return codes, powers, hashes[order], order, seen

    def _edges(self, letters: np.ndarray):
        """Pieces in words of one length: start, end, rows and numbers, by rising end."""
        codes, powers, keys, order, seen = self._keys
        count, size = letters.shape
        sums = np.zeros((size + 1, count), np.uint64)
        for j in range(size):
            sums[j + 1] = sums[j] * powers[1] + codes[letters[:, j]]
        for end in range(1, size + 1):
            for start in range(max(0, end - self._longest), end):
                hashes = sums[end] - sums[start] * powers[end - start]
                rows = np.flatnonzero(seen[hashes >> np.uint64(44)])
                if not len(rows):
                    continue
                at = np.minimum(np.searchsorted(keys, hashes[rows]), len(keys) - 1)
                same = keys[at] == hashes[rows]
                if same.any():
                    yield start, end, rows[same], order[at[same]]

    def _groups(self, words: list[bytes]):
        """Words by length, as places and matrices of bytes; words begin with a space."""
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(len(word) + 1, []).append(i)
        for size, places in by_size.items():
            joined = b"".join(b" " + words[i] for i in places)
            yield places, np.frombuffer(joined, np.uint8).reshape(len(places), size)

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Log of the sum over all spellings of each word, with the space before it."""
        out = np.empty(len(words))
        for places, letters in self._groups(words):
            if letters.shape[1] > _LONG:
                for i in places:
                    out[i] = self._long(b" " + words[i], None)
                continue
            value = np.full((letters.shape[1] + 1, len(places)), -np.inf)
            value[0] = 0
            for start, end, rows, numbers in self._edges(letters):
                value[end, rows] = np.logaddexp(
                    value[end, rows], value[start, rows] + self.weights[numbers]
                )
            out[places] = value[-1]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in spelling each word so many times."""
        counts = np.zeros(len(self.pieces) + 1)
        for places, letters in self._groups(words):
            if letters.shape[1] > _LONG:
                for i in places:
                    self._long(b" " + words[i], counts, times[i])
                continue
            of_word = times[places]
            size = letters.shape[1]
            value = np.full((size + 1, len(places)), -np.inf)
            rest = value.copy()
            value[0] = rest[size] = 0
            edges = list(self._edges(letters))
            for start, end, rows, numbers in edges:
                value[end, rows] = np.logaddexp(
                    value[end, rows], value[start, rows] + self.weights[numbers]
                )
            for start, end, rows, numbers in sorted(edges, key=lambda x: -x[1]):
                on = rest[end, rows] + self.weights[numbers]
                uses = np.exp(value[start, rows] + on - value[size, rows]) * of_word[rows]
                counts += np.bincount(numbers, uses, len(counts))
                rest[start, rows] = np.logaddexp(rest[start, rows], on)
        return counts

    def _long(self, word: bytes, counts: np.ndarray | None, times: float = 1.0) -> float:
        """Forward sum of one word of any length; adds expected uses to ``counts``."""
        size, edges = len(word), []
        value = [-np.inf] * (size + 1)
        value[0] = 0.0
        for end in range(1, size + 1):
            for start in range(max(0, end - self._longest), end):
                number = self._numbers.get(word[start:end])
                if number is not None:
                    value[end] = float(np.logaddexp(value[end], value[start] + self.weights[number]))
                    edges.append((start, end, number))
        if counts is not None:
            rest = [-np.inf] * (size + 1)
            rest[size] = 0.0
            for start, end, number in reversed(edges):
                on = rest[end] + self.weights[number]
                counts[number] += times * np.exp(value[start] + on - value[size])
                rest[start] = float(np.logaddexp(rest[start], on))
        return value[size]


def vocabulary(path: str) -> Lattice:
    """The pieces of a sentencepiece file with first weights from their scores.

    Scores that are ranks of merges become a Zipf law over the ranks. Pieces with a space
    after their first place span words and are left out; each byte that has no piece of its
    own takes the weight of its byte piece.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            found[piece] = 1 / (2 - model.get_score(i))
    least = min(found.values(), default=1.0)
    for b in range(256):
        found.setdefault(bytes([b]), least)
    pieces = sorted(found)
    weights = np.array([found[x] for x in pieces])
    # One end for about every thousand pieces.
    weights = np.append(weights / weights.sum() * 0.999, 0.001)
    return Lattice(pieces, np.log(weights))


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, and exactly the six white spaces


def count_words(rows: DataFrame) -> DataFrame:
    """``word`` and ``c``, its count in training rows (``learn``), of every word of all rows."""

    def run(batches):
        learned: Counter = Counter()
        others: set = set()

        def flush():
            words = list(learned) + [x for x in others if x not in learned]
            counts = list(learned.values()) + [0] * (len(words) - len(learned))
            learned.clear()
            others.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"]
            )

        for batch in sliced(batches, "text"):
            learn = batch.column("learn").to_pylist()
            for teaches, text in zip(learn, raw_texts(batch, "text")):
                if teaches:
                    learned.update(_words(text))
                    learned[END] += 1
                else:
                    others.update(_words(text))
            if len(learned) + len(others) > _COUNTED_WORDS:
                yield flush()
        yield flush()

    counted = map_batches(rows.select("learn", "text"), run, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def estimate(words: DataFrame, lattice: Lattice, rounds: int = ROUNDS) -> Lattice:
    """Weights from the expected uses of pieces in the training texts: each distinct word is
    summed once and counts as often as it occurs."""
    taught = words.filter((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c")
    ends = words.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    first = np.exp(lattice.weights)
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(lattice)

        def run(batches, shared=shared):
            total = np.zeros(len(shared.value.pieces) + 1)
            for batch in batches:
                times = batch.column("c").to_numpy().astype(float)
                total += shared.value.expected(batch.column("word").to_pylist(), times)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "n"]
            )

        # As many rows as the vocabulary has pieces, whatever the input.
        found = (
            map_batches(taught, run, "piece int, n double")
            .groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        )
        uses = np.zeros(len(first))
        uses[found["piece"].to_numpy()] = found["n"].to_numpy()
        uses[-1] = ends
        # All texts may be held out.
        uses += first * (PRIOR * uses.sum() or 1.0)
        lattice = Lattice(lattice.pieces, np.log(uses / uses.sum()))
    return lattice


def spelled(words: DataFrame, lattice: Lattice) -> DataFrame:
    """``words`` with ``q``, the log probability of the lattice."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        for batch in batches:
            values = shared.value.forward(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("word", "c")), pa.array(values)], ["word", "c", "q"]
            )

    return map_batches(words.select("word", "c"), run, "word binary, c long, q double")


def score_texts(
    df: DataFrame, path: str, held_out: str = "held_out", id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Word-count baseline, lattice marginal and mixture (all log10) of each whole text.

    Rows with ``held_out`` are scored but not learned from. Frequent words are summed inside
    the scan of the texts; the others meet their counts in one join, and a word that is not
    among the frequent ones is in few texts.
    """
    rows = df.select(
        df[id_column].cast("long").alias("doc_id"), df[held_out].alias("held_out"),
        (~df[held_out]).alias("learn"), df[text].cast("string").alias("text"),
    )
    counts = materialised(count_words(rows), "counts")
    totals = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")
    ).first()
    n, v = totals["n"], totals["v"]
    model = estimate(counts, vocabulary(path))
    words = materialised(spelled(counts, model), "words")
    ln10 = F.log(F.lit(10.0))
    is_end = F.col("word") == F.lit(END)
    end_score = float(model.weights[-1] - model.boundary)
    marginal = F.when(is_end, F.lit(end_score)).otherwise(F.col("q")) / ln10

    opened = F.col("q") + F.lit(model.boundary - model.opening)  # of a word once one is opened
    types = max(1, v)
    share = types / (types + 1)  # of the lattice among what counts do not cover; the rest is ends
    weight = F.when(is_end, 1 - share).otherwise(F.exp(opened) * share) * types
    base = F.log10((F.col("c") + 0.5) / (n + 0.5 * (v + 1)))
    # Beyond the range of doubles the lattice's logarithm stands alone.
    mixture = F.when(
        (F.col("c") > 0) | is_end | (opened > -700), F.log10((F.col("c") + weight) / (n + types))
    ).otherwise(opened / ln10 + F.log10(F.lit(types * share / (n + types))))
    valued = words.select(
        "word", "c", base.alias("base"), marginal.alias("model"), mixture.alias("mixture")
    )

    common = valued.orderBy(F.desc("c"), "word").limit(COMMON_WORDS).toArrow()
    table = {
        word: (*scores, int(c > 0))
        for word, c, *scores in zip(
            *(common[x].to_pylist() for x in ("word", "c", "base", "model", "mixture"))
        )
    }
    # An end that no training text taught.
    unseen = np.log10([0.5 / (n + 0.5 * (v + 1)), np.exp(end_score), (1 - share) * types / (n + types)])
    table.setdefault(END, (*unseen.tolist(), 0))
    shared = df.sparkSession.sparkContext.broadcast(table)

    sums = ("base", "model", "mixture")

    def run(batches):
        known = shared.value
        end = known[END]
        for batch in sliced(batches, "text"):
            size = batch.num_rows
            tokens, base, model, mixture, seen = ([0] * size for _ in range(5))
            at, rare, times = [], [], []
            for i, text in enumerate(raw_texts(batch, "text")):
                words = _words(text)
                tokens[i] = len(words) + 1
                b, m, x, k = end
                for word, c in Counter(words).items():
                    value = known.get(word)
                    if value is None:
                        at.append(i)
                        rare.append(word)
                        times.append(c)
                    else:
                        b += c * value[0]
                        m += c * value[1]
                        x += c * value[2]
                        k += c * value[3]
                base[i], model[i], mixture[i], seen[i] = b, m, x, k
            none = pa.nulls(len(at), pa.int64())
            rows = batch.column("row")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([rows, rows.take(pa.array(at, pa.int64()))]),
                    pa.array([None] * size + rare, pa.binary()),
                    pa.array([1] * size + times, pa.int64()),
                    pa.concat_arrays([batch.column("doc_id"), none]),
                    pa.concat_arrays([batch.column("held_out"), none.cast(pa.bool_())]),
                    pa.concat_arrays([pa.array(tokens, pa.int64()), none]),
                    pa.concat_arrays([pa.array(seen, pa.int64()), none]),
                    *[
                        pa.concat_arrays([pa.array(x, pa.float64()), none.cast(pa.float64())])
                        for x in (base, model, mixture)
                    ],
                ],
                ["row", "word", "times", "doc_id", "held_out", "n_tokens", "n_known", *sums],
            )

    parts = materialised(
        map_batches(
            rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text"),
            run,
            "row long, word binary, times long, doc_id long, held_out boolean, n_tokens long, "
            "n_known long, base double, model double, mixture double",
        ),
        "scores",
    )
    texts = parts.filter("word is null").drop("word", "times")
    rest = parts.filter("word is not null").select("row", "word", "times").join(valued, "word")
    rest = rest.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"),
        F.lit(None).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"),
        *[(F.col("times") * F.col(x)).alias(x) for x in sums],
    )
    summed = texts.union(rest).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("model").alias("score"),
        F.sum("mixture").alias("mixture_score"),
    )
    return summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        "base_score", "score", "mixture_score",
    )
