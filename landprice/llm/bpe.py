"""Byte-level BPE by depth-first traversal of a trie of distinct words.

The encoding of a prefix is that of a shorter prefix plus one last token. That token is the
only one that ends the prefix and stays apart from the last token before it, so each node of
the trie needs one state, its last token, and words that share a prefix share its states.

Defined results: null text is empty; an empty text has no ids, so ``n_tokens`` is 0 and
``ids`` is empty; a repeated row gives a repeated row; an empty table gives no rows; columns
other than ``id`` and ``text`` are not read. A word of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from landprice.llm.batches import map_batches, raw_texts, sliced

#: Fixed value: the pattern that splits text into words before the merges.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Characters for which the standard module's classes differ from the pattern's.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xff]")
#: The same pattern for texts without those characters, in the faster standard module.
_USUAL_WORDS = re.compile(
    r" ?[^\W\d_]++|'(?:s|t|re|ve|m|ll|d)| ?[0-9]++| ?(?:[^\s\w]|_)++|\s+(?!\S)|\s+"
)
#: Encoded words that a Python worker keeps between slices.
KEPT_WORDS = 300_000
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, their merges, and which tokens may follow each other."""

    def __init__(self, definition: bytes):
        parsed = json.loads(definition)
        model = parsed["model"]
        if model["type"] != "BPE" or parsed["normalizer"] or not parsed["pre_tokenizer"]["use_regex"]:
            raise ValueError("a byte-level BPE definition without normalizer is needed")
        if parsed["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a prefix space is not supported")
        alphabet = byte_alphabet()
        spelled = {x: bytes(alphabet[c] for c in x) for x in model["vocab"]}
        self.ids = {spelled[x]: i for x, i in model["vocab"].items()}
        size = 1 + max(model["vocab"].values())
        self.special = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        size = max(size, 1 + max(self.special.values(), default=0))
        self.spelling = [b""] * size
        for token, i in self.ids.items():
            self.spelling[i] = token
        for content, i in self.special.items():
            self.spelling[i] = content.encode()
        self.names = [str(i) for i in range(size)]
        self.rank: dict[tuple[int, int], int] = {}
        self.born = [-1] * size
        self.left = [-1] * size
        self.right = [-1] * size
        self.usable = {i for token, i in self.ids.items() if len(token) == 1}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = spelled[a], spelled[b]
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = rank
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, left, right
                # A token is of use if merging its own bytes gives it back.
                if {left, right} <= self.usable and self._apart(left, right, rank):
                    self.usable.add(made)
        self.ends = {t: i for t, i in self.ids.items() if i in self.usable}
        self._pairs: dict[int, bool] = {}
        # Which tokens end at a node: an automaton over the starts of tokens, met parts only.
        self._starts = {t[:n] for t in self.ends for n in range(len(t) + 1)}
        self._states, self._tails, self._closing = {b"": 0}, [b""], [()]
        self._follow: dict[int, int] = {}
        self.pattern = regex.compile(WORD_PATTERN)
        self.special_pattern = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special
            else None
        )

    def _apart(self, left: int, right: int, before: int = _NEVER) -> bool:
        """Whether no merge ranked under ``before`` crosses the seam of two tokens.

        Walks back through the pieces that met at the seam. Of equal ranks the left one is
        merged first, hence the two comparisons.
        """
        a, b, a_ends, b_ends = left, right, before, before
        while True:
            rank = self.rank.get((a, b), _NEVER)
            if rank < a_ends and (rank < b_ends or rank == b_ends != before):
                return False
            if self.born[a] > self.born[b]:
                a_ends, a = self.born[a], self.right[a]
            elif self.born[b] >= 0:
                b_ends, b = self.born[b], self.left[b]
            else:
                return True

    def apart(self, key: int) -> bool:
        """Whether two tokens, packed in a key, may follow each other; the answer is kept."""
        if len(self._pairs) > 500_000:
            self._pairs.clear()
        answer = self._pairs[key] = self._apart(key >> 32, key & 0xFFFFFFFF)
        return answer

    def _step(self, way: int) -> int:
        """The state after one more byte: the longest end of the path that starts a token."""
        tail = self._tails[way >> 8] + bytes([way & 255])
        while tail not in self._starts:
            tail = tail[1:]
        state = self._states.get(tail)
        if state is None:
            state = self._states[tail] = len(self._tails)
            self._tails.append(tail)
            found = ((self.ends.get(tail[i:]), len(tail) - i) for i in range(len(tail)))
            self._closing.append(tuple(x for x in found if x[0] is not None))
        self._follow[way] = state
        return state

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of each distinct non-empty word.

        Sorted words are the leaves of their trie in depth-first order. ``last`` and
        ``path`` hold the states on the way from the root; a word keeps those of the prefix
        it shares with its predecessor and only computes the nodes below.
        """
        spelling, apart, pairs = self.spelling, self.apart, self._pairs
        follow, step, closing = self._follow, self._step, self._closing
        out: dict[bytes, tuple[int, ...]] = {}
        last, path = [-1], [0]
        before = b""
        for word in sorted(set(words)):
            shared, limit = 0, min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], path[shared + 1 :]
            state = path[shared]
            for depth in range(shared + 1, len(word) + 1):
                way = state << 8 | word[depth - 1]
                state = follow.get(way)
                if state is None:
                    state = step(way)
                for token, length in closing[state]:
                    if length == depth:
                        break
                    key = last[depth - length] << 32 | token
                    fits = pairs.get(key)
                    if fits or fits is None and apart(key):
                        break
                last.append(token)
                path.append(state)
            ids, depth = [], len(word)
            while depth:
                ids.append(last[depth])
                depth -= len(spelling[last[depth]])
            out[word] = tuple(reversed(ids))
            before = word
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens are words of their own."""
        find = self.pattern.findall if _UNUSUAL.search(text) else _USUAL_WORDS.findall
        if self.special_pattern is None or not any(x in text for x in self.special):
            return find(text)
        words: list[str] = []
        for part in self.special_pattern.split(text):
            words += [part] if part in self.special else find(part)
        return words

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """A vocabulary with the words that this Python worker has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._known: dict[str, tuple[int, ...]] = {}
        self._special = {x: (i,) for x, i in vocabulary.special.items()}

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, in order. Texts come in bounded slices."""
        split = [self.vocabulary.split(x) for x in texts]
        if len(self._known) > KEPT_WORDS:
            self._known = {}
        known = self._known
        known.update(self._special)
        new = {word for words in split for word in words if word not in known}
        ids = self.vocabulary.encode_words(word.encode() for word in new)
        known.update((word, ids[word.encode()]) for word in new)
        for words in split:
            yield list(chain.from_iterable(map(known.__getitem__, words)))


@lru_cache(maxsize=2)
def encoder(definition: bytes) -> Encoder:
    return Encoder(Vocabulary(definition))


def share(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary file, of fixed size, for all executors; only the driver opens it."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``ids`` (array<int>) and ``decoded`` of each row."""
    shared = share(df, path)

    def run(batches):
        coder = encoder(shared.value)
        for batch in sliced(batches, "text", 1 << 20):
            ids = list(coder.encode_all([x.decode("utf-8", "replace") for x in raw_texts(batch, "text")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([coder.vocabulary.decode(x) for x in ids], pa.string())],
                ["id", "ids", "decoded"],
            )

    rows = df.select(df[id_column].cast("long").alias("id"), df[text].cast("string").alias("text"))
    return map_batches(rows, run, "id long, ids array<int>, decoded string")


def encoding_digests(
    df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token count and digests of ids and decoded text of each row.

    Digests are taken inside the task, so ids and texts are never sent back to Spark.
    """
    shared = share(df, path)

    def run(batches):
        coder = encoder(shared.value)
        names, spelling = coder.vocabulary.names, coder.vocabulary.spelling
        for batch in sliced(batches, "text"):
            counts, of_ids, of_texts = [], [], []
            whole = [x.decode("utf-8", "replace") for x in raw_texts(batch, "text")]
            for ids in coder.encode_all(whole):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded = b"".join(map(spelling.__getitem__, ids)).decode("utf-8", "replace")
                of_texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_texts, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(df[id_column].cast("long").alias("id"), df[text].cast("string").alias("text"))
    return map_batches(
        rows, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("id", "doc_id")
