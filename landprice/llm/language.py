"""Language of whole texts and of spans inside them.

Words are runs of letters. The script of a word, found by code point ranges, leaves only the
languages that were seen in that script; letter trigrams score it for each of those. A Viterbi
path over the words with a penalty for each change of language labels spans. The language of a
text is the one with most letters on that path.

Defined results: null, empty or letterless text is ``und`` with score 0; so is every text if
nothing was learned; of equal scores the language first in the alphabet wins; a repeated row
gives a repeated row; an empty table gives no rows; rows without a label teach nothing, nor do
those of labels past the ``MOST_LANGUAGES`` most frequent (ties: first in the alphabet), which are
predicted like all others.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landprice.llm.batches import map_batches, sliced, texts

#: First code point of each range of letters, and its script.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"),
    (0x1C80, "Cyrillic"), (0x1CA0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2C00, "other"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"),
    (0x3040, "Kana"), (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "Kana"),
    (0x3400, "Han"), (0xA000, "other"), (0xA640, "Cyrillic"), (0xA6A0, "other"),
    (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "other"), (0x20000, "Han"),
)
UNKNOWN = "und"
#: Documents of a language that teach the model, about; a bound on the work of learning.
TRAINING_DOCUMENTS = 2_000
#: Labels that are learned, the most frequent ones; bounds the sample and the size of the model.
MOST_LANGUAGES = 1_000
#: Letter trigrams are counted in so many cells, a power of two: the size of the model.
CELLS = 1 << 16
#: Log-odds that a change of language must gain.
SWITCH_PENALTY = 12.0
_STARTS = np.array([start for start, _ in SCRIPT_RANGES])
_NAMES = sorted({name for _, name in SCRIPT_RANGES})
_SCRIPTS = np.array([_NAMES.index(name) for _, name in SCRIPT_RANGES])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: Log probability of each trigram cell (rows) for each language.
    weights: np.ndarray
    #: Which languages (columns) a script (rows) leaves.
    allowed: np.ndarray


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """2 for letters, 1 for marks that go on a word, 0 for other code points."""
    kinds = (unicodedata.category(chr(i))[0] for i in range(0x110000))
    return np.fromiter((2 * (k == "L") + (k == "M") for k in kinds), np.uint8)


def lowered(text: str) -> str:
    """Lower case with every character at its own place."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(x if len(y := x.lower()) > 1 else y for x in text)


@dataclass
class Words:
    """The words of several texts."""

    cell: np.ndarray  # trigram cell of each letter
    first: np.ndarray  # place among the letters where each word begins
    script: np.ndarray  # of each word
    letters: np.ndarray  # in each word
    start: np.ndarray  # of each word, in its text
    text: np.ndarray  # that each word is of
    has_letter: np.ndarray  # of each text


def words_of(batch: list[str]) -> Words:
    low = [lowered(x) for x in batch]
    sizes = np.array([len(x) + 1 for x in low], np.int64)
    codes = np.frombuffer(
        "".join(x + "\n" for x in low).encode("utf-32-le", "surrogatepass"), "<u4"
    ).copy()
    kind = _letter_table()[codes]
    inside = kind > 0
    begin = np.cumsum(sizes) - sizes
    has_letter = np.maximum.reduceat(kind, begin) == 2 if len(low) else np.zeros(0, bool)
    codes[~inside] = 0
    at = np.flatnonzero(inside)
    before, after = codes[np.maximum(at - 1, 0)], codes[np.minimum(at + 1, len(codes) - 1)]
    before[at == 0] = 0
    mixed = codes[at] * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77)
    mixed += after * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    cell = (mixed >> np.uint32(16)) & np.uint32(CELLS - 1)
    opens = np.ones(len(at), bool)
    opens[1:] = np.diff(at) > 1
    first = np.flatnonzero(opens)
    of_text = np.searchsorted(begin, at[first], side="right") - 1
    return Words(
        cell=cell, first=first,
        script=_SCRIPTS[np.searchsorted(_STARTS, codes[at[first]], side="right") - 1],
        letters=np.diff(first, append=len(at)), start=at[first] - begin[of_text],
        text=of_text, has_letter=has_letter,
    )


def learn(df: DataFrame, label: str, text: str, key: str) -> LanguageModel:
    """Trigram counts of about ``TRAINING_DOCUMENTS`` rows of each of the frequent labels.

    Rows are taken by a hash of ``key``. Counts are summed in each task, then by Spark.
    """
    rows = df.filter(df[label].isNotNull() & df[text].isNotNull()).select(
        df[label].cast("string").alias("label"), df[text].cast("string").alias("text"),
        F.pmod(F.xxhash64(df[key].cast("string")), F.lit(1 << 20)).alias("place"),
    )
    frequent = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LANGUAGES)
    sizes = {x["label"]: x["count"] for x in frequent.collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((CELLS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    # A map of bounded size, looked up in the scan.
    shares = F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (
        name, min(1 << 20, -(-(TRAINING_DOCUMENTS << 20) // n)))))
    numbers = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (name, i)))
    sample = rows.filter(F.col("place") < shares[F.col("label")]).select(
        numbers[F.col("label")].alias("number"), "text"
    )

    def count(batches):
        cells = np.zeros((len(languages), CELLS + len(_NAMES)), np.int64)
        for batch in sliced(batches, "text", 1 << 20):
            number = batch.column("number").to_numpy()
            words = words_of(texts(batch, "text"))
            of_word = number[words.text]
            np.add.at(cells, (np.repeat(of_word, words.letters), words.cell), 1)
            np.add.at(cells, (of_word, CELLS + words.script), words.letters)
        at = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(cells[at])],
            ["number", "cell", "n"],
        )

    counted = map_batches(sample, count, "number int, cell int, n long")
    # At most CELLS rows for each language, whatever the input.
    found = counted.groupBy("number", "cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros((len(languages), CELLS + len(_NAMES)))
    cells[found["number"].to_numpy(), found["cell"].to_numpy()] = found["n"].to_numpy()
    grams, scripts = cells[:, :CELLS] + 0.5, cells[:, CELLS:]
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return LanguageModel(
        languages,
        np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(),
        (share > 0.01).T.copy(),
    )


def path_of(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The language of each word on the best path. ``scores``: words by languages."""
    best = int(scores.sum(axis=0).argmax())
    if scores.shape[1] == 1:
        return np.zeros(len(scores), np.int64)
    # No run of words gains enough in other languages to pay for leaving the best one.
    gain = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
    sums = np.concatenate([[0.0], np.cumsum(gain, dtype=np.float64)])
    if (sums - np.minimum.accumulate(sums)).max() <= penalty:
        return np.full(len(scores), best)
    back, value = [], [0.0] * scores.shape[1]
    for row in scores.tolist():
        top = max(value)
        leader, least = value.index(top), top - penalty
        back.append([i if x >= least else leader for i, x in enumerate(value)])
        value = [max(x, least) + y for x, y in zip(value, row)]
    out, at = np.empty(len(back), np.int64), value.index(max(value))
    for i in range(len(back) - 1, -1, -1):
        out[i] = at
        at = back[i][at]
    return out


def _labelled(model: LanguageModel, batch: list[str]):
    """For each text: its words' slice, path and total scores, or None without letters."""
    words = words_of(batch)
    if not len(words.first) or not model.languages:
        return words, [None] * len(batch)
    scores = np.add.reduceat(model.weights[words.cell], words.first, axis=0)
    allowed = model.allowed[words.script]
    known = allowed.any(axis=1)
    scores[~known] = 0
    scores[known] = np.where(allowed[known], scores[known], scores[known].min(1, keepdims=True) - 50)
    ends = np.searchsorted(words.text, np.arange(len(batch)), side="right")
    out, start = [], 0
    for i, end in enumerate(ends.tolist()):
        if words.has_letter[i]:
            part = scores[start:end]
            out.append((slice(start, end), path_of(part), part))
        else:
            out.append(None)
        start = end
    return words, out


def label_spans(df: DataFrame, model: LanguageModel, id_column: str, text: str) -> DataFrame:
    """``id``, ``start``, ``end`` (characters) and ``lang`` of each span of one language."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, "text", 1 << 20):
            ids, out = batch.column("id").to_pylist(), []
            words, found = _labelled(shared.value, texts(batch, "text"))
            for key, x in zip(ids, found):
                if x is None:
                    continue
                part, path, _ = x
                turns = np.flatnonzero(np.diff(path, prepend=-1))
                starts = words.start[part][turns]
                ends = (words.start[part] + words.letters[part])[np.append(turns[1:], len(path)) - 1]
                out += [(key, int(a), int(b), shared.value.languages[p])
                        for a, b, p in zip(starts, ends, path[turns])]
            fields = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(fields, kinds)], ["id", "start", "end", "lang"]
            )

    rows = df.select(df[id_column].cast("long").alias("id"), df[text].cast("string").alias("text"))
    return map_batches(rows, run, "id long, start long, end long, lang string")


def predictions(model: LanguageModel, batch: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text: its share of the letters, times how sure it is."""
    words, found = _labelled(model, batch)
    names, scores = [], []
    for x in found:
        if x is None:
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        part, path, rows = x
        letters = np.bincount(path, words.letters[part], len(model.languages))
        top = int(letters.argmax())
        on_path = rows[path == top].sum(axis=0, dtype=np.float64)
        sure = 1 / np.exp(np.clip(on_path - on_path[top], None, 50)).sum()
        names.append(model.languages[top])
        scores.append(float(letters[top] / letters.sum() * min(1.0, sure)))
    return names, scores


def predict(
    df: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True,
    named: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``df`` with the language and its score; columns of those names are replaced."""
    df = df.drop(*named)
    # Of bounded size: CELLS rows, at most MOST_LANGUAGES columns.
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [x for x in df.columns if keep_text or x != text]

    def run(batches):
        # Each character takes some forty bytes of arrays.
        for batch in sliced(batches, text, 1 << 20):
            names, scores = predictions(shared.value, texts(batch, text))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*kept, *named],
            )

    schema = df.select(kept).schema.add(named[0], "string").add(named[1], "double")
    return map_batches(df, run, schema)
