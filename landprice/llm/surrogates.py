"""Keyed surrogates for personal data in texts.

Detected entities are replaced by others of their type, format, script and, for given names,
gender. A surrogate is the entity's image under a keyed permutation of all strings of its
shape, so one entity has one surrogate in all documents and two never share one. A permutation
made of one cycle leaves nothing in its place. Surrogates that are entities of the corpus
themselves, or that are taken, are found by joins over all distinct entities and drawn again.
What still collides after ``PLAIN_DRAWS`` lies in a shape with few free members: mailboxes, surnames
and secrets then get a letter more with each draw, phones may change their area, so that these
always end. Addresses, cards and social numbers have no longer form; if after ``MOST_DRAWS`` one
still has no free surrogate, as its shape is full, it keeps the first and a warning counts such.

Defined results: null text stays null and empty text empty; texts without entities are returned
unchanged; a repeated row gives a repeated row; an empty table gives no rows; other columns
are kept, whatever their names. What is detected:

* secret: values of keys whose name ends in a word of ``_KEYS`` (``client_secret=``, ``"token":``);
  for password-like names any value, for others quoted values and unquoted ones of 8 characters
  or more with a digit or both cases; the literals true, false, null, none are no values; keys with
  a well-known start (``_KNOWN``), the body of private keys, passwords in URLs;
* email, address (IPv4), card, social (ddd-dd-dddd);
* phone: +country, 00country, (ddd) ddd-dddd, ddd-ddd-dddd with or without 1, and forms of
  9 to 15 digits with a leading 0, in groups apart by space, point, hyphen or slash;
* given names of ``GIVEN_NAMES`` and the surname after one or after a title.

A card number must pass its check digit and an address its
ranges; other numbers are left alone. A mailbox or secret without any letter or digit to change
gets some.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landprice.llm.batches import free_name, map_batches, raw_texts, sliced
from landprice.session import materialised

#: Draws in the entity's own shape, and at all; the joins of a draw are over what is left.
PLAIN_DRAWS = 8
MOST_DRAWS = 64
#: Redrawn surrogates up to this number are sent to all tasks; more are joined to their texts.
BROADCAST_ROWS = 100_000

#: Given names by script and gender. A surrogate is of the same list.
GIVEN_NAMES = {
    ("Latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles "
    "Hans Klaus Wolfgang Jürgen Jean Pierre Jacques Philippe José Carlos Juan Miguel".split(),
    ("Latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Ursula Helga Sabine Brigitte Marie Monique Sylvie Françoise María Carmen Pilar Lucía".split(),
    ("Cyrillic", "m"): "Иван Сергей Алексей Дмитрий Николай Михаил Андрей Владимир".split(),
    ("Cyrillic", "f"): "Мария Елена Ольга Наталья Татьяна Ирина Светлана Анна".split(),
    ("Greek", "m"): "Γιώργος Γιάννης Κώστας Δημήτρης Νίκος Παναγιώτης".split(),
    ("Greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
}
#: Titles that announce a name.
TITLES = ("Mr Mrs Ms Miss Herr Frau Monsieur Madame Mme Señor Señora Sr Sra "
          "господин госпожа κύριος κυρία").split()
#: Letters that may stand for each other, and digits.
CLASSES = (
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåèéêëìíîïòóôõöùúûü", "çñýß", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", "ÇÑÝ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
#: Second-level names that are set aside for examples and point at nobody.
RESERVED_DOMAINS = ("example.com", "example.net", "example.org")
_HEX = "0123456789abcdef"
_CLASS_OF = {c: i for i, letters in enumerate(CLASSES) for c in letters}
_NAMES = {name: group for group, names in GIVEN_NAMES.items() for name in names}
_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"

_HEADS = (*TITLES, *_NAMES)

_DIGIT = re.compile(r"\d")
#: Words at the end of the names of secrets; the first ones name passwords.
_PASSWORDS = r"pass[_-]?word|passwd|pass[_-]?phrase|pass[_-]?code|pwd"
_KEYS = r"token|secret|(?:api|access|secret|private|auth|encryption)[_-]?key|credentials?"
_KEY_PARTS = ("pass", "pwd", "token", "secret", "key", "credential")
_SETS = r"\\?[\"']?\s*(?:=>|:=|[=:])"
_QUOTED = r"\\?(?P<quote>[\"'])(?P<quoted>(?:(?!\\?(?P=quote))[^\\\n]|\\(?!(?P=quote))[^\n])+)"
_PASSWORD = re.compile(
    rf"(?i)(?:{_PASSWORDS}){_SETS}(?:\s*{_QUOTED}|[ \t]*(?P<bare>(?:(?!&\w+=)[^\s\"'])+))"
)
_SECRET = re.compile(rf"(?i)(?:{_KEYS}){_SETS}\s*(?:{_QUOTED}|(?P<bare>[^\s\"'<>{{}}()\[\],;&]{{8,}}))")
_LITERALS = ("true", "false", "null", "none")
#: Starts of keys of public services and what follows them.
_KNOWN = {
    "AKIA": "[0-9A-Z]{16}", "ASIA": "[0-9A-Z]{16}", "AIza": r"[\w-]{35}", "ghp_": "[A-Za-z0-9]{36}",
    "gho_": "[A-Za-z0-9]{36}", "ghu_": "[A-Za-z0-9]{36}", "ghs_": "[A-Za-z0-9]{36}",
    "ghr_": "[A-Za-z0-9]{36}", "github_pat_": r"\w{22,}", "glpat-": r"[\w-]{20,}",
    "npm_": "[A-Za-z0-9]{36}", "hf_": "[A-Za-z0-9]{30,}", "xoxa-": r"[\w-]{10,}",
    "xoxb-": r"[\w-]{10,}", "xoxp-": r"[\w-]{10,}", "xoxr-": r"[\w-]{10,}", "xoxs-": r"[\w-]{10,}",
    "sk-": r"(?=[\w-]*\d)[\w-]{20,}", "sk_live_": "[A-Za-z0-9]{16,}", "sk_test_": "[A-Za-z0-9]{16,}",
    "rk_live_": "[A-Za-z0-9]{16,}", "SG.": r"[\w-]{16,}\.[\w-]{16,}",
    "eyJ": r"[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}",
}
_KNOWN_KEY = re.compile(
    r"(?<![A-Za-z0-9_])(?:" + "|".join(f"{re.escape(k)}{v}" for k, v in _KNOWN.items()) + r")(?![A-Za-z0-9_])"
)
_PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*([^-]*[^-\s])\s*-----END")
_IN_URL = re.compile(r"://[^\s:/@]+:([^\s/@]+)@")
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+%-]*[\w+%-]@(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-])")
_ADDRESS = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
_CARD = re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)")
_SOCIAL = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(
    r"(?<![\w+])(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)"
)
#: National forms, and countries with single digits apart: groups of digits that stand alone.
_ALONE = r"(?<![\w+])(?<!\d[ ./-])(?<![.-])"
_NATIONAL = re.compile(
    rf"{_ALONE}(?:1[ .-])?[2-9]\d{{2}}[ .-][2-9]\d{{2}}[ .-]\d{{4}}(?![ ./-]?\d)(?!\w)"
    rf"|{_ALONE}00[1-9]\d{{0,2}}(?:[ ./-]\d{{2,8}}){{1,5}}(?![ ./-]?\d)(?!\w)"
    rf"|{_ALONE}\+[2-9]\d{{0,2}}(?:[ ./-]?\(?\d{{1,4}}\)?){{2,6}}(?![ ./-]?\d)(?!\w)"
    rf"|{_ALONE}0[1-9]\d{{0,3}}(?:[ ./-]\d{{2,8}}){{1,5}}(?![ ./-]?\d)(?!\w)"
)
_NAME = re.compile(
    rf"\b(?:(?:{'|'.join(TITLES)})\.?\s+)?({'|'.join(sorted(_NAMES, key=len, reverse=True))})"
    rf"\s+({_WORD})|\b(?:{'|'.join(TITLES)})\.?\s+({_WORD})"
)


class Permutation:
    """A keyed permutation of ``range(size)`` that is one cycle."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self._bits = max(2, (size - 1).bit_length() + 1) // 2
        self._seed = key + b"\0" + tweak.encode() + b"\0%d" % size

    def _round(self, number: int, value: int) -> int:
        digest = hashlib.shake_256(self._seed + b"\0%d\0%d" % (number, value))
        return int.from_bytes(digest.digest(self._bits // 8 + 1)) & ((1 << self._bits) - 1)

    def _mix(self, value: int, order: tuple[int, ...]) -> int:
        """Four Feistel rounds, walked until the value is in range."""
        low = (1 << self._bits) - 1
        while True:
            left, right = value >> self._bits, value & low
            for number in order:
                left, right = right, left ^ self._round(number, right)
            value = right << self._bits | left
            if value < self.size:
                return value

    def after(self, value: int) -> int:
        place = (self._mix(value, (0, 1, 2, 3)) + 1) % self.size
        return self._mix(place, (3, 2, 1, 0))


def _reshaped(
    key: bytes, tweak: str, text: str, choices: list[str | None],
    valid: Callable[[str], bool] = lambda _: True,
) -> str:
    """Another text in which each character comes from its choices; None keeps a character."""
    places = [(i, c) for i, c in enumerate(choices) if c and text[i] in c]
    size, value = 1, 0
    for i, letters in places:
        size, value = size * len(letters), value * len(letters) + letters.index(text[i])
    if size < 2:
        return text
    shape = [c if c and text[i] in c else text[i] for i, c in enumerate(choices)]
    cycle = Permutation(key, f"{tweak}\0" + "\0".join(shape), size)
    while True:
        value = rest = cycle.after(value)
        out = list(text)
        for i, letters in reversed(places):
            rest, digit = divmod(rest, len(letters))
            out[i] = letters[digit]
        made = "".join(out)
        if made == text or valid(made):
            return made


def _by_class(text: str) -> list[str | None]:
    return [CLASSES[_CLASS_OF[c]] if c in _CLASS_OF else None for c in text]


def passes_check(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _block(address: str) -> str:
    """The kind of network an address is of; surrogates stay inside it."""
    a, b = map(int, address.split(".")[:2])
    if a in (0, 10, 127) or a >= 224:
        return str(a) if a < 224 else "224" if a < 240 else "240"
    if a == 172 and 16 <= b < 32 or a == 192 and b == 168:
        return f"{a}.private"
    return "public"


def _longer(text: str, count: int) -> str:
    """The text and so many more of its last letter or digit; two texts stay two."""
    last = next((c for c in reversed(text) if c in _CLASS_OF), "a")
    return text + last * count


def surrogate(key: bytes, kind: str, entity: str, draw: int = 0) -> str:
    """The replacement of an entity in its plain form; ``draw`` numbers other choices."""
    extra = max(0, draw - PLAIN_DRAWS)
    tweak = f"{kind}\0{draw}"
    if kind == "given":
        names = GIVEN_NAMES[_NAMES[entity]]
        return names[Permutation(key, "\0".join(_NAMES[entity]), len(names)).after(names.index(entity))]
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        if not any(domain == x or domain.endswith("." + x) for x in RESERVED_DOMAINS):
            labels = domain.split(".")
            labels[:-1] = [_reshaped(key, "domain", x, _by_class(x)) for x in labels[:-1]]
            domain = ".".join(labels)
        local = _longer(local, extra)
        return f"{_reshaped(key, tweak, local, _by_class(local))}@{domain}"
    if kind == "address":
        block = _block(entity)
        number = sum(int(x) << 8 * (3 - i) for i, x in enumerate(entity.split(".")))
        cycle = Permutation(key, tweak, 1 << 32)
        while True:
            number = cycle.after(number)
            made = ".".join(str(number >> 8 * (3 - i) & 255) for i in range(4))
            if _block(made) == block:
                return made
    if kind == "card":
        choices = [None, *[CLASSES[0]] * (len(entity) - 2), None]
        made = _reshaped(key, tweak, entity[:-1] + "0", choices)
        return next(made[:-1] + c for c in CLASSES[0] if passes_check(made[:-1] + c))
    if kind == "phone":
        digits = entity.removeprefix("+")
        choices: list[str | None] = [CLASSES[0]] * len(entity)
        if entity[0] == "+":
            choices[:2] = [None, None]
        if len(digits) == 10 or len(digits) == 11 and digits[0] == "1":
            area = len(entity) - 10
            choices[area] = choices[area + 3] = "23456789"
            if entity[area + 3 : area + 6] == "555" and not extra:
                choices[area + 3 : area + 6] = [None] * 3
            choices[:area] = [None] * area
        if entity[:2] == "00":
            choices[:3] = [None] * 3
        elif entity[0] == "0":
            choices[:2] = [None, "123456789"]
        return _reshaped(key, tweak, entity, choices)
    if kind != "social":
        entity = _longer(entity, extra)
    if kind == "secret" and all(c in _HEX for c in entity):
        return _reshaped(key, tweak, entity, [_HEX] * len(entity))
    if kind == "secret" and _KNOWN_KEY.fullmatch(entity):
        start = max((len(x) for x in _KNOWN if entity.startswith(x)))
        return _reshaped(key, tweak, entity, [None] * start + _by_class(entity[start:]))
    return _reshaped(key, tweak, entity, _by_class(entity))


def _plain(kind: str, found: str) -> str:
    """One spelling for all formats of an entity."""
    if kind == "email" or kind == "secret" and all(c in _HEX for c in found.lower()):
        return found.lower()
    if kind == "card":
        return re.sub(r"\D", "", found)
    if kind == "phone":
        return re.sub(r"[^\d+]", "", found)
    return found


def _dressed(kind: str, found: str, made: str) -> str:
    """A surrogate in the format of the text it replaces."""
    if kind in ("card", "phone"):
        digits = iter(made.removeprefix("+"))
        return re.sub(r"\d", lambda _: next(digits), found)
    if kind in ("email", "secret") and made.islower() and found.isupper():
        return made.upper()
    return made


def _random(value: str) -> bool:
    """Whether an unquoted value looks like a key and not like a word."""
    digit = any(map(str.isdigit, value))
    return len(value) >= 8 and (digit or value.lower() != value != value.upper() and not value.istitle())


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """``start``, ``end``, kind and text of each entity, by place; they do not overlap."""
    found: list[tuple[int, int, str, str]] = []
    # Starts and ends of what is taken, in order.
    starts: list[int] = []
    ends: list[int] = []

    def take(start: int, end: int, kind: str) -> None:
        i = bisect_right(starts, start)
        if (not i or ends[i - 1] <= start) and (i == len(starts) or end <= starts[i]):
            starts.insert(i, start)
            ends.insert(i, end)
            found.append((start, end, kind, text[start:end]))

    # Most texts hold no digit and none of the names; a pattern is run only where it can match.
    digit = _DIGIT.search(text) is not None
    for m in _PRIVATE_KEY.finditer(text) if "PRIVATE KEY" in text else ():
        take(*m.span(1), "secret")
    if ("=" in text or ":" in text) and any(x in text.lower() for x in _KEY_PARTS):
        for pattern in (_PASSWORD, _SECRET):
            for m in pattern.finditer(text):
                value = m["quoted"] or m["bare"].rstrip(".,;:!?)]}")
                if value.lower() in _LITERALS or m["bare"] and pattern is _SECRET and not _random(value):
                    continue
                start = m.start("quoted" if m["quoted"] else "bare")
                if value:
                    take(start, start + len(value), "secret")
    for m in _KNOWN_KEY.finditer(text) if any(x in text for x in _KNOWN) else ():
        take(*m.span(), "secret")
    for m in _IN_URL.finditer(text) if "://" in text and "@" in text else ():
        take(*m.span(1), "secret")
    if "@" in text:
        for m in _EMAIL.finditer(text):
            take(*m.span(), "email")
    if digit:
        for m in _ADDRESS.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                take(*m.span(), "address")
        for m in _CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if passes_check(digits) and len(set(digits)) > 1:
                take(*m.span(), "card")
        for m in _SOCIAL.finditer(text):
            take(*m.span(), "social")
        for m in _PHONE.finditer(text):
            take(*m.span(), "phone")
        for m in _NATIONAL.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                take(*m.span(), "phone")
    names: dict[str, str] = {}
    for m in _NAME.finditer(text) if any(x in text for x in _HEADS) else ():
        for group, kind in ((1, "given"), (2, "surname"), (3, "surname")):
            word = m[group]
            if word and word[0].isupper() and (group == 1 or m[2] is None or m[2][0].isupper()):
                names.setdefault(word, "given" if word in _NAMES else kind)
    if names:
        # A part of a full name is that person wherever it stands in the text.
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b", text):
            take(*m.span(), names[m[0]])
    return sorted(found)


def replaced(text: str, key: bytes, redrawn: dict[str, str]) -> tuple[str, int]:
    """The text with surrogates and the number of entities. ``redrawn``: by kind and entity."""
    out, at, found = [], 0, entities(text)
    for start, end, kind, value in found:
        plain = _plain(kind, value)
        made = redrawn.get(f"{kind}:{plain}") or surrogate(key, kind, plain)
        out += [text[at:start], _dressed(kind, value, made)]
        at = end
    return "".join([*out, text[at:]]), len(found)


def _entity_rows(batches, text_keys: bool) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        rows = set()
        for key, raw in zip(batch.column("text_key").to_pylist(), raw_texts(batch, "text")):
            for _, _, kind, value in entities(raw.decode("utf-8", "replace")):
                rows.add((key if text_keys else 0, kind, _plain(kind, value)))
        fields = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), t) for x, t in zip(fields, (pa.int64(), pa.string(), pa.string()))],
            ["text_key", "kind", "entity"],
        )


def _drawn(rows: DataFrame, key: bytes, draw: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("kind").to_pylist(), batch.column("entity").to_pylist())
            made = [surrogate(key, kind, entity, draw) for kind, entity in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("entity"), pa.array(made, pa.string())],
                ["kind", "entity", "made"],
            )

    return map_batches(rows.select("kind", "entity"), run, "kind string, entity string, made string")


def redrawn_surrogates(found: DataFrame, key: bytes) -> DataFrame | None:
    """``kind``, ``entity``, ``made`` of entities whose first surrogate collides, if any.

    A surrogate collides if it is an entity of the corpus or the surrogate of another; of
    several entities with one surrogate the smallest keeps it. Given names come from short
    lists that permute among themselves, so only their distinctness is asked for.
    """
    known = materialised(found.select("kind", "entity").distinct(), "entities")
    real = known.filter("kind <> 'given'").select("kind", F.col("entity").alias("made"))
    used, redrawn, todo, draw = None, None, known, 0
    while True:
        drawn = materialised(_drawn(todo, key, draw), "drawn")
        owners = drawn.groupBy("kind", "made").agg(F.min("entity").alias("entity"))
        kept = owners.join(real, ["kind", "made"], "left_anti")
        if used is not None:
            kept = kept.join(used, ["kind", "made"], "left_anti")
        kept = materialised(kept.select("kind", "entity", "made"), "kept")
        todo = materialised(
            todo.select("kind", "entity").join(kept, ["kind", "entity"], "left_anti"), "again"
        )
        if draw:
            redrawn = kept if redrawn is None else redrawn.union(kept)
        # First surrogates stay taken even where they are given up.
        new = (kept if draw else drawn).select("kind", "made")
        used = new if used is None else used.union(new)
        if todo.isEmpty():
            return redrawn
        if draw == MOST_DRAWS:
            warnings.warn(f"{todo.count()} entities keep a surrogate that is another entity", stacklevel=2)
            return redrawn
        draw += 1


def with_surrogates(df: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with entities of the text column replaced; ``count`` names a column for their number."""
    keyed = df.select(F.xxhash64(df[text]).alias("text_key"), df[text].cast("string").alias("text"))
    schema = "text_key long, kind string, entity string"
    found = map_batches(keyed, lambda x: _entity_rows(x, False), schema)
    redrawn = redrawn_surrogates(found, key)
    spark = df.sparkSession
    columns = [x for x in df.columns if x != count]
    rows = df.select(*[df[x] for x in columns])
    extra = None
    shared = spark.sparkContext.broadcast({})
    if redrawn is not None:
        named = redrawn.select(F.concat_ws(":", "kind", "entity").alias("entity"), "made")
        if redrawn.count() <= BROADCAST_ROWS:
            table = named.toArrow().to_pydict()
            shared = spark.sparkContext.broadcast(dict(zip(table["entity"], table["made"])))
        else:
            extra, own_key = free_name(df, "_redrawn"), free_name(df, "_text_key")
            occurring = map_batches(keyed, lambda x: _entity_rows(x, True), schema).distinct()
            maps = (
                occurring.join(redrawn, ["kind", "entity"])
                .groupBy(F.col("text_key").alias(own_key))
                .agg(F.map_from_entries(F.collect_list(
                    F.struct(F.concat_ws(":", "kind", "entity"), "made"))).alias(extra))
            )
            rows = rows.join(maps, F.xxhash64(rows[text]) == maps[own_key], "left").drop(own_key)

    place = columns.index(text)

    def run(batches):
        for batch in sliced(batches, text):
            own = [None] * batch.num_rows if extra is None else batch.column(extra).to_pylist()
            out, numbers = [], []
            for raw, more in zip(batch.column(place).cast(pa.binary()).to_pylist(), own):
                if raw is None:
                    out.append(None)
                    numbers.append(0)
                    continue
                made, n = replaced(raw.decode("utf-8", "replace"), key, dict(more) if more else shared.value)
                out.append(made)
                numbers.append(n)
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[place] = pa.array(out, batch.schema.field(place).type)
            names = list(columns)
            if count:
                arrays.append(pa.array(numbers, pa.int32()))
                names.append(count)
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = df.select(columns).schema
    return map_batches(rows, run, schema.add(count, "integer") if count else schema)
