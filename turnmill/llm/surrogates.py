"""Personal data replaced by keyed surrogates of the same type and format.

Entities are e-mail addresses, phone numbers, card numbers, social security numbers, IBANs, IP addresses, access keys and
names. A name is what follows a title, all capitalised words and initials of it; every other mention of its words in the
same text is the same person's and gets the same surrogate. An entity's normal form (letters in lower case, digits without separators) is turned into a surrogate
of the same shape by a keyed hash: digits give digits, letters give letters of their script and case, card numbers keep
their first digit and check digit, IP addresses stay valid, and names are built from syllables with an ending that fits
the gender of the title or of the name. Separators and spelling in capitals are those of the text, so two spellings of one
entity stay two spellings of one surrogate, in all documents.

Distinctness is checked over the distinct entities of the corpus: where two of them would get one surrogate, or a surrogate
is itself an entity of the corpus, all but the smallest are drawn again with the next attempt, until none collide. After
every LENGTHEN attempts a surrogate is one character longer, so an end is reached even where all of a shape are taken.

The key is an argument: whoever has it can find out by trial which entity a surrogate stands for.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.llm.arrays import free_names, slices
from turnmill.session import materialize

MOST_SHARED = 50_000
LENGTHEN = 2
#: Titles before a name, with the gender they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_LOWER = "".join(c for c in map(chr, range(0x530)) if c.islower())
_NAME_WORD = rf"(?![{_LOWER}]|(?:{'|'.join(TITLES)})(?!\w))(?:[^\W\d_]\.|{_NAME})"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w+-](?:[\w.+-]*[\w+-])?@[\w-]+(?:\.[\w-]+)+"),
    "key": re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)(?:sk|ghp|xox[bp])[-_][A-Za-z0-9]{16,}(?!\w)|(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "card": re.compile(r"(?<![\w+-])(?:\d{13,19}|\d{4}(?P<mark>[ -])\d{4}(?P=mark)\d{4}(?P=mark)\d{1,7}|\d{4}(?P<gap>[ -])\d{6}(?P=gap)\d{5})(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?|\d{2,5}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w.-])\+\d{8,14}(?![\w-])"),
    "name": re.compile(rf"(?<!\w)({'|'.join(TITLES)})\.?[ ]({_NAME_WORD}(?: {_NAME_WORD})*)"),
}
_WORDS = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_POSSESSIVE = re.compile("['’]s?$")
_HAS_DIGIT, _HAS_TITLE = re.compile(r"\d"), re.compile("|".join(TITLES))
#: Letters by script: vowels and consonants for names, all for shapes.
LATIN, CYRILLIC, GREEK = ("aeiou", "bcdfghklmnprstvz"), ("аеиоу", "бвгдзклмнпрст"), ("αεηιο", "βγδζκλμνπρστ")

ALPHABETS = {LATIN: "abcdefghijklmnopqrstuvwxyz", CYRILLIC: "абвгдежзийклмнопрстуфхцчшщъыьэюя", GREEK: "αβγδεζηθικλμνξοπρστυφχψω"}


def script_of(letter: str) -> tuple[str, str]:
    code = ord(letter)
    return CYRILLIC if 0x400 <= code < 0x530 else GREEK if 0x370 <= code < 0x400 else LATIN


def luhn(digits: str) -> int:
    """The check sum; 0 for a valid number."""
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits))) % 10


def _valid(kind: str, text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    if kind == "card":
        return len(digits) in range(13, 20) and (luhn(digits) == 0 or len(digits) == 16)
    if kind == "ip":
        return all(int(p) < 256 for p in text.split("."))
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return True


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities of a text, in order and without overlap; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []
    kinds = []
    if "@" in text:
        kinds.append("email")
    if _HAS_DIGIT.search(text):
        kinds += ["key", "iban", "card", "ip", "ssn", "phone"]
    elif "sk-" in text or "ghp_" in text:
        kinds.append("key")
    for kind in kinds:
        for m in PATTERNS[kind].finditer(text):
            if _valid(kind, m[0]):
                found.append((m.start(), m.end(), kind, ""))
    if _HAS_TITLE.search(text):
        found += _names(text)
    order = {k: n for n, k in enumerate([*PATTERNS, "initial"])}
    starts: list[int] = []
    kept: list[tuple[int, int, str, str]] = []
    for item in sorted(found, key=lambda x: (order[x[2]], x[0])):
        at = bisect_left(starts, item[0])
        # Kept entities do not overlap, so only the neighbours can.
        if (at == 0 or kept[at - 1][1] <= item[0]) and (at == len(kept) or kept[at][0] >= item[1]):
            starts.insert(at, item[0])
            kept.insert(at, item)
    return kept


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Words and initials after titles, and every further mention of these words as a name, capitalised or in capitals."""
    found, parts = [], {}
    for m in PATTERNS["name"].finditer(text):
        at, gender = m.start(2), TITLES[m[1]]
        words = m[2].split(" ")
        for n, word in enumerate(words):
            name = _POSSESSIVE.sub("", word)
            if word.endswith("."):
                found.append((at, at + 1, "initial", ""))
            else:
                # The title tells the gender of first names; a last name is one for both. A possessive ends the name.
                own = gender if n < len(words) - 1 and name == word else ""
                found.append((at, at + len(name), "name", parts.setdefault(name.lower(), own)))
                if name != word:
                    break
            at += len(word) + 1
    if parts:
        known = {(a, b) for a, b, *_ in found}
        for m in _WORDS.finditer(text):
            name = m[0] if m[0].lower() in parts else _POSSESSIVE.sub("", m[0])
            span = m.start(), m.start() + len(name)
            if name.lower() in parts and name[0].isupper() and span not in known:
                found.append((*span, "name", parts[name.lower()]))
    return found


def normal(kind: str, text: str) -> str:
    """What makes two spellings the same entity."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "phone":
        return ("+" if text.startswith("+") else "") + re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    return text if kind == "key" else text.lower()


class _Draws:
    """A keyed stream of small numbers for one entity."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.block, self.pool = key, "\x00".join(parts).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def surrogate(key: bytes, kind: str, entity: str, gender: str, attempt: int) -> str:
    """The surrogate of a normal form: one of its own shape, longer by one for every LENGTHEN attempts."""
    draw, longer = _Draws(key, kind, entity, gender, str(attempt)), attempt // LENGTHEN
    if kind == "initial":
        return _shape(draw, entity)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4)) + (":" + _shape(draw, "0" * longer) if longer else "")
    if kind == "card":
        digits = entity[0] + "".join(str(draw.below(10)) for _ in entity[1:-1] + "0" * longer)
        check = next(c for c in "0123456789" if luhn(digits + c) == 0)
        return digits + (check if luhn(entity) == 0 else str((int(check) + 1 + draw.below(9)) % 10))
    if kind == "name":
        vowels, consonants = script_of(entity[0])
        size = max(2, (len(entity) + 1) // 2) + longer
        body = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(size))
        feminine = gender == "f" or not gender and entity[-1] in "aаα"
        return body[:-1] + (vowels[0] if feminine else vowels[3] + consonants[draw.below(len(consonants))])
    if kind == "phone":
        # The country code names no one; the rest changes, and no part begins with a new 0.
        plain = entity.lstrip("+")
        keep = len(plain) - 10 if entity.startswith("+") and len(plain) > 10 else 0
        return entity[:len(entity) - len(plain)] + plain[:keep] + "".join(
            str(2 + draw.below(8)) if n == keep and plain[n] != "0" else d if n == keep else str(draw.below(10))
            for n, d in enumerate(plain[keep:] + "0" * longer, keep))
    if kind == "email":
        local, _, domain = entity.partition("@")
        names = domain.split(".")
        # A domain's labels depend on the label alone, so one domain stays one domain.
        hosts = [_shape(_Draws(key, "label", n), n) for n in names[:-1]]
        return _shape(draw, local + "a" * longer) + "@" + ".".join([*hosts, names[-1]])
    if kind == "key":
        head = re.match(r"AKIA|ASIA|(?:sk|ghp|xox[bp])[-_]", entity)
        start = head.end() if head else 0
        if head:
            return entity[:start] + _shape(draw, entity[start:] + "0" * longer)
        return "".join("0123456789abcdef"[draw.below(16)] for _ in entity + "0" * longer)
    start = 2 if kind == "iban" else 0
    return entity[:start] + _shape(draw, entity[start:] + "0" * longer)


def _shape(draw: _Draws, text: str) -> str:
    """Digits for digits and letters for letters of the same script and case; other characters stay."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            letters = ALPHABETS[script_of(c)]
            new = letters[draw.below(len(letters))]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def render(kind: str, text: str, replacement: str) -> str:
    """The surrogate in the format of the text it replaces."""
    if kind in ("card", "ssn", "phone", "iban"):
        marks = iter(replacement.lstrip("+"))
        return "".join([next(marks, "") if c.isalnum() else c for c in text]) + "".join(marks)
    if kind == "initial":
        return replacement.upper()
    if kind == "name":
        return replacement.upper() if text.isupper() and len(text) > 1 else replacement.capitalize()
    if kind == "email" and text.isupper():
        return replacement.upper()
    return replacement


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, entity, gender``: the distinct entities of all texts."""
    def run(batches):
        for batch in batches:
            # One letter names no one: initials are replaced by the key alone.
            seen = {(kind, normal(kind, text[a:b]), gender) for part in slices(batch) for text in part.column(0).to_pylist()
                    if text for a, b, kind, gender in find(text) if kind != "initial"}
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(seen))], names=["kind", "entity", "gender"])

    return docs.select(text_col).mapInArrow(run, "kind string, entity string, gender string").distinct()


def attempts(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, entity, gender, attempt, surrogate`` without collisions: no surrogate twice in a kind, none an entity."""
    @F.arrow_udf("string")
    def draw(kinds: pa.Array, names: pa.Array, genders: pa.Array, tries: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *row) for row in zip(kinds.to_pylist(), names.to_pylist(), genders.to_pylist(), tries.to_pylist())], pa.string())

    args = ["kind", "entity", "gender", "attempt"]
    now = materialize(found.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw(*args)), "surrogates")
    while True:
        least = now.groupBy("kind", "surrogate").agg(F.min(F.struct("entity", "gender")).alias("least"), F.count("*").alias("n")).filter("n > 1")
        taken = now.select("kind", F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        marked = now.join(least.drop("n"), ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left")
        again = F.coalesce("real", F.lit(False)) | F.coalesce(F.struct("entity", "gender") != F.col("least"), F.lit(False))
        flagged = materialize(marked.select(*args, "surrogate", again.alias("again")), "surrogates")
        if flagged.filter("again").isEmpty():
            return flagged.drop("again")
        redrawn = flagged.filter("again").select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt"))
        now = materialize(flagged.filter("not again").drop("again").unionByName(redrawn.withColumn("surrogate", draw(*args))), "surrogates")


def _rewrite(text: Column, later: Column, key: bytes, shared) -> Column:
    @F.arrow_udf("struct<text string, replaced int>")
    def run(texts: pa.Array, own: pa.Array) -> pa.Array:
        known, memo, done, counts = shared.value, {}, [], []
        for a, b in zip(slices(texts), slices(own)):
            for value, tries in zip(a.to_pylist(), b.to_pylist()):
                if not value:
                    done.append(value)
                    counts.append(0)
                    continue
                more = {(t["kind"], t["entity"], t["gender"]): t["attempt"] for t in tries or ()}
                out, at, found = [], 0, find(value)
                for start, stop, kind, gender in found:
                    entity = (kind, normal(kind, value[start:stop]), gender)
                    attempt = more.get(entity, known.get(entity, 0))
                    if (entity, attempt) not in memo:
                        memo[entity, attempt] = surrogate(key, *entity, attempt)
                    out += [value[at:start], render(kind, value[start:stop], memo[entity, attempt])]
                    at = stop
                done.append("".join([*out, value[at:]]))
                counts.append(len(found))
        return pa.StructArray.from_arrays([pa.array(done, pa.string()), pa.array(counts, pa.int32())], names=["text", "replaced"])

    return run(text, later)


def replace(docs: DataFrame, key: bytes, text_col: str = "text", most_shared: int = MOST_SHARED) -> DataFrame:
    """``docs`` with surrogates in the text and the column replaced (how many) added; other columns stay.

    Only entities whose first surrogate collided need more than the key; they are sent to all tasks while there are at
    most ``most_shared``, and joined to the documents that hold them otherwise. Null and empty texts stay as they are with
    0 replaced; repeated rows each get the same result; an empty table gives no rows.
    """
    spark = docs.sparkSession
    settled = attempts(materialize(entities(docs, text_col), "entities"), key)
    redrawn = settled.filter("attempt > 0").drop("surrogate")
    replaced, tried, mark_col, done_col = free_names(docs, "replaced", "tried", "mark", "done")
    some = redrawn.limit(most_shared + 1).collect()
    none = F.lit(None).cast("array<struct<kind string, entity string, gender string, attempt int>>")
    if len(some) <= most_shared:
        shared = spark.sparkContext.broadcast({(r.kind, r.entity, r.gender): r.attempt for r in some})
        ready = docs.withColumn(tried, none)
    else:
        shared = spark.sparkContext.broadcast({})
        mark = F.xxhash64(F.col(text_col))

        def run(batches):
            for batch in batches:
                rows = {(mark, kind, normal(kind, text[a:b]), gender) for part in slices(batch)
                        for text, mark in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if text for a, b, kind, gender in find(text)}
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(rows))], names=[mark_col, "kind", "entity", "gender"])

        held = docs.select(text_col, mark.alias("m")).mapInArrow(run, f"{mark_col} bigint, kind string, entity string, gender string").distinct()
        own = held.join(redrawn, ["kind", "entity", "gender"]).groupBy(mark_col).agg(F.collect_list(F.struct("kind", "entity", "gender", "attempt")).alias(tried))
        ready = docs.withColumn(mark_col, mark).join(own, mark_col, "left").drop(mark_col)
    done = ready.withColumn(done_col, _rewrite(F.col(text_col), F.col(tried), key, shared))
    return done.select(*[F.col(f"{done_col}.text").alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
                       F.col(f"{done_col}.replaced").alias(replaced))
