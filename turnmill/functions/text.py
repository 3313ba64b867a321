"""Text predicates, redaction and the normal forms used for matching."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from turnmill import constants as K

# White space as (?U)\s has it, spelled out, which matches in a fraction of the time.
_SPACES = r"\t-\r\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRIP = rf"^[ {_SPACES}]+|[ {_SPACES}]+$"
# Runs of white space that are not one blank already.
SPREAD = rf"[ {_SPACES}]{{2,}}|[{_SPACES}]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]+"

# Characters for which lower-casing plus "ß" -> "ss" gives the NFKC case fold.
# Text outside this set takes the Arrow path below.
PLAIN_FOLD = (
    "^[\\x00-\\x7F\u00a1\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0400-\u045f\u05d0-\u05ea"
    "\u2013\u2014\u2018\u2019\u201c\u201d]*$"
)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, phrases) -> Column:
    return any_of([text.contains(p) for p in phrases])


def starts_with_any(text: Column, prefixes) -> Column:
    return any_of([text.startswith(p) for p in prefixes])


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends (``trim`` only knows blanks)."""
    return F.regexp_replace(text, STRIP, "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPREAD, " "))


def lines(text: Column) -> Column:
    """Split on every Unicode line break; a final break opens no extra line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def word_count(text: Column) -> Column:
    """Number of blank-separated words."""
    flat = collapse_space(text)
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, " ")))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def is_injected(text: Column) -> Column:
    return starts_with_any(F.regexp_replace(text, r"(?U)^\s+", ""), K.INJECTED_PREFIXES)


def is_pasted_log(text: Column) -> Column:
    """Four lines or more, over a quarter of which look like a stack trace."""
    rows = lines(text)
    hits = F.size(F.filter(rows, lambda line: line.rlike(K.TRACE_LINE)))
    return (F.size(rows) >= K.TRACE_MIN_LINES) & (hits > F.size(rows) * K.TRACE_SHARE)


def has_user_marker(line: Column) -> Column:
    return contains_any(line, K.USER_LINE_MARKERS)


def strip_envelopes(text: Column) -> Column:
    """Remove complete control envelopes and image markers, keep the words around them."""
    tags = "|".join(K.ENVELOPE_TAGS)
    envelope = rf"(?s)<(?<tag>{tags})(?:(?U:\s)[^>]*)?>.*?</\k<tag>>"
    return strip(F.regexp_replace(F.regexp_replace(text, envelope, ""), K.IMAGE_MARKER, ""))


def _redact_credentials(text: Column) -> Column:
    """Key word followed by a value: hide the value when it is long or has a non-letter.

    Every match is first fenced with marker characters around its value, so that a plain-word value still uses up its
    key word; then the fenced values that look secret are replaced and the other fences dropped.
    """
    start, value_at, end = "\ue001", "\ue002", "\ue003"
    value = rf"{K.CREDENTIAL_CHAR}{{{K.CREDENTIAL_MIN_CHARS},}}"
    found = rf"(?iU)\b({K.CREDENTIAL_KEY})\b({K.CREDENTIAL_JOINER})({value})"
    secret = (
        rf"(?i){start}({K.CREDENTIAL_KEY})[^{value_at}]*{value_at}"
        rf"(?:[^{end}]{{{K.CREDENTIAL_SURE_CHARS},}}|(?=[^{end}]*[^\p{{L}}{end}])[^{end}]+){end}"
    )
    fenced = F.regexp_replace(text, found, f"{start}$1$2{value_at}$3{end}")
    hidden = F.regexp_replace(fenced, secret, "$1=[REDACTED]")
    cleaned = F.regexp_replace(hidden, f"[{start}{value_at}{end}]", "")
    return F.when(text.rlike(rf"(?iU)\b(?:{K.CREDENTIAL_KEY})\b"), cleaned).otherwise(text)


def redact(text: Column) -> Column:
    for pattern, replacement in K.REDACTION_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return _redact_credentials(text)


def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


_nfkc_udf = F.pandas_udf(_fold, StringType())
_casefold_udf = F.pandas_udf(_casefold, StringType())


def _folded(text: Column, udf) -> Column:
    plain = text.rlike(PLAIN_FOLD)
    native = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    # Rows the JVM can fold send a null through Arrow, so only rare scripts pay for Python.
    return F.coalesce(udf(F.when(~plain, text)), native)


def nfkc_casefold(text: Column) -> Column:
    return _folded(text, _nfkc_udf)


def casefold(text: Column) -> Column:
    return _folded(text, _casefold_udf)


def salience_tokens(text: Column) -> Column:
    return F.regexp_extract_all(nfkc_casefold(text), F.lit(WORD), 0)


def usage_form(text: Column) -> Column:
    """Case, spacing and closing punctuation removed, so a resend reads as a resend."""
    flat = F.lower(collapse_space(text))
    return F.regexp_replace(flat, r"^[.!?, ]+|[.!?, ]+$", "")


def usage_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), 0))


def overlap(left_words: Column, right_words: Column) -> Column:
    """Shared words over all words of two word sets (Jaccard)."""
    both = F.size(F.array_intersect(left_words, right_words))
    return F.try_divide(both, F.size(left_words) + F.size(right_words) - both)


def line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def excerpt(text: Column, marker: Column | None = None) -> Column:
    """At most 120 characters on one line, moved right so that a buried marker stays visible."""
    flat, size = collapse_space(text), K.EXCERPT_CHARS
    start = F.lit(0)
    if marker is not None:
        found = F.coalesce(F.position(marker, F.lower(flat)), F.lit(0)) - 1
        start = F.greatest(F.lit(0), found - size // 3)
    clipped = F.regexp_replace(F.substring(flat, start + 1, F.lit(size)), r"(?U)\s+$", "")
    lead = F.when(start > 0, F.lit("...")).otherwise(F.lit(""))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(lead, clipped, F.lit("...")))


def quote_form(text: Column) -> Column:
    """Straight quotes, single blanks, folded case: formatting never fakes a mismatch."""
    straight = F.translate(text, "“”‘’", "\"\"''")
    return casefold(collapse_space(straight))


def rule_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", ""))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>#])", r"\\$1")


def estimate_tokens(chars: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.shiftright(chars.cast("bigint"), 2))


def fit_utf8(text: Column, max_bytes: Column) -> Column:
    """Longest prefix of at most ``max_bytes`` bytes that ends on a character boundary."""
    raw, limit = F.encode(text, "UTF-8"), max_bytes.cast("int")

    def splits_character(length: Column) -> Column:
        # The byte after the cut continues a character when its top bits are 10.
        return F.hex(F.substring(raw, length + 1, F.lit(1))).rlike("^[89AB]")

    cut = (
        F.when(~splits_character(limit), limit)
        .when(~splits_character(limit - 1), limit - 1)
        .when(~splits_character(limit - 2), limit - 2)
        .otherwise(limit - 3)
    )
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))
