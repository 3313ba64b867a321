"""Marker classification of message text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnmill import constants as K
from turnmill.functions.text import any_of, contains_any, starts_with_any


def _labels(conditions: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions.items()]))


def _marked(padded: Column, markers, word_boundary: bool) -> Column:
    if word_boundary:
        return any_of([padded.contains(f" {m.strip()} ") for m in markers])
    return contains_any(padded, markers)


def signal_hits(fingerprint: Column, word_boundary: bool = False, markers=None) -> dict[str, Column]:
    padded = F.concat(F.lit(" "), fingerprint, F.lit(" "))
    return {family: _marked(padded, words, word_boundary) for family, words in (markers or K.SALIENCE_MARKERS).items()}


def base_signals(fingerprint: Column, word_boundary: bool = False) -> Column:
    """Signal families the words alone show."""
    return _labels(signal_hits(fingerprint, word_boundary))


def signal_families(signals: Column, recurrence: Column) -> Column:
    """Sorted families, with recurrence across sessions; ``exploration`` when there is none."""
    found = F.when(recurrence > 1, F.array_append(signals, F.lit("recurrence"))).otherwise(signals)
    return F.when(F.size(found) == 0, F.array(F.lit("exploration"))).otherwise(F.sort_array(found))


def salience(signals: Column, recurrence: Column) -> Column:
    score = F.lit(1)
    for family, weight in K.SALIENCE_WEIGHTS.items():
        score = score + F.when(F.array_contains(signals, family), weight).otherwise(0)
    bonus = F.least(F.lit(K.RECURRENCE_CAP), (recurrence - 1) * K.RECURRENCE_STEP)
    return (score + F.when(recurrence > 1, bonus).otherwise(0)).cast("int")


def domain_hints(fingerprint: Column, given: Column | None = None, word_boundary: bool = False,
                 extra: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Domains whose markers the text holds; ``extra`` adds a caller's own markers (names, tools) per domain."""
    padded = F.concat(F.lit(" "), fingerprint, F.lit(" "))
    found = _labels({d: _marked(padded, words + (extra or {}).get(d, ()), word_boundary) for d, words in K.DOMAIN_MARKERS.items()})
    if given is not None:
        found = F.array_union(found, F.coalesce(given, F.array().cast("array<string>")))
    return F.when(F.size(found) == 0, F.array(F.lit("work"))).otherwise(F.sort_array(found))


def restated_marker(normal: Column) -> Column:
    """First listed phrase the text contains, or null."""
    return F.coalesce(*[F.when(normal.contains(m), F.lit(m)) for m in K.RESTATED_MARKERS])


def is_correction(normal: Column) -> Column:
    return starts_with_any(normal, K.CORRECTION_OPENERS) & ~starts_with_any(normal, K.CORRECTION_EXCLUSIONS)


def prohibited_claims(text: Column) -> Column:
    return _labels({c: F.lower(text).contains(c) for c in K.PROHIBITED_CLAIMS})
