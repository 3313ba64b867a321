"""SQL forms of the text functions, for checking on another engine.

That engine has neither look-around nor back-references, so the same languages are spelled out with what it has.
"""

from __future__ import annotations

from turnmill import constants as K


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(expression: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expression}, {quote(pattern)}, {quote(replacement)}, 'g')"


_WORD = r"\p{L}\p{N}_"
_PHONE = (r"(\+\d{1,3}[\s\-]?(?:\(\d{1,4}\)[\s\-]?)?\d(?:[\s\-]?\d){6,10}"
          r"|\(?0[2-9]\d{0,2}\)?(?:[\s\-]?\d){6,9})")
PHONE = rf"(^|[^{_WORD}.\-/]){_PHONE}($|[^{_WORD}/.\-]|[.\-]$|[.\-][^\d])"
_C, _L, _N = r"[^\s'\",;]", r"\p{L}", r"[^\s'\",;\p{L}]"
CREDENTIAL = (
    rf"(?i)\b({K.CREDENTIAL_KEY})\b{K.CREDENTIAL_JOINER}"
    rf"(?:{_C}{{12,}}|{_N}{_C}{{5,}}|{_L}{_N}{_C}{{4,}}|{_L}{{2}}{_N}{_C}{{3,}}|{_L}{{3}}{_N}{_C}{{2,}}|{_L}{{4}}{_N}{_C}+"
    rf"|{_L}{{5,}}{_N}{_C}*)")


def plain_rules() -> list[tuple[str, str]]:
    """Rules both engines read alike, apart from the flags."""
    rules = []
    for pattern, replacement in K.REDACTION_RULES:
        if replacement == "[PHONE]":
            continue
        rules.append((pattern.replace("(?U)", "").replace("(?iU)", "(?i)"), replacement.replace("$1", r"\1")))
    return rules


def redact(expression: str) -> str:
    rules = plain_rules()
    for pattern, replacement in rules[:-1]:
        expression = replace_all(expression, pattern, replacement)
    for _ in range(2):
        expression = replace_all(expression, PHONE, r"\1[PHONE]\3")
    expression = replace_all(expression, *rules[-1])
    return replace_all(expression, CREDENTIAL, r"\1=[REDACTED]")


def strip(expression: str) -> str:
    return replace_all(expression, r"^\s+|\s+$", "")


def collapse(expression: str) -> str:
    return strip(replace_all(expression, r"\s+", " "))


def usage_form(expression: str) -> str:
    return replace_all(f"lower({collapse(expression)})", "^[.!?, ]+|[.!?, ]+$", "")


def usage_words(expression: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({expression}), '[a-z0-9'']+'))"


def fingerprint(expression: str) -> str:
    folded = f"replace(lower({expression}), 'ß', 'ss')"
    return rf"array_to_string(regexp_extract_all({folded}, '[\p{{L}}\p{{N}}_]+'), ' ')"


def quote_form(expression: str) -> str:
    return f"replace(lower({collapse(expression)}), 'ß', 'ss')"


def tokens(expression: str) -> str:
    return f"greatest(1, {expression} // 4)"


def contains_any(expression: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({expression}, {quote(p)})" for p in phrases) + ")"


def starts_any(expression: str, phrases) -> str:
    return "(" + " OR ".join(f"starts_with({expression}, {quote(p)})" for p in phrases) + ")"


def lines(expression: str) -> str:
    return f"string_split_regex(regexp_replace({expression}, '(\\r\\n|[\\n\\r])$', ''), '\\r\\n|[\\n\\r]')"


TRACE_LINE = K.TRACE_LINE.replace("(?U)", "")


def quarter(date: str) -> str:
    return f"substr({date}, 1, 4) || '-Q' || CAST((CAST(substr({date}, 6, 2) AS INTEGER) - 1) // 3 + 1 AS VARCHAR)"


def sorted_join(list_expression: str) -> str:
    return f"array_to_string(list_sort({list_expression}), ',')"


def labels(pairs: list[tuple[str, str]]) -> str:
    """Sorted names whose condition holds, joined by commas."""
    cases = ", ".join(f"CASE WHEN {cond} THEN {quote(name)} END" for name, cond in pairs)
    return f"list_sort(list_filter([{cases}], lambda x: x IS NOT NULL))"
