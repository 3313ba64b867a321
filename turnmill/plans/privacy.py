"""Privacy scan of text and file names meant for publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnmill import constants as K
from turnmill.functions.text import any_of


def scan_findings(text: Column, canaries: dict[str, str], private_roots: tuple[str, ...] = ()) -> Column:
    """Sorted findings of one text. Canaries and roots are settings, tested where the text is."""
    tests = [F.when(text.contains(value), F.lit(name)) for name, value in canaries.items() if value]
    tests += [F.when(text.contains(root), F.lit("private-root")) for root in private_roots if root]
    home, other = text.rlike(K.LINUX_HOME), text.rlike(K.WINDOWS_HOME) | text.rlike(K.MAC_HOME)
    tests.append(F.when(any_of([text.rlike(p) for p in K.SECRET_PATTERNS]), F.lit("secret-pattern")))
    tests.append(F.when(home, F.lit("home-path")).when(other, F.lit("local-path")))
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*tests))))


def scan(texts: DataFrame, canaries: dict[str, str], private_roots: tuple[str, ...] = ()) -> DataFrame:
    return texts.withColumn("findings", scan_findings(F.col("text"), canaries, private_roots)).withColumn(
        "passed", F.size("findings") == 0)


def name_error(path: Column) -> Column:
    """Why a relative path may not be published, null when it may."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    suffix = F.when(F.lower(name).rlike(r".\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")
    return (
        F.when(F.exists(parts, lambda p: p.startswith(".")), "hidden")
        .when(name.isin(*K.RAW_PRIVATE_NAMES), "raw-profile")
        .when(name.contains("transcript"), "raw-transcript")
        .when(name.contains("receipt"), "raw-receipt")
        .when(~suffix.isin(*K.PUBLIC_EXTENSIONS), "extension"))


def scan_tree(files: DataFrame, canaries: dict[str, str], private_roots: tuple[str, ...] = ()) -> DataFrame:
    """Scan files (``path`` relative, ``content`` bytes): first the name, then the body.

    A text file must be UTF-8. In any other file bad bytes are replaced, and zero bytes dropped for a second look, so
    that readable passages in 8-bit or 16-bit form are found.
    """
    utf8 = F.make_valid_utf8(F.col("content").cast("string"))
    wide = F.translate(utf8, "\x00", "")
    found = F.sort_array(F.array_distinct(F.flatten(F.array(
        *[scan_findings(text, canaries, private_roots) for text in (F.col("path"), utf8, wide)]))))
    is_text = any_of([F.lower("path").endswith(s) for s in K.TEXT_EXTENSIONS])
    broken = F.when(is_text & ~F.is_valid_utf8(F.col("content").cast("string")), "not-utf8")
    error = F.coalesce(name_error(F.col("path")), broken)
    return files.select("path", error.alias("error"), found.alias("findings"),
                        (error.isNull() & (F.size(found) == 0)).alias("passed"))
