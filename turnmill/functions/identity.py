"""Content hashes, canonical JSON and the identifiers built from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnmill import constants as K


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column, length: int) -> Column:
    return F.substring(sha256(text), 1, length)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object with sorted keys, no blanks and non-ASCII kept. Nested structs must come sorted."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def normalized_path(path: Column) -> Column:
    """Local path of a file URI."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "%20", " ")


def source_of(path: Column) -> Column:
    """Which tool wrote a log, read off its path."""
    p = normalized_path(path)
    return (
        F.when(p.contains("/.codex/"), "codex")
        .when(p.contains("/.claude/"), "claude")
        .when(p.contains("/.copilot/"), "copilot")
        .when(p.contains("/antigravity/"), "antigravity")
        .when(p.contains("opencode.db") | p.contains("/opencode/"), "opencode")
        .otherwise("custom")
    )


def session_id(source: Column, path: Column) -> Column:
    return short_hash(F.concat_ws(":", source, normalized_path(path)), 16)


def session_label(path: Column) -> Column:
    """Parent folder and file name; the conversation id where the log sits in a hidden layout."""
    parts = F.split(normalized_path(path), "/")
    hidden = F.array_position(parts, ".system_generated").cast("int")
    name = F.element_at(parts, -1)
    parent = F.when(hidden > 1, F.try_element_at(parts, hidden - 1)).otherwise(
        F.try_element_at(parts, F.lit(-2)))
    return F.when(F.coalesce(parent, F.lit("")) == "", name).otherwise(F.concat_ws("/", parent, name))


def receipt_id(session: Column, date: Column, ordinal: Column, content_hash: Column) -> Column:
    identity = canonical_json({
        "schema_version": F.lit(K.RECEIPT_VERSION), "session_id": session, "date": date, "ordinal": ordinal,
        "content_hash": content_hash,
    })
    return F.concat(F.lit("rcpt-"), short_hash(identity, 20))


def content_id(prefix: str, fields: dict[str, Column]) -> Column:
    return F.concat(F.lit(prefix), short_hash(canonical_json(fields), 20))
