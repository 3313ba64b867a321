"""Session logs, one JSON object per line, in five dialects, as one message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C, identity as I, text as T
from turnmill.session import exists

MESSAGE_ORDER = ["block_start", "line_id", "part_no"]
MESSAGE_COLUMNS = ["owner_id", "session_id", "source", "file_path", *MESSAGE_ORDER, "date", "text"]
HIDDEN_LAYOUT = "*/.system_generated/logs/*.jsonl"
_ROWS_PER_CHUNK = 4096
_ID_SPACE = 1 << 33


def message_chunks() -> list[dict[str, Column]]:
    """Chunk keys that follow ``MESSAGE_ORDER`` inside a session."""
    line = F.col("line_id") % _ID_SPACE
    return [
        {"block_start": F.col("block_start"), "line_c1": F.floor(line / _ROWS_PER_CHUNK)},
        {"block_start": F.col("block_start"), "line_c2": F.floor(line / _ROWS_PER_CHUNK**2)},
    ]


def _scan(spark: SparkSession, path: str, recursive: bool) -> DataFrame | None:
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if not exists(spark, path):
        return None
    lines = reader.text(path)
    return lines.select(
        F.col("value"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("file_size"),
    )


def read_lines(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Every ``*.jsonl`` line below the roots, the hidden transcript layout included, sub-agent folders left out."""
    scans = []
    for root in sorted(set(r.rstrip("/") for r in roots)):
        # The recursive scan never enters a dot folder, so the second pattern adds files and repeats none.
        scans += [_scan(spark, root, True), _scan(spark, f"{root}/{HIDDEN_LAYOUT}", False)]
    found = [s for s in scans if s is not None]
    if not found:
        raise ValueError("no session logs below " + ", ".join(roots))
    lines = found[0]
    for scan in found[1:]:
        lines = lines.unionByName(scan)
    return lines.filter(~F.array_contains(F.split("file_path", "/"), "subagents"))


def _field(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _flag(record: Column, name: str) -> Column:
    return F.coalesce(_field(record, f"$.{name}", "boolean"), F.lit(False))


def is_human_turn(record: Column) -> Column:
    """Whether a person typed this ``user`` record; an origin object decides where there is one."""
    harness = _flag(record, "isMeta") | _flag(record, "isSidechain") | _flag(record, "isCompactSummary")
    has_tool_result = _field(record, "$.toolUseResult", "variant").isNotNull()
    origin = _field(record, "$.origin", "variant")
    by_origin = F.coalesce(_field(record, "$.origin.kind") == "human", F.lit(False))
    headless = F.coalesce(
        (_field(record, "$.promptSource") == "sdk") & (_field(record, "$.entrypoint") == "sdk-cli"), F.lit(False))
    return ~harness & ~has_tool_result & F.when(_is_object(origin), by_origin).otherwise(~headless)


def _texts(content: Column) -> Column:
    """Texts of a content field that is a string or a list of objects."""
    listed = F.transform(
        F.filter(F.try_variant_get(content, "$", "array<variant>"), _is_object),
        lambda part: F.coalesce(_field(part, "$.text"), F.lit("")))
    return F.when(F.schema_of_variant(content) == "STRING", F.array(_field(content, "$"))).otherwise(listed)


def record_texts(record: Column) -> Column:
    """Human texts of one decoded record, in order; null for a record that carries none."""
    kind = F.coalesce(_field(record, "$.type"), F.lit(""))
    content = F.coalesce(_field(record, "$.content"), F.lit(""))
    wrapped = F.regexp_extract_all(content, F.lit(K.USER_REQUEST), 1)
    request = F.when(_field(record, "$.source") == "USER_EXPLICIT",
                     F.when(F.size(wrapped) > 0, wrapped).otherwise(F.array(content)))
    steering = F.coalesce(_field(record, "$.data.source") == "system", F.lit(False))
    typed = F.when(~steering, F.array(F.coalesce(_field(record, "$.data.content"), F.lit(""))))

    payload = F.coalesce(_field(record, "$.payload", "variant"), record)
    message = F.coalesce(_field(payload, "$.message", "variant"), payload)
    is_message = (_field(payload, "$.type") == "message") | (kind == "user")
    from_user = (F.coalesce(_field(payload, "$.role"), F.lit("")) == "user") | (
        F.coalesce(_field(message, "$.role"), F.lit("")) == "user")
    body = F.coalesce(_field(message, "$.content", "variant"), _field(payload, "$.content", "variant"))
    chat = F.when(F.coalesce(is_message, F.lit(False)) & from_user, _texts(body))
    return (
        F.when((kind == "user") & ~is_human_turn(record), None)
        .when(kind == "USER_INPUT", request)
        .when(kind == "user.message", typed)
        .otherwise(chat)
    )


def keep_prose(messages: DataFrame) -> DataFrame:
    """Drop empty, injected and pasted-log texts."""
    text = F.col("text")
    return messages.filter(~T.is_blank(text) & ~T.is_injected(text) & ~T.is_pasted_log(text))


def extract_messages(lines: DataFrame, owner: Column | None = None) -> DataFrame:
    """Decode log lines into messages; a line that is no JSON object yields nothing."""
    marked = lines.filter(T.has_user_marker(F.col("value")))
    parsed = marked.withColumn("record", F.try_parse_json("value")).filter(_is_object(F.col("record")))
    stamp = F.coalesce(
        F.nullif(_field(F.col("record"), "$.timestamp"), F.lit("")), _field(F.col("record"), "$.created_at"))
    texts = parsed.select(
        "file_path", "block_start", "line_id", "modified",
        C.message_date(stamp).alias("date"),
        (F.coalesce(_field(F.col("record"), "$.type"), F.lit("")) == "response_item").alias("enveloped"),
        F.posexplode(record_texts(F.col("record"))).alias("part_no", "raw"),
    )
    text = T.strip(F.col("raw"))
    source = I.source_of(F.col("file_path"))
    messages = texts.select(
        (owner if owner is not None else F.lit("default")).alias("owner_id"),
        I.session_id(source, F.col("file_path")).alias("session_id"),
        source.alias("source"), "file_path", "block_start", "line_id", F.col("part_no").cast("bigint").alias("part_no"),
        "date", F.when(F.col("enveloped"), T.strip_envelopes(text)).otherwise(text).alias("text"), "modified",
    )
    return keep_prose(messages)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Per file, how many candidate lines could not be decoded."""
    bad = F.try_parse_json("value").isNull()
    return lines.filter(T.has_user_marker(F.col("value"))).filter(bad).groupBy("file_path").agg(
        F.count("*").alias("rejected"))


def read_messages(spark: SparkSession, roots: list[str], sources: list[str] | None = None) -> DataFrame:
    """Human messages below the roots, optionally of some sources only."""
    messages = extract_messages(read_lines(spark, roots))
    return messages if sources is None else messages.filter(F.col("source").isin(sources))
