"""Session store kept as message and part records: as two tables, or as a tree of JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill.functions import calendar as C, identity as I, text as T
from turnmill.operators.ordered import ranked
from turnmill.sources.logs import keep_prose

HOUR, DAY = 3_600_000, 86_400_000


def _json(column: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(column), path, kind)


def _human_text(part_data: Column) -> Column:
    """Text of a part a person typed; null for other kinds and for synthetic parts."""
    synthetic = F.coalesce(_json(part_data, "$.synthetic", "boolean"), F.lit(False))
    return F.when((_json(part_data, "$.type") == "text") & ~synthetic, _json(part_data, "$.text"))


def _finish(rows: DataFrame, order: list[str], chunks, path: Column, owner: str) -> DataFrame:
    rows = keep_prose(rows.withColumn("text", T.strip(F.col("text"))))
    placed = ranked(rows, ["store_session"], order, chunks, "line_id")
    source = I.source_of(path)
    return placed.select(
        F.lit(owner).alias("owner_id"), I.session_id(source, path).alias("session_id"), source.alias("source"),
        path.alias("file_path"), F.lit(0).cast("bigint").alias("block_start"), "line_id",
        F.lit(0).cast("bigint").alias("part_no"), "date", "text",
    )


def sessions_of(messages: DataFrame) -> DataFrame:
    return messages.select("session_id").filter(F.col("session_id") != "").distinct()


def messages_from_tables(messages: DataFrame, parts: DataFrame, store_path: str, owner: str = "default") -> DataFrame:
    """Join message and part tables (exported files, or read over JDBC).

    ``messages``: id, session_id, time_created in ms, data. ``parts``: id, message_id, time_created, data.
    """
    typed = messages.filter(_json(F.col("data"), "$.role") == "user").select(
        F.col("id").alias("message_id"), F.col("session_id").alias("store_session"), F.col("time_created").alias("sent"))
    texts = parts.select(
        "message_id", F.col("id").alias("part_id"), F.col("time_created").alias("part_time"),
        _human_text(F.col("data")).alias("text")).filter("text is not null")
    rows = texts.join(typed, ["message_id"]).withColumn("date", _date(F.col("sent")))
    chunks = [{"sent_hour": F.floor(F.col("sent") / HOUR)}, {"sent_month": F.floor(F.col("sent") / (30 * DAY))}]
    path = F.concat(F.lit(f"{store_path}::"), F.col("store_session"))
    return _finish(rows, ["sent", "message_id", "part_time", "part_id"], chunks, path, owner)


def _date(millis: Column) -> Column:
    return C.message_date(C.date_from_millis(millis))


def _tree(spark: SparkSession, root: str, kind: str) -> DataFrame:
    scan = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.json").text(f"{root}/storage/{kind}")
    parts = F.split(I.normalized_path(F.col("_metadata.file_path")), "/")
    return scan.select(
        F.col("value").alias("data"), I.normalized_path(F.col("_metadata.file_path")).alias("path"),
        F.element_at(parts, -2).alias("folder"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("name"))


def messages_from_tree(spark: SparkSession, root: str, owner: str = "default") -> DataFrame:
    """``storage/session/**/S.json`` with ``message/S/*.json`` and ``part/M/*.json``."""
    sessions = _tree(spark, root, "session").select(F.col("name").alias("store_session"), F.col("path").alias("session_path"))
    sent = _tree(spark, root, "message").filter(_json(F.col("data"), "$.role") == "user").select(
        F.col("folder").alias("store_session"), F.col("name").alias("message_name"),
        F.coalesce(_json(F.col("data"), "$.id"), F.col("name")).alias("message_id"),
        _date(_json(F.col("data"), "$.time.created", "bigint")).alias("date"))
    texts = _tree(spark, root, "part").select(
        F.col("folder").alias("message_id"), F.col("name").alias("part_name"),
        _human_text(F.col("data")).alias("text")).filter("text is not null")
    rows = texts.join(sent, ["message_id"]).join(sessions, ["store_session"])
    chunks = [{"message_name": F.col("message_name")}, {"message_stem": F.substring("message_name", 1, 12)}]
    return _finish(rows, ["message_name", "part_name"], chunks, F.col("session_path"), owner)
