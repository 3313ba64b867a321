"""Read a corpus text back into messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.operators.ordered import running
from turnmill.sources.logs import message_chunks

SESSION_HEADER = r"^===== session:([A-Za-z0-9_-]+) source:([a-z0-9_-]+) =====$"
DATE_HEADER = r"^\[([^\]]+)\]$"


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_id"))


def messages_from_corpus(lines: DataFrame) -> DataFrame:
    """Split lines on session headers, and each session on its date headers.

    Both splits number their headers with a running count along the file, so one large file is read by many tasks.
    """
    session = F.when(F.col("value").rlike(SESSION_HEADER), 1).otherwise(0).cast("bigint")
    dated = F.when(F.col("value").rlike(DATE_HEADER), 1).otherwise(0).cast("bigint")
    flagged = lines.withColumns({"is_session": session, "is_date": dated})
    counted = running(flagged, ["file_path"], ["block_start", "line_id"], message_chunks(),
                      sums={"sessions_before": F.col("is_session"), "dates_before": F.col("is_date")})
    counted = counted.withColumns({"session_no": F.col("sessions_before") + F.col("is_session"),
                                   "message_no": F.col("dates_before") + F.col("is_date")})
    headers = counted.filter("is_session = 1").select(
        "file_path", "session_no", F.regexp_extract("value", SESSION_HEADER, 1).alias("session_id"),
        F.regexp_extract("value", SESSION_HEADER, 2).alias("source"))
    body = counted.filter("is_session = 0 and session_no > 0 and message_no > 0")
    row = F.struct("block_start", "line_id", "is_date", "value")
    texts = body.groupBy("file_path", "session_no", "message_no").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    first = F.element_at("rows", 1)
    texts = texts.filter(first["is_date"] == 1).select(
        "file_path", "session_no", "message_no",
        F.regexp_extract(first["value"], DATE_HEADER, 1).alias("date"),
        F.array_join(F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: r["value"]), "\n").alias("text"))
    return texts.join(headers, ["file_path", "session_no"]).select(
        F.lit("default").alias("owner_id"), "session_id", "source", "file_path",
        F.lit(0).cast("bigint").alias("block_start"), F.col("message_no").alias("line_id"),
        F.lit(0).cast("bigint").alias("part_no"), "date", "text")
