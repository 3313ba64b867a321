"""Sessions that fell quiet, from a stream of their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill import constants as K
from turnmill.sinks.tables import append_once, write_delta


def quiet_sessions(messages: DataFrame, time: str = "ts", gap_seconds: int = K.QUIET_SECONDS,
                   late: str = "0 seconds", keys: tuple[str, ...] = ("owner_id", "session_id")) -> DataFrame:
    """Emit a session once ``gap_seconds`` pass without a message; a new message before that starts the wait again.

    The window state of a session is a count and two times, so it is small however long the session. Each task merges the
    messages of a session that it has read before they are shuffled, so a busy session is a row of each task.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    windowed = messages.withWatermark(time, late).groupBy(*keys, F.session_window(time, f"{gap_seconds} seconds").alias("w"))
    return windowed.agg(F.count("*").alias("events")).select(
        *keys, F.col("w.start").alias("first_at"), F.col("w.end").alias("quiet_since"), "events")


def emit_once(items: DataFrame, time: str, key: str = "inbox_id", late: str = "1 hour") -> DataFrame:
    """Drop items whose id was already seen inside the watermark."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def start_inbox(sessions: DataFrame, build, root: str, checkpoint: str, key: str = "inbox_id", **trigger):
    """Build inbox items for every micro-batch of quiet sessions and append those not stored yet.

    ``build`` maps a batch of sessions to items; a retried batch appends nothing twice, as items are named by content.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_delta(append_once(build(batch), f"{root}/items", [key]), f"{root}/conflicts", batch_id)

    return sessions.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def stream_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", files_per_batch: int = 1000) -> DataFrame:
    """New log files as they appear, in the columns ``extract_messages`` expects.

    A stream has no row ids, so a file is read as one text and its lines numbered from that.
    """
    files = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option(
        "wholetext", "true").option("maxFilesPerTrigger", files_per_batch).text(path)
    located = files.select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"))
    lines = located.select("file_path", "modified", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "value"))
    return lines.select(
        "value", "file_path", F.lit(0).cast("bigint").alias("block_start"), F.col("line_no").cast("bigint").alias("line_id"),
        "modified").filter(~F.array_contains(F.split("file_path", "/"), "subagents"))
