"""Corpus text, chunk files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnmill.operators.ordered import hash_chunks, integer_chunks, ranked
from turnmill.operators.packing import pack_greedy
from turnmill.plans.corpus import SESSION, block_text, header_text, session_stats
from turnmill.session import materialize

#: Messages of a session that stay in one file.
PART_MESSAGES = 1 << 16


def corpus_lines(messages: DataFrame) -> DataFrame:
    """Numbered messages with the text they have in a corpus.

    A session is written in parts of ``PART_MESSAGES``, each under the session's header, so that a large one can go on in
    another file and still be read.
    """
    value = F.when(F.col("ordinal") % PART_MESSAGES == 0, F.concat_ws("\n", header_text(), block_text())).otherwise(block_text())
    return messages.withColumns({"value": value, "part": F.floor(F.col("ordinal") / PART_MESSAGES)})


def _write_parts(rows: DataFrame, path: str, folders: list[str], order: list[str]) -> None:
    """Text files per folder, in order; a session of any size runs on from one file into the next."""
    keys = [*folders, *order, "part"]
    rows.select(*keys, "ordinal", "value").repartitionByRange(*keys).sortWithinPartitions(*keys, "ordinal").select(
        *folders, "value").write.mode("overwrite").partitionBy(*folders).text(path)


def write_corpus(messages: DataFrame, path: str) -> None:
    """One block per session from numbered messages, a folder per owner and source, in order of date and session."""
    dates = session_stats(messages).select(*SESSION, "source", "first_date")
    rows = corpus_lines(messages).join(dates, [*SESSION, "source"])
    _write_parts(rows, path, ["owner_id", "source"], ["first_date", "session_id"])


def chunk_sessions(sessions: DataFrame, total_chars: int, chunks: int) -> DataFrame:
    """Sessions with the number of the chunk file they go to: a chunk closes once it reaches its share.

    Narrow columns in and out: owner_id, source, session_id, first_date, chars.
    """
    target = max(1, total_chars // max(1, chunks))
    narrow = sessions.select("owner_id", "source", "first_date", "session_id", "chars")
    packed = pack_greedy(
        narrow, ["owner_id"], ["source", "first_date", "session_id"],
        hash_chunks("session_id", prefix=("source", "first_date"), digits=(3, 1)), "chars", target, on_overflow=False)
    starts = packed.select("owner_id", "bin_start").distinct()
    numbered = ranked(starts, ["owner_id"], ["bin_start"], integer_chunks("bin_start", max(target, 2)), "place")
    return packed.join(numbered, ["owner_id", "bin_start"]).withColumn(
        "chunk", F.format_string("chunk-%02d", F.col("place") + 1)).drop("bin_start", "place")


def session_chars(messages: DataFrame) -> DataFrame:
    """Length of each session's block: header, and a line break before every message."""
    stats = session_stats(messages)
    return stats.withColumn("chars", (F.length(header_text()) + F.col("message_count") + F.col("block_chars")).cast("bigint"))


def write_chunks(messages: DataFrame, path: str, chunks: int = 20) -> None:
    """About ``chunks`` folders of text files on session boundaries, from numbered messages."""
    sized = materialize(session_chars(messages), "session-chars")
    total = sized.agg(F.sum("chars")).first()[0] or 0
    placed = chunk_sessions(sized, total, chunks).select(*SESSION, "source", "first_date", "chunk")
    rows = corpus_lines(messages).join(placed, [*SESSION, "source"])
    _write_parts(rows, path, ["owner_id", "chunk"], ["source", "first_date", "session_id"])


def write_json(df: DataFrame, path: str) -> None:
    """A statistics table or report as JSON lines."""
    df.write.mode("overwrite").json(path)
