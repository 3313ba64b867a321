"""Log files that grow: which are new or changed since the last read, by size and time of change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.session import exists, materialize
from turnmill.sinks.tables import current, publish
from turnmill.sources.logs import read_lines

STATE = "file_path string, size long, modified timestamp"


def file_states(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``file_path, size, modified`` of every log below the roots; contents are not read."""
    found = [r for r in sorted(set(roots)) if exists(spark, r)]
    if not found:
        return spark.createDataFrame([], STATE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(found)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_status(now: DataFrame, before: DataFrame) -> DataFrame:
    """Every file with ``status``: pending (never read), changed, processed, or gone."""
    old = before.select("file_path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    status = (F.when(F.col("size").isNull(), "gone").when(F.col("old_size").isNull(), "pending").when(same, "processed").otherwise("changed"))
    return now.join(old, "file_path", "full_outer").select("file_path", "size", "modified", status.alias("status"))


def read_growing(spark: SparkSession, roots: list[str], state: str):
    """Lines of the files that are new or have changed, each file whole, and a function that marks them as read.

    Call the function once the lines are stored; until then the same files are offered again. Whole files are read again,
    so store what comes of them under the identity of its content, as ``append_once`` does; ``tail.tail_lines`` reads only
    what files have grown by. Files that did not change since the oldest changed one are not opened.
    """
    now = materialize(file_states(spark, roots), "file-states")
    before = current(spark, state)
    status = file_status(now, spark.createDataFrame([], STATE) if before is None else before)
    due = materialize(status.filter("status in ('pending', 'changed')").select("file_path", "modified"), "due-files")
    since = due.agg(F.min("modified")).first()[0]
    if since is None:
        return None, lambda: publish(now, state)
    changed = read_lines(spark, roots).filter(F.col("modified") >= F.lit(since))
    lines = changed.join(due.select("file_path"), "file_path", "left_semi").select(*changed.columns)
    return lines, lambda: publish(now, state)
