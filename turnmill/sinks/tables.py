"""Append-only and versioned tables on plain files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.functions.identity import canonical_json, sha256
from turnmill.operators.digest import set_digest
from turnmill.session import exists, materialize
from turnmill.sinks import keyindex

#: Rows of a file that ``append_once`` writes.
FILE_ROWS = 1_000_000


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None where nothing was written yet."""
    return spark.read.parquet(path) if exists(spark, f"{path}/[!_.]*") else None


def append_once(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Append rows whose key is new; return those that differ from the stored row of their key.

    Conflicting rows are not written: a content-addressed row never changes. Rows are written sorted into files by a hash of
    their key, and an index tells which files may hold a key, so a batch opens only those with keys of its own. The index is
    written last: rows count from then on, and what an interrupted batch left behind does not.
    """
    spark = rows.sparkSession
    # Digests are half as long in bytes as in digits, which they become where they are stored.
    content = F.unhex(sha256(canonical_json({c: F.col(c) for c in rows.columns})))
    digits = F.lower(F.hex("content_sha256"))
    dealt = rows.withColumns({"content_sha256": content, "key_hash": keyindex.key_hash(key)}).dropDuplicates([*key, "content_sha256"])
    hashed = materialize(dealt, "append")
    stored = stored_for(spark, path, hashed)
    stored = hashed.limit(0) if stored is None else stored.withColumn("content_sha256", F.unhex("content_sha256"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("key_hash", *key)]
    old = stored.select("key_hash", *key, F.col("content_sha256").alias("stored_sha256")).distinct()
    twice = hashed.groupBy("key_hash", *key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("twice", F.lit(True))
    both = hashed.alias("n").join(old.alias("o"), same, "left").select("n.*", "stored_sha256")
    both = materialize(both.alias("n").join(twice.alias("o"), same, "left").select("n.*", "twice"), "append")
    new = both.filter("stored_sha256 is null and twice is null").drop("stored_sha256", "twice")
    count = new.count()
    if count:
        folder = f"{path}/rows/appended_batch={uuid.uuid4().hex}"
        ordered = new.repartitionByRange(-(-count // FILE_ROWS), "key_hash").sortWithinPartitions("key_hash")
        ordered.withColumn("content_sha256", digits).write.parquet(folder)
        keyindex.index_files(spark.read.parquet(folder)).write.mode("append").parquet(f"{path}/index")
    found = both.filter("stored_sha256 != content_sha256 or (stored_sha256 is null and twice)").withColumn("content_sha256", digits)
    return found.drop("stored_sha256", "twice", "key_hash")


def files_for(spark: SparkSession, path: str, keys: DataFrame) -> list[str]:
    """The files of a table of ``append_once`` that may hold keys of ``keys`` (with their key_hash)."""
    index = read_table(spark, f"{path}/index")
    return [] if index is None else keyindex.files_for(index, keys.select("key_hash"))


def stored_for(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame | None:
    """The stored rows that may have a key of ``keys``, or None where there are none."""
    files = files_for(spark, path, keys)
    return spark.read.parquet(*files) if files else None


def read_appended(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of a table of ``append_once``, with their content_sha256."""
    index = read_table(spark, f"{path}/index")
    if index is None:
        return None
    # A batch that was interrupted before its index was written has rows, but no name in the index.
    batches = index.select(F.regexp_extract("file", "/appended_batch=([0-9a-f]{32})/", 1).alias("appended_batch")).distinct()
    stored = spark.read.parquet(f"{path}/rows")
    return stored.join(batches, "appended_batch", "left_semi").drop("appended_batch", "key_hash")


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a table as a new version, then point readers at it; returns the digest of its content.

    A pointer is one more row of a small table, so readers see the old version or the new one, at every moment, and a
    smaller rerun leaves no stale file behind. The table is written first and its digest taken from what was written.
    """
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/versions/{folder}")
    written = spark.read.schema(df.schema).parquet(f"{root}/versions/{folder}")
    found = set_digest(written, [], canonical_json({c: F.col(c) for c in df.columns}), "digest").first()
    digest = found["digest"] if found else "empty"
    pointers = read_table(spark, f"{root}/pointers")
    last = pointers.agg(F.max("number")).first()[0] if pointers is not None else 0
    row = spark.range(1).select(F.lit(last + 1).cast("bigint").alias("number"), F.lit(folder).alias("folder"), F.lit(digest).alias("digest"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return digest


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest published version."""
    pointers = read_table(spark, f"{root}/pointers")
    if pointers is None:
        return None
    return spark.read.parquet(f"{root}/versions/{pointers.agg(F.max_by('folder', 'number')).first()[0]}")


def write_run(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """The tables of one run (ledger, packets, plan, selected segments and so on), each under the run's id."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/run_id={run_id}")


def read_runs(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """All runs of a table, with the column ``run_id``."""
    return read_table(spark, f"{root}/{name}")


def quarantine(rows: DataFrame, bad: DataFrame, key: list[str], root: str, batch: str) -> DataFrame:
    """The sound rows; the bad ones, with what ``bad`` says about them, are set aside in a table of their own."""
    rows.join(bad, key).write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch}")
    return rows.join(bad.select(*key).distinct(), key, "left_anti")


def write_delta(df: DataFrame, root: str, batch_id: int) -> None:
    """Add one micro-batch to a log of changes; writing a batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{root}/delta/batch={batch_id}")


def read_deltas(spark: SparkSession, root: str) -> DataFrame | None:
    """The compacted base, if any, and every later micro-batch, with a ``batch`` column."""
    base = current(spark, f"{root}/base")
    deltas = read_table(spark, f"{root}/delta")
    if base is None or deltas is None:
        return base if deltas is None else deltas
    upto = base.agg(F.max("batch")).first()[0]
    return base.unionByName(deltas.filter(F.col("batch") > upto).select(*base.columns))


def compact(df: DataFrame, root: str) -> str:
    """Publish ``df`` (with its ``batch`` column at the newest batch it covers) as the new base."""
    upto = df.agg(F.max("batch")).first()[0]
    return publish(df.withColumn("batch", F.lit(upto)), f"{root}/base")
