"""Queries over tables that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnmill.queries.registry import query, table
from turnmill.session import run_folder
from turnmill.sinks import tables
from turnmill.sources import files


def _folder(spark):
    return f"{run_folder(spark)}/stored-{uuid.uuid4().hex}"


def _orders(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v"))


# The first write holds the even orders; the second all of them, every ninth with another value.
@query("append_conflicts", "SELECT o_orderkey AS id, o_custkey + 1 AS v FROM orders WHERE o_orderkey % 9 = 0 AND o_orderkey % 2 = 0")
def append_conflicts(spark, folder):
    rows, path = _orders(spark, folder), _folder(spark)
    tables.append_once(rows.filter("id % 2 = 0"), path, ["id"])
    again = rows.withColumn("v", F.when(F.col("id") % 9 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return tables.append_once(again, path, ["id"]).select("id", "v")


@query("appended_rows", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 AND o_orderkey % 2 = 1 THEN o_custkey + 1 ELSE o_custkey END AS v FROM orders")
def appended_rows(spark, folder):
    rows, path = _orders(spark, folder), _folder(spark)
    tables.append_once(rows.filter("id % 2 = 0"), path, ["id"])
    tables.append_once(rows.withColumn("v", F.when(F.col("id") % 9 == 0, F.col("v") + 1).otherwise(F.col("v"))), path, ["id"])
    return tables.read_appended(spark, path).select("id", "v")


@query("repeated_batch", """
SELECT o_orderkey % 3 AS batch, count(*) AS stored, CAST(ceil(count(*) / 1000000) AS INTEGER) AS files FROM orders GROUP BY 1""")
def repeated_batch(spark, folder):
    """Three batches, each sent twice: no row and no file is stored a second time."""
    rows, path = _orders(spark, folder).withColumn("batch", F.col("id") % 3), _folder(spark)
    for n in (0, 1, 2, 1, 0, 2):
        tables.append_once(rows.filter(F.col("batch") == n), path, ["id"])
    stored = spark.read.parquet(f"{path}/rows").groupBy("batch").agg(
        F.count("*").alias("stored"), F.countDistinct("_metadata.file_path").cast("int").alias("files"))
    return stored


@query("published_version", "SELECT o_orderkey AS id, o_custkey AS v FROM orders WHERE o_orderkey % 3 = 0")
def published_version(spark, folder):
    """A large version, then a smaller one: readers get the second and nothing of the first."""
    rows, root = _orders(spark, folder), _folder(spark)
    tables.publish(rows, root)
    tables.publish(rows.filter("id % 3 = 0"), root)
    return tables.current(spark, root)


@query("run_tables", """
SELECT 'a' AS run_id, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b', o_orderkey FROM orders WHERE o_orderkey % 5 = 0""")
def run_tables(spark, folder):
    rows, root = _orders(spark, folder), _folder(spark)
    tables.write_run({"ledger": rows.filter("id % 2 = 0"), "plan": rows.limit(0)}, root, "a")
    tables.write_run({"ledger": rows.filter("id % 5 = 0"), "plan": rows.limit(0)}, root, "b")
    return tables.read_runs(spark, root, "ledger").select(F.col("run_id").cast("string").alias("run_id"), "id")


@query("quarantined_rows", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'corrupt' END AS error FROM orders""")
def quarantined_rows(spark, folder):
    """Sound rows, and the bad ones from the table they were set aside in."""
    rows, root = _orders(spark, folder), _folder(spark)
    bad = rows.filter("id % 7 = 0").select("id", F.lit("corrupt").alias("error"))
    sound = tables.quarantine(rows, bad, ["id"], root, "1")
    aside = tables.read_table(spark, f"{root}/quarantine").select("id", "error")
    return sound.select("id", F.lit(None).cast("string").alias("error")).unionByName(aside)


_NATION_FILES = "SELECT c_nationkey AS n, string_agg(CAST(c_custkey AS VARCHAR), chr(10) ORDER BY c_custkey) || chr(10) AS content FROM customer GROUP BY 1"


def _nation_files(spark, folder, root):
    """One text file a nation, the numbers of its customers line by line."""
    rows = table(spark, folder, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey")
    dealt = rows.repartition("n").sortWithinPartitions("n", "c_custkey")
    dealt.select("n", F.col("c_custkey").cast("string").alias("value")).write.partitionBy("n").text(root)


@query("file_digests", f"WITH f AS ({_NATION_FILES}) SELECT 'n=' || n AS folder, strlen(content) AS size, sha256(content) AS sha256 FROM f")
def file_digests(spark, folder):
    """Files above a kilobyte are read block by block, smaller ones whole."""
    root = _folder(spark)
    _nation_files(spark, folder, root)
    found = files.file_digests(spark, root, "*.txt", 1024)
    return found.select(F.substring_index("path", "/", 1).alias("folder"), "size", "sha256")


@query("manifest_problems", """
SELECT n, CASE WHEN n % 5 = 0 THEN 'unlisted' WHEN n % 5 = 1 THEN 'changed' ELSE 'missing' END AS problem FROM (
  SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_nationkey % 5 < 2 UNION ALL SELECT DISTINCT c_nationkey + 1002 FROM customer WHERE c_nationkey % 5 = 0)""")
def manifest_problems(spark, folder):
    """A manifest that leaves out every fifth file, has another digest for the next, and names files that are not there."""
    root, n = _folder(spark), F.col("n")
    _nation_files(spark, folder, root)
    found = files.file_digests(spark, root, "*.txt").withColumn("path", F.substring_index("path", "/", 1))
    rows = found.withColumn("n", F.substring("path", 3, 9).cast("bigint"))
    listed = rows.filter(n % 5 != 0).select("path", F.when(n % 5 == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    gone = rows.filter(n % 5 == 0).select(F.concat(F.lit("n="), (n + 1002).cast("string")).alias("path"), "sha256")
    problems = files.check_manifest(found, listed.unionByName(gone))
    return problems.select(F.substring("path", 3, 9).cast("bigint").alias("n"), "problem")
