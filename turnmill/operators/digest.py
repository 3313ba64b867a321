"""Digest of a table's content, built as a tree so that no task lists a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnmill.functions.identity import sha256

LEVELS = (6, 4, 2)


def set_digest(df: DataFrame, group: list[str], entry: Column, name: str = "digest") -> DataFrame:
    """One digest per group over its entries, whatever their order; copies of an entry count.

    Entries are hashed, equal ones counted, and digests of a shared prefix hashed together until one is left.
    """
    leaves = df.select(*group, sha256(entry).alias("__leaf")).groupBy(*group, "__leaf").agg(F.count("*").alias("__n"))
    node = leaves.select(*group, F.col("__leaf").alias("__key"), F.concat_ws(":", "__leaf", "__n").alias("__value"))
    for digits in LEVELS:
        node = node.groupBy(*group, F.substring("__key", 1, digits).alias("__prefix")).agg(
            sha256(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "__key", "__value"))), "\n")).alias("__value"))
        node = node.withColumnRenamed("__prefix", "__key")
    return node.groupBy(*group).agg(
        sha256(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "__key", "__value"))), "\n")).alias(name))
