"""Following pointers: ancestors of a head, or the path a head took."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnmill.session import materialize


def walk(pointers: DataFrame, starts: DataFrame, max_steps: int | None = None) -> DataFrame:
    """Nodes reached from each start: ``owner_id, start, node, steps``, the start itself at 0 steps.

    ``pointers``: owner_id, node, next (one row per node). ``starts``: owner_id, node. Paths and pointers double with every
    join, so a chain of a million steps takes twenty. The walk ends where no chain goes on. With ``max_steps`` paths end
    there; without, a chain that returns to itself ends after as many steps as there are pointers.
    """
    jump = materialize(pointers.filter("next is not null").select("owner_id", "node", "next"), "jump")
    bound = jump.count() if max_steps is None else max_steps
    reached = materialize(
        starts.select("owner_id", F.col("node").alias("start"), "node", F.lit(0).cast("bigint").alias("steps")), "reached")
    length = 1
    while length <= bound:
        ahead = materialize(reached.join(jump, ["owner_id", "node"]).select(
            "owner_id", "start", F.col("next").alias("node"), (F.col("steps") + length).alias("steps")), "reached")
        # Only the new part is written; the parts written before are read as they are.
        reached = reached.unionByName(ahead)
        length *= 2
        if length > bound or ahead.isEmpty():
            break
        onward = jump.select("owner_id", F.col("node").alias("from"), F.col("next").alias("node"))
        jump = materialize(onward.join(jump, ["owner_id", "node"]).select(
            "owner_id", F.col("from").alias("node"), "next"), "jump")
    return reached.filter(F.col("steps") <= bound)


def broken_chains(pointers: DataFrame, reached: DataFrame, max_steps: int) -> DataFrame:
    """Starts whose chain returns to a node, names a missing one, or does not end within ``max_steps``."""
    again = reached.groupBy("owner_id", "start", "node").agg(F.count("*").alias("n")).filter("n > 1").select(
        "owner_id", "start", F.lit("cycle").alias("problem"))
    known = pointers.select("owner_id", "node", "next").withColumn("known", F.lit(True))
    tips = reached.join(known, ["owner_id", "node"], "left")
    lost = tips.filter("known is null").select("owner_id", "start", F.lit("missing").alias("problem"))
    long = tips.filter(F.col("next").isNotNull() & (F.col("steps") == max_steps)).select(
        "owner_id", "start", F.lit("too-long").alias("problem"))
    return again.unionByName(lost).unionByName(long).distinct()
