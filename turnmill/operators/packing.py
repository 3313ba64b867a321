"""Greedy bin packing of an ordered sequence, exact and in parallel.

Where a bin closes depends on every bin before it, but only through one number: the running total at which the open
bin began. So the sequence is cut into blocks of similar weight, and each block is summarised as a step function from
the incoming start to the outgoing one. Functions of neighbouring blocks compose, level by level, until one task can
walk what is left of a group; the starts then flow back down and every block marks its own bins. The result equals
the sequential loop, and no task sees more than one block of rows or ``fan_out`` functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from turnmill.operators.ordered import running
from turnmill.session import materialize

FAR = np.iinfo(np.int64).max
SAME = np.iinfo(np.int64).min


def _block_function(before: np.ndarray, weight: np.ndarray, gap: int, on_overflow: bool):
    """Summarise a block as arrays (upper, value): a start s maps to the first value with upper >= s + gap.

    ``SAME`` as a value means that no bin opens in the block.
    """
    size = len(before)
    edge = before + weight if on_overflow else before
    follow = np.maximum(np.arange(1, size + 1), np.searchsorted(edge, before + gap, "left"))
    last = np.where(follow < size, follow, np.arange(size))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    reachable = int(np.searchsorted(edge, before[0] + gap, "left"))
    stop = min(reachable, size - 1)
    upper, value = edge[: stop + 1].copy(), before[last[: stop + 1]]
    if reachable >= size:
        upper, value = np.append(upper, FAR), np.append(value, SAME)
    else:
        upper[-1] = FAR
    return _merge(upper, value)


def _merge(upper, value):
    keep = np.append(value[1:] != value[:-1], True)
    return upper[keep], value[keep]


def _apply(upper, value, start, gap):
    found = value[np.searchsorted(upper, start + gap, "left")]
    return np.where(found == SAME, start, found)


def _compose(first, second, gap):
    upper, value = first
    if value[-1] == SAME:
        floor = upper[-2] if len(upper) > 1 else SAME
        head, rest = value[:-1], second[0] > floor
        return _merge(
            np.concatenate([upper[:-1], second[0][rest]]),
            np.concatenate([_apply(*second, head, gap), second[1][rest]]),
        )
    return _merge(upper, _apply(*second, value, gap))


def _pieces(rows: pd.DataFrame):
    """Functions of a frame, in block order."""
    rows = rows.sort_values(["block", "upper"])
    for block, part in rows.groupby("block", sort=True):
        yield block, (part["upper"].to_numpy(), part["value"].to_numpy())


def pack_greedy(
    df: DataFrame,
    group: list[str],
    order: list[str],
    chunks: list[dict[str, Column]],
    weight: str,
    limit: int,
    on_overflow: bool = True,
    block_weight: int | None = None,
    fan_out: int = 256,
) -> DataFrame:
    """Add ``bin_start``: the running weight at which the row's bin begins, which names the bin inside its group.

    With ``on_overflow`` a bin closes before the row that would take it over ``limit``; an item larger than the limit
    gets a bin of its own. Otherwise a bin closes after the row that brings it to ``limit``. Weights are positive
    integers. Pass only narrow columns; wide ones are better joined back afterwards.
    """
    gap = limit + 1 if on_overflow else limit
    block_weight = block_weight or 64 * max(limit, 1)
    placed = running(df, group, order, chunks, sums={"__before": F.col(weight).cast("bigint")})
    placed = placed.withColumn("block", F.floor(F.col("__before") / block_weight))
    placed = materialize(placed, "packing")
    keys = [f for f in placed.schema.fields if f.name in group]
    function_schema = T.StructType([*keys, T.StructField("block", T.LongType()), T.StructField("upper", T.LongType()),
                                    T.StructField("value", T.LongType())])
    start_schema = T.StructType([*keys, T.StructField("block", T.LongType()), T.StructField("start", T.LongType())])

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__before")
        upper, value = _block_function(rows["__before"].to_numpy(), rows["__w"].to_numpy(), gap, on_overflow)
        out = pd.DataFrame({"block": rows["block"].iloc[0], "upper": upper, "value": value})
        for key in group:
            out[key] = rows[key].iloc[0]
        return out[[*group, "block", "upper", "value"]]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, function in _pieces(rows):
            whole = function if whole is None else _compose(whole, function, gap)
        out = pd.DataFrame({"block": rows["parent"].iloc[0], "upper": whole[0], "value": whole[1]})
        for key in group:
            out[key] = rows[key].iloc[0]
        return out[[*group, "block", "upper", "value"]]

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        start, blocks, starts = int(rows["start"].iloc[0]), [], []
        for block, function in _pieces(rows):
            blocks.append(block)
            starts.append(start)
            start = int(_apply(*function, np.array([start]), gap)[0])
        out = pd.DataFrame({"block": blocks, "start": starts})
        for key in group:
            out[key] = rows[key].iloc[0]
        return out[[*group, "block", "start"]]

    columns = df.columns

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__before")
        before, size = rows["__before"].to_numpy(), len(rows)
        edge = before + rows["__w"].to_numpy() if on_overflow else before
        opened, start = np.full(size, rows["start"].iloc[0]), int(rows["start"].iloc[0])
        at = int(np.searchsorted(edge, start + gap, "left"))
        while at < size:
            start = int(before[at])
            opened[at:] = start
            at = max(at + 1, int(np.searchsorted(edge, start + gap, "left")))
        rows["bin_start"] = opened
        return rows[[*columns, "bin_start"]]

    narrow = placed.select(*group, "block", "__before", F.col(weight).cast("bigint").alias("__w"))
    levels = [materialize(narrow.groupBy(*group, "block").applyInPandas(summarise, function_schema), "packing-fn")]
    widest = levels[0].agg(F.max("block")).first()[0]
    depth = 1 if not widest else max(1, math.ceil(math.log(widest + 1, fan_out)))
    for _ in range(depth - 1):
        parents = levels[-1].withColumn("parent", F.floor(F.col("block") / fan_out))
        levels.append(materialize(parents.groupBy(*group, "parent").applyInPandas(fold, function_schema), "packing-fn"))

    top = levels[-1].withColumn("start", F.lit(-gap).cast("bigint"))
    starts = top.groupBy(*group).applyInPandas(walk, start_schema)
    for level in reversed(levels[:-1]):
        children = level.withColumn("parent", F.floor(F.col("block") / fan_out)).join(
            starts.withColumnRenamed("block", "parent"), [*group, "parent"])
        starts = children.groupBy(*group, "parent").applyInPandas(walk, start_schema)

    result_schema = T.StructType([*df.schema.fields, T.StructField("bin_start", T.LongType())])
    fed = placed.withColumn("__w", F.col(weight).cast("bigint")).join(starts, [*group, "block"])
    return fed.groupBy(*group, "block").applyInPandas(mark, result_schema)
