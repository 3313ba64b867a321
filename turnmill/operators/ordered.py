"""Running values and ranks inside groups of any size.

A plain window sends a whole group to one task. Here a group is cut into chunks that follow its order, the window runs
inside each chunk, and the totals of the chunks before are added. Chunk totals are one row per chunk, and are
themselves scanned chunk by chunk, so no task ever holds a whole large group.

``chunks`` lists the chunk keys from fine to coarse. Each entry is a list of columns that sort the same way as the
rows, and each coarser entry must be a function of the finer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 4096


def integer_chunks(name: str, rows: int = CHUNK_ROWS, prefix: tuple[str, ...] = ()) -> list[dict[str, Column]]:
    """Chunk keys for an order that ends in a unique non-negative integer (a turn, a line, a rank)."""
    head = {p: F.col(p) for p in prefix}
    return [
        {**head, f"{name}_c1": F.floor(F.col(name) / rows)},
        {**head, f"{name}_c2": F.floor(F.col(name) / (rows * rows))},
    ]


def hash_chunks(name: str, prefix: tuple[str, ...] = (), digits: tuple[int, int] = (4, 2),
                skip: int = 0) -> list[dict[str, Column]]:
    """Chunk keys for an order that ends in a hex digest, whose leading digits spread evenly."""
    head = {p: F.col(p) for p in prefix}
    return [{**head, f"{name}_h{d}": F.substring(F.col(name), 1 + skip, d)} for d in digits]


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    chunks: list[dict[str, Column]],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
) -> DataFrame:
    """Add, per row, the sum or maximum of a value over the rows before it in its group.

    ``sums`` maps a new column to the value to add up; it is 0 on the first row. ``maxes`` maps a new column to the
    value whose maximum is wanted; it is null on the first row. Group and chunk keys must not be null.
    """
    sums, maxes = sums or {}, maxes or {}
    values = {**{f"__v_{n}": c for n, c in sums.items()}, **{f"__v_{n}": c for n, c in maxes.items()}}
    columns = df.columns
    keyed = df.withColumns(values)
    return _scan(keyed, columns, group, order, chunks, list(sums), list(maxes))


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _scan(df, columns, group, order, chunks, sums, maxes) -> DataFrame:
    if not chunks:
        window = _before(Window.partitionBy(*group).orderBy(*order))
        return df.select(
            *columns,
            *[F.coalesce(F.sum(f"__v_{n}").over(window), F.lit(0).cast("bigint")).alias(n) for n in sums],
            *[F.max(f"__v_{n}").over(window).alias(n) for n in maxes],
        )
    fine, rest = chunks[0], chunks[1:]
    keys = list(fine)
    added = {k: c for k, c in fine.items() if k not in columns}
    coarser = {k: c for level in rest for k, c in level.items() if k not in columns and k not in added}
    df = df.withColumns({**added, **coarser})
    window = _before(Window.partitionBy(*group, *keys).orderBy(*order))
    inside = df.select(
        *columns, *added,
        *[F.coalesce(F.sum(f"__v_{n}").over(window), F.lit(0).cast("bigint")).alias(f"__in_{n}") for n in sums],
        *[F.max(f"__v_{n}").over(window).alias(f"__in_{n}") for n in maxes],
    )
    totals = df.groupBy(*group, *keys, *coarser).agg(
        *[F.sum(f"__v_{n}").alias(f"__v_{n}") for n in sums],
        *[F.max(f"__v_{n}").alias(f"__v_{n}") for n in maxes],
    )
    kept = [*group, *keys, *coarser]
    named_rest = [{k: F.col(k) for k in level} for level in rest]
    offsets = _scan(totals, kept, group, keys, named_rest, sums, maxes).select(
        *group, *keys, *[F.col(n).alias(f"__off_{n}") for n in (*sums, *maxes)]
    )
    joined = inside.join(offsets, [*group, *keys])
    return joined.select(
        *columns,
        *[(F.col(f"__in_{n}") + F.col(f"__off_{n}")).alias(n) for n in sums],
        *[F.greatest(f"__in_{n}", f"__off_{n}").alias(n) for n in maxes],
    )


def ranked(df: DataFrame, group: list[str], order: list[str], chunks, name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in its group. ``order`` must be unique in the group."""
    return running(df, group, order, chunks, sums={name: F.lit(1).cast("bigint")})


def previous(
    df: DataFrame, group: list[str], position: str, values: dict[str, str], rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add values of the row before, where ``position`` is a gap-free 0-based rank in the group.

    The last row of a chunk is copied into the next chunk, so each chunk finds the row before its first one locally.
    """
    chunk = F.floor(F.col(position) / rows)
    last = F.col(position) % rows == rows - 1
    places = F.when(last, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = df.withColumn("__chunk", F.explode(places)).withColumn(
        "__guest", F.floor(F.col(position) / rows) != F.col("__chunk"))
    window = Window.partitionBy(*group, "__chunk").orderBy(position)
    seen = spread.select("*", *[F.lag(source).over(window).alias(name) for name, source in values.items()])
    return seen.filter(~F.col("__guest")).drop("__chunk", "__guest")


def runs(
    df: DataFrame, group: list[str], position: str, breaks: dict[str, Column], rows: int = CHUNK_ROWS
) -> DataFrame:
    """Number the maximal runs of neighbouring rows; a row whose break flag is true opens a new run.

    ``breaks`` maps the name of a run number to its flag. ``position`` is a gap-free 0-based rank.
    """
    flags = {f"__brk_{n}": F.when(flag, 1).otherwise(0).cast("bigint") for n, flag in breaks.items()}
    flagged = df.withColumns(flags)
    scanned = running(
        flagged, group, [position], integer_chunks(position, rows),
        sums={f"__sum_{n}": F.col(f"__brk_{n}") for n in breaks},
    )
    numbered = scanned.withColumns({n: F.col(f"__sum_{n}") + F.col(f"__brk_{n}") for n in breaks})
    return numbered.drop(*flags, *[f"__sum_{n}" for n in breaks])


def outside_in(position: Column, count: Column) -> Column:
    """Place of a row when its group is read first, last, second, second to last, and so on (0-based)."""
    front = position * 2
    return F.when(front < count, front).otherwise((count - 1 - position) * 2 + 1)


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``. Combines before the shuffle, so copies of one key cost nothing."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("__row")).select(
        *keys, *[F.col(f"__row.{c}").alias(c) for c in (*order, *rest)]
    ).select(*df.columns)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least by ``order``; combines before the shuffle like ``newest``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("__row")).select(
        *keys, *[F.col(f"__row.{c}").alias(c) for c in (*order, *rest)]
    ).select(*df.columns)


def top_rows(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group. Spark trims every partition to ``k`` rows per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= k).drop("__n")
