"""Small helpers for Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

SLICE_ROWS = 128
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Spark hand texts to Python in small batches; with the default of 10,000 rows a batch of long texts is large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batch, rows: int = SLICE_ROWS) -> Iterator:
    """Parts of an Arrow batch or array, so that only a few texts at a time become Python objects."""
    for start in range(0, len(batch) if isinstance(batch, pa.Array) else batch.num_rows, rows):
        yield batch.slice(start, rows)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not use yet, whatever its own columns are called."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def numbered_copies(df: DataFrame, count: str, name: str, at_once: int = 4096) -> DataFrame:
    """Each row as often as ``count`` says, numbered from 1 in ``name``. No array longer than needed for a part is built."""
    parts = df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / at_once))))
    within = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(at_once).cast("bigint"), F.col(count) - F.col(name) * at_once))
    numbers = F.transform(within, lambda i: i + F.col(name) * at_once)
    return parts.withColumn(name, F.explode(numbers))


def frequent(counted: DataFrame, most: int, at_least: bool = False) -> DataFrame:
    """Rows of the largest counts (column ``n``), found without a sort from a histogram of a few hundred buckets.

    Whole buckets of similar counts are taken from the top: as many as hold at most ``most`` rows, or with ``at_least``
    as few as hold that many. ``counted`` should be written, as it is read twice.
    """
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    held = counted.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows")).collect()
    total, lowest = 0, 1 << 30
    for row in sorted(held, key=lambda r: -r["bucket"]):
        if total + row["rows"] > most and not at_least:
            break
        total, lowest = total + row["rows"], row["bucket"]
        if total >= most:
            break
    return counted.filter(bucket >= lowest)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as zstd-compressed byte planes: first the planes of the lowest bytes."""
    parts = [np.array([len(arrays)] + [x for a in arrays for x in (len(a), a.itemsize)], dtype="<u8").tobytes()]
    parts += [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, "<u8", 1)[0])
    shapes, at, found = np.frombuffer(raw, "<u8", 2 * count, 8).astype(int).reshape(-1, 2).tolist(), 8 + 16 * count, []
    for size, width in shapes:
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        found.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(size))
        at += size * width
    return found
