"""Which files of a table may hold a key: per written file and range of key hashes, a Bloom filter of its keys.

A key's hash names its range by its first bits. The filter of a range is as large as its keys ask for, so a file of few
keys has few small rows in the index whatever their hashes, and a batch of keys is tested only against the ranges it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RANGE_BITS = 12
#: At these sizes one key in twenty thousand is taken for one of the file's.
BITS_PER_KEY, PROBES = 24, 8

INDEX = "file string, range int, keys bigint, filter binary"


def key_hash(key: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])


def key_range(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - RANGE_BITS).cast("int")


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key: multiples of a second number from a first one, both cut from the hash."""
    mixed = hashes.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first, second = mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF) | np.uint64(1)
    return (first[:, None] + second[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def build_filter(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(hashes) * BITS_PER_KEY // 8) * 8), dtype=bool)
    bits[_places(hashes, len(bits)).astype(np.int64).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(data: bytes, hashes: np.ndarray) -> bool:
    """Whether the filter passes any of the keys. It passes every key it was built from."""
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).astype(bool)
    return bool(bits[_places(hashes, len(bits)).astype(np.int64)].all(axis=1).any())


def _filters(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = np.concatenate([b.column("key_hash").to_numpy() for b in batches])
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([len(hashes)], pa.int64()), pa.array([build_filter(hashes)])],
        names=["file", "range", "keys", "filter"])


def index_files(written: DataFrame) -> DataFrame:
    """Index rows of the files that ``written`` (with a column key_hash) is read from."""
    hashes = written.select(F.col("_metadata.file_path").alias("file"), key_range(F.col("key_hash")).alias("range"), "key_hash")
    return hashes.groupBy("file", "range").applyInArrow(_filters, INDEX)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.column("wanted")
        found = [n for n, data in enumerate(batch.column("filter")) if may_hold(data.as_py(), wanted[n].values.to_numpy())]
        yield pa.RecordBatch.from_arrays([batch.column("file").take(pa.array(found, pa.int64()))], names=["file"])


def files_for(index: DataFrame, keys: DataFrame) -> list[str]:
    """The files that may hold a key of ``keys`` (a column key_hash): all that do, and hardly another."""
    wanted = keys.groupBy(key_range(F.col("key_hash")).alias("range")).agg(F.collect_set("key_hash").alias("wanted"))
    met = index.join(wanted, "range").select("file", "filter", "wanted")
    return sorted(r["file"] for r in met.mapInArrow(_held, "file string").distinct().collect())
