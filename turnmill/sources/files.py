"""Content digests of files and of whole trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.functions.identity import canonical_json, normalized_path
from turnmill.operators.digest import set_digest

WHOLE_BYTES, BLOCK_BYTES = 1 << 26, 1 << 22


def file_digests(spark: SparkSession, root: str, glob: str | None = None, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``path`` relative to the root, ``size`` and ``sha256`` of every file.

    Files of up to ``whole_bytes`` are read as one value. Larger ones are read block by block in the task that has their name,
    so a file of any size takes the memory of a block; their folder must be one that pyarrow can open from the tasks.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/") + "/"
    files = reader.load(root)
    path = F.replace(normalized_path(F.col("path")), F.lit(base), F.lit("")).alias("path")
    # The filter on the length keeps large files from being opened here.
    small = files.filter(F.col("length") <= whole_bytes).select(path, F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole_bytes).select("path", F.col("length").alias("size"))
    read = large.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_digest, "path string, size bigint, sha256 string")
    return small.unionByName(read.select(path, "size", "sha256"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for place in batch.column(0).to_pylist():
            files, name = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), unquote(place.removeprefix("file:")))
            digest = hashlib.sha256()
            with files.open_input_file(name) as file:
                while block := file.read(BLOCK_BYTES):
                    digest.update(block)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "size", "sha256"])


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest over the paths, sizes and digests of all files."""
    entry = canonical_json({"path": F.col("path"), "sha256": F.col("sha256"), "size": F.col("size")})
    return set_digest(files, [], entry, "tree_sha256")


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare files with a manifest of ``path, sha256``: one row per missing, changed or unlisted file."""
    both = files.select("path", F.col("sha256").alias("actual")).join(
        manifest.select("path", F.col("sha256").alias("expected")), "path", "full_outer")
    problem = (F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unlisted")
               .when(F.col("actual") != F.col("expected"), "changed"))
    return both.select("path", problem.alias("problem")).filter("problem is not null")
