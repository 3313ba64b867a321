"""Exact duplicates by counting quotient filters.

A text's 64-bit fingerprint is cut into a quotient (its high bits) and a remainder. Each partition builds a counting
quotient filter over its fingerprints: a bitmap of the quotients in use, one run-end bit per slot, and the remainders in
order, each with its count. Quotient and remainder together are the whole fingerprint, so nothing is lost. Filters are cut
by ranges of quotients, and the parts of one range are merged by their sorted remainders. Fingerprints with a total above
one send their documents to byte verification: texts are grouped by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.llm.arrays import free_names, numbered_copies, slices
from turnmill.session import materialize

REMAINDER_BITS = 40
ROUTE_BITS = 1 << 27


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A to Z in lower case and null as the empty text."""
    return pc.ascii_lower(pc.fill_null(texts, ""))


def digests(text: Column, bits: int = 64) -> Column:
    """struct(fp, sha): XXH64 as a signed long and SHA-256 as hex, both of the normalised text in UTF-8.

    ``bits`` keeps only so many bits of the fingerprint; tests use it to make different texts meet.
    """
    @F.arrow_udf("struct<fp bigint, sha string>")
    def run(texts: pa.Array) -> pa.Array:
        fps, shas = [], []
        for part in slices(texts):
            for value in folded(part):
                data = value.as_buffer()
                fps.append(xxhash.xxh64_intdigest(data) >> (64 - bits) << (64 - bits))
                shas.append(hashlib.sha256(data).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(shas, pa.string())], names=["fp", "sha"])

    return run(text)


def build_filter(fps: np.ndarray, counts: np.ndarray) -> bytes:
    """One range of a counting quotient filter. ``fps`` are distinct, sorted and unsigned."""
    quotients = fps >> np.uint64(REMAINDER_BITS)
    first = int(quotients[0])
    offsets = (quotients - np.uint64(first)).astype(np.int64)
    occupied = np.zeros(int(offsets[-1]) + 1, dtype=np.uint8)
    occupied[offsets] = 1
    runends = np.r_[offsets[1:] != offsets[:-1], True].astype(np.uint8)
    remainders = np.ascontiguousarray((fps & np.uint64((1 << REMAINDER_BITS) - 1)).view(np.uint8).reshape(-1, 8)[:, :REMAINDER_BITS // 8])
    several = (counts > 1).astype(np.uint8)
    head = np.array([first, len(occupied), len(fps)], dtype=np.int64)
    parts = [head, np.packbits(occupied), np.packbits(runends), remainders, np.packbits(several), counts[counts > 1].astype(np.int64)]
    return b"".join(p.tobytes() for p in parts)


def read_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of a filter, sorted."""
    first, width, slots = np.frombuffer(data, dtype=np.int64, count=3).tolist()
    at = 24

    def bits(n):
        nonlocal at
        size = (n + 7) // 8
        found = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n)
        at += size
        return found

    quotients = np.flatnonzero(bits(width)) + first
    ends = bits(slots)
    size = REMAINDER_BITS // 8
    wide = np.zeros((slots, 8), dtype=np.uint8)
    wide[:, :size] = np.frombuffer(data, np.uint8, slots * size, at).reshape(slots, size)
    at += slots * size
    several = bits(slots).astype(bool)
    counts = np.ones(slots, dtype=np.int64)
    counts[several] = np.frombuffer(data, dtype=np.int64, offset=at)
    run = np.r_[0, np.cumsum(ends)[:-1]]
    return quotients[run].astype(np.uint64) << np.uint64(REMAINDER_BITS) | wide.view(np.uint64).ravel(), counts


def merge_filters(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and added counts of several filters of one range."""
    read = [read_filter(p) for p in parts]
    fps, counts = np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read])
    order = np.argsort(fps, kind="stable")
    fps, counts = fps[order], counts[order]
    starts = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
    return fps[starts], np.add.reduceat(counts, starts)


def _count(fps, counts=None):
    order = np.argsort(fps, kind="stable")
    fps = fps[order]
    starts = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
    counts = np.ones(len(fps), np.int64) if counts is None else counts[order]
    return fps[starts], np.add.reduceat(counts, starts)


def _partition_filters(range_bits: int):
    def run(batches):
        held, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                new = batch.column(0).to_numpy().view(np.uint64)
                held, counts = _count(np.concatenate([held, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
        places = (held >> np.uint64(64 - range_bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(held) else []
        stops = np.r_[starts[1:], len(held)] if len(held) else []
        for at in range(0, len(starts), 4096):
            some = list(zip(starts[at:at + 4096], stops[at:at + 4096]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(places[a]) for a, _ in some], pa.int32()),
                 pa.array([build_filter(held[a:b], counts[a:b]) for a, b in some], pa.binary())], names=["place", "filter"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    fps, counts = merge_filters(table.column("filter").to_pylist())
    several = counts > 1
    return pa.table({"fp": pa.array(fps[several].view(np.int64)), "n": pa.array(counts[several])})


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """``fp, n``: the values of the column ``fp`` that occur more than once, through merged per-partition filters."""
    wanted = 4 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = min(24, max(4, wanted.bit_length()))
    filters = fps.select("fp").mapInArrow(_partition_filters(range_bits), "place int, filter binary")
    return filters.groupBy("place").applyInArrow(_merge, "fp bigint, n bigint")


def _route(repeated: DataFrame):
    """A test that every repeated fingerprint passes: a bitmap of fixed size, set where one falls.

    The bitmap is 16 MB at most. With more repeated fingerprints than it can tell apart further documents pass too; they
    are verified like the others and found to be alone.
    """
    size = 1 << 20
    count = repeated.count()
    while size < ROUTE_BITS and size < 16 * count:
        size *= 2
    words = repeated.select(F.pmod(F.col("fp"), F.lit(size)).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    bitmap = np.zeros(size // 64, dtype=np.int64)
    found = words.toArrow()
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return repeated.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8)), size


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """``id_col, sha, copies, keep_id, group_size``: one row per distinct id and text, with how many rows carry it.

    Texts are equal when they are identical after lower-casing A to Z; null counts as empty. ``keep_id`` is the largest id
    among equal texts (null only where all are), ``group_size`` the number of their rows. An empty table gives no rows;
    extra columns are not read.
    """
    d = digests(F.col(text_col), bits)
    narrow = materialize(
        docs.select(F.col(id_col).alias("id"), d.alias("d")).select("id", "d.fp", "d.sha"), "digests")
    repeated = materialize(repeated_fingerprints(narrow), "repeated")
    bitmap, size = _route(repeated)

    def verify(batches):
        for batch in batches:
            for part in slices(batch):
                ids, texts, found = part.column(0), folded(part.column(1)), []
                for i, value in enumerate(texts):
                    fp = xxhash.xxh64_intdigest(value.as_buffer()) >> (64 - bits) << (64 - bits)
                    bit = (fp - (1 << 64) if fp >> 63 else fp) % size
                    if bitmap.value[bit >> 3] >> (bit & 7) & 1:
                        found.append((i, fp - (1 << 64) if fp >> 63 else fp))
                if found:
                    at = pa.array([i for i, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), pa.array([fp for _, fp in found], pa.int64()), texts.take(at)], names=["id", "fp", "norm"])

    id_type = docs.schema[id_col].dataType.simpleString()
    routed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        verify, f"id {id_type}, fp bigint, norm string")
    # Equal bytes meet here and nowhere else; copies in one task are one row before the shuffle.
    verified = routed.groupBy("fp", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = verified.filter("group_size > 1").select(F.col("fp"), F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    classes = materialize(classes, "classes")
    rows = narrow.groupBy("id", "fp", "sha").agg(F.count("*").alias("copies"))
    joined = rows.join(classes, ["fp", "sha"], "left")
    return joined.select(
        F.col("id").alias(id_col), "sha", "copies",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per document, dropped ones too: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; where rows share both id and text, one of them does.
    """
    classes = duplicate_classes(docs, id_col, text_col, bits)
    copied = numbered_copies(classes, "copies", "copy")
    return copied.select(
        id_col, "keep_id", "group_size",
        (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that share id and text, one does."""
    sha, = free_names(docs, "sha")
    classes = materialize(duplicate_classes(docs, id_col, text_col), "duplicate-classes")
    stay = classes.filter(F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias("__id"), F.col("sha").alias("__sha"), "copies")
    marked = docs.withColumn(sha, digests(F.col(text_col))["sha"])
    same = marked[id_col].eqNullSafe(F.col("__id")) & (marked[sha] == F.col("__sha"))
    single = marked.join(stay.filter("copies = 1"), same, "left_semi")
    several = marked.join(stay.filter("copies > 1"), same, "left_semi").dropDuplicates([id_col, sha])
    return single.unionByName(several).select(*docs.columns)
