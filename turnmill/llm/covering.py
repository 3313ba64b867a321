"""SimHash near-duplicates found by covering locality-sensitive hashing.

For a radius r, every bit position gets a random vector of r + 1 bits. Each non-zero vector v of r + 1 bits gives one
table, whose mask keeps the positions i with odd <v, m(i)>. If two fingerprints differ in at most r positions, some v is
orthogonal to all vectors of those positions, so they agree under that mask: no pair within the radius is missed, and
with r = 4 there are 31 tables whose keys hold about half of the bits.

Work is done on distinct fingerprints. A bucket (one table, one key) returns the edges of a spanning forest of its links,
never its pairs: from each fingerprint of the frontier, those within the radius leave the bucket's unvisited rest. A bucket
of more than ``bucket_rows`` fingerprints is not gathered; its fingerprints are posted under every value that differs in
at most half the radius on the bits the mask leaves free. Two fingerprints share such a value exactly when they are within
the radius, so one minimum per value links all of them, in as many rows as there are fingerprints times a constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.llm.arrays import free_names, slices
from turnmill.llm.graph import components
from turnmill.session import materialize

BITS = 64
BUCKET_ROWS = 200_000
BLOCK = 1 << 15


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``width`` words joined by a space, in blocks; fewer words are one run, none none."""
    if not words:
        return
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    stops = np.cumsum(lengths) - 1
    starts = stops - lengths + 1
    span = min(width, len(words)) - 1
    pairs = list(zip(starts[:len(words) - span].tolist(), stops[span:].tolist()))
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(pairs), BLOCK):
        part = pairs[at:at + BLOCK]
        yield np.fromiter((digest(text[a:b], 42) for a, b in part), dtype=np.uint64, count=len(part))


def simhash(text: str | None, width: int) -> int:
    """64-bit SimHash of a text's word shingles, as a signed number: a bit is 1 if more than half of the hashes have it.

    A to Z are lower-cased and words end at space, tab, LF, VT, FF or CR, which is what bytes.lower and bytes.split do.
    """
    votes, total = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), width):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    packed = np.packbits((votes * 2 > total).astype(np.uint8), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(text: Column, width: int) -> Column:
    """SimHash of a text column as a signed long; null and wordless texts give 0."""
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t, width) for part in slices(texts) for t in part.to_pylist()], type=pa.int64())

    return run(text)


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """The 2^(radius+1) - 1 bit masks of the covering family."""
    drawn = np.random.default_rng(seed).integers(0, 1 << (radius + 1), size=BITS).tolist()
    return [sum(((v & vector).bit_count() & 1) << i for i, vector in enumerate(drawn)) for v in range(1, 1 << (radius + 1))]


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    rest, left, right = values, [], []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            source = frontier.pop()
            near = np.bitwise_count(rest ^ source) <= radius
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), source, dtype=values.dtype))
                right.append(found)
                frontier.extend(found)
                rest = rest[~near]
    if not left:
        return values[:0], values[:0]
    return np.concatenate(left), np.concatenate(right)


def _halfway(values: np.ndarray, mask: int, radius: int) -> Iterator[np.ndarray]:
    """Each array holds the fingerprints with one choice of at most half the radius free bits flipped."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    for size in range((radius + 1) // 2 + 1):
        for chosen in combinations(free, size):
            yield values ^ np.uint64(sum(1 << i for i in chosen))


def _link_buckets(masks: list[int], radius: int, bucket_rows: int):
    """Over rows (table, key, fp) sorted by all three: edges (kind 0) or halfway postings (kind 1) as (a, b, kind)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int8())])

    def rows(a, b, kind):
        for at in range(0, len(a), BLOCK):
            left, right = a[at:at + BLOCK].view(np.int64), b[at:at + BLOCK].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(np.full(len(left), kind, np.int8))], schema=schema)

    def post(values, table):
        for moved in _halfway(values, masks[table], radius):
            yield from rows(moved, values, 1)

    def close(held):
        if not held["posted"] and held["values"]:
            values = np.concatenate(held["values"])
            if len(values) > 1:
                yield from rows(*forest(values, radius), 0)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tables, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = batch.column(2).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])])
            stops = np.r_[starts[1:], len(keys)]
            several = np.flatnonzero((stops - starts > 1) | (starts == 0) | (stops == len(keys)))
            for i in several.tolist():
                here, part = (int(tables[starts[i]]), int(keys[starts[i]])), values[starts[i]:stops[i]]
                if held is None or held["at"] != here:
                    if held is not None:
                        yield from close(held)
                    held = {"at": here, "values": [], "size": 0, "posted": False}
                held["size"] += len(part)
                if held["posted"]:
                    yield from post(part, here[0])
                elif held["size"] > bucket_rows:
                    for earlier in held["values"]:
                        yield from post(earlier, here[0])
                    yield from post(part, here[0])
                    held["posted"], held["values"] = True, []
                else:
                    held["values"].append(part.copy())
        if held is not None:
            yield from close(held)

    return run


def near_links(fps: DataFrame, radius: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``a, b`` that connect distinct fingerprints (column ``fp``) exactly as all pairs within ``radius`` would."""
    masks = covering_masks(radius)
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("place", "key"))
    placed = keyed.select(F.col("place").cast("int").alias("place"), "key", "fp").repartition("place", "key").sortWithinPartitions("place", "key")
    found = materialize(placed.mapInArrow(_link_buckets(masks, radius, bucket_rows), "a bigint, b bigint, kind tinyint"), "near")
    direct = found.filter("kind = 0").select("a", "b").distinct()
    posted = found.filter("kind = 1").select("a", "b").distinct()
    if posted.isEmpty():
        return direct
    least = posted.groupBy("a").agg(F.min("b").alias("least"))
    return direct.unionByName(posted.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``id_col, fp, component_id`` for every row: its fingerprint and the smallest id it is linked to, itself included.

    Rows link when their fingerprints differ in at most ``radius`` bits; links carry on through further rows. Rows whose
    text is null, empty or without words have fingerprint 0 and link like any other. A null id is never the smallest one:
    a component of null ids only has a null ``component_id``. Repeated rows and repeated ids give a row each. An empty
    table gives no rows. Extra columns are not read.
    """
    known = materialize(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), width).alias("fp")), "simhash")
    firsts = materialize(known.groupBy("fp").agg(F.min("id").alias("first_id")), "firsts")
    roots = materialize(components(near_links(firsts.select("fp"), radius, bucket_rows)), "roots")
    linked = firsts.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    whole = linked.join(least, "root").select("fp", "least_id")
    placed = firsts.join(whole, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return known.join(placed, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each component, one row of its smallest id. All columns are kept.

    Rows with a null id stay, as nothing names them. Where an id is repeated, its rows are told apart by fingerprint.
    """
    fp, = free_names(docs, "fp")
    seen = materialize(near_duplicates(docs, id_col, text_col, width, radius), "near-classes")
    stay = seen.filter(F.col(id_col) == F.col("component_id"))
    repeated = seen.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(id_col)
    single = docs.join(stay.join(repeated, id_col, "left_anti").select(id_col), id_col, "left_semi")
    several = docs.join(repeated, id_col, "left_semi").withColumn(fp, fingerprints(F.col(text_col), width)).join(
        stay.select(id_col, F.col("fp").alias(fp)).distinct(), [id_col, fp], "left_semi").dropDuplicates([id_col, fp])
    unnamed = docs.filter(F.col(id_col).isNull())
    return single.unionByName(several.select(*docs.columns)).unionByName(unnamed)
