"""Exact top-k search by inner product with vector-approximation files.

Vectors are scaled to whole numbers. Equal vectors are one class that keeps its k + 1 smallest ids, which is all that ties
can ask of it. Classes are dealt into blocks; a block's approximation file holds for every component a cell of a few bits
between the block's smallest and largest value there. Distinct query vectors are packed into chunks, and every chunk meets
every block's file:

1. A first scan bounds each score from below; the (k + 1)-th largest bound over all blocks is what a result must reach.
2. A second scan bounds each score from above and lets through the classes that can reach it.
3. Exact vectors are read in the order of these bounds, a stretch at a time, until the (k + 1)-th exact score of a query is
   above the bound of all that it has not read.

Scores are sums of whole numbers and exact; bounds beyond 2^53 are widened by what a double may lose. k + 1 results are kept
for a query vector, so that each query of its class can leave itself out.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id or vectors whose
scaled length is 2^30 or more, whose scores may not fit a long. Of rows that repeat an id one takes part (the smallest
vector). A query meets vectors of its own length only. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnmill.llm.arrays import pack, unpack
from turnmill.session import materialize

FACTOR = 256.0
BLOCK_ROWS, CHUNK_QUERIES, SLICE_QUERIES = 1 << 14, 512, 32
CELL_BITS = 6
#: Candidates read at first, as a multiple of the results wanted, and how much longer each further stretch is.
FIRST_READ, READ_GROWTH = 4, 4


def scaled(rows: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    """``id, vec``: floor(factor * x) of every component of the vectors that take part."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    length = F.aggregate(vec, F.lit(0.0), lambda total, x: total + (x * factor) * (x * factor))
    good = rows.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"), finite.alias("finite"), length.alias("length"))
    good = good.filter("id is not null and finite and size(vec) > 0").filter(F.col("length") < float(1 << 60))
    whole = F.transform("vec", lambda x: F.floor(x * factor).cast("bigint"))
    return good.select("id", whole.alias("vec")).groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _stack(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    held = [[] for _ in names]
    for batch in batches:
        for kept, name in zip(held, names):
            column = batch.column(name)
            kept.append(_matrix(column) if pa.types.is_list(column.type) else column.to_numpy())
    return [np.concatenate(h) for h in held]


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of every component, and for each place the first value of cell 0 and the number of values in a cell."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    step = (high - low >> CELL_BITS) + 1
    return ((vectors - low) // step).astype(np.uint8), low, step


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the lowest corner of each cell, and what is to be added for the smallest and the largest score in it.

    ``cells`` are doubles, one column per vector.
    """
    queries, low, step = queries.astype(np.float64), low.astype(np.float64), step.astype(np.float64)
    corner = (queries * step) @ cells
    corner += (queries @ low)[:, None]
    inside = queries * (step - 1)
    size = np.abs(queries) @ (np.abs(low) + step * (1 << CELL_BITS))
    slack = np.where(size < 2.0 ** 52, 0.0, size * 2.0 ** -48 * len(low))
    return corner, np.minimum(inside, 0).sum(axis=1) - slack, np.maximum(inside, 0).sum(axis=1) + slack


def _pack_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, copies, vectors = _stack(batches, "id", "copies", "vec")
    order = np.argsort(ids)
    cells, low, step = approximate(vectors[order])
    yield _packed(key, pack(ids[order], copies[order].astype(np.int64), low, step, cells.ravel()))


def _pack_chunk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, vectors = _stack(batches, "id", "vec")
    order = np.argsort(ids)
    yield _packed(key, pack(ids[order], vectors[order].ravel()))


def _packed(key: tuple[pa.Scalar, ...], data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([data])], names=["size", "place", "data"])


def _signed(data: bytes) -> list[np.ndarray]:
    return [a.view(np.int64) if a.itemsize == 8 else a for a in unpack(data)]


def _scan(batch: pa.RecordBatch, row: int):
    """The queries of a chunk and the bounds of their scores with a block, a few queries at a time."""
    query_ids, flat = _signed(batch.column("queries")[row].as_py())
    ids, copies, low, step, cells = _signed(batch.column("file")[row].as_py())
    queries, cells = flat.reshape(len(query_ids), -1), cells.reshape(len(ids), -1).T.astype(np.float64)
    for at in range(0, len(query_ids), SLICE_QUERIES):
        some = slice(at, at + SLICE_QUERIES)
        yield some, query_ids[some], ids, copies, *bounds(queries[some], cells, low, step)


def _largest(values: np.ndarray, copies: np.ndarray, wanted: int) -> np.ndarray:
    """Of each row the largest values, copies counted, filled up with minus infinity."""
    few = min(wanted, values.shape[1])
    at = np.argpartition(-values, few - 1, axis=1)[:, :few]
    found = np.full((len(values), wanted), -np.inf)
    for n, (own, places) in enumerate(zip(np.take_along_axis(values, at, axis=1), at)):
        order = np.argsort(-own)
        repeated = np.repeat(own[order], copies[places[order]])[:wanted]
        found[n, :len(repeated)] = repeated
    return found


def _reach(wanted: int):
    """Per chunk and block the largest lower bounds of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                best = np.concatenate([_largest(corner + least[:, None], copies, wanted) for _, _, _, copies, corner, least, _ in _scan(batch, row)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("size").slice(row, 1), batch.column("chunk").slice(row, 1), pa.array([pack(best.ravel())])], names=["size", "place", "data"])

    return run


def _threshold(wanted: int):
    """What each query of a chunk has to reach: the last of its largest lower bounds over all blocks."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for data in batch.column("data").to_pylist():
                more = unpack(data)[0].view(np.float64).reshape(-1, wanted)
                best = more if best is None else np.sort(np.concatenate([best, more], axis=1), axis=1)[:, -wanted:]
        yield _packed(key, pack(best.min(axis=1)))

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            reach = unpack(batch.column("reach")[row].as_py())[0].view(np.float64)
            for some, query_ids, ids, _, corner, _, most in _scan(batch, row):
                upper = corner + most[:, None]
                q, at = np.nonzero(upper >= reach[some][:, None])
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[at]), pa.array(upper[q, at])], names=["query", "id", "upper"])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [(row["query"], row["query_vec"], row["vec"], row["ids"]) for row in batch.to_pylist()]
        if lists:
            scores = [int(np.dot(np.array(q, dtype=np.int64), np.array(v, dtype=np.int64))) for _, q, v, _ in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in lists], pa.int64()), pa.array([x[3] for x in lists], pa.list_(pa.int64())), pa.array(scores, pa.int64())],
                names=["query", "ids", "score"])


def search(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, factor: float = FACTOR,
           block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES, first_read: int = FIRST_READ) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products for each query, largest first, ties to smaller ids.

    ``queries`` is a condition on the column ``id``. Candidates are all vectors but the query's own; fewer than k of them
    give fewer rows.
    """
    wanted = k + 1
    good = materialize(scaled(rows, id_col, vector_col, factor), "scaled")
    # The smallest ids of equal vectors; Spark keeps only these of each partition before the shuffle.
    smallest = good.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("n") <= wanted)
    classes = smallest.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.select(F.element_at("ids", 1).alias("id"), F.size("vec").alias("size"), "vec", "ids"), "classes")
    asked = good.filter(queries).select(F.col("id").alias("query_id"), "vec").join(classes.select("vec", "id", "size"), "vec")
    asked = materialize(asked.select("query_id", F.col("id").alias("query")), "asked")
    query_vectors = classes.join(asked.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select("id", "size", "vec")

    held = classes.groupBy("size").agg(F.count("*").alias("rows")).select("size", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"))
    asking = query_vectors.groupBy("size").agg(F.count("*").alias("rows")).select("size", F.ceil(F.col("rows") / chunk_queries).cast("int").alias("chunks"))
    spread = materialize(held.join(asking, "size"), "spread")
    dealt = lambda df, n: df.join(spread, "size").withColumn("place", F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    packed = "size int, place int, data binary"
    files = dealt(classes, "blocks").select("size", "place", "id", F.size("ids").alias("copies"), "vec").groupBy("size", "place").applyInArrow(_pack_block, packed)
    files = materialize(files.select("size", F.col("place").alias("block"), F.col("data").alias("file")), "files")
    chunks = dealt(query_vectors, "chunks").select("size", "place", "id", "vec").groupBy("size", "place").applyInArrow(_pack_chunk, packed)
    chunks = materialize(chunks.select("size", F.col("place").alias("chunk"), F.col("data").alias("queries")), "chunks")

    def meet(left: DataFrame) -> DataFrame:
        to_all = left.join(spread.select("size", "blocks"), "size").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return to_all.drop("blocks").join(files, ["size", "block"])

    reached = meet(chunks).mapInArrow(_reach(wanted), packed).groupBy("size", "place").applyInArrow(_threshold(wanted), packed)
    reached = materialize(reached.select("size", F.col("place").alias("chunk"), F.col("data").alias("reach")), "reach")
    found = meet(chunks.join(reached, ["size", "chunk"])).mapInArrow(_candidates, "query bigint, id bigint, upper double")
    waiting = materialize(found, "candidates")

    in_order = Window.partitionBy("query").orderBy(F.desc("upper"), "id")
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    vectors = query_vectors.select(F.col("id").alias("query"), F.col("vec").alias("query_vec"))
    place = F.struct("upper", (-F.col("id")).alias("negative_id"))
    best, length = None, first_read * wanted
    while best is None or not waiting.isEmpty():
        # Each task keeps the first of a query before they are shuffled, so a query of many candidates is no larger a task.
        stretch = materialize(waiting.withColumn("n", F.row_number().over(in_order)).filter(F.col("n") <= length).drop("n"), "stretch")
        read = stretch.join(classes.select("id", "vec", "ids"), "id").join(vectors, "query").select("query", "query_vec", "vec", "ids")
        scores = read.mapInArrow(_products, "query bigint, ids array<bigint>, score bigint").select("query", F.explode("ids").alias("vec_id"), "score")
        scores = scores if best is None else scores.unionByName(best)
        best = materialize(scores.withColumn("n", F.row_number().over(best_first)).filter(F.col("n") <= wanted).drop("n"), "best")
        length *= READ_GROWTH
        # A candidate of the same bound as the last result may still be a tie with a smaller id.
        last = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        read_to = stretch.groupBy("query").agg(F.min(place).alias("read_to")).join(last, "query")
        waiting = materialize(waiting.join(read_to, "query").filter(
            (place < F.col("read_to")) & ((F.col("n") < wanted) | (F.col("upper") >= F.col("last").cast("double")))).select("query", "id", "upper"), "waiting")
    own = asked.join(best, "query").filter("vec_id != query_id")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
