"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order in which it sees a set of pivots, nearest first. It is posted in the inverted files
of its nearest pivots; a query opens the files of its own nearest pivots, ranks what it finds there by the footrule
distance between the two orders (the sum of differences of the pivots' places), and the best are ranked again by the exact
measure. Files are cut into blocks of bounded size, and so are the queries that open one file; a block and the queries
that meet it are one task's work, and only the best few of each query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnmill.session import materialize

#: Pivots are a bounded sample of the vectors; every vector is indexed.
PIVOTS = 128
POST, PROBE = 6, 32
BLOCK_ROWS, CHUNK_QUERIES = 4096, 2048
KEEP_SHARE, KEEP_LEAST = 0.1, 128


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` (doubles): finite, non-zero vectors of the most common length, one per id (the smallest)."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = rows.select(F.col(id_col).alias("id"), vec.alias("vec"), finite.alias("finite"), F.exists(vec, lambda x: x != 0).alias("some"))
    good = good.filter("id is not null and finite and some")
    return good.groupBy("id").agg(F.min("vec").alias("vec"))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _order(pivots: np.ndarray, probe: int):
    """Over rows (id, vec): id, vec, places (of every pivot, a byte each), tops (the first pivots)."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _scaled(_matrix(batch.column(1))) @ pivots.T
            order = np.argsort(-near, axis=1, kind="stable")
            places = np.empty(order.shape, dtype=np.uint8)
            np.put_along_axis(places, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
            tops = order[:, :probe].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tops) + 1) * tops.shape[1], pa.int32()), pa.array(tops.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.tobytes() for p in places], pa.binary()), lists], names=["id", "vec", "places", "tops"])

    return run


def _meet(k: int, keep_share: float, keep_least: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, posted: pa.Table) -> pa.Table:
        if not queries.num_rows or not posted.num_rows:
            return schema.empty_table()
        ids, vectors = posted.column("id").to_numpy(), _scaled(_matrix(posted.column("vec")))
        width = len(posted.column("places")[0].as_py())
        places = _bytes(posted.column("places"), width)
        keep = max(keep_least, int(keep_share * len(ids)))
        found = [[], [], []]
        for query, vector, own in zip(queries.column("id").to_numpy(), _scaled(_matrix(queries.column("vec"))), _bytes(queries.column("places"), width)):
            rows = np.flatnonzero(ids != query)
            if len(rows) > keep:
                footrule = (np.maximum(places, own) - np.minimum(places, own)).sum(axis=1, dtype=np.uint32)[rows]
                # Of equal distances the smaller ids stay.
                rows = rows[np.lexsort((ids[rows], footrule))[:keep]]
            # Row by row in one order of its components, so equal vectors have one score wherever they lie.
            scores = (vectors[rows] * vector).sum(axis=1)
            best = np.lexsort((ids[rows], -scores))[:k]
            found[0].append(np.full(len(best), query))
            found[1].append(ids[rows][best])
            found[2].append(scores[best])
        return pa.table([pa.array(np.concatenate(c)) for c in found], schema=schema)

    return run


def _blocks(rows: DataFrame, places: str, size: int) -> dict[int, int]:
    """How many blocks each pivot's rows need; one entry per pivot."""
    counted = rows.select(F.explode(places).alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n")).collect()
    return {r["pivot"]: -(-r["n"] // size) for r in counted}


def _by_pivot(blocks: dict[int, int]):
    """The number of blocks as a column of pivot."""
    known = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else F.lit(None).cast("map<int,int>")
    return F.coalesce(F.element_at(known, F.col("pivot")), F.lit(0))


def nearest(rows: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, pivots: int = PIVOTS,
            post: int = POST, probe: int = PROBE, keep_share: float = KEEP_SHARE, keep_least: int = KEEP_LEAST,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each query by cosine, nearest first, ties to smaller ids.

    ``queries`` is a condition on the column ``id``. Candidates are all vectors but the query's own. Vectors that are null,
    zero, not finite, hold nulls, or have another length than most take no part, nor do rows with a null id; of rows that
    repeat an id one takes part. A query that meets fewer than k candidates is compared with all of them. An empty table
    gives no rows; extra columns are not read.
    """
    good = materialize(usable(rows, id_col, vector_col), "vectors")
    usual = good.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if usual is None:
        return rows.sparkSession.createDataFrame([], schema)
    good = good.filter(F.size("vec") == usual["n"])
    count = min(pivots, 255, max(8, usual["rows"] // 16))
    chosen = good.orderBy(F.xxhash64("id"), "id").limit(count).toArrow()
    ordered = materialize(good.mapInArrow(_order(_scaled(_matrix(chosen.column("vec"))), probe), "id bigint, vec array<double>, places binary, tops array<int>"), "orders")
    asked = ordered.filter(queries)

    def search(asking, posted, tops_asked, tops_posted):
        files, crowds = _blocks(posted, tops_posted, block_rows), _blocks(asking, tops_asked, CHUNK_QUERIES)
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = asking.select("id", "vec", "places", F.explode(tops_asked).alias("pivot")).filter(_by_pivot(files) > 0)
        left = left.withColumn("chunk", F.pmod(F.xxhash64("id"), _by_pivot(crowds)).cast("int")).withColumn("block", spread(_by_pivot(files)))
        right = posted.select("id", "vec", "places", F.explode(tops_posted).alias("pivot")).filter(_by_pivot(crowds) > 0)
        right = right.withColumn("block", F.pmod(F.xxhash64("id"), _by_pivot(files)).cast("int")).withColumn("chunk", spread(_by_pivot(crowds)))
        key = ["pivot", "block", "chunk"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
            _meet(k, keep_share, keep_least), "query_id bigint, vec_id bigint, score double")

    first = materialize(search(asked, ordered, F.slice("tops", 1, probe), F.slice("tops", 1, post)), "met").distinct()
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, usual["rows"] - 1))
    short = materialize(asked.join(enough, asked["id"] == enough["query_id"], "left_anti"), "short")
    found = first
    if usual["rows"] > 1 and not short.isEmpty():
        # Every vector once, in the file of its first pivot, against the queries that are left.
        everywhere = F.array(*[F.lit(p) for p in range(len(chosen))])
        found = first.unionByName(search(short, ordered, everywhere, F.slice("tops", 1, 1))).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
