import math
import random

from llm_cases import values
from pyspark.sql import functions as F

from turnmill.llm import vafile

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vec string, size int, n int, query long"


def brute(rows, every, k):
    best = {}
    for row in rows:
        vec = row[1]
        if row[0] is None or not vec or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if sum((256 * x) ** 2 for x in vec) >= 2.0 ** 60:
            continue
        whole = [math.floor(256 * x) for x in vec]
        best[row[0]] = min(best.get(row[0], whole), whole)
    found = []
    for q, own in best.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in best.items() if i != q and len(v) == len(own))
            found += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found, key=repr)


def check(spark, vectors, every=5, k=5, **kwargs):
    rows = [(i, v, 0, "x", "y", 1, 2, 3) for i, v in vectors]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert values(vafile.search(df, F.col("id") % every == 0, k=k, **kwargs)) == brute(rows, every, k)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 0.1) for _ in range(16)]) for i in range(700)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(60)] + [(2000 + i, [0.0] * 16) for i in range(12)]
    vectors += [(3000, None), (3001, []), (3002, [None] * 16), (3003, [float("nan")] * 16), (3005, [float("inf")] * 16), (None, [1.0] * 16)]
    vectors += [(3010, [1.0, 2.0]), (3015, [2.0, -1.0]), (5, vectors[9][1]), (3020, [1e30] * 16), (3025, [7.5])]
    check(spark, vectors)
    check(spark, vectors, k=3, block_rows=50, chunk_queries=16, first_read=1)


def test_ties_at_the_edge_of_a_stretch(spark):
    # Many different vectors of one score: the smallest ids must be found whatever is read first.
    vectors = [(i, [1.0, (i % 97) / 256, 0.0]) for i in range(400)] + [(1000, [1.0, 0.0, 0.5])]
    check(spark, vectors, every=1000, first_read=1)


def test_large_components(spark):
    rng = random.Random(3)
    check(spark, [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 6) for _ in range(6)]) for i in range(200)])


def test_few_and_no_vectors(spark):
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.25]), (5, [0.5, 0.25])])
    df = spark.createDataFrame([], SCHEMA)
    assert vafile.search(df, F.col("id") % 50 == 0).count() == 0
