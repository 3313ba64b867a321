import re
from collections import Counter

import numpy as np
from llm_cases import documents, frame, values
from pyspark.sql import functions as F

from turnmill.llm import mixing


def sizes_of(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]


def targets_of(rows, weights=(5, 2, 1), share=1.5):
    totals = Counter()
    for r, n in zip(rows, sizes_of(rows)):
        totals[r[3]] += n
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    whole, capped = share * sum(totals.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (whole - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if level * weight[s] > 2 * totals[s]]
        if not above:
            return {s: capped.get(s, level * weight[s]) for s in names}, totals
        capped |= {s: 2.0 * totals[s] for s in above}


def test_documents_taken(spark):
    rows = documents(300)
    want, totals = targets_of(rows)
    df = frame(spark, rows)
    sizes, targets, blocks = mixing.mix(df, block_words=16, shard_blocks=64)
    taken = mixing.documents_taken(sizes, targets, blocks)
    got = taken.collect()
    assert len(got) == len(rows)
    assert sorted((r["id"], r["size"]) for r in got if r["id"] is not None) == sorted((r[0], n) for r, n in zip(rows, sizes_of(rows)) if r[0] is not None)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    placed = blocks.collect()
    words = Counter()
    for b in placed:
        words[b["source"]] += b["words"]
    for source, goal in want.items():
        assert abs(words[source] - goal) <= 16
    for r in targets.collect():
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["source_size"] == totals[r["source"]]
    # Every block is in one shard, shards are as large as each other, and their places have no gaps.
    assert len({(*[b[k] for k in mixing.KEY], b["block"], b["pass"]) for b in placed}) == len(placed)
    shards = Counter(b["shard"] for b in placed)
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) > 4
    for shard, n in shards.items():
        assert sorted(b["place"] for b in placed if b["shard"] == shard) == list(range(1, n + 1))
    again = mixing.documents_taken(*mixing.mix(df.repartition(5), block_words=16, shard_blocks=64))
    assert values(taken) == values(again)


def test_mixed_rows_keep_columns(spark):
    rows = documents(100)
    df = frame(spark, rows)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    used = Counter(tuple(r)[:4] for r in mixed.collect())
    there = Counter(r[:4] for r in rows)
    assert used and all(n <= 2 * there[key] for key, n in used.items())
    assert mixing.mixed_rows(frame(spark, [])).count() == 0
    assert mixing.mixed_rows(frame(spark, [(1, None, "en", None, 0, "x", "y", 1, "z")])).count() == 0


def test_hypergeometric_draws(spark):
    population, marked, draws = 60, 25, 20
    df = spark.range(20000).select(mixing.hypergeometric(
        F.lit(population).cast("bigint"), F.lit(marked).cast("bigint"), F.lit(draws).cast("bigint"), mixing.uniform(F.lit(3), "id")).alias("x"))
    seen = Counter(r["x"] for r in df.collect())
    drawn = Counter(np.random.default_rng(1).hypergeometric(marked, population - marked, draws, 200000).tolist())
    for x in range(3, 15):
        assert abs(seen[x] / 20000 - drawn[x] / 200000) < 0.012
    edge = spark.range(1).select(*[mixing.hypergeometric(*[F.lit(v).cast("bigint") for v in p], F.lit(u)).alias(f"x{i}{j}")
                                   for i, p in enumerate([(5, 5, 3), (5, 0, 3), (5, 2, 0), (5, 2, 5), (0, 0, 0), (5, 4, 3)]) for j, u in enumerate((0.0, 0.999999))]).first()
    assert list(edge)[:10] == [3, 3, 0, 0, 0, 0, 2, 2, 0, 0] and set(list(edge)[10:]) == {2, 3}
