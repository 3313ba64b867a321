import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnmill.operators import ordered as O, packing as P, prints, selection as S
from turnmill.operators.digest import set_digest
from turnmill.operators.lineage import broken_chains, walk


def bins_of(weights, limit, on_overflow):
    starts, start, total, seen, is_open = [], 0, 0, 0, False
    for w in weights:
        if on_overflow and is_open and total + w > limit:
            is_open = False
        if not is_open:
            start, total, is_open = seen, 0, True
        starts.append(start)
        total, seen = total + w, seen + w
        if not on_overflow and total >= limit:
            is_open = False
    return starts


@pytest.mark.parametrize("n, largest, limit, block, fan_out, on_overflow", [
    (120, 30, 50, 160, 2, True), (90, 1, 20, 30, 2, True), (120, 30, 50, 120, 3, False), (120, 120, 50, 150, 4, True),
    (80, 9, 100, 40, 2, True), (60, 30, 50, None, 256, True)])
def test_pack_greedy_equals_the_loop(spark, n, largest, limit, block, fan_out, on_overflow):
    rng, data, want = random.Random(n + largest), [], set()
    for group in ("hot", "cold"):
        weights = [rng.randint(1, largest) for _ in range(n if group == "hot" else 7)]
        for i, (w, s) in enumerate(zip(weights, bins_of(weights, limit, on_overflow))):
            data.append((group, i, w))
            want.add((group, i, w, s))
    df = spark.createDataFrame(data, "g string, k long, w long")
    got = P.pack_greedy(df, ["g"], ["k"], O.integer_chunks("k", 16), "w", limit, on_overflow, block, fan_out)
    assert {tuple(r) for r in got.collect()} == want


def test_running_values_across_chunks(spark, rows):
    from pyspark.sql import Window

    df = spark.range(2000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 7919 % 101).alias("w")).filter("w > 3")
    before = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("s"), F.max("w").over(before).alias("m"))
    got = O.running(df, ["g"], ["id"], O.integer_chunks("id", 8), sums={"s": F.col("w")}, maxes={"m": F.col("w")})
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    placed = O.ranked(df, ["g"], ["id"], O.integer_chunks("id", 8), "place")
    paired = O.runs(O.previous(placed, ["g"], "place", {"prior": "w"}, 8), ["g"], "place",
                    {"run": F.coalesce(F.col("w") % 2 != F.col("prior") % 2, F.lit(True))}, 8)
    lagged = df.select("*", F.lag("w").over(Window.partitionBy("g").orderBy("id")).alias("prior"))
    opens = F.coalesce(F.col("w") % 2 != F.col("prior") % 2, F.lit(True)).cast("long")
    numbered = lagged.select("g", "id", F.sum(opens).over(Window.partitionBy("g").orderBy("id")).alias("run"))
    assert rows(paired, "g", "id", "run") == rows(numbered)


def test_helpers(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, n int, v string")
    assert rows(O.newest(df, ["k"], ["n"])) == [("a", 3, "y"), ("b", 2, "z")]
    assert rows(O.first_rows(df, ["k"], ["n"])) == [("a", 1, "x"), ("b", 2, "z")]
    order = spark.range(5).select("id", O.outside_in(F.col("id"), F.lit(5)).alias("p")).orderBy("p").collect()
    assert [r[0] for r in order] == [0, 4, 1, 3, 2]


def test_set_digest_ignores_order_and_partitions(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("v"))
    one = {tuple(r) for r in set_digest(df, ["g"], F.col("v")).collect()}
    two = {tuple(r) for r in set_digest(df.orderBy(F.desc("v")).repartition(7), ["g"], F.col("v")).collect()}
    assert one == two and len(one) == 2
    assert {tuple(r) for r in set_digest(df.unionByName(df.limit(1)), ["g"], F.col("v")).collect()} != one


def rounds(items, budget, packet):
    """Plain replay of the selection: items are (id, source, date, tokens, salience, domains, families)."""
    lanes = {}
    for item in items:
        if item[3] > packet:
            continue
        quarter = f"{item[2][:4]}-Q{(int(item[2][5:7]) + 2) // 3}" if item[2] != "undated" else "unknown"
        for domain in item[5]:
            for family in item[6]:
                lanes.setdefault((domain, item[1], quarter, family), []).append(item)
    for lane in lanes.values():
        lane.sort(key=lambda i: (-i[4], i[0]))
    taken, spent, moved = [], 0, True
    while moved:
        moved = False
        for key in sorted(lanes):
            while lanes[key] and lanes[key][0][0] in taken:
                lanes[key].pop(0)
            if lanes[key]:
                item = lanes[key].pop(0)
                if spent + item[3] <= budget:
                    taken.append(item[0])
                    spent += item[3]
                    moved = True
    for item in sorted((i for i in items if i[3] <= packet), key=lambda i: (-i[4], i[0])):
        if item[0] not in taken and spent + item[3] <= budget:
            taken.append(item[0])
            spent += item[3]
    return taken


@pytest.mark.parametrize("budget, batch", [(500, 200_000), (500, 16), (100_000, 60)])
def test_selection_equals_the_replay(spark, budget, batch):
    rng, data, want = random.Random(budget), [], {}
    for owner in ("a", "b"):
        items = []
        for n in range(24 if owner == "a" else 4):
            date = rng.choice(["undated", "2026-01-05", "2026-02-05", "2026-05-01"])
            items.append((f"rcpt-{rng.getrandbits(80):020x}", rng.choice(["codex", "claude"]), date, rng.randint(1, 120), rng.randint(1, 30),
                          sorted(rng.sample(["work", "design", "write"], rng.randint(1, 2))),
                          sorted(rng.sample(["directive", "exploration", "rejection"], rng.randint(1, 3)))))
        want[owner] = rounds(items, budget, 100)
        data += [(owner, *i) for i in items]
    df = spark.createDataFrame(data, "owner_id string, receipt_id string, source string, date string, tokens long, salience int, "
                                     "domain_hints array<string>, signal_families array<string>")
    picked = S.select_stage(df, budget, 100, batch_rows=batch).collect()
    got = {o: [r.receipt_id for r in sorted(picked, key=lambda r: r.position) if r.owner_id == o] for o in want}
    assert got == want


def segments_of(spark, items):
    return spark.createDataFrame(
        [("o", s, d, f"{h:064x}", t, True, False) for s, d, h, t in items],
        "owner_id string, source string, first_date string, segment_hash string, source_tokens long, active boolean, oversize boolean")


def test_preview_takes_both_ends(spark, rows):
    months = [("claude", f"2026-0{m}-01", m, 20_000) for m in range(1, 7)]
    first = S.select_segments(segments_of(spark, months), 4, 100_000)
    assert [r[0] for r in rows(first, "first_date")] == ["2026-01-01", "2026-02-01", "2026-05-01", "2026-06-01"]
    again = S.select_segments(segments_of(spark, months[::-1]).repartition(3), 4, 100_000)
    assert rows(first, "segment_hash") == rows(again, "segment_hash")


def test_previews_nest_and_skip_what_does_not_fit(spark):
    items = [(s, f"2026-0{m}-01", m + 10 * n, 24_000) for n, s in enumerate(("claude", "codex")) for m in range(1, 7)]
    picks = [{r.segment_hash for r in S.select_segments(segments_of(spark, items), n, 160_000).collect()} for n in (4, 6, 8)]
    assert [len(p) for p in picks] == [4, 6, 6] and picks[0] < picks[1] and picks[1] <= picks[2]
    odd = [("claude", "2026-01-01", 1, 90), ("claude", "2026-02-01", 2, 5), ("claude", "2026-03-01", 3, 50)]
    assert {int(r.segment_hash, 16) for r in S.select_segments(segments_of(spark, odd), 3, 100).collect()} == {1, 2}


def test_run_segments_split(spark, rows):
    items = segments_of(spark, [("claude", f"2026-0{m}-01", m, 10) for m in range(1, 6)])
    report, work, waiting = S.select_run_segments(items, items.filter("first_date = '2026-03-01'"), 2, 100)
    assert rows(work, "first_date") == [("2026-01-01",), ("2026-05-01",)]
    assert report.count() == 3 and rows(waiting) == [("o", 2)]


def test_walk_finds_ancestors_and_cycles(spark, rows):
    nodes = [("a", f"n{i}", f"n{i - 1}" if i else None) for i in range(20)] + [("b", "x", "y"), ("b", "y", "x"), ("c", "p", "gone")]
    pointers = spark.createDataFrame(nodes, "owner_id string, node string, next string")
    starts = spark.createDataFrame([("a", "n19"), ("b", "x"), ("c", "p")], "owner_id string, node string")
    reached = walk(pointers, starts, 30)
    assert rows(reached.filter("owner_id = 'a'"), "node", "steps") == sorted([(f"n{i}", 19 - i) for i in range(20)], key=str)
    assert ("b", "x", "cycle") in rows(broken_chains(pointers, reached, 30)) and ("c", "p", "missing") in rows(
        broken_chains(pointers, reached, 30))


def test_stretches_are_rows_only_where_needles_are(spark, rows):
    rng = random.Random(4)
    letters = lambda most: "".join(rng.choice("abß😀 .") for _ in range(rng.randint(1, most)))
    texts = [(rng.choice("pq"), n, letters(90)) for n in range(200)] + [("p", 900, ""), ("q", 901, None), ("q", 902, "xyz" * 20_000)]
    needles = sorted({(rng.choice("pq"), letters(12)) for _ in range(400)} | {("q", "zx" + "yzx" * 700), ("p", "xyz")})
    wanted = sorted({(o, n, needle) for o, n, t in texts for own, needle in needles if own == o and needle in (t or "")}, key=str)
    hay = spark.createDataFrame(texts, "owner_id string, n int, haystack string").repartition(3)
    sought = spark.createDataFrame(needles, "owner_id string, needle string")
    for bits in (1 << 29, 1 << 12):
        found = rows(prints.stretches(sought, hay, ["n"], bits), "owner_id", "n", "needle")
        assert set(wanted) <= set(found) and len(found) == len(set(found)) <= 1.1 * len(wanted)
    either = set(rows(prints.stretches(sought, hay, []), "owner_id", "needle"))
    assert {(o, needle) for o, _, needle in wanted} <= either


def test_needles_of_many_lengths_give_few_stretches_by_chance(spark):
    rng = random.Random(5)
    letters = lambda size: "".join(rng.choice("abcdefgh ") for _ in range(size))
    needles = [("p", letters(rng.randint(16, 500))) for _ in range(4000)]
    texts = [("p", n, letters(2000) + needles[n][1] + letters(500)) for n in range(100)]
    sought = spark.createDataFrame(needles, "owner_id string, needle string")
    found = prints.stretches(sought, spark.createDataFrame(texts, "owner_id string, n int, haystack string"), ["n"])
    assert found.join(sought, ["owner_id", "needle"], "left_semi").count() == 100
    # There are some 250,000 places and 480 lengths.
    assert found.count() < 400


def test_long_texts_are_searched_in_pieces_and_finds_leave_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    letters = lambda size: "".join(rng.choice("ab ß") for _ in range(size))
    needles = sorted({letters(rng.randint(1, 40)) for _ in range(60)} | {"ab" * 9})
    texts = [letters(rng.randint(0, 90)) for _ in range(30)] + [letters(3000), "ab" * 700, "", letters(20)]
    sought = spark.createDataFrame([("p", n) for n in needles], "owner_id string, needle string")
    table = prints._table(sought, prints.LEAST_BITS, len(needles))
    owner = sought.select(F.xxhash64("owner_id")).first()[0]
    levels = {}
    for size in sorted({len(n) for n in needles}):
        levels.setdefault(size.bit_length() - 1, []).append(size)
    rows = pa.RecordBatch.from_pydict({"__owner": [owner] * len(texts), "owner_id": ["p"] * len(texts), "n": list(range(len(texts))), "haystack": texts})
    monkeypatch.setattr(prints, "SLICE_CHARS", 200)
    monkeypatch.setattr(prints, "FOUND_CHARS", 10)
    assert max(len(t) for _, part in prints._parts(rows, 40) for t in part) < 240
    parts = list(prints._stretches(SimpleNamespace(value=table), levels)([rows]))
    found = [(n, needle) for part in parts for n, needle in zip(part["n"].to_pylist(), part["needle"].to_pylist()) if needle in needles]
    assert len(parts) > 2 and sorted(found) == sorted((n, needle) for n, t in enumerate(texts) for needle in needles if needle in t)
