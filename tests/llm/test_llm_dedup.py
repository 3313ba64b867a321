import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from llm_cases import documents, frame, values

from turnmill.llm import covering, graph, linewindows, quotient


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_duplicates_against_brute_force(spark):
    rows = documents()
    for bits in (64, 2):
        got = values(quotient.exact_duplicates(frame(spark, rows), bits=bits), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        groups = defaultdict(list)
        for r in rows:
            groups[lower(r[1])].append(r[0])
        want = []
        for text, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            for n, i in enumerate(sorted(ids, key=lambda i: i != keep)):
                want.append((i, keep, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want, key=repr)


def test_exact_keep_one_keeps_columns_and_one_row_of_each_text(spark):
    rows = documents()
    kept = quotient.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    texts = [lower(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({lower(r[1]) for r in rows})
    assert quotient.keep_one(frame(spark, [])).count() == 0


def test_filters_round_trip_and_merge():
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    parts = [np.concatenate([whole[:700], whole[:50]]), whole[500:], whole[2000:]]
    counted = [np.unique(p, return_counts=True) for p in parts]
    filters = [quotient.build_filter(v, c) for v, c in counted]
    for (v, c), f in zip(counted, filters):
        a, b = quotient.read_filter(f)
        assert (a == v).all() and (b == c).all()
    v, c = quotient.merge_filters(filters)
    a, b = np.unique(np.concatenate(parts), return_counts=True)
    assert (v == a).all() and (c == b).all()


def simhash(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    runs = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    rows = documents(40)
    base = " ".join(f"w{rng.randint(0, 500)}" for _ in range(300)).split()
    for n in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(300)] = f"v{n}"
        rows.append((1000 + n, " ".join(words), "en", "a", 0, "x", "y", 1, "z"))
    prints = [simhash(r[1], 4) for r in rows]
    distinct = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 4]
    assert links
    roots = components(links, distinct)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[roots[p]] = min(least.get(roots[p], r[0]), r[0])
    want = sorted(((r[0], p - (1 << 64) if p >> 63 else p, least.get(roots[p])) for r, p in zip(rows, prints)), key=repr)
    for bucket_rows in (200_000, 2):
        assert values(covering.near_duplicates(frame(spark, rows), bucket_rows=bucket_rows), "doc_id", "fp", "component_id") == want
    kept = covering.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    stay = {(c, p) for i, p, c in want if i == c and i is not None}
    assert {(r["doc_id"], covering.simhash(r["text"], 4)) for r in kept.collect() if r["doc_id"] is not None} == stay
    assert covering.near_duplicates(frame(spark, [])).count() == 0


def test_masks_cover_every_pair_in_the_radius():
    rng = random.Random(2)
    for radius in (2, 4):
        masks = covering.covering_masks(radius)
        assert len(masks) == (1 << radius + 1) - 1
        for _ in range(3000):
            x = rng.getrandbits(64)
            y = x
            for bit in rng.sample(range(64), rng.randint(0, radius)):
                y ^= 1 << bit
            assert any(x & m == y & m for m in masks)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (5000, 5000)]
    random.Random(1).shuffle(edges)
    got = dict(values(graph.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert all(got[i] == 0 for i in range(301))
    assert all(got[2000 + i] == 1000 for i in range(50)) and got[1000] == 1000


def strip_windows(rows, size=3):
    """Plain replay: first places by (id, text), later windows cover their lines, first occurrences keep theirs."""
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda d: (d[0] is None, d[0] or 0, 0))
    places = defaultdict(list)
    lines = {}
    for d in docs:
        lines[d] = [x.strip() for x in (d[1] or "").split("\n") if x.strip()]
        for p in range(len(lines[d]) - size + 1):
            places[tuple(lines[d][p:p + size])].append((d, p))
    gone = defaultdict(set)
    for found in places.values():
        first, at = found[0]
        for d, p in found[1:]:
            gone[d] |= set(range(max(p, at + size) if d == first else p, p + size))
    return gone, lines


def test_line_windows_against_replay(spark):
    rng = random.Random(4)
    pool = [f"line {i} of text" for i in range(12)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    texts += ["same\n" * 8, "x\n\n y \n\nz", "q\nx\ny \nz\nr", None, "", "one", "one\ntwo"]
    rows = [(i, t, "en", "a", 0, "x", "y", 1, "z") for i, t in enumerate(texts)] + [(2, texts[2], "en", "a", 0, "x", "y", 1, "z")]
    gone, lines = strip_windows(rows)
    df = linewindows.remove_repeats(frame(spark, rows))
    assert df.columns == [*frame(spark, rows).columns, "_lines", "removed"]
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        before = texts[r["doc_id"]]
        kept = [x for n, x in enumerate(lines[r["doc_id"], before]) if n not in gone[r["doc_id"], before]]
        assert [x.strip() for x in (r["text"] or "").split("\n") if x.strip()] == kept
        assert (r["text"] is None) == (before is None)
        assert len(r["removed"]) == len(gone[r["doc_id"], before])
        if not r["removed"]:
            assert r["text"] == before
    assert linewindows.remove_repeats(frame(spark, [])).count() == 0
