import random
from collections import defaultdict

import corpus_pipeline
from llm_cases import documents, frame
from test_llm_dedup import components

from turnmill.llm import similar


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_dedup_links_documents_of_similarity_080(spark):
    # Every 60th to 12th word of a copy is another one: similarities on both sides of 0.8, few within 6 bits of SimHash.
    rng, rows = random.Random(5), documents()
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((1000 + 2 * i, " ".join(words), "en", "a", 0, "x", "y", 1, "z"))
        for at in rng.sample(range(300), 4 + i % 8):
            words[at] = "other"
        rows.append((1001 + 2 * i, " ".join(words), "en", "a", 0, "x", "y", 1, "z"))
    sets = defaultdict(set)
    for r in rows:
        sets[r[1] or ""] = sets_of(r[1])
    texts = sorted(sets)
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    roots = components([(a, b) for n, a in enumerate(texts) for b in texts[:n] if alike(sets[a], sets[b])], texts)
    least = {}
    for r in rows:
        if r[0] is not None:
            root = roots[r[1] or ""]
            least[root] = min(least.get(root, r[0]), r[0])
    got = similar.classes(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == sorted((str(r[0]), least[roots[r[1] or ""]]) for r in rows)
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert kept.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {*least.values(), None}
    assert len({i for i in least.values() if i >= 1000}) < 70
    assert corpus_pipeline.near_dedup(spark, frame(spark, []), "").count() == 0


def test_no_link_is_lost_between_texts_of_one_fingerprint(spark, monkeypatch):
    # Fingerprints and bands are the same for all, so only a few pairs of texts are met by them.
    monkeypatch.setattr(similar, "bands", lambda hashes: similar.np.zeros(similar.BANDS, dtype=similar.np.int64))
    monkeypatch.setattr(similar, "simhash", lambda text, width: 5)
    rng, rows = random.Random(8), []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows.append((2 * i, " ".join(words), "en", "a", 0, "x", "y", 1, "z"))
        rows.append((2 * i + 1, " ".join(words[:96] + ["other"] * 4), "en", "a", 0, "x", "y", 1, "z"))
    got = {r["doc_id"]: r["component_id"] for r in similar.classes(frame(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_sketches_rule_out_pairs_but_no_similar_one(spark):
    # A phrase that all texts hold makes pairs of them all; before, each pair was sent the whole sets of both.
    rng, texts = random.Random(4), []
    for i in range(30):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)] + "one phrase that is in all of them".split()
        texts += [" ".join(words), " ".join(words[:190] + ["other"] * 3 + words[193:])]
    sets = [similar.shingles(t, 5) for t in texts]
    prints = spark.createDataFrame([(i, len(h), similar.sketch(h)) for i, h in enumerate(sets)], "node bigint, size int, sketch binary")
    pairs = spark.createDataFrame([(a, b) for b in range(60) for a in range(b)], "a bigint, b bigint")
    got = {tuple(r) for r in similar.possible(pairs, prints, 0.8).collect()}
    wanted = {(2 * i, 2 * i + 1) for i in range(30)}
    assert all(len(sets_of(texts[a]) & sets_of(texts[b])) >= 0.8 * len(sets_of(texts[a]) | sets_of(texts[b])) for a, b in wanted)
    assert got >= wanted and len(got) < 60


def test_pairs_that_share_a_rare_phrase_become_rows_only_if_sketches_pass(spark):
    # The phrase counts as the rarest, so all texts meet by it; before, each pair of them was a row.
    rng, texts, phrase = random.Random(6), [], "one phrase that all have"
    for i in range(30):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
        texts += [" ".join([phrase, *words]), " ".join([phrase, *words[:190], *["other"] * 3, *words[193:]])]
    sets = [similar.shingles(t, 5) for t in texts]
    cell = lambda h: int(h >> similar.np.uint64(64 - similar.CELL_BITS))
    met = {cell(h) for h in similar.shingles(phrase, 5)}
    cells = spark.createDataFrame([(c, 1000) for c in {cell(h) for s in sets for h in s} - met], "cell int, n bigint")
    nodes = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node bigint, root bigint, text string")
    prints = spark.createDataFrame([(i, len(h), similar.sketch(h)) for i, h in enumerate(sets)], "node bigint, size int, sketch binary")
    got = {tuple(r) for r in similar.missed(nodes, cells, prints, 5, 0.8).collect()}
    wanted = {(2 * i, 2 * i + 1) for i in range(30)}
    assert all(len(sets_of(texts[a]) & sets_of(texts[b])) >= 0.8 * len(sets_of(texts[a]) | sets_of(texts[b])) for a, b in wanted)
    assert got >= wanted and len(got) < 60


def test_rows_that_meet_none_go_and_no_pair_is_lost():
    np, pa, rng = similar.np, similar.pa, similar.np.random.default_rng(3)
    for _ in range(20):
        rows = sorted((int(t), int(s), i, int(r), int(rng.integers(0, s // 5 + 1))) for i, (t, s, r) in enumerate(zip(
            rng.integers(0, 9, 80), rng.integers(1, 60, 80), rng.integers(0, 6, 80))))
        token, size, node, root, place = (np.array(c, dtype=k) for c, k in zip(zip(*rows), (np.int64, np.int32, np.int64, np.int64, np.int32)))
        names = ["token", "node", "root", "size", "place"]
        whole = pa.RecordBatch.from_arrays([pa.array(c) for c in (token, node, root, size, place)], names=names)
        parts = [whole.slice(at, 7) for at in range(0, 80, 7)]
        pairs = {(min(node[a], node[b]), max(node[a], node[b])) for b in range(80) for a in range(b) if token[a] == token[b] and root[a] != root[b]
                 and size[a] >= 0.8 * size[b] - 1e-6 and min(size[a] - place[a], size[b] - place[b]) >= 0.8 / 1.8 * (size[a] + size[b]) - 1e-6}
        kept = pa.Table.from_batches(similar._meeting(0.8)(iter(parts)), whole.schema)
        assert set(kept["node"].to_pylist()) >= {n for p in pairs for n in p}
        assert kept.num_rows < 80
        # Sketches of nothing rule nothing out.
        blank = kept.append_column("sketch", pa.array([bytes(similar.SKETCH_BITS // 8)] * kept.num_rows, pa.binary()))
        got = [p for b in similar._sharing(0.8)(iter(blank.to_batches(max_chunksize=7))) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())]
        assert set(got) == pairs and len(got) == len(pairs)


def test_sketches_tell_long_texts_apart():
    # Before, texts of over 4,600 shingles passed whatever they held.
    np, rng = similar.np, similar.np.random.default_rng(9)
    sizes, hashes = [6000, 6000, 9000, 1000, 5000], []
    for n in sizes:
        hashes.append(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) ^ rng.integers(0, 2, n, dtype=np.uint64)))
    hashes += [np.r_[hashes[0][:5400], hashes[1][:600]], np.r_[hashes[3][:950], hashes[1][:50]], np.r_[hashes[0], hashes[2][:1000]]]
    sketches = np.array([similar.sketch(h) for h in hashes], dtype=object)
    for a in range(len(hashes)):
        for b in range(len(hashes)):
            both = len(np.intersect1d(hashes[a], hashes[b]))
            near = both >= 0.8 * (len(hashes[a]) + len(hashes[b]) - both)
            got = similar._may_be(sketches[[a]], sketches[[b]], np.array([len(hashes[a]) + len(hashes[b])]), 0.8)
            # What sizes alone rule out is not asked of sketches.
            assert got.tolist() == [near] or min(len(hashes[a]), len(hashes[b])) < 0.8 * max(len(hashes[a]), len(hashes[b]))
