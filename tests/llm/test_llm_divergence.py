import random
import re
from collections import Counter, defaultdict

import numpy as np
from llm_cases import documents, frame, values

from turnmill.llm import divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    docs = [(r[2] or "", r[3] or "", WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    held = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= least:
            kept[lang].append(t)
    groups = defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(t for t in terms if t in set(kept[lang]))
    share = lambda counts, lang: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts.values()) + 2 * len(kept[lang])) for t in kept[lang]}
    p = {g: share(c, g[0]) for g, c in groups.items()}
    whole = {lang: share(sum((c for g, c in groups.items() if g[0] == lang), Counter()), lang) for lang in {g[0] for g in groups}}
    f = lambda x, y: (x - y) ** 2 // (x + y)
    found = []
    for (lang, source), own in p.items():
        pairs = [(s, sum(f(own[t], p[lang, s][t]) for t in kept[lang])) for la, s in p if la == lang and s != source]
        terms = [(t, f(own[t], whole[lang][t])) for t in kept[lang] if groups[lang, source][t] and own[t] > whole[lang][t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            found += [(lang, source, part, item, value, n) for n, (item, value) in enumerate(ranked, 1)]
    return sorted(found, key=repr)


def test_against_brute_force(spark):
    rows = documents(n=80)
    df = frame(spark, rows)
    for least, kwargs in ((10, {}), (3, {"shard_terms": 20, "block_sources": 1, "broadcast_bytes": 2000}), (500, {})):
        assert values(divergence.Audit(df, least=least, **kwargs).divergence()) == brute(rows, least, 10)


def test_many_sources_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("aa bb cc dd ee ff gg hh ß É".split(), k=rng.randint(0, 9))), "en", f"s{rng.randint(0, 25)}", 0, "x", "y", 1, "z") for i in range(200)]
    assert values(divergence.Audit(frame(spark, rows), least=2, block_sources=4, shard_terms=3).divergence(3)) == brute(rows, 2, 3)


def test_no_documents(spark):
    assert divergence.Audit(frame(spark, documents()[:1]).limit(0)).divergence().count() == 0


def test_hash_is_minimal_and_tells_strangers_apart(monkeypatch):
    terms = sorted({f"t{n}".encode() for n in range(5000)} | {"é".encode(), b"z" * 3000})
    for bits in (64, 8):
        monkeypatch.setattr(divergence, "hashes", lambda t, bits=bits: np.array([divergence.xxhash.xxh64_intdigest(x, 42) >> (64 - bits) for x in t], dtype=np.uint64))
        some = terms if bits == 64 else terms[:300]
        built = divergence.PerfectHash.from_bytes(divergence.PerfectHash.build(some).to_bytes())
        slots = built.slots(some, divergence.hashes(some))
        assert sorted(slots.tolist()) == list(range(len(some)))
        assert [built.terms[s] for s in slots.tolist()] == some
        others = [f"o{n}".encode() for n in range(5000)]
        assert (built.slots(others, divergence.hashes(others)) == -1).all()


def test_shares_of_large_counts():
    for total, count in ((10**13, 10**13 - 5), (7, 3), (0, 0), (123456789012, 9999)):
        assert divergence.shares(np.array([count]), total, 4)[0] == 1 + 10**9 * (count + 2) // (total + 8)
