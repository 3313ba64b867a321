import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from test_llm_dedup import components, lower, simhash
from test_llm_mixing import targets_of
from test_llm_models import WORDS

from turnmill.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def corpus():
    rng, rows = random.Random(8), []
    for i in range(150):
        lang = rng.choice(sorted(WORDS))
        words = WORDS[lang] + [w + rng.choice(WORDS[lang]) for w in WORDS[lang]]
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 15))) for _ in range(rng.randint(2, 20)))
        rows.append((i, text, lang, rng.choice("abcd"), len(text)))
    rows += [(1000 + i, rows[i][1].upper() if rows[i][2] != "ru" else rows[i][1], "en", "a", 0) for i in range(10)]
    long = " ".join(rng.choice(WORDS["en"]) + rng.choice(WORDS["en"]) for _ in range(900))
    rows += [(2000 + i, long.replace(" ", f" x{i} ", 1), "en", "b", 0) for i in range(6)]
    rows += [(3000, None, "en", "a", 0), (3001, "", "en", "a", 0), (3002, "12 34 !", None, None, 0)]
    return rows


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    folder = str(tmp_path / "data")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "tokens" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append([tuple(r) for r in docs.collect()])

    letters = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert sorted(seen[0]) == sorted(letters)
    groups = defaultdict(list)
    for r in letters:
        groups[lower(r[1])].append(r)
    exact = sorted(max(g) for g in groups.values())
    assert sorted(seen[1]) == exact and len(exact) < len(letters)
    prints = {r[0]: simhash(r[1], corpus_pipeline.SHINGLE) for r in exact}
    distinct = sorted(set(prints.values()))
    roots = components([(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= corpus_pipeline.RADIUS], distinct)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    near = [r for r in exact if least[roots[prints[r[0]]]] == r[0]]
    assert sorted(seen[2]) == near and len(near) <= len(exact) - 5
    uses, there = Counter(seen[3]), {r[0]: r for r in near}
    assert all(there[r[0]] == r and n <= 2 for r, n in uses.items())
    want, _ = targets_of(near)
    words, largest = Counter(), Counter()
    for r in seen[3]:
        words[r[3]] += len(r[1].split())
    for r in near:
        largest[r[3]] = max(largest[r[3]], len(r[1].split()))
    assert all(abs(words[s] - want[s]) <= largest[s] for s in want)
    digests = Counter()
    for r in seen[3]:
        ids = REFERENCE.encode_ordinary(r[1])
        digests[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()] += 1
    assert Counter(seen[4]) == digests
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == digests


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
