import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_cases import documents, frame, values

from turnmill.llm import alignment


@pytest.fixture(scope="module")
def vocabularies():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def brute(texts, vocabularies):
    """Every pair of tokens of a text compared, whole texts encoded."""
    import sentencepiece
    import tokenizers

    a_model = tokenizers.Tokenizer.from_str(vocabularies[0])
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_proto=vocabularies[1])

    def spans(ids, size_of):
        at, found = 0, []
        for i in ids:
            found.append((at, at + size_of(i), i))
            at += size_of(i)
        return found

    cut = []
    for text in texts:
        if not text:
            cut.append(([], [], [], []))
            continue
        whole = (" " + text).encode()
        a_ids, b_ids = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        a_bytes = lambda i: alignment.byte_level(a_model.id_to_token(i))
        b_bytes = lambda i: alignment.piece_bytes(b_model.id_to_piece(i))
        if b"".join(map(a_bytes, a_ids)) != whole or b"".join(map(b_bytes, b_ids)) != whole:
            cut.append(([], [], [], []))
            continue
        a, b = spans(a_ids, lambda i: len(a_bytes(i))), spans(b_ids, lambda i: len(b_bytes(i)))
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        groups, ends = [], sorted({x[1] for x in a} & {y[1] for y in b})
        for lo, hi in zip([0, *ends], ends):
            groups.append(",".join(str(x[2]) for x in a if lo < x[1] <= hi) + "|" + ",".join(str(y[2]) for y in b if lo < y[1] <= hi))
        cut.append((a, b, groups, links))
    counts = Counter(link for *_, links in cut for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for a, b, groups, links in cut:
        joined = ";".join(groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                     hashlib.sha256(joined.encode()).hexdigest() if joined else "", joined))
    return rows, counts


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def awkward():
    texts = ["a <|endoftext|> b </s><s> <unk> <0x41>", "▁ literal ▁▁x", "tail  ", " lead", "\n\nx \n y\t z", "don't we'll  it's", " x   y", "é a ́b",
             "日本語 テキスト", "1234567 89 0", "x" * 3000, "  ", "é è​ ᠎ q", "\x00 \x1c a\x85 b", "word " * 400, "ﬁ ½ ²"]
    return [(1000 + i, t, "en", "a", 0, "x", "y", 1, "z") for i, t in enumerate(texts)]


def test_against_whole_texts(spark, vocabularies):
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 6000] + awkward()
    df = frame(spark, rows)
    for chunk_links in (200, 1 << 22):
        found = alignment.Alignment(df, *vocabularies, groups=True, chunk_links=chunk_links, radix_bytes=512)
        wanted, counts = brute([r[1] for r in rows], vocabularies)
        assert values(found.documents(), "doc_id", *COLUMNS) == sorted([(r[0], *w) for r, w in zip(rows, wanted)], key=repr)
        assert {(r["a"], r["b"]): r["n"] for r in found.pairs().collect()} == counts


def test_whole_texts_where_words_cannot_be_cut(spark, vocabularies, monkeypatch):
    rows = [r for r in documents(n=8) if r[1] is None or len(r[1]) < 500]
    df = frame(spark, rows)
    by_unit = values(alignment.Alignment(df, *vocabularies, groups=True).documents())
    monkeypatch.setattr(alignment, "unit_wise", lambda a, b: False)
    assert values(alignment.Alignment(df, *vocabularies, groups=True).documents()) == by_unit


def test_no_rows_and_no_tokens(spark, vocabularies):
    assert alignment.Alignment(frame(spark, documents()[:0] or documents()[:1]).limit(0), *vocabularies).documents().count() == 0
    df = frame(spark, [(1, None, "en", "a", 0, "x", "y", 1, "z"), (None, "", "en", "a", 0, "x", "y", 1, "z")])
    assert values(alignment.Alignment(df, *vocabularies).documents()) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=repr)


def test_words_can_be_cut_in_the_public_vocabularies(vocabularies):
    assert alignment.unit_wise(*vocabularies)


def test_merge_of_many_runs():
    rng = random.Random(5)
    runs, total = [], Counter()
    for n in range(150):
        some = Counter(rng.choices(range(3000 if n % 3 else 40), k=rng.randint(0, 900)))
        total.update(some)
        pairs = np.array(sorted(some), dtype=np.uint64)
        runs.append((some, alignment.Run(n, alignment.pack_pairs(pairs, np.array([some[p] for p in sorted(some)], dtype=np.int64)))))
    seen, back, last = {}, {n: [] for n in range(len(runs))}, -1
    for pairs, totals, own in alignment.merge_runs([r for _, r in runs]):
        assert pairs[0] > last and (np.diff(pairs.astype(np.int64)) > 0).all()
        last = int(pairs[-1])
        seen.update(zip(pairs.tolist(), totals.tolist()))
        for counts, n in own:
            back[n] += counts.tolist()
    assert seen == total
    assert all(back[n] == [total[p] for p in sorted(some)] for n, (some, _) in enumerate(runs))


def test_blocks_are_read_in_turn(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 7)
    monkeypatch.setattr(alignment, "FAN", 2)
    test_merge_of_many_runs()
