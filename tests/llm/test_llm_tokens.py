import hashlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st
from llm_cases import documents, frame, values
from pyspark.sql import functions as F

from turnmill.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("head", [1, 40, 1 << 17])
def test_encoding_equals_the_library(spark, head):
    rows = documents()
    df = frame(spark, rows)
    ids = df.select("doc_id", "text", bpe.encode(df, RANKS, public_tokenizers.PATTERN, head_words=head).alias("ids"))
    trip = values(df.select("doc_id", bpe.round_trip(df, RANKS, public_tokenizers.PATTERN, head_words=head).alias("t")).select("doc_id", "t.*"))
    done = ids.select("*", bpe.ids_digest(F.col("ids")).alias("sha"), bpe.decode(F.col("ids"), RANKS, spark).alias("back")).collect()
    assert len(done) == len(rows)
    assert len(trip) == len(rows)
    for r in done:
        want = REFERENCE.encode_ordinary(r["text"] or "")
        assert r["ids"] == want
        assert bytes(r["back"]) == (r["text"] or "").encode()
        assert (r["doc_id"], len(want), r["sha"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) in trip
        assert r["sha"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_empty_table(spark):
    df = frame(spark, [])
    assert df.select(bpe.encode(df, RANKS, public_tokenizers.PATTERN).alias("ids")).count() == 0
    assert df.select(bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).alias("t")).count() == 0


def test_fold_equals_the_library(spark):
    words = [" the", "strawberries", "ßßñé", "🎉", "aaaaaaaaaaaaaa", "x", " qzxqzxqzx", "1234567890", "-------"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", bpe.merge_fold(F.col("w"), RANKS).alias("ids"))
    want = sorted((w, REFERENCE.encode_ordinary(w)) for w in words)
    assert [(a, list(b)) for a, b in values(got, "w", "ids")] == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=1, max_size=60))
def test_heap_merges_equal_the_library(text):
    data = text.encode("utf-8", "ignore")
    if data:
        assert bpe.merge_word(data, RANKS) == REFERENCE._core_bpe.encode_single_piece(data)


def test_pattern_cuts_unicode_space(spark):
    text = "a\u00a0 b\u2003\u2003c \u3000\nd\u0085e\x1cf\u180eg  "
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(bpe.words_of(F.col("text"), public_tokenizers.PATTERN).alias("w")).first()["w"]
    assert "".join(got) == text
    assert [x for w in got for x in bpe.merge_word(w.encode(), RANKS)] == REFERENCE.encode_ordinary(text)
