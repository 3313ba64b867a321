"""Byte-level BPE encoding and decoding.

Text is cut into words by the vocabulary's pattern. The frequent distinct words of the corpus are encoded once: a fold
(higher-order functions over an array of bytes) merges the pair of lowest rank again and again, ranks being looked up in a
literal map that is cut into hash buckets, as Spark searches a map from end to end. Their ids form a dictionary of at most
``head_words`` words of at most ``HEAD_BYTES`` bytes, which every task gets. Documents are then put together from it in
Arrow tasks. A word outside the dictionary is merged where it is met, by the same rule with a heap, and remembered by the
task: nothing is dropped, and no table of all distinct words has to meet all documents. Decoding concatenates the bytes of
each id.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.llm.arrays import frequent, slices
from turnmill.session import materialize

BUCKETS = 8192
HEAD_WORDS = 1 << 17
HEAD_BYTES = 48
MEMO_WORDS = 1 << 16
SHORT_BYTES = 64
NO_RANK = 1 << 40
SPACE = r"[ \t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 bytes and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out as Unicode white space, which Java's do not cover."""
    inside = SPACE[1:-1]
    return pattern.replace(r"[^\s", f"[^{inside}").replace(r"\S", f"[^{inside}]").replace(r"\s", SPACE)


def words_of(text: Column, pattern: str) -> Column:
    """All matches of the pattern in order; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal array of maps from upper-case hex to rank, one map per hash bucket."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for word, rank in ranks.items():
        text = word.hex().upper()
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def rank_of(table: Column, text: Column) -> Column:
    """Rank of a byte string given as upper-case hex, or null."""
    return F.element_at(F.element_at(table, (F.crc32(text.cast("binary")) % BUCKETS + 1).cast("int")), text)


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def merge_fold(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word (a string): start from its bytes, merge the leftmost pair of lowest rank until none has a rank."""
    # The table is bound once: a plan with many copies of it is a burden for the driver.
    return _let(rank_table(ranks), lambda table: _fold(F.hex(word.cast("binary")), lambda text: rank_of(table, text)))


def _fold(text: Column, look: Callable[[Column], Column]) -> Column:
    none = F.array().cast("array<int>")

    def step(state, _):
        tokens, ranks = state["t"], state["r"]

        def merge(at):
            def put(joined):
                left = F.when(at > 1, F.array(look(F.concat(F.element_at(tokens, at - 1), joined)))).otherwise(none)
                right = F.when(at < F.size(ranks), F.array(look(F.concat(joined, F.element_at(tokens, at + 2))))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(tokens, F.lit(1), at - 1), F.array(joined), F.slice(tokens, at + 2, F.size(tokens))).alias("t"),
                    F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(ranks, at + 2, F.size(tokens))).alias("r"))

            return _let(F.concat(F.element_at(tokens, at), F.element_at(tokens, at + 1)), put)

        lowest = F.array_min(ranks)
        return F.when(lowest.isNull(), state).otherwise(_let(F.array_position(ranks, lowest).cast("int"), merge))

    def fold(hexed):
        size = (F.length(hexed) / 2).cast("int")
        tokens = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(hexed, 2 * i - 1, F.lit(2)))
        ranks = F.transform(F.sequence(F.lit(1), size - 1), lambda i: look(F.substring(hexed, 2 * i - 1, F.lit(4))))
        begin = F.struct(tokens.alias("t"), ranks.alias("r"))
        return F.aggregate(F.sequence(F.lit(1), size - 1), begin, step, lambda s: F.transform(s["t"], look))

    # A word that is in the vocabulary is that one token, whatever merges would lead to.
    return _let(text, lambda h: _let(look(h), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(fold(h))))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges outside Spark's expressions, for words that are not in the dictionary."""
    if word in ranks:
        return [ranks[word]]
    return _merge_short(word, ranks) if len(word) <= SHORT_BYTES else _merge_long(word, ranks)


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    cuts, pairs = list(range(len(word) + 1)), [get(word[i:i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == NO_RANK:
            break
        at = pairs.index(lowest)
        del cuts[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = get(word[cuts[at]:cuts[at + 2]], NO_RANK)
        if at:
            pairs[at - 1] = get(word[cuts[at - 1]:cuts[at + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With a heap, in time that grows hardly faster than the word."""
    size = len(word)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    pieces: list[bytes | None] = [word[i:i + 1] for i in range(size)]
    heap = [(ranks[word[i:i + 2]], i, word[i:i + 2]) for i in range(size - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)

    def offer(at):
        follower = after[at]
        if follower < size:
            joined = pieces[at] + pieces[follower]
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], at, joined))

    while heap:
        _, at, joined = heapq.heappop(heap)
        if pieces[at] is None or after[at] >= size or pieces[at] + pieces[after[at]] != joined:
            continue
        gone = after[at]
        pieces[at], pieces[gone] = joined, None
        after[at] = after[gone]
        if after[at] < size:
            before[after[at]] = at
        if before[at] >= 0:
            offer(before[at])
        offer(at)
    return [ranks[p] for p in pieces if p is not None]


def head_dictionary(docs: DataFrame, text_col: str, ranks: dict[bytes, int], pattern: str, head_words: int = HEAD_WORDS) -> Broadcast:
    """The most frequent distinct words of all documents with their ids as 32-bit little-endian bytes.

    At most ``head_words`` words of at most HEAD_BYTES bytes, so under 40 MB; which words are in it changes no result.
    """
    words = docs.select(F.explode(words_of(F.col(text_col), pattern)).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.octet_length("word") <= HEAD_BYTES)
    head = frequent(materialize(counted, "words"), head_words).select("word")
    encoded = head.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "word").select(
        "word", merge_fold(F.col("word"), ranks).alias("ids")).toArrow()
    ids = encoded.column("ids").combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks)
    flat, cuts = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
    table = {w: flat[a:b].tobytes() for w, a, b in zip(encoded.column("word").to_numpy().tolist(), cuts[:-1].tolist(), cuts[1:].tolist())}
    return docs.sparkSession.sparkContext.broadcast(table)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", head_words: int = HEAD_WORDS) -> Column:
    """A column of ``docs`` with the ids of each whole text, as array<int>, without special tokens.

    Every match of the pattern is encoded by itself. Null and empty texts give an empty array. All rows and columns of
    ``docs`` stay as they are, repeated rows and an empty table included.
    """
    context = docs.sparkSession.sparkContext
    head = head_dictionary(docs, text_col, ranks, pattern, head_words)
    shared = context.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded = _coder(head.value, shared.value)
        for batch in batches:
            cuts, chunks = [0], []
            for part in slices(batch):
                for ids in coded(part):
                    chunks.append(ids)
                    cuts.append(cuts[-1] + len(ids) // 4)
            flat = np.frombuffer(b"".join(chunks), dtype="<i4")
            yield pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))

    return run(words_of(F.col(text_col), pattern))


def _coder(known: dict[str, bytes], ranks: dict[bytes, int]):
    """A function from lists of words to the ids of each list, as 32-bit little-endian bytes."""
    look, memo = known.get, {}

    def rare(word):
        found = memo.get(word)
        if found is None:
            found = np.array(merge_word(word.encode(), ranks), dtype="<u4").tobytes()
            if len(memo) < MEMO_WORDS and len(word) <= HEAD_BYTES:
                memo[word] = found
        return found

    def code(part: pa.ListArray) -> list[bytes]:
        starts = part.offsets.to_numpy()
        words = part.values.slice(starts[0], starts[-1] - starts[0]).to_numpy(zero_copy_only=False).tolist()
        coded = list(map(look, words))
        if None in coded:
            coded = [rare(w) if c is None else c for c, w in zip(coded, words)]
        edges = (starts - starts[0]).tolist()
        return [b"".join(coded[a:b]) for a, b in zip(edges[:-1], edges[1:])]

    return code


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", head_words: int = HEAD_WORDS) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of each whole text: encoded as by ``encode``, and decoded, in one task.

    Ids do not leave the task, so a long text is no long array of a row. Null and empty texts have no ids.
    """
    head = head_dictionary(docs, text_col, ranks, pattern, head_words)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = _coder(head.value, shared.value)
        piece = {rank: word for word, rank in shared.value.items()}.__getitem__
        for batch in batches:
            rows = [], [], []
            for part in slices(batch):
                for ids in code(part):
                    decoded = b"".join(map(piece, np.frombuffer(ids, dtype="<u4").tolist()))
                    for kept, value in zip(rows, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())):
                        kept.append(value)
            yield pa.StructArray.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())],
                names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(words_of(F.col(text_col), pattern))


def decode(ids: Column, ranks: dict[bytes, int], spark) -> Column:
    """The bytes that an array of ids stands for; the array must not be null."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        pieces[rank] = word
    shared = spark.sparkContext.broadcast(pieces)

    @F.arrow_udf("binary")
    def run(batches: pa.Array) -> pa.Array:
        piece, done = shared.value.__getitem__, []
        for part in slices(batches):
            starts = part.offsets.to_numpy()
            pieces = list(map(piece, part.values.slice(starts[0], starts[-1] - starts[0]).to_numpy().tolist()))
            edges = (starts - starts[0]).tolist()
            done += [b"".join(pieces[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.array(done, pa.binary())

    return run(ids)


def ids_digest(ids: Column) -> Column:
    """SHA-256, as hex, of ids as little-endian unsigned 32-bit integers."""
    @F.arrow_udf("string")
    def run(batches: pa.Array) -> pa.Array:
        starts, values = batches.offsets.to_numpy().tolist(), batches.values.to_numpy().astype("<u4")
        return pa.array([hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(starts[:-1], starts[1:])], pa.string())

    return run(ids)
