"""Scoring documents by cross-entropy difference between a target and a background language model.

Both models are bigram models over all words of all documents. The background is learned from every document, the target
from the documents named as such. The models are matched: same order, vocabulary and smoothing, and background counts are
scaled to as many words as the target has, so that a word seen once weighs the same in both. A document's score is the mean
over its words of target loss minus background loss, so the lowest scores are most like the target.

Counts cover all words and all documents. The loss of a pair is -log(pair + prior * word) + log(word before + prior). Texts
are read once and kept in chunks, as numbers of the chunk's own words. A chunk names each of its words and pairs once, with
its counts there, in runs that are dealt out by ranges of hashes; the runs of a range are added up and each chunk is told the
totals of what it named, in its own order. So what travels is one entry per chunk and distinct pair, whether a pair stands
there once or a million times, and no key gathers more entries than there are chunks. Words and pairs are told apart by 64
bits: a word by its XXH64, a pair by a mix of those of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.arrays import frequent, pack, slices, unpack
from turnmill.session import materialize

PRIOR = 50.0
FLUSH_WORDS = 400_000
SHARED_IDS = 100_000
#: Words of a chunk, and ranges of hashes that the entries of each task of the input are dealt to.
CHUNK_WORDS = 1 << 20
PARTS_PER_TASK, LEAST_PARTS, MOST_PARTS = 8, 64, 4096
#: Stand for the place before a text's first word and for all words outside of a fixed vocabulary; no word has a blank.
START, OTHER = (xxhash.xxh64_intdigest(name) for name in (b"start of text", b"other word"))


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, A to Z lower-cased, between white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(marked: DataFrame) -> DataFrame:
    """``word, n, t, last, last_t``: how often each word is in all and in target documents, and ends one.

    ``marked``: id, text, whether the document is a target.
    """
    names = ["n", "t", "last", "last_t"]

    def count(batches):
        held = [Counter() for _ in names]

        def rows():
            words = list(held[0])
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in held)], names=["word", *names])

        for batch in batches:
            for part in slices(batch):
                for text, target in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = words_of(text)
                    for counts, some in zip(held, (words, words * target, words[-1:], words[-1:] * target)):
                        counts.update(some)
                if len(held[0]) > FLUSH_WORDS:
                    yield rows()
                    held = [Counter() for _ in names]
        if held[0]:
            yield rows()

    counted = marked.mapInArrow(count, "word binary, n bigint, t bigint, last bigint, last_t bigint")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


class _Numbers(dict):
    """Words numbered from 0 in the order in which they are met; all outside of ``known``, where given, have one number."""

    def __init__(self, known: frozenset[bytes] | None):
        super().__init__()
        self.known, self.hashes, self.other = known, [], None

    def __missing__(self, word: bytes) -> int:
        if self.known is None or word in self.known:
            number = len(self.hashes)
            self.hashes.append(xxhash.xxh64_intdigest(word))
        elif self.other is None:
            number = self.other = len(self.hashes)
            self.hashes.append(OTHER)
        else:
            number = self.other
        self[word] = number
        return number


def _chunks(known, chunk_words: int):
    """Over id, text, target: texts as numbers of words, a row per chunk."""
    names = ["chunk", "ids", "data", "words", "wanted", "texts", "wanted_texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value if known is not None else None
        chunk = TaskContext.get().partitionId() << 32
        numbers, flat, lengths, marks, ids = _Numbers(vocabulary), [], [], [], []
        held = 0

        def row():
            sizes, wanted = np.array(lengths, dtype=np.int64), np.array(marks, dtype=bool)
            words = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            data = pack(np.array(numbers.hashes, dtype=np.uint64), words.astype(np.int32), sizes, wanted.astype(np.uint8))
            all_ids = pa.concat_arrays(ids)
            sums = len(words), int(sizes[wanted].sum()), int((sizes > 0).sum()), int((sizes[wanted] > 0).sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), pa.array([data], pa.binary()),
                 *(pa.array([x], pa.int64()) for x in sums)], names=names)

        for batch in batches:
            for part in slices(batch):
                ids.append(part.column(0))
                marks += part.column(2).to_pylist()
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    lengths.append(len(words))
                    held += len(words)
                    flat.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                if held > chunk_words or len(lengths) > chunk_words:
                    yield row()
                    chunk += 1
                    numbers, flat, lengths, marks, ids, held = _Numbers(vocabulary), [], [], [], [], 0
        if lengths:
            yield row()

    return run


class _Chunk:
    """The words and pairs of a chunk, each named once and in the order of its hash, with its counts."""

    def __init__(self, data: bytes):
        hashes, *rest = unpack(data)
        flat, self.lengths, marks = (a.astype(np.int64) for a in rest)
        start, stops, self.marks = len(hashes), np.cumsum(self.lengths), marks.astype(bool)
        some = self.lengths > 0
        target = np.repeat(self.marks, self.lengths)
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[(stops - self.lengths)[some]] = start
        codes, self.pair_of = np.unique(before * (start + 1) + flat, return_inverse=True)
        self.before, self.after = codes // (start + 1), codes % (start + 1)
        named = np.r_[hashes, np.uint64(START)]
        keys = named[self.before] * np.uint64(0x9E3779B97F4A7C15) + named[self.after]
        keys ^= keys >> np.uint64(32)
        keys *= np.uint64(0xD6E8FEB86659FD93)
        self.pairs = self._run(keys, self.pair_of, self.pair_of[target])
        ends = stops[some] - 1
        self.words = self._run(hashes, flat, flat[target], flat[ends], flat[ends][self.marks[some]])

    @staticmethod
    def _run(keys: np.ndarray, *occurrences: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The order of the keys, and in that order keys and counts."""
        order = np.argsort(keys, kind="stable")
        return order, [keys[order], *(np.bincount(o, minlength=len(keys))[order].astype(np.uint32) for o in occurrences)]


def _runs(parts: int):
    """Over chunk, data: runs as ``chunk, part, data``; those of pairs are in the first ``parts``, those of words in as many more."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                read = _Chunk(data.as_py())
                for first, (_, arrays) in ((0, read.pairs), (parts, read.words)):
                    cuts = np.r_[0, np.searchsorted(arrays[0], bounds), len(arrays[0])]
                    held = np.flatnonzero(np.diff(cuts))
                    blobs = [pack(*(a[cuts[i]:cuts[i + 1]] for a in arrays)) for i in held.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(held), chunk, np.int64)), pa.array((held + first).astype(np.int32)), pa.array(blobs, pa.binary())],
                        names=["chunk", "part", "data"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows in a row with one value in ``column``, as plain values."""
    held: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() if c.type == pa.binary() or pa.types.is_integer(c.type) else c[i] for c in batch.columns)
            if held and held[0][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _totals(parts: int):
    """Over runs sorted by part: to each the totals of its keys. ``types`` adds up to the number of distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 1):
            runs = [unpack(data) for _, _, data in rows]
            keys, place = np.unique(np.concatenate([r[0] for r in runs]), return_inverse=True)
            stops = np.cumsum([len(r[0]) for r in runs])
            sums = [np.bincount(place, np.concatenate(c), len(keys)).astype(np.int64) for c in list(zip(*runs))[1:]]
            small = [s.astype(np.uint32) if s.max() < 1 << 32 else s for s in sums]
            types = len(keys) if rows[0][1] >= parts else 0
            for i, (chunk, part, _) in enumerate(rows):
                own = place[stops[i] - len(runs[i][0]):stops[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([pack(*(s[own] for s in small))], pa.binary()),
                     pa.array([types if i == 0 else 0], pa.int64())], names=["chunk", "part", "data", "types"])

    return run


def _losses(parts: int, prior: float, types: int, every: int, wanted: int, ends: int, target_ends: int):
    """Over chunk, part, data, ids sorted by chunk and part (-1: the chunk itself): words and summed losses of each text."""
    ratio = wanted / max(every, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 0):
            read, ids = _Chunk(rows[0][2]), rows[0][3].values
            n = len(read.lengths)
            told = []
            for order, low, columns in ((read.pairs[0], 0, 2), (read.words[0], parts, 4)):
                replies = [unpack(data) for _, part, data, _ in rows[1:] if low <= part < low + parts]
                sums = [np.empty(len(order), dtype=np.float64) for _ in range(columns)]
                for i, total in enumerate(sums):
                    if replies:
                        total[order] = np.concatenate([r[i] for r in replies])
                told.append(sums)
            (pair_n, pair_t), (word_n, word_t, last_n, last_t) = told
            sides = []
            for pair, word, last, scale, total, first in ((pair_t, word_t, last_t, 1.0, wanted, target_ends), (pair_n, word_n, last_n, ratio, ratio * every, ends)):
                smooth = prior * (scale * word + 1) / (total + types or 1)
                row = np.log(scale * np.r_[word - last, first] + prior)
                loss = row[read.before] - np.log(scale * pair + smooth[read.after])
                sides.append(np.bincount(np.repeat(np.arange(n), read.lengths), loss[read.pair_of], n))
            yield pa.RecordBatch.from_arrays([ids, pa.array(read.lengths), *map(pa.array, sides)], names=["id", "tokens", "t", "b"])

    return run


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None,
          prior: float = PRIOR, dense: int | None = None, hot: int | None = None) -> DataFrame:
    """``id_col, tokens, target_loss, background_loss, score`` for every row; losses are means per word in nats.

    ``targets``: the ids (a column named ``id_col``) of documents that are like what is wanted; null and unknown ids name
    none. Null, empty and wordless texts have 0 tokens and null losses. Without targets the target model knows nothing and
    gives every word the same loss. Repeated rows count and are scored each; an empty table gives no rows; extra columns
    are not read. With ``size`` the models have that many entries only: the most frequent words (ties by the word's bytes)
    and one for all others. ``dense`` and ``hot`` are taken for older callers and change nothing: all words
    and pairs are counted one way.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = materialize(targets.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull()).distinct(), "targets")
    few = named.limit(SHARED_IDS + 1).count() <= SHARED_IDS
    named = named.withColumn("target", F.lit(True))
    marked = texts.join(F.broadcast(named) if few else named, "id", "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))

    known = None
    if size is not None:
        words = materialize(word_counts(marked), "words")
        top = frequent(words, size - 1, at_least=True).orderBy(F.desc("n"), "word").limit(size - 1).toArrow()
        known = spark.sparkContext.broadcast(frozenset(top.column("word").to_pylist()))
    kind = texts.schema["id"].dataType.simpleString()
    sums = ["words", "wanted", "texts", "wanted_texts"]
    chunks = materialize(marked.mapInArrow(
        _chunks(known, CHUNK_WORDS), f"chunk bigint, ids array<{kind}>, data binary, " + ", ".join(f"{c} bigint" for c in sums)), "chunks")
    every, wanted, ends, target_ends = (int(x) for x in chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in sums]).first())
    # Tasks grow with the input, and so do ranges: one range holds few of the distinct pairs.
    parts = min(MOST_PARTS, max(LEAST_PARTS, PARTS_PER_TASK * marked.rdd.getNumPartitions()))
    runs = chunks.select("chunk", "data").mapInArrow(_runs(parts), "chunk bigint, part int, data binary")
    totals = materialize(runs.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(
        _totals(parts), "chunk bigint, part int, data binary, types bigint"), "totals")
    types = size if size is not None else int(totals.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0])
    own = chunks.select("chunk", F.lit(-1).alias("part"), "data", "ids")
    told = own.unionByName(totals.select("chunk", "part", "data", F.lit(None).cast(f"array<{kind}>").alias("ids")))
    summed = told.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(
        _losses(parts, prior, types, every, wanted, ends, target_ends), f"id {kind}, tokens bigint, t double, b double")
    some = F.col("tokens") > 0
    return summed.select(
        F.col("id").alias(id_col), "tokens", F.when(some, F.col("t") / F.col("tokens")).alias("target_loss"),
        F.when(some, F.col("b") / F.col("tokens")).alias("background_loss"), F.when(some, (F.col("t") - F.col("b")) / F.col("tokens")).alias("score"))
