"""How far the sources of a language differ in their words, by exact counts of the terms that many documents hold.

A first pass counts in how many documents of a language each term occurs; terms of too few go. The kept terms of a language
are cut into shards of about SHARD_TERMS, and one minimal perfect hash is built for each: levels of bits, a key standing in
the first level where it is alone, its slot being the number of bits before it. A slot keeps its term, so a term that was
not kept is told from the one whose slot it hits. The hashes are broadcast, as many at once as BROADCAST_BYTES hold, and a
second pass over the documents counts the terms of every (language, source) in dense arrays of slots; a term never travels
again, only slots do. With more hashes than that the second pass is made once per share of them.

Arrays are added up per group and shard. One task then holds one shard for a block of sources (or two blocks) and adds up
what its terms contribute to each pair of sources; blocks keep a language of many sources from being one task's work.

Shares are whole numbers of a billion: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with N the group's counts over the V kept
terms of its language; the divergence of two shares is floor((p - q)^2 / (p + q)). All arithmetic is on whole numbers and
exact while a group has fewer than 10^14 words.

Null texts, languages and sources count as ''. Every row is a document, repeated rows too. A text without terms still makes
its group occur. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from turnmill.llm.arrays import pack, slices, unpack
from turnmill.session import materialize

SHARD_TERMS, BLOCK_SOURCES = 1 << 14, 256
BROADCAST_BYTES = 1 << 26
#: A task sends on what it has counted at so many terms or cells.
HELD_TERMS, HELD_CELLS = 1 << 19, 1 << 22
LEVELS = 40
HASH_SEED = 42
SHARE, SPLIT = 1_000_000_000, 32_000
#: Letters in lower case, bytes beyond ASCII as they are, spaces for all else: terms are what is left between spaces.
TERMS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERMS).split(b" ") if text else []


def hashes(terms: list[bytes]) -> np.ndarray:
    """The same numbers as Spark's xxhash64."""
    return np.array([xxhash.xxh64_intdigest(t, HASH_SEED) for t in terms], dtype=np.uint64)


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ mixed >> np.uint64(31)) % np.uint64(size)


class PerfectHash:
    """Slots of a set of terms, without gaps. Terms that share all 64 bits of a hash are told apart by their bytes."""

    def __init__(self, levels: list[np.ndarray], terms: list[bytes]):
        self.levels, self.terms = levels, terms
        self.before = np.cumsum([0] + [int(bits.sum()) for bits in levels]).tolist()
        self.ranks = [np.cumsum(bits, dtype=np.int64) - 1 for bits in levels]
        self.rest = {t: n for n, t in enumerate(terms[self.before[-1]:], self.before[-1])}

    @classmethod
    def build(cls, terms: list[bytes]) -> PerfectHash:
        keys, left, levels, order = hashes(terms), np.arange(len(terms)), [], []
        while len(left) and len(levels) < LEVELS:
            at = _position(keys[left], len(levels), max(64, 2 * len(left))).astype(np.int64)
            alone = np.bincount(at, minlength=max(64, 2 * len(left))) == 1
            levels.append(alone)
            placed = alone[at]
            order += left[placed][np.argsort(at[placed])].tolist()
            left = left[~placed]
        return cls(levels, [terms[n] for n in order + left.tolist()])

    def slots(self, terms: list[bytes], keys: np.ndarray) -> np.ndarray:
        """Each term's slot, or -1 if it is not in the set."""
        found, left = np.full(len(terms), -1, dtype=np.int64), np.arange(len(terms))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _position(keys[left], level, len(bits)).astype(np.int64)
            here = bits[at]
            found[left[here]] = self.before[level] + ranks[at[here]]
            left = left[~here]
        for n in left.tolist() if self.rest else ():
            found[n] = self.rest.get(terms[n], -1)
        stored = self.terms
        return np.array([s if s >= 0 and stored[s] == t else -1 for s, t in zip(found.tolist(), terms)], dtype=np.int64)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(b) for b in self.levels], dtype="<u8")
        bits = np.packbits(np.concatenate([np.zeros(0, dtype=bool), *self.levels]))
        return pack(sizes, bits, np.array([len(t) for t in self.terms], dtype="<u4"), np.frombuffer(b"".join(self.terms), dtype=np.uint8))

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        sizes, bits, lengths, text = unpack(data)
        sizes = sizes.astype(np.int64)
        levels = np.split(np.unpackbits(bits, count=int(sizes.sum())).astype(bool), np.cumsum(sizes)[:-1]) if len(sizes) else []
        ends, text = np.cumsum(lengths, dtype=np.int64).tolist(), text.tobytes()
        return cls(levels, [text[a:b] for a, b in zip([0, *ends], ends)])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, n: the documents that hold a term, as far as one task has counted."""
    held = {}

    def counted():
        for lang, terms in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64())],
                names=["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(2)):
                found = set(terms_of(text.as_py()))
                found.discard(b"")
                held.setdefault(lang, Counter()).update(found)
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from counted()
    yield from counted()


def _build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = sorted(t.encode() for batch in batches for t in batch.column(2).to_pylist())
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([len(terms)], pa.int32()), pa.array([PerfectHash.build(terms).to_bytes()])],
        names=["lang", "shard", "terms", "data"])


def _recount(shared):
    """Over lang, source, text: lang, source, shard, total, cells (counts by slot), as far as one task has counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shards = {}, {}
        for lang, of, shard, data in shared.value:
            shards[lang] = of
            known[lang, shard] = PerfectHash.from_bytes(data)
        words, cells = {}, {}

        def resolve():
            for (lang, source), counts in words.items():
                if lang not in shards:
                    continue
                counts.pop(b"", None)
                terms, times = list(counts), np.array(list(counts.values()), dtype=np.int64)
                keys = hashes(terms)
                of = np.mod(keys.view(np.int64), shards[lang])
                order = np.argsort(of, kind="stable")
                edges = np.searchsorted(of[order], np.arange(shards[lang] + 1))
                for shard in np.unique(of).tolist():
                    if (lang, shard) not in known:
                        continue
                    own = order[edges[shard]:edges[shard + 1]]
                    slots = known[lang, shard].slots([terms[n] for n in own.tolist()], keys[own])
                    if (slots >= 0).any():
                        dense = cells.setdefault((lang, source, shard), np.zeros(len(known[lang, shard].terms), dtype=np.int64))
                        # A slot is one term, and a term is in counts once.
                        dense[slots[slots >= 0]] += times[own][slots >= 0]
            words.clear()

        def counted():
            found = list(cells.items())
            for at in range(0, len(found), 64):
                some = found[at:at + 64]
                yield _cells([k for k, _ in some], [c for _, c in some])
            cells.clear()

        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    words.setdefault((lang, source), Counter()).update(terms_of(text.as_py()))
                if sum(map(len, words.values())) > HELD_TERMS:
                    resolve()
                    if sum(map(len, cells.values())) > HELD_CELLS:
                        yield from counted()
        resolve()
        yield from counted()

    return run


def _cells(keys, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()),
         pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([pack(c.astype("<u8")) for c in counts], pa.binary())],
        names=["lang", "source", "shard", "total", "cells"])


def _sum(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Added cells of one key, (lang, source, shard) or (lang, shard)."""
    total = 0
    for batch in batches:
        for data in batch.column("cells").to_pylist():
            total = total + unpack(data)[0].astype(np.int64)
    names = [k.as_py() for k in key]
    yield _cells([(names[0], names[1] if len(names) == 3 else None, names[-1])], [total])


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), divided in two steps so that no product leaves 64 bits."""
    whole = total + 2 * terms
    first, rest = np.divmod((counts + 2) * SPLIT, whole)
    return 1 + first * (SHARE // SPLIT) + rest * (SHARE // SPLIT) // whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(top: int):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(groups: pa.Table, held: pa.Table) -> pa.Table:
        """One shard for the sources of the blocks i and j of a language."""
        if not groups.num_rows:
            return schema.empty_table()
        lang, i, j = (groups.column(n)[0].as_py() for n in ("lang", "i", "j"))
        sources, blocks, totals = (groups.column(n).to_pylist() for n in ("source", "block", "total"))
        kept = groups.column("kept")[0].as_py()
        hashed, cells, whole, whole_total = None, {}, None, 0
        for kind, source, total, data in zip(*[held.column(n).to_pylist() for n in ("kind", "source", "total", "cells")]):
            if kind == "hash":
                hashed = PerfectHash.from_bytes(data)
            elif kind == "lang":
                whole, whole_total = unpack(data)[0].astype(np.int64), total
            else:
                cells[source] = unpack(data)[0].astype(np.int64)
        size = groups.column("slots")[0].as_py()
        counts = [cells.get(s, np.zeros(size, dtype=np.int64)) for s in sources]
        p = [shares(c, t, kept) for c, t in zip(counts, totals)]
        rows = []
        for a in range(len(sources)):
            for b in range(a + 1, len(sources)):
                if i == j or blocks[a] != blocks[b]:
                    value = int(distance(p[a], p[b]).sum())
                    rows += [(sources[a], "pair", sources[b], value), (sources[b], "pair", sources[a], value)]
        if i == j and hashed is not None and whole is not None:
            q = shares(whole, whole_total, kept)
            alphabet = np.empty(size, dtype=np.int64)
            alphabet[sorted(range(size), key=hashed.terms.__getitem__)] = np.arange(size)
            for source, count, own in zip(sources, counts, p):
                at = np.flatnonzero((count > 0) & (own > q))
                value = distance(own[at], q[at])
                for n in np.lexsort((alphabet[at], -value))[:top].tolist():
                    rows.append((source, "term", hashed.terms[at[n]].decode(), int(value[n])))
        return pa.table([pa.array([lang] * len(rows), pa.string()), *[pa.array([r[n] for r in rows], schema.field(n + 1).type) for n in range(4)]], schema=schema)

    return run


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """``lang, term``: terms in at least ``least`` documents of the language."""
    counted = docs.mapInArrow(_frequencies, "lang string, term string, n bigint")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def _rounds(built: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The hashes with a round for each, no round holding more than ``limit`` bytes unless it is a single hash."""
    rounds = 1
    while True:
        dealt = built.withColumn("round", F.pmod(F.xxhash64("lang", "shard"), F.lit(rounds)))
        held = dealt.groupBy("round").agg(F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("n"))
        worst = held.filter("n > 1").agg(F.max("bytes").alias("bytes")).first()["bytes"] or 0
        if worst <= limit:
            return dealt, rounds
        rounds *= 2


class Audit:
    """Counted sources of a corpus. ``least`` is the number of documents a term must be in to be kept for its language."""

    def __init__(self, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10,
                 shard_terms: int = SHARD_TERMS, block_sources: int = BLOCK_SOURCES, broadcast_bytes: int = BROADCAST_BYTES):
        spark = docs.sparkSession
        plain = lambda name, new: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(new)
        docs = docs.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text"))
        self.terms = materialize(kept_terms(docs, least), "kept-terms")
        groups = docs.groupBy("lang", "source").agg(F.count("*").alias("documents"))
        kept = self.terms.groupBy("lang").agg(F.count("*").alias("kept"))
        langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept, "lang", "left").fillna(0, ["kept"])
        langs = langs.select("lang", "kept", F.ceil(F.col("kept") / shard_terms).cast("int").alias("shards"), F.ceil(F.col("sources") / block_sources).cast("int").alias("blocks"))
        langs = materialize(langs, "languages")
        sharded = self.terms.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term")
        built = materialize(sharded.groupBy("lang", "shard").applyInArrow(_build, "lang string, shard int, terms int, data binary"), "hashes")
        dealt, rounds = _rounds(built.join(langs.select("lang", "shards"), "lang"), broadcast_bytes)
        counted = []
        for n in range(rounds):
            some = dealt.filter(F.col("round") == n).select("lang", "shards", "shard", "data").toArrow()
            shared = spark.sparkContext.broadcast(list(zip(*[c.to_pylist() for c in some.columns])))
            counted.append(materialize(docs.mapInArrow(_recount(shared), "lang string, source string, shard int, total bigint, cells binary"), "recounted"))
            shared.unpersist()
        together = counted[0]
        for more in counted[1:]:
            together = together.unionByName(more)
        schema = "lang string, source string, shard int, total bigint, cells binary"
        self.cells = materialize(together.groupBy("lang", "source", "shard").applyInArrow(_sum, schema), "cells")
        self.whole = materialize(self.cells.groupBy("lang", "shard").applyInArrow(_sum, schema), "language-cells")
        totals = self.cells.groupBy("lang", "source").agg(F.sum("total").alias("total"))
        groups = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
        self.groups = materialize(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "groups")
        self.langs, self.hashes = langs, built

    def divergence(self, top: int = 10) -> DataFrame:
        """``lang, source, part, item, value, rank``.

        Part ``pair``: every other source of the language with the summed divergence over all kept terms. Part ``term``: the
        ``top`` terms that occur in the group and have a larger share there than in the language. Ranks start at 1, largest
        value first, ties by item.
        """
        sizes = self.hashes.select("lang", "shard", F.col("terms").alias("slots"))
        # A language without kept terms has one empty shard, so that its pairs are there with a value of 0.
        shard = F.explode(F.when(F.col("shards") > 0, F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(F.array(F.lit(-1))))
        with_block = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
            "i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
        groups = with_block(self.groups.withColumn("shard", shard)).join(sizes, ["lang", "shard"], "left").fillna(0, ["slots"])
        place = self.groups.select("lang", "source", "block", "blocks")
        cells = with_block(self.cells.join(place, ["lang", "source"]).withColumn("kind", F.lit("source")))
        diagonal = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        totals = self.whole.groupBy("lang").agg(F.sum("total").alias("total"))
        blocks = self.langs.select("lang", "blocks")
        whole = self.whole.drop("total", "source").join(totals, "lang").join(blocks, "lang").select(
            "lang", "shard", diagonal.alias("i"), F.lit("lang").alias("kind"), F.lit(None).cast("string").alias("source"), "total", "cells")
        hashed = self.hashes.join(blocks, "lang").select(
            "lang", "shard", diagonal.alias("i"), F.lit("hash").alias("kind"), F.lit(None).cast("string").alias("source"),
            F.lit(0).cast("bigint").alias("total"), F.col("data").alias("cells"))
        names = ["lang", "shard", "i", "j", "kind", "source", "total", "cells"]
        held = cells.select(*names)
        for more in (whole, hashed):
            held = held.unionByName(more.withColumn("j", F.col("i")).select(*names))
        key = ["lang", "shard", "i", "j"]
        found = groups.select(*key, "source", "block", "total", "kept", "slots").groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(
            _compare(top), "lang string, source string, part string, item string, value bigint")
        found = materialize(found, "compared")
        pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        ranked = pairs.withColumn("rank", F.row_number().over(best))
        terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        return ranked.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
