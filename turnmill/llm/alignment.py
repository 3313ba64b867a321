"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the pairs of ids that overlap.

A byte-level BPE (A) and a sentencepiece model (B) cut the same bytes. Where tokens of both end, a group ends; inside a
group every A token is linked to the B tokens whose bytes it shares. How many links hold a pair of ids is counted over all
documents by external spill counting:

1. A task encodes its documents and collects chunks of links as records (pair, document, times). Records are radix
   partitioned by pair, sorted by B id, A id and document, and written as one zstd run per chunk and partition: the run's
   pairs with their counts in the chunk, in blocks, and beside them the documents of each pair.
2. One task merges the pairs of all runs of a partition with a heap over their blocks. Pairs come out in order of their B
   id, so the largest count of each B id is known when its last pair is passed. Each run gets the counts of its pairs back
   in its own order. The documents of a pair stay in their chunk, so a pair that every document holds is one record per
   chunk. An id's pairs are split among partitions by their A id; the largest counts, one number per B id, meet once more.
3. A chunk's runs and the counts that came back are put together: every document adds up its own links.

Texts are encoded unit by unit where no token of either vocabulary can reach from the end of a word into the white space
after it, and whole otherwise; a task remembers units, so a word is encoded once and its links are copied. Null ids,
repeated rows, extra columns and empty tables are kept as they are: one row per row of the input. Texts that are null or
empty, or whose joined bytes of A or B are not the text with a space before it, have no tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.arrays import pack, slices, unpack
from turnmill.session import materialize

#: A chunk ends at so many links or documents; a task's memory of units is emptied at so many links of its own.
CHUNK_LINKS, CHUNK_DOCS, STORE_LINKS = 1 << 20, 1 << 16, 1 << 20
BLOCK_PAIRS, FAN = 8192, 64
#: Bytes of text per partition of pairs, and the parts an id's pairs are split into.
RADIX_BYTES, RADIX_LEAST, RADIX_MOST, SPLITS = 1 << 25, 8, 1 << 14, 16
#: A space after a character that is white space in no engine's view; no match of a byte-level pattern reaches over it.
UNIT_END = re.compile(r" (?<=[!-~\w] )")
CLOSED = re.compile(r"[!-~\w]\Z")
JOINED_CHARS = 1 << 14
SPACE = "▁"


def byte_level(token: str) -> bytes:
    """The bytes of a byte-level token: printable characters stand for themselves, those from 256 on for the other bytes."""
    return b"".join(bytes([_BYTES[c]]) if c in _BYTES else c.encode() for c in token)


def _byte_alphabet() -> dict[str, int]:
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


_BYTES = _byte_alphabet()


def piece_bytes(piece: str) -> bytes:
    """The bytes of a sentencepiece token."""
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace(SPACE, " ").encode()


def unit_wise(a_json: str, b_model: bytes) -> bool:
    """Whether words can be encoded one by one: neither side changes texts first, no token crosses the end of a word."""
    from sentencepiece import sentencepiece_model_pb2

    a = json.loads(a_json)
    first = a.get("pre_tokenizer") or {}
    a_safe = a.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
    a_safe = a_safe and a["model"]["type"] == "BPE" and all(t["special"] for t in a.get("added_tokens", []))
    b = sentencepiece_model_pb2.ModelProto()
    b.ParseFromString(b_model)
    spec = b.normalizer_spec
    b_safe = spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
    b_safe = b_safe and b.trainer_spec.model_type == 2 and all(p.type in (1, 2, 3, 6) for p in b.pieces)
    return bool(a_safe and b_safe and not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in b.pieces))


class Units:
    """Encoded units of one task: counts, group texts and links of each, appended as they are met."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        size = max(self.a.get_vocab().values()) + 1
        self.a_bytes = [byte_level(self.a.id_to_token(i) or "") for i in range(size)]
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = np.array([len(t) for t in self.a_bytes]), np.array([len(t) for t in self.b_bytes])
        # An id's text inside a group and at its end, for A and then for B.
        self.shown = [f"{i}{tail}".encode() for sizes, tails in ((self.a_size, ",|"), (self.b_size, ",;")) for i in range(len(sizes)) for tail in tails]
        self.clear()

    def clear(self) -> None:
        self.places, self.groups, self.counts, self.sizes, self.keys, self.links = {}, [], [], [], [], 0

    def known(self, units: list[str], by_unit: bool) -> list[int]:
        """Places of units, encoding those that are new."""
        found = list(map(self.places.get, units))
        if None in found:
            new = list({u: None for u, at in zip(units, found) if at is None})
            if by_unit:
                self._add_joined([u for u in new if CLOSED.search(u)])
                new = [u for u in new if u not in self.places]
            for at in range(0, len(new), 1024):
                self._add(new[at:at + 1024], [[u] for u in new[at:at + 1024]])
            found = list(map(self.places.get, units))
        return found

    def _add_joined(self, units: list[str]) -> None:
        """Encode units many at a time as one text, in which their ends are ends of tokens."""
        held, size = [[]], 0
        for unit in units:
            if size > JOINED_CHARS:
                held.append([])
                size = 0
            held[-1].append(unit)
            size += len(unit) + 1
        self._add([" ".join(group) for group in held if group], [group for group in held if group])

    def _add(self, texts: list[str], units: list[list[str]]) -> None:
        """Encode texts and cut what comes of them at the ends of their units.

        A text of one unit whose bytes do not agree has no tokens and no groups; one of several is left to be encoded unit
        by unit.
        """
        if not texts:
            return
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b_ids = self.b.encode(texts, num_threads=1)
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        agree = [b"".join(map(a_bytes, x)) == (w := (" " + t).encode()) == b"".join(map(b_bytes, y)) for t, x, y in zip(texts, a_ids, b_ids)]
        for own, good in zip(units, agree):
            if not good and len(own) == 1:
                self._keep(own, [b""], np.zeros((1, 4), dtype=np.int64), np.zeros(0, dtype=np.uint64))
        a = np.fromiter(chain.from_iterable(x for x, good in zip(a_ids, agree) if good), dtype=np.int64)
        b = np.fromiter(chain.from_iterable(x for x, good in zip(b_ids, agree) if good), dtype=np.int64)
        cut = [u for own, good in zip(units, agree) if good for u in own]
        if not cut:
            return
        # Both sides have the same bytes, so ends are compared over all texts at once.
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        borders = np.cumsum([len(u.encode()) + 1 for u in cut])
        marks = np.zeros((2, int(borders[-1]) + 1), dtype=bool)
        marks[0, a_end], marks[1, b_end] = True, True
        both = marks.all(axis=0)
        if not both[borders].all():
            raise ValueError("a token reaches over the end of a unit")
        before = np.cumsum(marks, axis=1) - marks
        ends = np.flatnonzero(marks.any(axis=0))
        group = np.cumsum(both) - both
        a_at, b_at = before[0, ends], before[1, ends]
        counts = np.diff(np.stack([
            np.searchsorted(a_end, borders, "right"), np.searchsorted(b_end, borders, "right"),
            group[borders] + 1, np.searchsorted(ends, borders, "right")], axis=1), axis=0, prepend=0)
        order = np.argsort(np.concatenate([group[a_end] * 2, group[b_end] * 2 + 1]), kind="stable")
        shown = np.concatenate([a * 2 + both[a_end], (b + len(self.a_size)) * 2 + both[b_end]])[order]
        pieces = list(map(self.shown.__getitem__, shown.tolist()))
        cuts = [0, *np.cumsum(counts[:, 0] + counts[:, 1]).tolist()]
        self._keep(cut, [b"".join(pieces[lo:hi]) for lo, hi in zip(cuts, cuts[1:])], counts, self.keyed(a[a_at], b[b_at]))

    def _keep(self, units: list[str], groups: list[bytes], counts: np.ndarray, keys: np.ndarray) -> None:
        self.places.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        self.groups += groups
        self.counts += counts[:, 3].tolist()
        self.sizes.append(counts)
        self.keys.append(keys)
        self.links += len(keys)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all units, and the keys of their links one unit after the other."""
        self.sizes = [np.concatenate([np.zeros((0, 4), dtype=np.int64), *self.sizes])]
        self.keys = [np.concatenate([np.zeros(0, dtype=np.uint64), *self.keys])]
        return self.sizes[0], self.keys[0]


_LOADED: dict[str, Units] = {}


def _units(a_json: str, b_model: bytes, keyed) -> Units:
    """The vocabularies of a task, without units. A Python worker loads them once and keeps its last ones."""
    name = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Units(a_json, b_model)
    units = _LOADED[name]
    units.clear()
    units.keyed = keyed
    return units


class Layout:
    """Where the parts of a record's 64-bit key lie: partition, B id, A id, document, from the highest bits down."""

    def __init__(self, a_ids: int, b_ids: int, partitions: int):
        self.a_bits, self.b_bits = max(1, (a_ids - 1).bit_length()), max(1, (b_ids - 1).bit_length())
        self.part_bits = (partitions - 1).bit_length()
        left = 64 - self.a_bits - self.b_bits - self.part_bits
        if left < 1:
            raise ValueError("vocabularies too large for 64-bit keys")
        self.doc_bits = min(left, CHUNK_DOCS.bit_length() - 1)

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        mixed = (b * np.uint64(SPLITS) + a % np.uint64(SPLITS)) * np.uint64(0x9E3779B97F4A7C15)
        part = mixed >> np.uint64(64 - self.part_bits) if self.part_bits else np.zeros_like(mixed)
        return ((part << np.uint64(self.b_bits) | b) << np.uint64(self.a_bits) | a) << np.uint64(self.doc_bits)

    def pair(self, key: np.ndarray) -> np.ndarray:
        """B id and A id in one number, without the partition."""
        return key >> np.uint64(self.doc_bits) & np.uint64((1 << self.a_bits + self.b_bits) - 1)

    def part(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(self.doc_bits + self.a_bits + self.b_bits)).astype(np.int64)


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]]))


def build_runs(keys: np.ndarray, layout: Layout) -> Iterator[tuple[int, bytes, bytes]]:
    """Partition, pairs and documents of each run of a chunk. ``keys`` has one key with its document per link; it is sorted."""
    keys.sort()
    at = _starts(keys)
    records, times = keys[at], np.diff(np.append(at, len(keys)))
    head = records >> np.uint64(layout.doc_bits)
    first = _starts(head)
    holders = np.diff(np.append(first, len(records)))
    counts = np.add.reduceat(times, first) if len(first) else times
    docs = (records & np.uint64((1 << layout.doc_bits) - 1)).astype("<u2" if layout.doc_bits <= 16 else "<u4")
    pairs, parts = layout.pair(records[first]), layout.part(records[first])
    cut = _starts(parts)
    for lo, hi in zip(cut, np.append(cut[1:], len(parts))):
        own = slice(first[lo], first[hi] if hi < len(first) else len(records))
        sides = (pairs[lo:hi] >> np.uint64(layout.a_bits)).astype("<u4")
        yield int(parts[lo]), pack_pairs(pairs[lo:hi], counts[lo:hi]), pack(
            holders[lo:hi].astype("<u4"), np.diff(sides, prepend=np.uint32(0)), docs[own], times[own].astype("<u4"))


def pack_pairs(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs and their counts in blocks: number of pairs, of blocks, each block's first pair and size, the blocks."""
    blocks, firsts = [], []
    for at in range(0, len(pairs), BLOCK_PAIRS):
        some = pairs[at:at + BLOCK_PAIRS].astype("<u8")
        firsts.append(some[0])
        blocks.append(pack(np.diff(some, prepend=some[:1]), counts[at:at + BLOCK_PAIRS].astype("<u8")))
    head = np.array([len(pairs), len(blocks), *firsts, *map(len, blocks)], dtype="<u8")
    return head.tobytes() + b"".join(blocks)


class Run:
    """The pairs of a run, read block by block."""

    def __init__(self, chunk: int, data: bytes):
        self.chunk, self.data = chunk, data
        self.size, count = np.frombuffer(data, "<u8", 2).astype(int).tolist()
        self.firsts = np.frombuffer(data, "<u8", count, 16).tolist()
        self.edges = np.cumsum([16 + 16 * count, *np.frombuffer(data, "<u8", count, 16 + 8 * count).astype(int)]).tolist()
        self.found = []

    def block(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        steps, counts = unpack(self.data[self.edges[at]:self.edges[at + 1]])
        return np.uint64(self.firsts[at]) + np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def merge_runs(runs: list[Run]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, int]]]]:
    """Pairs in order with their totals, a stretch at a time, and for each run that has pairs there its own totals.

    The heap holds the first pair of every run's next block. Blocks are taken from it a few at a time; what lies before
    the heap's new top is complete.
    """
    heap = [(run.firsts[0], n, 0) for n, run in enumerate(runs) if run.size]
    heapq.heapify(heap)
    pairs, counts, owner, open_blocks = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while heap:
        taken = []
        while heap and len(taken) < max(FAN, open_blocks):
            _, n, at = heapq.heappop(heap)
            taken.append((n, *runs[n].block(at)))
            if at + 1 < len(runs[n].firsts):
                heapq.heappush(heap, (runs[n].firsts[at + 1], n, at + 1))
        pairs = np.concatenate([pairs, *[t[1] for t in taken]])
        counts = np.concatenate([counts, *[t[2] for t in taken]])
        owner = np.concatenate([owner, *[np.full(len(t[1]), t[0]) for t in taken]])
        ready = pairs < np.uint64(heap[0][0]) if heap else np.ones(len(pairs), dtype=bool)
        order = np.flatnonzero(ready)[np.argsort(pairs[ready], kind="stable")]
        first = _starts(pairs[order])
        if len(order):
            totals = np.add.reduceat(counts[order], first)
            each = np.repeat(totals, np.diff(np.append(first, len(order))))
            by_run = np.argsort(owner[order], kind="stable")
            cut = _starts(owner[order][by_run])
            own = [(each[by_run[lo:hi]], int(owner[order[by_run[lo]]])) for lo, hi in zip(cut, np.append(cut[1:], len(order)))]
            yield pairs[order][first], totals, own
        pairs, counts, owner = pairs[~ready], counts[~ready], owner[~ready]
        open_blocks = len(_starts(np.sort(owner)))


class Alignment:
    """The encoded and counted corpus.

    ``a_json`` is the text of a byte-level BPE of the tokenizers library, ``b_model`` a sentencepiece model; both are a few
    megabytes and travel with the tasks. ``groups`` keeps every document's groups as text beside their digest.
    """

    def __init__(self, docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text", groups: bool = False,
                 chunk_links: int = CHUNK_LINKS, radix_bytes: int = RADIX_BYTES):
        import sentencepiece
        import tokenizers

        self.id_col, self.groups = id_col, groups
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
        partitions = min(RADIX_MOST, max(RADIX_LEAST, 1 << (size // radix_bytes).bit_length()))
        a_ids = max(tokenizers.Tokenizer.from_str(a_json).get_vocab().values()) + 1
        self.b_ids = sentencepiece.SentencePieceProcessor(model_proto=b_model).get_piece_size()
        self.layout = Layout(a_ids, self.b_ids, partitions)
        shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model, unit_wise(a_json, b_model)))
        id_type = docs.schema[id_col].dataType.simpleString()
        self.schema = f"id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, groups string"
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        self.encoded = materialize(rows.mapInArrow(
            _encode(shared, self.layout, groups, chunk_links),
            f"chunk bigint, place int, {self.schema}, part int, pairs binary, holders binary"), "aligned")

    def _merged(self, pairs: bool):
        layout = self.layout

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs = [Run(c, d) for batch in batches for c, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            part, best = key[0].as_py(), {}
            left = [r.size for r in runs]
            for found, totals, own in merge_runs(runs):
                side = (found >> np.uint64(layout.a_bits)).astype(np.int64)
                if pairs:
                    yield pa.RecordBatch.from_arrays([
                        pa.array((found & np.uint64((1 << layout.a_bits) - 1)).astype(np.int32)), pa.array(side.astype(np.int32)), pa.array(totals)],
                        names=["a", "b", "n"])
                    continue
                at = _starts(side)
                for b, most in zip(side[at].tolist(), np.maximum.reduceat(totals, at).tolist()):
                    best[b] = max(most, best.get(b, 0))
                back = []
                for counts, n in own:
                    runs[n].found.append(pack(counts.astype("<u8")))
                    left[n] -= len(counts)
                    if not left[n]:
                        back.append((runs[n].chunk, pack(np.concatenate([unpack(d)[0] for d in runs[n].found]))))
                        runs[n].found = []
                if back:
                    yield _reply([c for c, _ in back], part, [d for _, d in back], [None] * len(back), [None] * len(back))
            if best:
                yield _reply([None] * len(best), part, [None] * len(best), list(best), list(best.values()))

        return run

    def pairs(self) -> DataFrame:
        """``a, b, n``: how many links of the corpus hold each pair of ids."""
        runs = self.encoded.filter("part is not null").select("part", "chunk", "pairs")
        return runs.groupBy("part").applyInArrow(self._merged(True), "a int, b int, n bigint")

    def documents(self) -> DataFrame:
        """One row per row of the input: the id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and ``groups`` if kept.

        ``n_best`` counts the links whose pair's count is the largest of their B id, ``count_sum`` adds up the counts.
        """
        runs = self.encoded.filter("part is not null")
        merged = materialize(runs.select("part", "chunk", "pairs").groupBy("part").applyInArrow(
            self._merged(False), "chunk bigint, part int, counts binary, b int, best bigint"), "pair-counts")
        most = np.full(self.b_ids, -1, dtype=np.int64)
        # One number per id of the vocabulary.
        found = merged.filter("b is not null").groupBy("b").agg(F.max("best").alias("best")).toArrow()
        most[found.column("b").to_numpy()] = found.column("best").to_numpy()
        largest = self.encoded.sparkSession.sparkContext.broadcast(most)
        back = merged.filter("chunk is not null").select("chunk", "part", "counts", F.lit(None).cast("binary").alias("holders"))
        parts = runs.select("chunk", "part", F.lit(None).cast("binary").alias("counts"), "holders").unionByName(back)
        rows = self.encoded.filter("place is not null").select("chunk", "place", "id", "n_a", "n_b", "n_groups", "n_links", "sha", "groups")
        done = rows.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(
            _add_up(largest), f"{self.schema}, n_best bigint, count_sum bigint")
        kept = ["groups"] if self.groups else []
        return done.select(F.col("id").alias(self.id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"), *kept)


def _reply(chunks, part, counts, sides, best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(chunks, pa.int64()), pa.array([part] * len(chunks), pa.int32()), pa.array(counts, pa.binary()), pa.array(sides, pa.int32()), pa.array(best, pa.int64())],
        names=["chunk", "part", "counts", "b", "best"])


def _encode(shared, layout: Layout, keep_groups: bool, chunk_links: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_json, b_model, by_unit = shared.value
        units = _units(a_json, b_model, layout.keys)
        chunk, ids, coded, digests, groups, links = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def encode(texts):
            """Places of the units of each text."""
            cut = [(UNIT_END.split(t) if by_unit else [t]) if t else [] for t in texts]
            flat = units.known(list(chain.from_iterable(cut)), by_unit)
            edges = [0, *accumulate(map(len, cut))]
            found = [flat[lo:hi] for lo, hi in zip(edges, edges[1:])]
            for n, own in enumerate(found):
                if by_unit and not all(map(units.groups.__getitem__, own)):
                    found[n] = units.known([texts[n]], False)
            return found

        def finished():
            sizes, keys = units.tables()
            flat = np.array([u for own in coded for u in own], dtype=np.int64)
            doc = np.repeat(np.arange(len(coded)), [len(own) for own in coded])
            totals = np.zeros((len(coded), 4), dtype=np.int64)
            np.add.at(totals, doc, sizes[flat])
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk] * len(coded), pa.int64()), pa.array(range(len(coded)), pa.int32()), pa.concat_arrays(ids),
                *[pa.array(totals[:, n]) for n in range(4)], pa.array(digests, pa.string()), pa.array(groups, pa.string()),
                pa.nulls(len(coded), pa.int32()), pa.nulls(len(coded), pa.binary()), pa.nulls(len(coded), pa.binary())], names=names)
            start, count = np.cumsum(sizes[:, 3]) - sizes[:, 3], sizes[flat, 3]
            place = np.repeat(start[flat] - (np.cumsum(count) - count), count)
            place += np.arange(len(place))
            links_of = keys[place]
            del place
            links_of |= np.repeat(doc.astype(np.uint64), count)
            for part, pairs, holders in build_runs(links_of, layout):
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, ids[0].type), *[pa.nulls(1, pa.int64())] * 4,
                    pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([part], pa.int32()), pa.array([pairs]), pa.array([holders])], names=names)

        names = ["chunk", "place", "id", "n_a", "n_b", "n_groups", "n_links", "sha", "groups", "part", "pairs", "holders"]
        for batch in batches:
            for part in slices(batch):
                for n, found in enumerate(encode(part.column(1).to_pylist())):
                    joined = b"".join(map(units.groups.__getitem__, found))[:-1]
                    ids.append(part.column(0).slice(n, 1))
                    coded.append(found)
                    digests.append(hashlib.sha256(joined).hexdigest() if joined else "")
                    groups.append(joined.decode() if keep_groups else None)
                    links += sum(map(units.counts.__getitem__, found))
                    if links >= chunk_links or len(coded) == 1 << layout.doc_bits:
                        yield from finished()
                        chunk, ids, coded, digests, groups, links = chunk + 1, [], [], [], [], 0
                if units.links >= STORE_LINKS:
                    if coded:
                        yield from finished()
                        chunk, ids, coded, digests, groups, links = chunk + 1, [], [], [], [], 0
                    units.clear()
        if coded:
            yield from finished()
        units.clear()

    return run


def _add_up(largest):
    def run(rows: pa.Table, parts: pa.Table) -> pa.Table:
        held, back = {}, {}
        for part, counts, holders in zip(*[parts.column(n).to_pylist() for n in ("part", "counts", "holders")]):
            (held if counts is None else back)[part] = holders if counts is None else counts
        sums = np.zeros((2, rows.num_rows), dtype=np.int64)
        for part, data in held.items():
            holders, sides, docs, times = unpack(data)
            counts = unpack(back[part])[0].astype(np.int64)
            best = counts == largest.value[np.cumsum(sides, dtype=np.uint32)]
            np.add.at(sums[0], docs, np.repeat(best, holders) * times.astype(np.int64))
            np.add.at(sums[1], docs, np.repeat(counts, holders) * times.astype(np.int64))
        place = rows.column("place").to_numpy()
        kept = rows.select(["id", "n_a", "n_b", "n_groups", "n_links", "sha", "groups"])
        return kept.append_column("n_best", pa.array(sums[0][place])).append_column("count_sum", pa.array(sums[1][place]))

    return run
