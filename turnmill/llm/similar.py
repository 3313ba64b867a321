"""Near-duplicates whose word shingles are as similar as asked for (Jaccard), found by two searches and confirmed exactly.

One search is covering locality-sensitive hashing of SimHash fingerprints, sure within its radius. SimHash tells apart
little at a similarity of 0.8, where about ten of 64 bits differ; the other search cuts ROWS * BANDS minima of seeded hashes
into bands, and texts of similarity s share a band with a chance of 1 - (1 - s^ROWS)^BANDS, 0.998 at 0.8. Texts that share
a band are compared with two of them, drawn anew for each band, so a group of n texts costs 2 n comparisons a band and
all pairs of up to three are met. Only pairs whose sets of shingle hashes reach the similarity are linked.

What both searches leave out is found by a third one, which is exact. Shingles are ordered, rare ones first. If a text of n
shingles is as similar to another as asked for, they share one among the first n - ceil(least * n) + 1 of each, and from the
first they share on enough are left in both. Texts that are linked already are not compared again.

A pair is first judged by two prints, which hold the parity of how many shingles fall into each of SKETCH_BITS cells, or more
for long texts. Each cell where they differ is a shingle that only one text has, so a pair with too many such cells is not similar
enough, whatever the shingles are. Only for pairs that pass are whole sets of shingles sent and compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.llm.arrays import free_names, slices
from turnmill.llm.covering import near_links, shingle_hashes, simhash
from turnmill.llm.graph import components
from turnmill.session import materialize

BANDS, ROWS = 16, 5
#: Shingles are ordered by how many fall into each of 2^CELL_BITS cells; bounds leave some room for rounding.
CELL_BITS, SLACK = 18, 1e-6
SKETCH_BITS = 2048
#: Pairs of sketches compared at once in a task.
SKETCH_ROWS = 1 << 12
_DRAWN = np.random.default_rng(11).integers(0, 1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
FACTORS, MASKS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a text without words has one of its own."""
    parts = list(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, dtype=np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key per band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        mixed = hashes[at:at + 512, None] ^ MASKS
        mixed *= FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= FACTORS
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the number of shingles in each cell; texts of more shingles than cells have as many more, a power of two."""
    cells = max(SKETCH_BITS, 1 << (len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _may_be(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Whether the sketches leave the similarity possible. ``sizes``: of both texts together."""
    lengths = np.array([[len(a), len(b)] for a, b in zip(left, right)]).reshape(-1, 2)
    apart = np.zeros(len(left), dtype=np.int64)
    for pair in np.unique(lengths, axis=0):
        rows, bits = np.flatnonzero((lengths == pair).all(axis=1)), []
        for side in (left, right):
            bits.append(np.frombuffer(b"".join(side[rows]), np.uint64).reshape(len(rows), -1))
            # Cells go by the lowest bits of hashes, so the halves of a longer sketch make one of half as many cells.
            while bits[-1].shape[1] * 8 > pair.min():
                half = bits[-1].shape[1] // 2
                bits[-1] = bits[-1][:, :half] ^ bits[-1][:, half:]
        apart[rows] = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
    return apart <= (1 - least) / (1 + least) * sizes + SLACK


def node_of(text: Column) -> Column:
    """What stands for a text; equal texts are one node."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs ``a, b`` worth comparing. ``nodes``: node, fp, bands."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    drawn = F.struct(F.xxhash64("node", "key").alias("h"), "node")
    ends = keyed.groupBy("key").agg(F.min(drawn).alias("low"), F.max(drawn).alias("high")).filter("low.node != high.node")
    met = keyed.join(ends, "key").select("node", F.explode(F.array("low.node", "high.node")).alias("other"))
    leads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    same = nodes.join(leads, "fp").select("node", F.col("lead").alias("other"))
    ends_of = [leads.select(F.col("fp").alias(c), F.col("lead").alias(n)) for c, n in (("a", "node"), ("b", "other"))]
    near = near_links(leads.select("fp"), radius).join(ends_of[0], "a").join(ends_of[1], "b").select("node", "other")
    every = met.unionByName(same).unionByName(near).filter("node != other")
    return every.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


_PRINTS = pa.schema([("id", pa.null()), ("node", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("size", pa.int32()),
                     ("sketch", pa.binary()), ("cells", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _first_shingles(width: int, least: float, levels: np.ndarray):
    """Over node, root, text: the shingles that a similar text shares one of, with the text's size and their places in its order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                nodes, roots, tokens, sizes = part.column(0).to_numpy(), part.column(1).to_numpy(), [], []
                for text in part.column(2).to_pylist():
                    hashes = shingles(text, width)
                    level = levels[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    first = len(hashes) - int(np.ceil(least * len(hashes) - SLACK)) + 1
                    tokens.append(hashes[np.argsort(level, kind="stable")[:first]])
                    sizes.append(len(hashes))
                taken = [len(t) for t in tokens]
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in taken])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(nodes, taken)), pa.array(np.repeat(roots, taken)),
                     pa.array(np.repeat(np.array(sizes, dtype=np.int32), taken)), pa.array(places)], names=["token", "node", "root", "size", "place"])

    return run


def _whole_tokens(found):
    """Over rows sorted by their first column: what ``found`` yields for their columns, a token's rows never parted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if held and (last or held[0][0][0] != columns[0][0]):
                yield from found(*[np.concatenate(c) for c in zip(*held, [c[:last] for c in columns])])
                held = []
            elif last:
                yield from found(*[c[:last] for c in columns])
            held.append([c[last:].copy() for c in columns])
        if held:
            yield from found(*[np.concatenate(c) for c in zip(*held)])

    return run


def _reach(size: np.ndarray, place: np.ndarray, least: float) -> np.ndarray:
    """The largest size of a text that can be similar to one of ``size``, if the first shingle they share is at ``place`` in it."""
    return np.minimum((size + SLACK) / least, (size - place + SLACK) * (1 + least) / least - size)


def _meeting(least: float):
    """Over rows sorted by token and size: those that may be similar to one of another root with their token."""
    def found(token, node, root, size, place):
        rows = np.arange(len(token))
        fresh = np.r_[True, token[1:] != token[:-1]]
        starts = np.flatnonzero(fresh | np.r_[True, root[1:] != root[:-1]])
        run = np.searchsorted(starts, rows, "right") - 1
        before, after = starts[run] - 1, np.r_[starts[1:], len(rows)][run]
        # Sizes grow, so if the nearest of another root on one side is too far off, all on that side are.
        smaller = (before >= 0) & (token[before] == token) & (size[before] >= least * size - SLACK)
        inside, after = after < len(rows), np.minimum(after, len(rows) - 1)
        larger = inside & (token[after] == token) & (size[after] <= _reach(size, place, least))
        on = smaller | larger
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (token, node, root, size, place)],
                                             names=["token", "node", "root", "size", "place"])

    return _whole_tokens(found)


def _sharing(least: float):
    """Over rows sorted by token and size: pairs of nodes of different roots that share a token and may be similar by their sketches."""
    def pairs(token, node, root, size, place, sketches):
        at, step, reach = np.arange(len(token)), 1, _reach(size, place, least)
        while len(at):
            at = at[at + step < len(token)]
            other = at + step
            # Sizes grow, so what is too large now ends the search from here.
            on = (token[at] == token[other]) & (size[other] <= reach[at])
            at, other = at[on], other[on]
            met = np.flatnonzero((root[at] != root[other]) & (size[at] <= reach[other]))
            for part in (met[i:i + SKETCH_ROWS] for i in range(0, len(met), SKETCH_ROWS)):
                left, right = at[part], other[part]
                near = _may_be(sketches[left], sketches[right], size[left] + size[right], least)
                if near.any():
                    a, b = node[left[near]], node[right[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            step += 1

    return _whole_tokens(pairs)


def missed(nodes: DataFrame, cells: DataFrame, prints: DataFrame, width: int, least: float) -> DataFrame:
    """All pairs ``a, b`` of different roots that may reach the similarity, by their sketches too.

    ``nodes``: node, root, text, one row per node. ``cells``: cell, n, how many shingles, counted per text, fall into each.
    ``prints``: node, size, sketch, one row per node. Sketches are sent with the tokens that texts of several roots share,
    so that pairs are judged where they meet, and only those that pass become rows.
    """
    counted = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    # The order only has to be the same for all texts; a rough one, of a byte per cell, meets few pairs in vain.
    levels = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    levels[counted.column("cell").to_numpy()] = np.minimum(255, np.log2(counted.column("n").to_numpy()) * 8).astype(np.uint8)
    posted = nodes.select("node", "root", "text").mapInArrow(
        _first_shingles(width, least, levels), "token bigint, node bigint, root bigint, size int, place int")
    sorted_by_token = posted.repartition("token").sortWithinPartitions("token", "size")
    met = materialize(sorted_by_token.mapInArrow(_meeting(least), "token bigint, node bigint, root bigint, size int, place int"), "met")
    judged = met.join(prints.select("node", "sketch"), "node").select("token", "node", "root", "size", "place", "sketch")
    judged = judged.repartition("token").sortWithinPartitions("token", "size")
    return judged.mapInArrow(_sharing(least), "a bigint, b bigint").distinct()


def possible(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` whose sketches do not rule the similarity out. ``prints``: node, size, sketch, one row per node."""
    @F.arrow_udf("boolean")
    def may_be(left: pa.Array, right: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array(_may_be(*(x.to_numpy(zero_copy_only=False) for x in (left, right, sizes)), least))

    left, right = (prints.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("sketch").alias(f"{n}_sketch")) for n in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").filter(may_be("a_sketch", "b_sketch", F.col("a_size") + F.col("b_size"))).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The ``pairs``, written already, whose shingle sets have at least that similarity. ``texts``: node, text, one row per node."""
    @F.arrow_udf("binary")
    def packed(values: pa.Array) -> pa.Array:
        return pa.array([shingles(t, width).tobytes() for part in slices(values) for t in part.to_pylist()], pa.binary())

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(slices(left), slices(right)):
            for a, b in zip(x.to_pylist(), y.to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(both >= least * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(texts.join(wanted, "node", "left_semi").select("node", packed("text").alias("hashes")), "shingles")
    left, right = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_hashes")) for n in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").filter(alike("a_hashes", "b_hashes")).select("a", "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, radius: int = 6) -> DataFrame:
    """``id_col, node, component_id`` for every row: its text's node and the smallest id it is linked to, itself included.

    Links carry on through further rows. Texts without words are alike. A null id is never the smallest one.
    """
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text, and in the end one of how many shingles fell into each cell."""
        counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
        kinds = None
        for batch in batches:
            for part in slices(batch):
                fps, keys, sizes, sketches = [], [], [], []
                for text in part.column(2).to_pylist():
                    hashes = shingles(text, width)
                    fps.append(simhash(text, width))
                    keys.append(bands(hashes))
                    sizes.append(len(hashes))
                    sketches.append(sketch(hashes))
                    np.add.at(counts, (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
                kinds = _PRINTS.set(0, pa.field("id", part.column(0).type))
                values = [part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32()),
                          pa.array(sketches, pa.binary()), *(pa.nulls(len(fps), f.type) for f in list(_PRINTS)[6:])]
                yield pa.RecordBatch.from_arrays(values, schema=kinds)
        if kinds is not None:
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(kinds)[:6]), pa.array([held.tolist()], pa.list_(pa.int32())),
                                              pa.array([counts[held].tolist()], pa.list_(pa.int64()))], schema=kinds)

    named = docs.select(F.col(id_col).alias("id"), node_of(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    read = materialize(named.mapInArrow(
        prints, f"id {kind}, node bigint, fp bigint, bands array<bigint>, size int, sketch binary, cells array<int>, counts array<bigint>"), "prints")
    known = read.filter("cells is null")
    cells = read.filter("cells is not null").select(F.explode(F.arrays_zip("cells", "counts")).alias("c")).select(
        F.col("c.cells").alias("cell"), F.col("c.counts").alias("n"))
    nodes = known.select("node", "fp", "bands").dropDuplicates(["node"])
    sketches = known.select("node", "size", "sketch").dropDuplicates(["node"])
    pairs = materialize(candidates(nodes, radius), "pairs")
    # Texts are long, so only those of several rows are gathered; the others are read where they lie.
    repeated = materialize(known.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"), "repeated")
    several = named.join(repeated, "node", "left_semi").select("node", "text").dropDuplicates(["node"])
    texts = named.join(repeated, "node", "left_anti").select("node", "text").unionByName(several)
    links = materialize(confirmed(materialize(possible(pairs, sketches, least), "possible"), texts, width, least), "similar")
    roots = materialize(components(links), "roots")
    rooted = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = materialize(confirmed(materialize(missed(rooted, cells, sketches, width, least), "possible"), texts, width, least), "similar")
    if not more.isEmpty():
        roots = materialize(components(links.unionByName(more)), "roots")
    firsts = known.groupBy("node").agg(F.min("id").alias("first_id"))
    placed = materialize(firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return known.select("id", "node").join(placed.join(smallest, "root").select("node", "component_id"), "node").select(
        F.col("id").alias(id_col), "node", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, radius: int = 6) -> DataFrame:
    """The rows of ``docs`` that stay: of each component, one row of its smallest id. All columns are kept.

    Rows with a null id stay, as nothing names them. Where an id is repeated, its rows are told apart by their text.
    """
    node, = free_names(docs, "node")
    seen = materialize(classes(docs, id_col, text_col, width, least, radius), "near-classes")
    stay = seen.filter(F.col(id_col) == F.col("component_id"))
    repeated = materialize(seen.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(id_col), "repeated")
    # Fewer go than stay, and a short list of them leaves texts where they lie.
    gone = materialize(seen.filter(F.col(id_col) != F.col("component_id")).select(id_col).unionByName(repeated).distinct(), "gone")
    single = docs.filter(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti")
    several = docs.join(repeated, id_col, "left_semi").withColumn(node, node_of(F.col(text_col))).join(
        stay.select(id_col, F.col("node").alias(node)).distinct(), [id_col, node], "left_semi").dropDuplicates([id_col, node])
    unnamed = docs.filter(F.col(id_col).isNull())
    return single.unionByName(several.select(*docs.columns)).unionByName(unnamed)
