"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source has a target in words. Its documents are cut into blocks, and blocks are drawn in a keyed random order, pass
after pass, until the target is met; the number of drawn blocks is the source's quota. A tree then splits all quotas
among the output shards: each node holds the quotas of its shards, and draws how many blocks of each source its left half
gets, so that every shard's composition is distributed as if all drawn blocks were shuffled together, while the quotas
stay exact. The drawn blocks of a source, in their random order, are dealt to the shards by those counts, each block once,
and every shard is shuffled locally. Nothing is sorted as a whole.

Draws of the tree are exact inversions of the hypergeometric distribution from its mode outwards, computed with folds over
sequences. Sources are hashed into at most ``GROUPS`` quota groups where there are more of them than that; within a group
the common random order deals sources out with the right distribution, so the arrays of the tree have a fixed bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnmill.llm.arrays import numbered_copies
from turnmill.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
GROUPS = 1024
BUCKET_BITS = 12
SHARD_BLOCKS = 1 << 15
KEY = ["id", "source", "size", "mark", "copy"]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target, place``: words each source gives. ``sizes``: source, size (one row per document).

    Sources by code point, null last, weigh ``weights`` in turn. Together they share ``share`` times all words; no target
    exceeds ``most`` times its source, and what is above is shared by weight among the others until none is above. There
    is one row per source here, not per document, so the running sums over sources are one small window.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
             ) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level)
    # The first source in this order that is not filled up sets the level for itself and all after it.
    below = F.col("level") < F.col("cap") / F.col("weight")
    first = F.min(F.when(below, F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)
    return levelled.withColumn("free", first["level"]).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("free") * F.col("weight"), F.col("cap"))).alias("target"), "place")


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _span(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(population: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``marked`` among ``population`` are found in ``draws`` draws: the value at ``uniform`` in [0, 1)."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def draw(v):
        n, k, d, u = v["n"], v["k"], v["d"], v["u"]
        rest = n - k - d
        lowest, highest = F.greatest(zero, -rest), F.least(k, d)
        share = k / n
        spread = F.sqrt(d * share * (1 - share) * (n - d) / F.greatest(n - 1, one))
        reach = F.ceil(spread * 10).cast("bigint") + 10

        def from_mode(mode):
            up = _span(mode, F.least(highest, mode + reach) - 1)
            down = F.reverse(_span(F.greatest(lowest, mode - reach) + 1, mode))
            rise = lambda x: (k - x) * (d - x) / ((x + 1) * (rest + x + 1).cast("double"))
            fall = lambda x: x * (rest + x) / ((k - x + 1) * (d - x + 1).cast("double"))

            def total(steps, ratio):
                return F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), lambda s, x: _let(
                    s["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))), lambda s: s["sum"])

            def find(steps, ratio, step, start, above):
                begin = F.struct(F.lit(1.0).alias("w"), above.alias("left"), start.alias("at"))
                return F.aggregate(steps, begin, lambda s, x: F.when(s["left"] < 0, s).otherwise(_let(
                    s["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (s["left"] - w).alias("left"), (x + step).alias("at")))),
                    lambda s: s["at"])

            def pick(sums):
                level = u * (1 + sums["up"] + sums["down"])
                return F.when(level < 1 + sums["up"], find(up, rise, 1, mode, level - 1)).otherwise(
                    find(down, fall, -1, mode, level - 1 - sums["up"]))

            return _let(F.struct(total(up, rise).alias("up"), total(down, fall).alias("down")), pick)

        mode = F.greatest(lowest, F.least(highest, F.floor((d + 1) * ((k + 1) / (n + 2))).cast("bigint")))
        return F.when(lowest == highest, lowest).otherwise(_let(mode, from_mode))

    packed = F.struct(population.alias("n"), marked.alias("k"), draws.alias("d"), uniform.alias("u"))
    return _let(packed, draw)


def uniform(*parts) -> Column:
    """A keyed number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def shard_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """``shard, group, start, blocks``: the drawn blocks of each group, dealt to 2^levels shards in order.

    ``quotas``: one row with an array ``quota`` of at most GROUPS counts. Every level halves each node's shards.
    """
    nodes = quotas.select(F.lit(0).cast("bigint").alias("node"), "quota")
    for level in range(levels):
        def left(node, quota, level=level):
            whole = F.aggregate(quota, F.lit(0).cast("bigint"), lambda a, q: a + q)
            begin = F.struct(whole.alias("n"), F.floor(whole / 2).alias("d"), F.array().cast("array<bigint>").alias("out"))

            def step(state, q):
                u = uniform(F.lit(seed), F.lit(level), node, F.size(state["out"]))
                return _let(hypergeometric(state["n"], q, state["d"], u), lambda x: F.struct(
                    (state["n"] - q).alias("n"), (state["d"] - x).alias("d"), F.concat(state["out"], F.array(x)).alias("out")))

            return F.aggregate(quota, begin, step, lambda s: s["out"])

        split = nodes.withColumn("taken", left(F.col("node"), F.col("quota")))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("taken").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quota", "taken", lambda q, t: q - t).alias("quota")))
        nodes = split.select(F.inline(halves))
        if level % 4 == 3:
            nodes = nodes.repartition("node")
    dealt = nodes.select(F.col("node").alias("shard"), F.posexplode("quota").alias("group", "blocks")).filter("blocks > 0")
    before = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("start", F.coalesce(F.sum("blocks").over(before), F.lit(0).cast("bigint")))


def _before(rows: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before in the keyed order of a group, which is cut by leading bits."""
    first = F.shiftrightunsigned("draw", 64 - BUCKET_BITS).alias("bucket")
    keyed = rows.withColumn("bucket", first).withColumn("value", value)
    inside = Window.partitionBy(group, "bucket").orderBy("draw", *KEY, "block", "pass").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(group, "bucket").agg(F.sum("value").alias("value"))
    along = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("g"), F.col("bucket").alias("b"), F.coalesce(F.sum("value").over(along), F.lit(0)).alias("offset"))
    local = keyed.withColumn(name, F.coalesce(F.sum("value").over(inside), F.lit(0)))
    return local.join(offsets, F.col(group).eqNullSafe(F.col("g")) & (F.col("bucket") == F.col("b"))).withColumn(
        name, F.col(name) + F.col("offset")).drop("g", "b", "offset", "bucket", "value")


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The documents as id, source, size in words, and a mark of the text; repeated rows are numbered in ``copy``."""
    narrow = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    copies = narrow.groupBy("id", "source", "size", "mark").agg(F.count("*").alias("n"))
    return materialize(numbered_copies(copies, "n", "copy").drop("n"), "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block_words: int | None = 128,
        shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables: documents, targets, drawn blocks.

    Documents: id, source, size, mark, copy. Targets: source, source_size, target, place. Blocks: the key of a document,
    block (number in the document), pass (0 for its first use), words, shard, place (order in the shard). A block has at
    most ``block_words`` words of one document, or the whole document with None; the last block of a source is taken when
    at least half of it lies under the target. Documents without words give no block. All draws are keyed by ``seed`` and
    the rows themselves, so reruns agree. Null ids, sources and texts are values like others (a null text is empty).
    """
    sizes = document_sizes(docs, id_col, text_col, source_col)
    targets = materialize(source_targets(sizes, weights, share, most), "targets")
    full = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0).cast("bigint"))
    plan = targets.select(
        F.col("source").alias("s"), full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("rest"),
        (F.pmod(F.col("place") - 1, F.lit(GROUPS))).cast("int").alias("group"))
    planned = sizes.filter("size > 0").join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = F.col("size") if block_words is None else F.lit(block_words).cast("bigint")
    blocks = planned.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / per)))).withColumn(
        "words", F.least(per, F.col("size") - F.col("block") * per))
    uses = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.least(F.col("full"), F.lit(most - 1)).cast("int")))).withColumn(
        "draw", F.xxhash64(F.lit(seed), *KEY, "block", "pass"))
    part = _before(uses.filter(F.col("pass") == F.col("full")), "source", F.col("words"), "reached")
    part = part.filter(F.col("reached") + F.col("words") / 2 <= F.col("rest")).drop("reached")
    drawn = materialize(uses.filter(F.col("pass") < F.col("full")).unionByName(part), "drawn")

    quotas = drawn.groupBy("group").agg(F.count("*").alias("n"))
    row = quotas.agg(F.map_from_entries(F.collect_list(F.struct("group", "n"))).alias("n"), F.max("group").alias("last"), F.sum("n").alias("all"))
    row = row.filter("`all` > 0").select("all", F.transform(F.sequence(F.lit(0), F.col("last")), lambda g: F.coalesce(
        F.element_at("n", g), F.lit(0)).cast("bigint")).alias("quota"))
    found = row.select("all").first()
    levels = (max(1, -(-found["all"] // shard_blocks)) - 1).bit_length() if found else 0
    dealt = shard_quotas(row, levels, seed)
    places = dealt.select("shard", "group", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1)).alias("at"))
    ordered = _before(drawn, "group", F.lit(1), "at")
    # There is a place for every drawn block; Spark sees only the few rows they unfold from and would broadcast them.
    placed = ordered.join(places.hint("merge"), ["group", "at"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "draw"), *KEY, "block", "pass")
    shuffled = placed.withColumn("place", F.row_number().over(local))
    return sizes, targets, shuffled.select(*KEY, "block", "pass", "words", "shard", "place")


def documents_taken(sizes: DataFrame, targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, shards (those that hold a block of it)."""
    taken = blocks.groupBy(*KEY).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    full = sizes.join(taken.withColumnsRenamed({c: f"t_{c}" for c in KEY}), [sizes[c].eqNullSafe(F.col(f"t_{c}")) for c in KEY], "left")
    named = full.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return named.select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of ``docs``, whole documents, one row per use; columns as in ``docs``.

    Where rows agree in id, source and text but not in other columns, each use carries one of them.
    """
    sizes, _, blocks = mix(docs, id_col, text_col, source_col, block_words=None, **options)
    uses = blocks.groupBy("id", "source", "mark").agg(F.count("*").alias("uses"))
    repeated = sizes.filter("copy > 1").select("id", "source", "mark").distinct()

    def match(rows, keys):
        """Rows of documents with the keys they agree in."""
        keys = keys.withColumnsRenamed({c: f"__{c}" for c in keys.columns})
        return keys, [rows[id_col].eqNullSafe(F.col("__id")), rows[source_col].eqNullSafe(F.col("__source")),
                      F.xxhash64(F.coalesce(rows[text_col], F.lit(""))) == F.col("__mark")]

    once = docs.join(*match(docs, repeated), "left_anti")
    several = docs.join(*match(docs, repeated), "left_semi").withColumn("__m", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    whole = once.unionByName(several.dropDuplicates([id_col, source_col, "__m"]).drop("__m"))
    return numbered_copies(whole.join(*match(whole, uses)), "__uses", "__use").select(*docs.columns)
