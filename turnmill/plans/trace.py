"""Quoted spans of a profile, traced to the sessions that contain them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnmill import constants as K
from turnmill.functions import text as T
from turnmill.operators.ordered import first_rows, integer_chunks, running
from turnmill.operators.prints import stretches
from turnmill.session import materialize

#: Characters of needles' heads that one pass over the texts looks for, and of a head; the rest is compared where a head is met.
SHARD_CHARS, HEAD_CHARS = 2_000_000, 32
#: Passes over the texts with automata; with more needles than they hold, texts are searched by prints of characters instead.
MOST_PASSES = 2
WINDOW_CHARS = 8192


def _curly(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.CURLY_QUOTE), 1)


def _straight(text: Column) -> Column:
    """Pairs of straight marks per line, left to right; an odd last mark pairs with nothing."""
    rest = F.regexp_replace(text, K.CURLY_QUOTE, " ")

    def inside(parts):
        return F.filter(parts, lambda _, i: (i % 2 == 1) & (i <= F.size(parts) - 2))

    # Split first and filter the bound array, so that no line is split once per part.
    split = F.transform(F.split(rest, "\n"), lambda line: F.split(line, '"'))
    return F.flatten(F.transform(split, inside))


def extract_quotes(profiles: DataFrame, min_words: int = K.TRACE_MIN_WORDS) -> DataFrame:
    """Every quoted span long enough to be a receipt, first spelling per normal form.

    ``profiles``: owner_id, profile_id, text.
    """
    spans = profiles.select(
        "owner_id", "profile_id", F.posexplode(F.concat(_curly(F.col("text")), _straight(F.col("text")))).alias("place", "raw"))
    quote = T.strip(F.col("raw"))
    opened = F.col("quote").rlike(r"^[\p{L}\p{N}'’]")
    plain = ~F.col("quote").contains("**") & ~F.col("quote").contains("`")
    kept = spans.withColumn("quote", quote).filter(
        (T.word_count(F.col("quote")) >= min_words) & opened & plain).withColumn("needle", T.quote_form(F.col("quote")))
    kept = kept.filter("needle != ''").drop("raw")
    return first_rows(kept, ["owner_id", "profile_id", "needle"], ["place"])


_BUILT: dict[str, tuple] = {}


def _automaton(shard: str, needles: list[tuple[str, str]]) -> tuple:
    """The heads of a shard's needles as an Aho-Corasick automaton, each with the needles that begin so and their owners.

    A Python worker keeps its last one.
    """
    if shard not in _BUILT:
        import ahocorasick

        begun: dict[str, dict[str, set[str]]] = {}
        for owner, needle in needles:
            begun.setdefault(needle[:HEAD_CHARS], {}).setdefault(needle, set()).add(owner)
        found = ahocorasick.Automaton()
        for head, own in begun.items():
            found.add_word(head, (len(head), list(own.items())))
        found.make_automaton()
        _BUILT.clear()
        _BUILT[shard] = found
    return _BUILT[shard]


def _search(shard: str, shared):
    """Over owner_id, key columns, haystack: the owner, the key and each needle of the owner that the text contains."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shard, shared.value)
        for batch in batches:
            rows, needles = [], []
            for n, (owner, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1))):
                text = value.as_py() or ""
                met = {needle for end, (size, begun) in automaton.iter(text) for needle, owners in begun
                       if owner in owners and text.startswith(needle, end - size + 1)}
                rows += [n] * len(met)
                needles += met
            if rows:
                at = pa.array(rows, pa.int64())
                kept = [batch.column(c).take(at) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(needles, pa.string())], names=[*batch.schema.names[:-1], "needle"])

    return run


def find_spans(needles: DataFrame, texts: DataFrame, key: list[str], shard_chars: int = SHARD_CHARS, most_passes: int = MOST_PASSES) -> DataFrame:
    """``owner_id``, ``key``, ``needle``: once for each text that contains a needle of its owner.

    ``needles``: owner_id, needle. ``texts``: owner_id, ``key`` columns, haystack. Both in ``quote_form``; empty needles
    match nothing. Without ``key`` a needle comes once or more for each owner. Needles are cut into shards of ``shard_chars``;
    for each an automaton is sent out and every text is read once, where it lies. Where that would take more than
    ``most_passes`` passes, stretches of the texts whose prints are those of needles are joined with these by equality.
    """
    spark = texts.sparkSession
    known = materialize(needles.filter("needle != ''").select("owner_id", "needle").distinct(), "needles")
    # What goes out counts as well, at an eighth: automata take more room than texts.
    chars = known.agg(F.sum(F.least(F.length("needle"), F.lit(HEAD_CHARS)) + F.floor(F.length("needle") / 8)).alias("n")).first()["n"] or 0
    passes = -(-chars // shard_chars)
    if passes > most_passes:
        return stretches(known, texts, key).join(known, ["owner_id", "needle"], "left_semi").select("owner_id", *key, "needle")
    schema = StructType([*[texts.schema[c] for c in ("owner_id", *key)], StructField("needle", StringType())])
    found = texts.select("owner_id", *key, F.lit("").alias("needle")).limit(0)
    if passes > 1:
        texts = materialize(texts.select("owner_id", *key, "haystack"), "haystacks")
    for n in range(passes):
        rows = known.filter(F.pmod(F.xxhash64("owner_id", "needle"), F.lit(passes)) == n).toArrow()
        # Needles of one owner share its name.
        owners = rows.column("owner_id").combine_chunks().dictionary_encode()
        owners = owners.combine_chunks() if isinstance(owners, pa.ChunkedArray) else owners
        named = list(map(owners.dictionary.to_pylist().__getitem__, owners.indices.to_pylist()))
        shared = spark.sparkContext.broadcast(list(zip(named, rows.column("needle").to_pylist())))
        found = found.unionByName(texts.select("owner_id", *key, "haystack").mapInArrow(_search(uuid.uuid4().hex, shared), schema))
    return found


def border_windows(messages: DataFrame, reach: int, window_chars: int = WINDOW_CHARS) -> DataFrame:
    """``owner_id, session_id, haystack``: the text around the borders of a session's messages, in overlapping windows.

    ``messages``: owner_id, session_id, ordinal (a whole number that orders a session), haystack. Any stretch of at most
    ``reach`` characters that crosses a border lies whole in one window. Of a long message only both ends are kept, apart
    from each other, so a window is of bounded size and a session of any length is as many windows as its borders need.
    """
    apart = F.concat(F.left("haystack", F.lit(reach)), F.lit("\n"), F.right("haystack", F.lit(reach)))
    pieces = messages.select("owner_id", "session_id", "ordinal", F.when(
        F.length("haystack") > 2 * reach, apart).otherwise(F.col("haystack")).alias("piece"))
    placed = running(materialize(pieces, "pieces"), ["owner_id", "session_id"], ["ordinal"], integer_chunks("ordinal"),
                     sums={"start": (F.length("piece") + 1).cast("bigint")})
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("start") - reach) / window_chars))
    last = F.floor((F.col("start") + F.length("piece")) / window_chars)
    dealt = placed.withColumn("window", F.explode(F.sequence(first, last)))
    grouped = dealt.groupBy("owner_id", "session_id", "window").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("pieces"))
    return grouped.filter(F.size("pieces") > 1).select(
        "owner_id", "session_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), " ").alias("haystack"))


def trace(quotes: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per quote and session that contains it, its messages following each other with their dates.

    ``messages``: owner_id, session_id, ordinal, date, text.
    """
    shown = F.concat(F.lit("["), F.col("date"), F.lit("] "), F.col("text"))
    texts = materialize(messages.select("owner_id", "session_id", "ordinal", T.quote_form(shown).alias("haystack")), "haystacks")
    reach = quotes.agg(F.max(F.length("needle")).alias("n")).first()["n"] or 1
    searched = texts.drop("ordinal").unionByName(border_windows(texts, reach, max(WINDOW_CHARS, 4 * reach)))
    found = find_spans(quotes, searched, ["session_id"]).select("owner_id", "needle", "session_id").distinct()
    return quotes.join(found, ["owner_id", "needle"])


def trace_results(quotes: DataFrame, traced: DataFrame) -> DataFrame:
    """Per quote, in how many sessions it stands. ``traced`` may leave out profile_id; it then has a row for each needle and session."""
    key = [c for c in ("owner_id", "profile_id", "needle") if c in traced.columns]
    counts = traced.groupBy(*key).agg(F.countDistinct("session_id").alias("sessions"))
    return quotes.join(counts, key, "left").fillna(0, ["sessions"]).withColumn(
        "supported", F.col("sessions") > 0)


def trace_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("owner_id", "profile_id").agg(
        F.count("*").alias("quotes_checked"), F.count_if(F.col("sessions") == 0).alias("unsupported"),
        F.count_if(F.col("sessions") == 1).alias("single_session"))
