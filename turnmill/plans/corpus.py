"""From messages to a deduplicated, redacted corpus of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C, identity as I, text as T
from turnmill.operators.ordered import first_rows, ranked
from turnmill.sources.logs import MESSAGE_ORDER, message_chunks
from turnmill.session import materialize

SESSION = ["owner_id", "session_id"]
_FOLD, _FOLDS = 1024, 4


def dedupe_long(messages: DataFrame, min_chars: int = K.DEDUPE_MIN_CHARS) -> DataFrame:
    """Keep the first copy of every long text, in file and line order; short texts all stay.

    Repeated short texts are signal. Copies combine before the shuffle, so a text pasted a billion times moves once per
    map task.
    """
    long = F.length("text") >= min_chars
    keyed = messages.filter(long).withColumn("__hash", I.sha256(F.col("text")))
    first = first_rows(keyed, ["owner_id", "__hash"], ["file_path", *MESSAGE_ORDER]).drop("__hash")
    return messages.filter(~long).unionByName(first)


def redact_messages(messages: DataFrame) -> DataFrame:
    """Replace secrets and personal data; ``redacted`` tells whether the text changed."""
    cleaned = messages.withColumn("__clean", T.redact(F.col("text")))
    return cleaned.withColumns({"redacted": F.col("__clean") != F.col("text"), "text": F.col("__clean")}).drop("__clean")


def number_messages(messages: DataFrame) -> DataFrame:
    """Add ``ordinal``, the 0-based place of a message in its session."""
    return ranked(messages, SESSION, MESSAGE_ORDER, message_chunks(), "ordinal").withColumn(
        "ordinal", F.col("ordinal").cast("int"))


def mine(messages: DataFrame, dedupe: bool = True, redact: bool = True) -> DataFrame:
    """Deduplicate on the original text, then redact, then number what is left."""
    kept = dedupe_long(messages) if dedupe else messages
    kept = redact_messages(kept) if redact else kept.withColumn("redacted", F.lit(False))
    return number_messages(kept)


def corpus_stats(messages: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """Totals per owner over mined messages."""
    stats = messages.groupBy("owner_id").agg(
        F.countDistinct("session_id").alias("sessions"), F.count("*").alias("messages"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.count_if("redacted").alias("redactions"),
        F.coalesce(F.min(C.known(F.col("date"))), F.lit("")).alias("first_date"),
        F.coalesce(F.max(C.known(F.col("date"))), F.lit("")).alias("last_date"),
    ).withColumn("tokens", F.shiftright("chars", 2))
    return stats if duplicates is None else stats.join(duplicates, "owner_id", "left")


def count_duplicates(before: DataFrame, min_chars: int = K.DEDUPE_MIN_CHARS) -> DataFrame:
    """Long messages that repeat an earlier one, per owner."""
    long = before.filter(F.length("text") >= min_chars).groupBy("owner_id", I.sha256(F.col("text")).alias("h")).agg(
        F.count("*").alias("n"))
    return long.groupBy("owner_id").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def block_text() -> Column:
    return F.concat(F.lit("["), F.col("date"), F.lit("]\n"), F.col("text"))


def header_text() -> Column:
    return F.concat(F.lit("===== session:"), F.col("session_id"), F.lit(" source:"), F.col("source"), F.lit(" ====="))


def session_stats(messages: DataFrame) -> DataFrame:
    """Size and dates per session, without touching its text as a whole."""
    chars = F.length("text") + F.length("date") + 3
    return messages.groupBy(*SESSION, "source").agg(
        F.coalesce(F.min(C.known(F.col("date"))), F.lit(C.UNDATED)).alias("first_date"),
        F.coalesce(F.max(C.known(F.col("date"))), F.lit(C.UNDATED)).alias("last_date"),
        F.count("*").alias("message_count"), F.sum(chars.cast("bigint")).alias("block_chars"),
    ).withColumn("tokens", T.estimate_tokens(F.col("block_chars")))


def content_hashes(messages: DataFrame) -> DataFrame:
    """One hash per session over its messages in order, by one rule at every size.

    Each message is hashed with its date; digests are folded a thousand at a time, four times, and the header is hashed
    with what is left. No task sees more than a thousand digests of a session at once, and no row holds its text.
    """
    level = messages.select(*SESSION, "source", F.col("ordinal").cast("bigint").alias("ordinal"), I.sha256(block_text()).alias("digest"))
    for _ in range(_FOLDS):
        level = level.groupBy(*SESSION, "source", F.floor(F.col("ordinal") / _FOLD).alias("__up")).agg(
            F.sort_array(F.collect_list(F.struct("ordinal", "digest"))).alias("parts"))
        level = level.select(*SESSION, "source", F.col("__up").alias("ordinal"), I.sha256(
            F.array_join(F.transform("parts", lambda p: p["digest"]), "")).alias("digest"))
    return level.select(*SESSION, "source", I.sha256(F.concat_ws("\n", header_text(), F.col("digest"))).alias("content_hash"))


HASH_STATE = "level int, ordinal bigint, digest string"


def extend_hashes(messages: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Hashes of the sessions that have new messages, as ``content_hashes`` gives them for all of their messages.

    ``messages`` are the new ones, numbered on from those before without gaps. ``stored`` is what an earlier call returned
    beside the hashes: per session and level of the fold the digests whose thousand is not full yet, at most a few thousand
    short rows however long the session. Of a session with an append only these are read and its new messages hashed; other
    sessions' rows pass through. Returns the hashes and the rows to store.
    """
    key = [*SESSION, "source"]
    new = messages.select(*key, F.lit(0).alias("level"), F.col("ordinal").cast("bigint").alias("ordinal"), I.sha256(block_text()).alias("digest"))
    new = materialize(new, "digests")
    changed = new.select(*key).distinct()
    held = new.limit(0) if stored is None else materialize(stored.join(changed, key, "left_semi"), "open-digests")
    rows = new.drop("level").withColumn("full", F.lit(True))
    kept = new.limit(0) if stored is None else stored.join(changed, key, "left_anti").select(*new.columns)
    for level in range(_FOLDS):
        before = held.filter(F.col("level") == level).select(*key, "ordinal", "digest", F.lit(True).alias("full"))
        rows = rows.unionByName(before).withColumn("up", F.floor(F.col("ordinal") / _FOLD))
        folded = rows.groupBy(*key, "up").agg(F.sort_array(F.collect_list(F.struct("ordinal", "digest"))).alias("parts"), F.bool_and("full").alias("full"))
        # A node is full when all its children are there and full themselves; it never changes again.
        folded = folded.select(*key, "up", (F.col("full") & (F.size("parts") == _FOLD)).alias("full"), I.sha256(
            F.array_join(F.transform("parts", lambda p: p["digest"]), "")).alias("digest"))
        folded = materialize(folded, "folded")
        opened = folded.filter("not full").select(*key, "up")
        kept = kept.unionByName(rows.filter("full").join(opened, [*key, "up"], "left_semi").select(*key, F.lit(level).alias("level"), "ordinal", "digest"))
        rows = folded.withColumnRenamed("up", "ordinal").select(*key, "ordinal", "digest", "full")
    hashes = rows.select(*key, I.sha256(F.concat_ws("\n", header_text(), F.col("digest"))).alias("content_hash"))
    return hashes, materialize(kept, "open-digests")


def roll_up(messages: DataFrame) -> DataFrame:
    """One row per session: size, dates and the hash of its content. Its text stays in the messages.

    ``messages`` are numbered; write them first, as they are read twice here.
    """
    return session_stats(messages).join(content_hashes(messages), [*SESSION, "source"])
