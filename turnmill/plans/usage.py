"""Usage report: where a person repeats, rewords, restates or corrects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C, identity as I, markers as M, text as T
from turnmill.operators.ordered import first_rows, integer_chunks, previous, ranked, runs, top_rows

SESSION = ["owner_id", "session_id"]
ORDER = ["neg_count", "date", "session_id", "ordinal"]
_RECEIPTS = ("array<struct<neg_count:bigint,date:string,session_id:string,ordinal:int,source:string,text:string,"
             "marker:string,count:bigint>>")


def _prepared(messages: DataFrame) -> DataFrame:
    """Normal form and word set per message; the text itself shrinks to its excerpt."""
    normal, words = T.usage_form(F.col("text")), T.usage_words(F.col("text"))
    base = messages.select(
        *SESSION, "source", "date", "ordinal", normal.alias("normal"), words.alias("words"),
        T.line_breaks(F.col("text")).alias("breaks"), T.excerpt(F.col("text")).alias("quote"), "text")
    comparable = (F.size("words") >= K.REWORD_MIN_WORDS) & (F.col("breaks") <= K.REWORD_MAX_LINE_BREAKS)
    return base.filter("normal != ''").select(
        *SESSION, "source", "date", "ordinal", "normal", "text", "quote", F.size("words").alias("word_count"),
        F.when(comparable, F.col("words")).alias("words"))


def message_runs(messages: DataFrame) -> DataFrame:
    """Every message that says something, with the repeat run and the reword run it belongs to."""
    live = _prepared(messages).select(
        *SESSION, "source", "date", "ordinal", I.sha256(F.col("normal")).alias("normal_hash"), "quote", "word_count", "words")
    placed = ranked(live, SESSION, ["ordinal"], integer_chunks("ordinal"), "place")
    paired = previous(placed, SESSION, "place", {"prior_hash": "normal_hash", "prior_words": "words"})
    same = F.coalesce(F.col("normal_hash") == F.col("prior_hash"), F.lit(False))
    close = F.coalesce(T.overlap(F.col("words"), F.col("prior_words")) >= K.REWORD_MIN_OVERLAP, F.lit(False))
    return runs(paired, SESSION, "place", {"repeat_run": ~same, "reword_run": ~(close & ~same)})


def _run_findings(numbered: DataFrame) -> DataFrame:
    """Long repeat and reword runs; both kinds come from one pass over the numbered messages."""
    kinds = F.array(F.struct(F.lit("repeat_sends").alias("finding"), F.col("repeat_run").alias("run")),
                    F.struct(F.lit("reword_loops").alias("finding"), F.col("reword_run").alias("run")))
    first = F.min_by(F.struct("date", "quote", "word_count"), "ordinal")
    found = numbered.select(*SESSION, "source", "ordinal", "date", "quote", "word_count", F.inline(kinds)).groupBy(
        *SESSION, "source", "finding", "run").agg(
        F.count("*").alias("count"), F.min("ordinal").alias("ordinal"), first.alias("first"))
    repeats = (F.col("count") >= K.REPEAT_MIN_RUN) & (F.col("first.word_count") >= K.REPEAT_MIN_WORDS)
    kept = F.when(F.col("finding") == "repeat_sends", repeats).otherwise(F.col("count") >= K.REWORD_MIN_RUN)
    return found.filter(kept).select(
        "owner_id", "finding", "session_id", "source", F.col("first.date").alias("date"), "ordinal",
        F.col("first.quote").alias("text"), F.lit("").alias("marker"), "count")


def _single_findings(messages: DataFrame) -> DataFrame:
    """Messages that restate context or open with a correction; one message can do both."""
    normal = T.usage_form(F.col("text"))
    base = messages.select(*SESSION, "source", "date", "ordinal", "text", normal.alias("normal")).withColumns(
        {"marker": M.restated_marker(F.col("normal")), "corrects": M.is_correction(F.col("normal"))})

    def found(name, marker, text):
        return F.struct(F.lit(name).alias("finding"), text.alias("quote"), marker.alias("shown"))

    both = F.array_compact(F.array(
        F.when(F.col("marker").isNotNull(), found("restated_context", F.col("marker"), T.excerpt(F.col("text"), F.col("marker")))),
        F.when(F.col("corrects"), found("corrections", F.lit(""), T.excerpt(F.col("text"))))))
    # Outer, then filtered: a filter below the generator would work the normal form out again for every phrase.
    return base.select(*SESSION, "source", "date", "ordinal", F.inline_outer(both)).filter("finding is not null").select(
        "owner_id", "finding", "session_id", "source", "date", "ordinal", F.col("quote").alias("text"),
        F.col("shown").alias("marker"), F.lit(1).cast("bigint").alias("count"))


def findings(messages: DataFrame) -> DataFrame:
    """Evidence rows of all four findings."""
    return _run_findings(message_runs(messages)).unionByName(_single_findings(messages))


def totals(messages: DataFrame) -> DataFrame:
    """Counts, dates and the upper median of words per message, per owner."""
    counted = messages.select(*SESSION, "date", F.size(T.usage_words(F.col("text"))).alias("words"))
    base = counted.groupBy("owner_id").agg(
        F.countDistinct("session_id").alias("sessions"), F.count("*").alias("messages"),
        F.coalesce(F.min(C.known(F.col("date"))), F.lit("")).alias("first_date"),
        F.coalesce(F.max(C.known(F.col("date"))), F.lit("")).alias("last_date"),
        F.count_if(F.col("words") <= K.SHORT_PROMPT_WORDS).alias("short_prompts"))
    return base.join(upper_median(counted, ["owner_id"], "words", "median_words"), "owner_id")


def upper_median(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Element ``n div 2`` of the sorted values, read off their histogram."""
    histogram = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*group).orderBy(value)
    whole = Window.partitionBy(*group)
    return histogram.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(whole)}).filter(
        F.expr("__upto > __all div 2 and __upto - __n <= __all div 2")).select(*group, F.col(value).alias(name))


def sessions_by_source(messages: DataFrame) -> DataFrame:
    return messages.groupBy("owner_id", "source").agg(F.countDistinct("session_id").alias("sessions"))


def report(messages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row per owner and finding: occurrences, whether it is flagged, and up to three distinct quotes.

    Pass ``found`` when ``findings`` was already written; it is read three times here.
    """
    found = findings(messages) if found is None else found
    counted = found.groupBy("owner_id", "finding").agg(F.sum("count").alias("occurrences"))
    keys = F.array(*[F.lit(k) for k in K.FINDING_KEYS])
    owners = totals(messages).select("owner_id", "messages", F.explode(keys).alias("finding"))
    counted = owners.join(counted, ["owner_id", "finding"], "left").fillna(0, ["occurrences"])
    rate = F.expr("100 * occurrences div messages")
    flagged = (
        F.when(F.col("finding") == "restated_context", F.col("occurrences") >= K.RESTATED_MIN)
        .when(F.col("finding") == "corrections", rate >= K.CORRECTION_RATE_MIN)
        .otherwise(F.col("occurrences") > 0))
    ordered = found.withColumn("neg_count", -F.col("count"))
    distinct = first_rows(ordered, ["owner_id", "finding", "text"], ORDER)
    sampled = top_rows(distinct, ["owner_id", "finding"], [F.col(c) for c in ORDER], K.FINDING_RECEIPTS)
    receipt = F.struct(*ORDER, "source", "text", "marker", "count")
    samples = sampled.groupBy("owner_id", "finding").agg(F.sort_array(F.collect_list(receipt)).alias("receipts"))
    return counted.join(samples, ["owner_id", "finding"], "left").select(
        "owner_id", "finding", "occurrences", flagged.alias("flagged"),
        F.when(F.col("finding") == "corrections", rate).alias("correction_rate"),
        F.transform(F.coalesce("receipts", F.array().cast(_RECEIPTS)), lambda r: r.dropFields("neg_count")).alias(
            "receipts"))
