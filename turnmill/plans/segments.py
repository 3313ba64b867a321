"""Segments: sessions packed into bounded units of work, kept up to date as sessions change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C, identity as I
from turnmill.operators.digest import set_digest
from turnmill.operators.ordered import hash_chunks
from turnmill.operators.packing import pack_greedy
from turnmill.session import materialize

SESSION = ["owner_id", "session_id"]
SEGMENT = ["owner_id", "segment_hash"]


def seal(sessions: DataFrame, target_tokens: int) -> DataFrame:
    """Pack sessions per source in time order and describe every segment.

    A segment holds at most ``target_tokens``, or one session that is larger. ``sessions`` comes from ``roll_up``.
    """
    narrow = sessions.select(*SESSION, "source", "first_date", F.col("tokens").cast("bigint").alias("tokens"))
    packed = pack_greedy(
        narrow, ["owner_id", "source"], ["first_date", "session_id"],
        hash_chunks("session_id", prefix=("first_date",), digits=(3, 1)), "tokens", target_tokens)
    members = packed.select(*SESSION, "bin_start").join(sessions, SESSION)
    member = F.struct("first_date", "session_id", "content_hash")
    grouped = members.groupBy("owner_id", "source", "bin_start").agg(
        F.sort_array(F.collect_list(member)).alias("members"), F.sum("tokens").alias("source_tokens"),
        F.coalesce(F.min(C.known(F.col("first_date"))), F.lit(C.UNDATED)).alias("first_date"),
        F.coalesce(F.max(C.known(F.col("last_date"))), F.lit(C.UNDATED)).alias("last_date"))
    versions = F.transform("members", lambda m: F.struct(
        m["content_hash"].alias("content_hash"), m["session_id"].alias("session_id")))
    identity = I.canonical_json({
        "schema_version": F.lit(K.SEGMENT_VERSION), "extraction_schema_version": F.lit(K.EXTRACTION_VERSION),
        "target_tokens": F.lit(target_tokens), "sessions": versions})
    single = F.size("members") == 1
    text_hash = I.sha256(F.array_join(F.transform("members", lambda m: m["content_hash"]), "\n"))
    return grouped.select(
        "owner_id", I.sha256(identity).alias("segment_hash"), F.lit(True).alias("active"), "source", "first_date",
        "last_date", "source_tokens", text_hash.alias("text_hash"), versions.alias("session_versions"),
        (single & (F.col("source_tokens") > target_tokens)).alias("oversize"))


def versions_of(segments: DataFrame) -> DataFrame:
    return segments.select(*SEGMENT, F.posexplode("session_versions").alias("place", "v")).select(
        *SEGMENT, "place", "v.session_id", "v.content_hash")


def stale_segments(segments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Active segments with a session that changed or is gone."""
    current = sessions.select(*SESSION, F.col("content_hash").alias("current_hash"))
    held = versions_of(segments.filter("active")).join(current, SESSION, "left")
    changed = ~F.col("content_hash").eqNullSafe(F.col("current_hash"))
    return held.filter(changed).select(*SEGMENT).distinct()


def sync(segments: DataFrame, sessions: DataFrame, target_tokens: int) -> DataFrame:
    """Bring an index up to date: stale segments retire, and only their sessions and new ones are packed again."""
    stale = materialize(stale_segments(segments, sessions), "stale")
    kept = segments.join(stale, SEGMENT, "left_anti")
    retired = segments.join(stale, SEGMENT, "left_semi").withColumn("active", F.lit(False))
    represented = versions_of(kept.filter("active")).select(*SESSION).distinct()
    fresh = materialize(seal(sessions.join(represented, SESSION, "left_anti"), target_tokens), "fresh")
    old = kept.unionByName(retired)
    # A segment packed again to the same content takes the place of its retired row.
    return old.join(fresh.select(*SEGMENT), SEGMENT, "left_anti").unionByName(fresh)


def broken_segments(segments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Segments whose sessions or text no longer match what they were sealed from."""
    current = sessions.select(*SESSION, F.col("content_hash").alias("current_hash"))
    rows = versions_of(segments).join(current, SESSION, "left")
    seen = rows.groupBy(*SEGMENT).agg(
        F.bool_or(~F.col("content_hash").eqNullSafe(F.col("current_hash"))).alias("missing"),
        F.sort_array(F.collect_list(F.struct("place", "current_hash"))).alias("members"))
    text_hash = I.sha256(F.array_join(F.transform("members", lambda m: m["current_hash"]), "\n"))
    problem = F.when(F.col("missing"), "missing-session").when(text_hash != F.col("text_hash"), "text-mismatch")
    return seen.join(segments.select(*SEGMENT, "text_hash"), SEGMENT).select(
        *SEGMENT, problem.alias("problem")).filter("problem is not null")


def plan(selected: DataFrame, cached: DataFrame, reduction_cached: DataFrame | None = None,
         adequate: bool | None = None) -> DataFrame:
    """Work left per owner: segments with no report yet, and whether a reduction is due.

    ``cached``: segments with a valid report. ``reduction_cached``: owners whose report set was already reduced.
    """
    hit = selected.join(cached.select(*SEGMENT).distinct().withColumn("hit", F.lit(1)), SEGMENT, "left")
    work = hit.groupBy("owner_id").agg(
        F.countDistinct("segment_hash").alias("selected_segments"), F.sum("source_tokens").alias("selected_source_tokens"),
        F.count("hit").alias("cached_segments"),
        F.countDistinct(C.month_stratum(F.col("source"), F.col("first_date"))).alias("strata"))
    work = work.withColumn("planned_worker_calls", F.col("selected_segments") - F.col("cached_segments"))
    if reduction_cached is None:
        done = work.withColumn("reduced", F.lit(False))
    else:
        done = work.join(reduction_cached.select("owner_id").distinct().withColumn("reduced", F.lit(True)), "owner_id",
                         "left").fillna(False, ["reduced"])
    finished = (F.col("planned_worker_calls") == 0) & F.col("reduced")
    return done.withColumns({
        "planned_reducer_calls": F.when(finished, 0).otherwise(1),
        "adequate_strata": F.col("strata") >= 2 if adequate is None else F.lit(adequate),
    }).drop("reduced")


def approval_hash(plan_row: DataFrame) -> DataFrame:
    """Add the hash that binds an approval to exactly this plan."""
    return plan_row.withColumn("approval_hash", I.sha256(I.canonical_json({c: F.col(c) for c in plan_row.columns})))


def drifted(approved: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Owners whose plan is no longer the approved one."""
    now = recomputed.select("owner_id", F.col("approval_hash").alias("now_hash"))
    return approved.join(now, "owner_id", "left").filter(
        ~F.col("approval_hash").eqNullSafe(F.col("now_hash"))).select("owner_id")


def report_set_hash(reports: DataFrame) -> DataFrame:
    """Digest over the selected reports of an owner; ``reports``: owner_id, path, sha256."""
    entry = I.canonical_json({"path": F.col("path"), "sha256": F.col("sha256")})
    return set_digest(reports, ["owner_id"], entry, "report_set_hash")
