"""Inbox, candidate policy, decisions and generations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C, identity as I, text as T
from turnmill.operators.lineage import walk
from turnmill.operators.ordered import integer_chunks, newest, previous, ranked, runs, top_rows
from turnmill.session import materialize

UTC_SECONDS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
HEX = {n: f"^[a-f0-9]{{{n}}}$" for n in (16, 64)}


def schema_name(kind: str, namespace: str = "turnmill") -> str:
    """Versioned name of a record kind; it enters the record's identity, so keep one namespace per store."""
    return f"{namespace}.autopilot-{kind}/v1"


# --- inbox -----------------------------------------------------------------

def quiet_sessions(events: DataFrame, keys: list[str], time: str, gap_seconds: int = K.QUIET_SECONDS) -> DataFrame:
    """Stretches of activity that end in at least ``gap_seconds`` of silence, batch form. Keys must not be null.

    Events of one key in one slot of ``gap_seconds`` follow each other in less than that, whatever their number: they are one
    summary (first, last, count), added up before the shuffle. Summaries of neighbouring slots are one stretch where less than
    the gap lies between them; they are put together in chunks, so a key that never falls quiet is many tasks.
    """
    gap = gap_seconds * 1_000_000
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    slots = events.filter(F.col(time).isNotNull()).groupBy(*keys, F.floor(micros(time) / gap).alias("slot")).agg(
        F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count("*").alias("events"))
    # Slots before 1970 have negative numbers; chunks only need to follow their order.
    placed = ranked(materialize(slots, "slots"), keys, ["slot"], integer_chunks("slot"), "place")
    paired = previous(materialize(placed, "slots"), keys, "place", {"before": "last_at"})
    opens = F.col("before").isNull() | (micros("first_at") - micros("before") >= gap)
    numbered = runs(materialize(paired, "slots"), keys, "place", {"stretch": opens})
    return numbered.groupBy(*keys, "stretch").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("events").alias("events")).drop("stretch")


def _bounded_candidates(messages: DataFrame) -> DataFrame:
    """The messages of a session that its bounds could keep, and nothing else.

    The first 256 can. A later one counts only if an earlier one was cut to nothing, which leaves at most three bytes:
    so at most three more, the first ones whose first character has that size.
    """
    keys = ["owner_id", "session_id"]
    first_char = F.octet_length(F.substring("head", 1, 1))
    # Of each size of a first character so many that the first 256 of all and three later ones are among them, read once.
    likely = top_rows(messages.withColumn("first_char", first_char), [*keys, "first_char"], [F.col("ordinal")], K.INBOX_MAX_RECEIPTS + 3)
    messages = materialize(likely.drop("first_char"), "likely")
    early = top_rows(messages, keys, [F.col("ordinal")], K.INBOX_MAX_RECEIPTS)
    spare = messages.filter(first_char <= 3).join(early.select(*keys, "ordinal"), [*keys, "ordinal"], "left_anti")
    spare = top_rows(spare.withColumn("first_char", first_char), [*keys, "first_char"], [F.col("ordinal")], 3)
    return early.unionByName(spare.drop("first_char"))


def _spend(rows: pd.DataFrame) -> pd.DataFrame:
    """Give out the bytes of one session in order; about 260 rows at most."""
    rows = rows.sort_values("ordinal")
    left, taken, heads, cut = 65_536, 0, [], []
    for head in rows["head"]:
        raw = head.encode("utf-8")
        part = raw[:left].decode("utf-8", "ignore") if taken < 256 else ""
        heads.append(part)
        cut.append(part != head)
        left -= len(part.encode("utf-8"))
        taken += bool(part)
    rows["head"], rows["cut"] = heads, rows["cut"] | pd.Series(cut, index=rows.index)
    return rows[rows["head"] != ""]


def inbox_receipts(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts of a session scan without their text, and per session how many messages were cut or left out.

    At most 256 messages count per session; each is cut at 2,000 characters and then to what is left of 65,536 bytes.
    ``messages`` are numbered (``ordinal``) and carry ``modified``, the time their file changed.
    """
    keys = ["owner_id", "session_id"]
    clean = messages.withColumn("clean", T.redact(T.strip(F.col("text")))).filter("clean != ''")
    cut = clean.select(
        *keys, "source", "date", "modified", "ordinal", F.substring("clean", 1, K.INBOX_MESSAGE_CHARS).alias("head"),
        (F.length("clean") > K.INBOX_MESSAGE_CHARS).alias("cut"))
    near = _bounded_candidates(cut)
    size = near.groupBy(*keys).agg(F.sum(F.octet_length("head")).alias("bytes"), F.count("*").alias("n"))
    sized = near.join(size, keys)
    fits = (F.col("bytes") <= K.INBOX_SESSION_BYTES) & (F.col("n") <= K.INBOX_MAX_RECEIPTS)
    tight = sized.filter(~fits).drop("bytes", "n")
    kept = sized.filter(fits).drop("bytes", "n").unionByName(tight.groupBy(*keys).applyInPandas(_spend, tight.schema))
    rows = kept.withColumns({
        "message_sha256": I.sha256(F.col("head")), "observed_at": C.observed_at(F.col("date"), F.col("modified"))})
    receipt = I.content_id("rcpt_", {c: F.col(c) for c in ("session_id", "ordinal", "message_sha256", "observed_at")})
    receipts = rows.select(
        *keys, "source", "ordinal", receipt.alias("receipt_id"), "message_sha256", "observed_at",
        F.substring("observed_at", 1, 7).alias("time_stratum"), "cut", "modified")
    seen = cut.groupBy(*keys).agg(F.count("*").alias("seen"))
    whole = receipts.groupBy(*keys).agg(F.count_if(~F.col("cut")).alias("whole"))
    truncated = seen.join(whole, keys, "left").select(
        *keys, (F.col("seen") - F.coalesce("whole", F.lit(0))).cast("int").alias("truncated_message_count"))
    return receipts, truncated


def inbox(receipts: DataFrame, truncated: DataFrame, files: DataFrame, namespace: str = "turnmill") -> DataFrame:
    """One item per quiet session. ``files``: owner_id, session_id, size, mtime_ns, quiet_since."""
    keys = ["owner_id", "session_id"]
    row = F.struct(*[F.col(c) for c in ("message_sha256", "observed_at", "receipt_id", "session_id", "time_stratum")])
    grouped = receipts.groupBy(*keys, "source").agg(
        F.array_sort(F.collect_list(row), lambda a, b: F.when(a["receipt_id"] < b["receipt_id"], -1).when(
            a["receipt_id"] > b["receipt_id"], 1).otherwise(0)).alias("receipts"))
    full = grouped.join(truncated, keys).join(files, keys)
    ids = F.transform("receipts", lambda r: r["receipt_id"])
    identity = F.struct(F.col("mtime_ns").alias("mtime_ns"), F.col("size").alias("size"))
    full = full.withColumns({
        "schema_version": F.lit(schema_name("inbox", namespace)), "message_count": F.size("receipts"),
        "session_fingerprint": I.sha256(I.canonical_json({"identity": identity, "receipt_ids": ids}))})
    named = ("schema_version", "session_id", "source", "session_fingerprint", "receipts", "message_count",
             "truncated_message_count")
    return full.select(
        "owner_id", I.content_id("inbox_", {c: F.col(c) for c in named}).alias("inbox_id"), *named,
        F.date_format("quiet_since", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


def new_items(items: DataFrame, processed: DataFrame) -> DataFrame:
    """Items whose fingerprint was not processed before."""
    key = ["owner_id", "session_id", "session_fingerprint"]
    return items.join(processed.select(*key), key, "left_anti")


# --- policy and decisions --------------------------------------------------

def support(evidence: Column) -> tuple[Column, Column]:
    """Distinct sessions and months in a candidate's evidence, which its contract bounds to 64 rows."""
    return (F.size(F.array_distinct(F.transform(evidence, lambda e: e["session_id"]))),
            F.size(F.array_distinct(F.transform(evidence, lambda e: e["time_stratum"]))))


def policy(kind: Column, risks: Column, contradictions: Column, sessions: Column, strata: Column,
           auto_activate: bool = False) -> tuple[Column, Column]:
    """Policy class of a candidate and the reason; the first that applies."""
    known = F.array(*[F.lit(r) for r in K.PROHIBITED_RISKS])
    reason = (
        F.when(F.size(F.array_except(risks, known)) > 0, "unknown-risk-category")
        .when(F.size(risks) > 0, "prohibited-risk")
        .when(kind == "retirement", "retirement")
        .when(contradictions > 0, "contradiction")
        .when(sessions < 3, "insufficient-sessions")
        .when(strata < 2, "insufficient-time-strata")
        .otherwise("repeated-explicit-low-risk" if auto_activate else "auto-disabled"))
    outcome = F.when(reason == "unknown-risk-category", "reject").when(
        reason == "repeated-explicit-low-risk", "safe").otherwise("review")
    return outcome, reason


def with_support(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add receipts, sessions and time_strata from evidence rows (owner_id, candidate_id, session_id, time_stratum)."""
    counts = evidence.groupBy("owner_id", "candidate_id").agg(
        F.count("*").alias("receipts"), F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("time_stratum").alias("time_strata"))
    return candidates.join(counts, ["owner_id", "candidate_id"])


def with_policy(candidates: DataFrame, auto_activate: bool = False) -> DataFrame:
    """Add policy class and reason; support comes from the ``evidence`` array unless ``with_support`` added it."""
    if "evidence" in candidates.columns:
        sessions, strata = support(F.col("evidence"))
        candidates = candidates.withColumns({"receipts": F.size("evidence"), "sessions": sessions, "time_strata": strata})
    outcome, reason = policy(F.col("kind"), F.col("risk_categories"), F.col("contradiction_count"), F.col("sessions"),
                             F.col("time_strata"), auto_activate)
    return candidates.withColumns({"policy_class": outcome, "policy_reason": reason})


def latest_decisions(decisions: DataFrame) -> DataFrame:
    return newest(decisions, ["owner_id", "candidate_id"], ["decided_at", "decision_id"])


def review_queue(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every candidate with its support, policy and newest decision."""
    latest = latest_decisions(decisions).select(
        "owner_id", "candidate_id", "decision", "decision_id", F.col("reason").alias("decision_reason"), "decided_at")
    queue = with_policy(candidates).drop("evidence").join(latest, ["owner_id", "candidate_id"], "left")
    return queue.fillna("pending", ["decision"])


def status_counts(queue: DataFrame, inbox_items: DataFrame, generations: DataFrame) -> DataFrame:
    """Totals per owner."""
    counts = queue.groupBy("owner_id").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("decision") == "pending").alias("pending"),
        F.count_if(F.col("decision") == "approve").alias("approved"),
        F.count_if(F.col("decision") == "reject").alias("rejected"))
    for name, table in (("inbox", inbox_items), ("generations", generations)):
        counts = counts.join(table.groupBy("owner_id").agg(F.count("*").alias(name)), "owner_id", "full_outer")
    return counts.na.fill(0)


def record_decisions(candidates: DataFrame, verdicts: DataFrame, namespace: str = "turnmill") -> tuple[DataFrame, DataFrame]:
    """New decisions from ``owner_id, candidate_id, decision, reason, decided_at``, and the verdicts refused.

    An approval is refused where the policy rejects the candidate, and any verdict on an unknown candidate.
    """
    known = with_policy(candidates).select("owner_id", "candidate_id", "policy_class")
    joined = verdicts.join(known, ["owner_id", "candidate_id"], "left").withColumn(
        "schema_version", F.lit(schema_name("decision", namespace)))
    refused = F.coalesce(F.col("policy_class").isNull() | (
        (F.col("decision") == "approve") & (F.col("policy_class") == "reject")), F.lit(True))
    named = ("schema_version", "candidate_id", "decision", "reason", "policy_class", "decided_at")
    made = joined.filter(~refused).select(
        "owner_id", I.content_id("dec_", {c: F.col(c) for c in named}).alias("decision_id"), *named)
    return made, joined.filter(refused).select(*verdicts.columns)


# --- generations -----------------------------------------------------------

def blocked_candidates(chosen: DataFrame, decisions: DataFrame) -> DataFrame:
    """Chosen candidates whose newest decision is no approval of an allowed class."""
    latest = latest_decisions(decisions).select("owner_id", "candidate_id", "decision", "policy_class")
    both = chosen.join(latest, ["owner_id", "candidate_id"], "left")
    allowed = (F.col("decision") == "approve") & F.col("policy_class").isin("safe", "review")
    return both.filter(~F.coalesce(allowed, F.lit(False))).select("owner_id", "candidate_id")


def active_statements(members: DataFrame, chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """Statements of the next generation: those active now and the newly chosen, without repeats.

    ``members`` and ``chosen``: owner_id, candidate_id. Rows order by domain, then candidate id.
    """
    ids = members.select("owner_id", "candidate_id").unionByName(chosen.select("owner_id", "candidate_id")).distinct()
    return ids.join(candidates.select("owner_id", "candidate_id", "domain", "statement"), ["owner_id", "candidate_id"])


def rollback(generations: DataFrame, heads: DataFrame, targets: DataFrame) -> DataFrame:
    """Whether each owner may go back to its target: the target must be a strict ancestor of the head."""
    pointers = generations.select("owner_id", F.col("generation_id").alias("node"), F.col("parent_generation_id").alias("next"))
    reached = walk(pointers, heads.select("owner_id", F.col("generation_id").alias("node")))
    ancestors = reached.filter("steps > 0").select("owner_id", F.col("node").alias("generation_id")).distinct()
    hit = ancestors.withColumn("is_ancestor", F.lit(True))
    return targets.join(hit, ["owner_id", "generation_id"], "left").fillna(False, ["is_ancestor"])


def pull_status(generations: DataFrame, local: DataFrame, remote: DataFrame, max_steps: int = K.MAX_GENERATIONS) -> DataFrame:
    """Per owner: unchanged, activated when the remote head descends from the local one, conflict, or chain-too-long.

    ``local`` and ``remote``: owner_id, generation_id; an owner without a local head takes any remote one. A local head
    that is not among the ``max_steps`` nearest ancestors of a longer chain is an error of the chain, not a conflict.
    """
    both = remote.select("owner_id", F.col("generation_id").alias("remote")).join(
        local.select("owner_id", F.col("generation_id").alias("local")), "owner_id", "full_outer")
    pointers = generations.select("owner_id", F.col("generation_id").alias("node"), F.col("parent_generation_id").alias("next"))
    reached = walk(pointers, remote.select("owner_id", F.col("generation_id").alias("node")), max_steps + 1)
    near = F.col("steps") <= max_steps
    on_path = reached.filter(near).select("owner_id", F.col("node").alias("local")).distinct().withColumn("descends", F.lit(True))
    long = reached.filter(~near).select("owner_id").distinct().withColumn("long", F.lit(True))
    status = (
        F.when(F.col("remote").isNull() | F.col("remote").eqNullSafe(F.col("local")), "unchanged")
        .when(F.col("local").isNull() | F.col("descends"), "activated")
        .when(F.col("long"), "chain-too-long")
        .otherwise("conflict"))
    return both.join(on_path, ["owner_id", "local"], "left").join(long, "owner_id", "left").select("owner_id", "local", "remote", status.alias("status"))


# --- contracts -------------------------------------------------------------

def _first_failure(checks: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(code)) for code, good in checks])


def _valid_time(value: Column) -> Column:
    return value.rlike(UTC_SECONDS) & value.try_cast("timestamp").isNotNull()


def _sorted_unique(values: Column) -> Column:
    return values == F.sort_array(F.array_distinct(values))


def candidate_error(namespace: str = "turnmill") -> Column:
    """First broken clause of the candidate contract, null for a sound row.

    ``evidence`` structs hold observed_at, receipt_id, session_id, time_stratum in that order.
    """
    ids = F.transform("evidence", lambda e: e["receipt_id"])
    named = ("schema_version", "kind", "domain", "statement", "scope", "evidence", "contradiction_count",
             "risk_categories", "source_packet_hash", "prompt_contract_version")
    return _first_failure([
        ("schema", F.col("schema_version") == schema_name("candidate", namespace)),
        ("candidate-id", F.col("candidate_id").rlike("^cand_[a-f0-9]{20}$")),
        ("kind", F.col("kind").isin(*K.CANDIDATE_KINDS)), ("domain", F.col("domain").isin(*K.DOMAINS)),
        ("statement", F.length("statement").between(1, 2000)),
        ("control-character", ~F.col("statement").rlike("[\\x00-\\x1f\\x7f]")),
        ("scope", F.size("scope") <= 16),
        ("scope-item", F.forall("scope", lambda s: s.rlike("^[a-z0-9][a-z0-9-]{0,63}$"))),
        ("scope-order", _sorted_unique(F.col("scope"))),
        ("evidence", F.size("evidence").between(1, 64)),
        ("evidence-row", F.forall("evidence", lambda e: e["receipt_id"].rlike("^rcpt_[a-f0-9]{20}$")
                                  & e["session_id"].rlike(HEX[16]) & _valid_time(e["observed_at"])
                                  & (e["time_stratum"] == F.substring(e["observed_at"], 1, 7)))),
        ("evidence-repeat", F.size(F.array_distinct(ids)) == F.size(ids)),
        ("contradictions", F.col("contradiction_count").between(0, 1000)),
        ("risks", F.size("risk_categories") <= 16),
        ("risk-item", F.forall("risk_categories", lambda r: r.rlike("^[a-z][a-z-]{0,63}$"))),
        ("risk-order", _sorted_unique(F.col("risk_categories"))),
        ("packet-hash", F.col("source_packet_hash").rlike(HEX[64])),
        ("prompt", F.col("prompt_contract_version") == schema_name("candidate-prompt", namespace)),
        ("created-at", _valid_time(F.col("created_at"))),
        ("identity", F.col("candidate_id") == I.content_id("cand_", {c: F.col(c) for c in named}))])


def decision_error(namespace: str = "turnmill") -> Column:
    named = ("schema_version", "candidate_id", "decision", "reason", "policy_class", "decided_at")
    return _first_failure([
        ("schema", F.col("schema_version") == schema_name("decision", namespace)),
        ("decision-id", F.col("decision_id").rlike("^dec_[a-f0-9]{20}$")),
        ("candidate-id", F.col("candidate_id").rlike("^cand_[a-f0-9]{20}$")),
        ("decision", F.col("decision").isin("approve", "reject")),
        ("reason", F.col("reason").rlike("^[a-z0-9][a-z0-9-]{0,199}$")),
        ("policy-class", F.col("policy_class").isin("safe", "review", "reject")),
        ("decided-at", _valid_time(F.col("decided_at"))),
        ("identity", F.col("decision_id") == I.content_id("dec_", {c: F.col(c) for c in named}))])


def generation_error(namespace: str = "turnmill") -> Column:
    """``domains`` is an array of structs (artifact, domain, sha256), sorted by domain."""
    shape = "^gen_[a-f0-9]{20}$"
    inner = F.transform("domains", lambda d: F.concat(
        F.lit('"'), d["domain"], F.lit('":{"artifact":"'), d["artifact"], F.lit('","sha256":"'), d["sha256"], F.lit('"}')))
    head = F.rtrim(F.to_json(F.struct("candidate_ids", "created_at")), F.lit("}"))
    tail = F.ltrim(F.to_json(F.struct("operation", "parent_generation_id", "schema_version"),
                             {"ignoreNullFields": "false"}), F.lit("{"))
    text = F.concat(head, F.lit(',"domains":{'), F.array_join(inner, ","), F.lit("},"), tail)
    return _first_failure([
        ("schema", F.col("schema_version") == schema_name("generation", namespace)),
        ("generation-id", F.col("generation_id").rlike(shape)),
        ("parent-id", F.col("parent_generation_id").isNull() | F.col("parent_generation_id").rlike(shape)),
        ("operation", F.col("operation").isin("activate", "rollback")),
        ("candidate-order", _sorted_unique(F.col("candidate_ids"))),
        ("candidate-ids", F.forall("candidate_ids", lambda c: c.rlike("^cand_[a-f0-9]{20}$"))),
        ("domains", F.forall("domains", lambda d: d["domain"].isin(*K.DOMAINS)
                             & (d["artifact"] == F.concat(d["domain"], F.lit(".md"))) & d["sha256"].rlike(HEX[64]))),
        ("created-at", _valid_time(F.col("created_at"))),
        ("identity", F.col("generation_id") == F.concat(F.lit("gen_"), I.short_hash(text, 20)))])


def inbox_error(namespace: str = "turnmill") -> Column:
    ids = F.transform("receipts", lambda r: r["receipt_id"])
    named = ("schema_version", "session_id", "source", "session_fingerprint", "receipts", "message_count",
             "truncated_message_count")
    return _first_failure([
        ("schema", F.col("schema_version") == schema_name("inbox", namespace)),
        ("inbox-id", F.col("inbox_id").rlike("^inbox_[a-f0-9]{20}$")),
        ("session-id", F.col("session_id").rlike(HEX[16])), ("source", F.col("source").isin(*K.SOURCES)),
        ("fingerprint", F.col("session_fingerprint").rlike(HEX[64])),
        ("receipts", F.size("receipts").between(1, K.INBOX_MAX_RECEIPTS)),
        ("receipt-row", F.forall("receipts", lambda r: r["receipt_id"].rlike("^rcpt_[a-f0-9]{20}$")
                                 & r["message_sha256"].rlike(HEX[64]) & (r["session_id"] == F.col("session_id"))
                                 & _valid_time(r["observed_at"])
                                 & (r["time_stratum"] == F.substring(r["observed_at"], 1, 7)))),
        ("receipt-order", _sorted_unique(ids)),
        ("counts", (F.col("message_count") == F.size("receipts")) & (F.col("truncated_message_count") >= 0)),
        ("created-at", _valid_time(F.col("created_at"))),
        ("identity", F.col("inbox_id") == I.content_id("inbox_", {c: F.col(c) for c in named}))])


def checkpoint_error(namespace: str = "turnmill") -> Column:
    return _first_failure([
        ("schema", F.col("schema_version") == schema_name("checkpoint", namespace)),
        ("path-hash", F.col("path_hash").rlike(HEX[64])), ("source", F.col("source").isin(*K.SOURCES)),
        ("identity", (F.col("identity.size") >= 0) & (F.col("identity.mtime_ns") >= 0)),
        ("unchanged-since", F.col("unchanged_since") >= 0),
        ("fingerprint", F.col("processed_fingerprint").isNull() | F.col("processed_fingerprint").rlike(HEX[64]))])
