"""Queries over checked records: reports, profile packs, segments, experiment cells, inbox receipts, and logs found in folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from turnmill import constants as K
from turnmill.functions.identity import sha256
from turnmill.operators.ordered import integer_chunks, ranked
from turnmill.plans import corpus, evidence, experiment, review, segments
from turnmill.queries import sqltext as S
from turnmill.queries.corpus import CONV_KEPT, MINED
from turnmill.queries.evidence import RULES_SQL, _flat, rules
from turnmill.queries.inputs import CONV_SQL, conversation_messages
from turnmill.queries.receipts import _SEAL, _SYNC, _TARGET, _before_and_after, mined_documents, sealed_documents
from turnmill.queries.registry import query, table
from turnmill.session import materialize, run_folder
from turnmill.sinks import corpus as sink
from turnmill.sources import logs


def _folder(spark):
    return f"{run_folder(spark)}/records-{uuid.uuid4().hex}"


# --- reports and packs ---------------------------------------------------------

# Each segment has a report; the first digits of its hash say what is wrong with it.
_MUTATIONS = [None, "schema-version", "coverage-sessions", "coverage-metadata", "evidence-id", "register", "domain-or-kind", "missing-text",
              "unknown-session", "not-verbatim", "domain-evidence", "quote-length"]
_CODES = ", ".join("NULL" if m is None else f"'{m}'" for m in _MUTATIONS)


@query("report_errors", f"""
{_SEAL}
SELECT owner_id, segment_hash, [{_CODES}][CAST('0x' || substr(segment_hash, 1, 4) AS INTEGER) % {len(_MUTATIONS)} + 1] AS error FROM ssegments""")
def report_errors(spark, folder):
    messages = materialize(mined_documents(spark, folder), "messages")
    _, sealed = sealed_documents(spark, folder)
    sealed = materialize(sealed, "segments")
    first = messages.withColumn("n", F.row_number().over(Window.partitionBy("owner_id", "session_id").orderBy("ordinal"))).filter("n = 1")
    said = sealed.withColumn("session_id", F.element_at("session_versions", 1)["session_id"]).join(
        first.select("owner_id", "session_id", "date", F.trim(F.regexp_extract("text", r"^(\S(?:.{0,30}\S)?)", 1)).alias("said")), ["owner_id", "session_id"])
    m = F.conv(F.substring("segment_hash", 1, 4), 16, 10).cast("int") % len(_MUTATIONS)

    def bent(code, other, usual):
        return F.when(m == _MUTATIONS.index(code), other).otherwise(usual)

    quote = F.struct(
        bent("unknown-session", F.lit("f" * 16), F.col("session_id")).alias("session_id"), "date",
        bent("not-verbatim", F.concat(F.col("said"), F.lit(" zzqx")), bent("quote-length", F.repeat(F.lit("x"), F.lit(201)), F.col("said"))).alias("text"))
    none = F.array().cast("array<struct<session_id:string,date:string,text:string>>")
    item = F.struct(
        bent("evidence-id", F.lit("ev-x"), F.concat(F.lit("ev-"), F.substring("segment_hash", 1, 8), F.lit("-tests"))).alias("evidence_id"),
        F.lit("work").alias("domain"), bent("domain-or-kind", F.lit("guess"), F.lit("inferred")).alias("kind"),
        bent("register", F.lit("casual"), F.lit(None)).alias("register"), F.lit("run tests").alias("instruction"),
        F.lit("before each push").alias("implication"), bent("missing-text", none, F.array(quote)).alias("quotes"), none.alias("contradictions"))
    ids = F.transform("session_versions", lambda v: v["session_id"])
    cover = F.struct(
        bent("coverage-sessions", F.slice(ids, F.lit(2), F.size(ids)), ids).alias("session_ids"), F.array("source").alias("sources"),
        bent("coverage-metadata", F.lit("x"), F.col("first_date")).alias("first_date"), "last_date", "source_tokens")
    states = F.struct(F.lit("evidence").alias("work"), bent("domain-evidence", F.lit("evidence"), F.lit("no-signal")).alias("design"),
                      F.lit("no-signal").alias("write"), F.lit("no-signal").alias("video"))
    body = F.struct(bent("schema-version", F.lit("1"), F.lit("2")).alias("schema_version"), "segment_hash", cover.alias("coverage"),
                    states.alias("domain_coverage"), F.array(item).alias("evidence"))
    raw = said.select("owner_id", F.to_json(body).alias("raw"))
    checked = evidence.check_reports(evidence.parse_reports(raw), sealed, messages)
    return checked.select("owner_id", "segment_hash", "error")


@query("law_issues", f"""
WITH {RULES_SQL},
known AS (SELECT r.owner_id, r.text, max(s.sessions) AS sessions FROM rules r JOIN support s USING (owner_id, rule_id) WHERE r.domain = 'work' GROUP BY ALL),
laws AS (SELECT DISTINCT 'u' || (o_custkey % 3) AS owner_id, CASE WHEN o_orderkey % 5 = 0 THEN 'never said ' ELSE 'always do ' END || o_orderpriority AS text,
                (o_orderkey % 12) || ' sessions' AS count FROM orders)
SELECT owner_id, text, problem FROM (
  SELECT l.*, CASE WHEN k.sessions IS NULL THEN 'no-such-rule' WHEN l.count <> k.sessions || ' sessions' THEN 'wrong-count' END AS problem
  FROM laws l LEFT JOIN known k USING (owner_id, text)) WHERE problem IS NOT NULL""")
def law_issues(spark, folder):
    listed, o = rules(spark, folder), F.col("o_orderkey")
    laws = table(spark, folder, "orders").select(
        F.concat(F.lit("u"), (F.col("o_custkey") % 3).cast("string")).alias("owner_id"),
        F.concat(F.when(o % 5 == 0, "never said ").otherwise("always do "), F.col("o_orderpriority")).alias("text"),
        F.concat((o % 12).cast("string"), F.lit(" sessions")).alias("count")).distinct()
    return evidence.law_issues(laws, listed, evidence.rule_support(listed, _flat(spark, folder)))


# Every line of an order is a quote of its part. The appendix lacks every eleventh of them and the headings of some parts.
@query("appendix_issues", """
WITH q AS (SELECT 'u' || (l_partkey % 3) AS owner_id, 'ev-' || l_partkey AS evidence_id, l_partkey, l_orderkey, l_linenumber FROM lineitem),
heads AS (SELECT DISTINCT owner_id, evidence_id FROM q WHERE l_partkey % 20 <> 3)
SELECT DISTINCT owner_id, evidence_id, 'missing-quote' AS problem FROM q WHERE (l_orderkey * 7 + l_linenumber) % 11 = 0
UNION ALL
SELECT owner_id, evidence_id, 'missing-id' FROM (SELECT DISTINCT owner_id, evidence_id FROM q) a
WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.owner_id = a.owner_id AND contains(h.evidence_id, a.evidence_id))""")
def appendix_issues(spark, folder):
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    quotes = table(spark, folder, "lineitem").select(
        F.concat(F.lit("u"), (p % 3).cast("string")).alias("owner_id"), F.concat(F.lit("ev-"), p.cast("string")).alias("evidence_id"), p, o, n,
        F.lit("s_1").alias("session_id"), F.lit("r").alias("receipt_id"), F.date_format("l_shipdate", "yyyy").alias("date"),
        F.concat(F.lit("line *"), o.cast("string"), F.lit("_"), n.cast("string"), F.lit("* of <it>")).alias("text"))
    ids = quotes.select("owner_id", "evidence_id", "l_partkey").distinct()
    heads = ids.filter("l_partkey % 20 <> 3").select("owner_id", F.concat(F.lit("## "), F.col("evidence_id")).alias("line"))
    kept = quotes.filter("(l_orderkey * 7 + l_linenumber) % 11 <> 0")
    appendix = evidence.appendix_lines(ids.select("owner_id", "evidence_id"), kept).select("owner_id", "line").unionByName(heads)
    return evidence.appendix_issues(appendix, ids, quotes.select("owner_id", "evidence_id", "date", "text"))


@query("broken_segments", f"""
{_SYNC}
SELECT o.owner_id, o.segment_hash, CASE WHEN s.segment_hash IS NOT NULL THEN 'missing-session' ELSE 'text-mismatch' END AS problem
FROM osegments o LEFT JOIN stale s USING (owner_id, segment_hash) WHERE s.segment_hash IS NOT NULL OR substr(o.segment_hash, 1, 1) < '4'""")
def broken_segments(spark, folder):
    was, now = _before_and_after(spark, folder)
    sealed = materialize(segments.seal(was, _TARGET), "segments")
    other = sealed.withColumn("text_hash", F.when(F.substring("segment_hash", 1, 1) < "4", sha256(F.col("text_hash"))).otherwise(F.col("text_hash")))
    return segments.broken_segments(other, now)


# --- experiment ----------------------------------------------------------------

_BASE = """'{"budget":{"calls":' || calls || ',"minutes":30},"family":"' || family || '","fixture_sha256":"' || fixture || '","host":"h' || (s_suppkey % 3) ||
  '","instruction_sha256":"' || instruction || '","permission_policy_sha256":"' || sha256('permission') || '","system_id":"sys-' || s_suppkey || '","task_id":"' || task_id ||
  '","tool_policy_sha256":"' || sha256('tool' || s_suppkey) || '","trial":' || trial || ',"variant":"' || variant || '"}'"""
_VALUES = {name: ", ".join(f"('{v}')" if isinstance(v, str) else f"({v})" for v in values)
           for name, values in (("families", K.FAMILIES), ("variants", K.VARIANTS), ("trials", K.TRIALS))}


@query("matrix_cells", f"""
WITH f(family) AS (VALUES {_VALUES['families']}), v(variant) AS (VALUES {_VALUES['variants']}), t(trial) AS (VALUES {_VALUES['trials']}),
grid AS (SELECT *, family || '-' || variant AS task_id, sha256('fixture' || family || variant) AS fixture, sha256('instruction' || family || variant) AS instruction,
                length(family) AS calls FROM supplier, f, v, t),
pairs AS (SELECT *, 'pair-' || substr(sha256({_BASE}), 1, 20) AS pair_id FROM grid),
cells AS (SELECT * FROM pairs, (VALUES ('{K.BASELINE_CONDITION}'), ('{K.TREATED_CONDITION}')) c(condition))
SELECT 'sys-' || s_suppkey AS system_id, task_id, trial, pair_id, condition,
       'cell-' || substr(sha256('{{"condition":"' || condition || '","pair_id":"' || pair_id || '"}}'), 1, 20) AS cell_id,
       CAST(CASE WHEN (condition = '{K.BASELINE_CONDITION}') = (sha256('seed:' || pair_id || ':{K.BASELINE_CONDITION}') < sha256('seed:' || pair_id || ':{K.TREATED_CONDITION}'))
            THEN 1 ELSE 2 END AS INTEGER) AS "order" FROM cells""")
def matrix_cells(spark, folder):
    s = F.col("s_suppkey").cast("string")
    systems = table(spark, folder, "supplier").select(
        F.concat(F.lit("sys-"), s).alias("system_id"), F.concat(F.lit("h"), (F.col("s_suppkey") % 3).cast("string")).alias("host"),
        sha256(F.concat(F.lit("tool"), s)).alias("tool_policy_sha256"), sha256(F.lit("permission")).alias("permission_policy_sha256"))
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, K.FAMILIES))).alias("family"))
    tasks = one.select("family", F.explode(F.array(*map(F.lit, K.VARIANTS))).alias("variant")).select(
        F.concat_ws("-", "family", "variant").alias("task_id"), sha256(F.concat(F.lit("fixture"), "family", "variant")).alias("fixture_sha256"),
        sha256(F.concat(F.lit("instruction"), "family", "variant")).alias("instruction_sha256"))
    budgets = one.select("family", F.struct(F.length("family").alias("calls"), F.lit(30).alias("minutes")).alias("budget"))
    return experiment.build_cells(systems, tasks, budgets, "0" * 64, "seed").select(
        "system_id", "task_id", "trial", "pair_id", "condition", "cell_id", "order")


# --- inbox and files -------------------------------------------------------------

# A source is a session and its documents are its messages, so large sources run out of bytes or of places.
_HEADS = f"""
clean AS (SELECT source, doc_id, {S.redact(S.strip('text'))} AS clean FROM documents),
heads AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal, substr(clean, 1, {K.INBOX_MESSAGE_CHARS}) AS head,
                 length(clean) > {K.INBOX_MESSAGE_CHARS} AS cut FROM clean WHERE clean <> ''),
spent(source, ordinal, part, cut, room, taken) AS (
  SELECT source, CAST(-1 AS BIGINT), '', false, CAST({K.INBOX_SESSION_BYTES} AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT source FROM heads)
  UNION ALL
  SELECT source, ordinal, part, cut OR part <> head, room - strlen(part), taken + CAST(part <> '' AS BIGINT) FROM (
    SELECT s.source, h.ordinal, h.head, h.cut, s.room, s.taken, CASE WHEN s.taken >= {K.INBOX_MAX_RECEIPTS} OR s.room = 0 THEN '' WHEN strlen(h.head) <= s.room THEN h.head
      ELSE substr(h.head, 1, CAST(list_max(list_filter(range(0, least(length(h.head), s.room) + 1), lambda i: strlen(substr(h.head, 1, i)) <= s.room)) AS BIGINT)) END AS part
    FROM spent s JOIN heads h ON h.source = s.source AND h.ordinal = s.ordinal + 1)
)"""


@query("inbox_receipts", f"""
WITH RECURSIVE {_HEADS}
SELECT source AS session_id, CAST(ordinal AS BIGINT) AS ordinal, sha256(part) AS message_sha256, cut FROM spent WHERE part <> ''""")
def inbox_receipts(spark, folder):
    docs = table(spark, folder, "documents").filter("source is not null").select("source", "doc_id", "text")
    clean = docs.filter(F.col("text").rlike(r"\S")).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 62))))
    place = F.col("place")
    messages = ranked(clean, ["source"], ["at"], integer_chunks("at"), "place").select(
        F.lit("o").alias("owner_id"), F.col("source").alias("session_id"), F.lit("custom").alias("source"), F.lit("undated").alias("date"),
        F.lit("2026-01-01").cast("timestamp").alias("modified"), place.cast("bigint").alias("ordinal"), "text")
    receipts, _ = review.inbox_receipts(messages)
    return receipts.select("session_id", "ordinal", "message_sha256", "cut")


# Conversations as files of one line a turn, seven folders of them; what sub-agents wrote is left out.
@query("discovered_logs", """
WITH l AS (SELECT conv_id, turn, role, text, conv_id % 7 AS folder, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, turn) - 1 AS line FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY folder ORDER BY line) - 1 AS place, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_hash
FROM l WHERE role = 'user' AND trim(text) <> '' AND folder <> 6 AND turn % 5 <> 1 AND turn % 7 <> 2 AND turn % 11 <> 3""")
def discovered_logs(spark, folder):
    root, turn = f"{_folder(spark)}/.claude/projects", F.col("turn")
    record = F.struct(
        F.when(F.col("role") == "user", "user").otherwise("assistant").alias("type"),
        F.concat(F.lit("2026-03-01T10:00:00Z "), F.col("conv_id").cast("string"), F.lit(" "), turn.cast("string")).alias("timestamp"),
        F.struct("role", F.concat(F.col("conv_id").cast("string"), F.lit(" "), turn.cast("string"), F.lit(" "), F.col("text")).alias("content")).alias("message"),
        F.when(turn % 5 == 1, True).alias("isSidechain"), F.when(turn % 7 == 2, "ran").alias("toolUseResult"), F.when(turn % 11 == 3, F.struct(
            F.lit("machine").alias("kind"))).alias("origin"))
    lines = table(spark, folder, "conversations").select("conv_id", "turn", (F.col("conv_id") % 7).alias("folder"), F.to_json(record).alias("value"))

    def write(rows, path):
        placed = rows.repartition("folder").sortWithinPartitions("folder", "conv_id", "turn")
        # One column without quoting is a file of lines; only this writer can name them as logs are named.
        placed.select("folder", "value").write.option("extension", "jsonl").option("quote", "").option("sep", "\x01").option(
            "ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").partitionBy("folder").csv(path)

    write(lines.filter("folder <> 6"), f"{root}/p")
    write(lines.filter("folder = 6"), f"{root}/subagents")
    found = logs.extract_messages(logs.read_lines(spark, [root, f"{root}/", root]))
    said = found.select("file_path", "block_start", "line_id", F.regexp_extract("text", r"^(\d+) ", 1).cast("bigint").alias("conv_id"),
                        F.regexp_extract("text", r"^\d+ (\d+) ", 1).cast("bigint").alias("turn"), F.regexp_replace("text", r"^\d+ \d+ \s*", "").alias("said"))
    order = Window.partitionBy("file_path").orderBy("block_start", "line_id")
    placed = said.filter("said <> ''").withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
    return placed.select("conv_id", "turn", "place", sha256(F.col("said")).alias("text_hash"))


@query("stats_report", f"""
WITH {CONV_SQL}, {CONV_KEPT}, {MINED}
SELECT owner_id, count(DISTINCT session_id) AS sessions, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM mined GROUP BY owner_id""")
def stats_report(spark, folder):
    """Statistics written as JSON and read again."""
    path = _folder(spark)
    stats = corpus.corpus_stats(corpus.mine(conversation_messages(spark, folder)))
    sink.write_json(stats, path)
    return spark.read.schema(stats.schema).json(path).select("owner_id", "sessions", "messages", "chars")


# --- record contracts --------------------------------------------------------------

# Every event is a record; its number modulo the number of faults says which clause it breaks.
_CHECKPOINT_FAULTS = ["schema", "path-hash", "source", "identity", "unchanged-since", "fingerprint"]


def _expected(faults, number):
    return f"CASE {number} % {len(faults) + 3} " + " ".join(f"WHEN {n} THEN '{f}'" for n, f in enumerate(faults)) + " END"


@query("checkpoint_errors", f"SELECT event_id, {_expected(_CHECKPOINT_FAULTS, 'event_id')} AS error FROM events")
def checkpoint_errors(spark, folder):
    n = F.col("event_id") % (len(_CHECKPOINT_FAULTS) + 3)

    def bent(code, other, usual):
        return F.when(n == _CHECKPOINT_FAULTS.index(code), other).otherwise(usual)

    rows = table(spark, folder, "events").select(
        "event_id", bent("schema", F.lit("other/v1"), F.lit(review.schema_name("checkpoint"))).alias("schema_version"),
        bent("path-hash", F.lit("abc"), sha256(F.col("event_id").cast("string"))).alias("path_hash"),
        bent("source", F.lit("pigeon"), F.lit("codex")).alias("source"),
        F.struct(F.col("event_id").alias("size"), bent("identity", F.lit(-1), F.lit(5)).cast("bigint").alias("mtime_ns")).alias("identity"),
        bent("unchanged-since", F.lit(-1), F.lit(0)).alias("unchanged_since"),
        bent("fingerprint", F.lit("abc"), F.when(n == 7, sha256(F.lit("f")))).alias("processed_fingerprint"))
    return rows.select("event_id", review.checkpoint_error().alias("error"))


_DECISION_FAULTS = ["schema", "decision-id", "candidate-id", "decision", "reason", "policy-class", "decided-at", "identity"]


@query("decision_errors", f"SELECT event_id, {_expected(_DECISION_FAULTS, 'event_id')} AS error FROM events")
def decision_errors(spark, folder):
    n = F.col("event_id") % (len(_DECISION_FAULTS) + 3)

    def bent(code, other, usual):
        return F.when(n == _DECISION_FAULTS.index(code), F.lit(other)).otherwise(usual)

    named = table(spark, folder, "events").select(
        "event_id", bent("schema", "other/v1", F.lit(review.schema_name("decision"))).alias("schema_version"),
        bent("candidate-id", "cand_x", F.concat(F.lit("cand_"), F.substring(sha256(F.col("event_id").cast("string")), 1, 20))).alias("candidate_id"),
        bent("decision", "maybe", F.lit("approve")).alias("decision"), bent("reason", "Because!", F.lit("because")).alias("reason"),
        bent("policy-class", "wild", F.lit("safe")).alias("policy_class"), bent("decided-at", "2026-02-30T00:00:00Z", F.lit("2026-02-03T00:00:00Z")).alias("decided_at"))
    # Written by hand, so that the rule under test does not name the records it tests.
    text = F.concat(*[x for c in ("candidate_id", "decided_at", "decision", "policy_class", "reason", "schema_version")
                      for x in (F.lit(("{" if c == "candidate_id" else ",") + f'"{c}":"'), F.col(c), F.lit('"'))], F.lit("}"))
    ident = F.concat(F.lit("dec_"), F.substring(sha256(text), 1, 20))
    rows = named.withColumn("decision_id", bent("decision-id", "dec_1", F.when(n == _DECISION_FAULTS.index("identity"), F.lit("dec_" + "0" * 20)).otherwise(ident)))
    return rows.select("event_id", review.decision_error().alias("error"))


_GENERATION_FAULTS = ["schema", "generation-id", "parent-id", "operation", "candidate-order", "candidate-ids", "domains", "created-at", "identity"]


@query("generation_errors", f"SELECT event_id, {_expected(_GENERATION_FAULTS, 'event_id')} AS error FROM events")
def generation_errors(spark, folder):
    n = F.col("event_id") % (len(_GENERATION_FAULTS) + 3)

    def bent(code, other, usual):
        return F.when(n == _GENERATION_FAULTS.index(code), other).otherwise(usual)

    names = F.sort_array(F.array(*[F.concat(F.lit("cand_"), F.substring(sha256(F.concat(F.col("event_id").cast("string"), F.lit(x))), 1, 20)) for x in "ab"]))
    rows = table(spark, folder, "events").select(
        "event_id", bent("schema", F.lit("other/v1"), F.lit(review.schema_name("generation"))).alias("schema_version"),
        bent("parent-id", F.lit("gen_x"), F.when(n == 10, F.concat(F.lit("gen_"), F.lit("a" * 20)))).alias("parent_generation_id"),
        bent("operation", F.lit("undo"), F.lit("activate")).alias("operation"),
        bent("candidate-order", F.reverse(names), bent("candidate-ids", F.array(F.lit("cand_1")), names)).alias("candidate_ids"),
        bent("created-at", F.lit("soon"), F.lit("2026-02-03T00:00:00Z")).alias("created_at"),
        F.array(F.struct(bent("domains", F.lit("notes"), F.lit("work.md")).alias("artifact"), F.lit("work").alias("domain"), sha256(F.lit("w")).alias("sha256"))).alias("domains"))
    parent = F.coalesce(F.concat(F.lit('"'), F.col("parent_generation_id"), F.lit('"')), F.lit("null"))
    text = F.concat(
        F.lit('{"candidate_ids":["'), F.array_join("candidate_ids", '","'), F.lit('"],"created_at":"'), F.col("created_at"), F.lit('","domains":{"work":{"artifact":"'),
        F.col("domains")[0]["artifact"], F.lit('","sha256":"'), F.col("domains")[0]["sha256"], F.lit('"}},"operation":"'), F.col("operation"),
        F.lit('","parent_generation_id":'), parent, F.lit(',"schema_version":"'), F.col("schema_version"), F.lit('"}'))
    ident = F.concat(F.lit("gen_"), F.substring(sha256(text), 1, 20))
    named = rows.withColumn("generation_id", bent("generation-id", F.lit("gen_1"), F.when(
        n == _GENERATION_FAULTS.index("identity"), F.lit("gen_" + "0" * 20)).otherwise(ident)))
    return named.select("event_id", review.generation_error().alias("error"))
