"""Source queries: conversations written out as log lines in each dialect, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.operators.ordered import running
from turnmill.plans import corpus
from turnmill.queries.inputs import CONV_SQL, conversation_messages
from turnmill.queries.registry import query, table
from turnmill.session import materialize
from turnmill.sources import corpus_text, logs, opencode

_PATHS = {0: "/h/.codex/sessions", 1: "/h/.claude/projects/p", 2: "/h/.copilot/session-state", 3: "/h/antigravity/brain", 4: "/h/logs"}
_NAMES = {0: "codex", 1: "claude", 2: "copilot", 3: "antigravity", 4: "custom"}
_CASE = "CASE conv_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _PATHS.items()) + " END"
_SOURCE = "CASE conv_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _NAMES.items()) + " END"


def log_lines(spark, folder):
    """One log file per conversation; every seventh line is cut off before its end."""
    c, user, text = F.col("conv_id") % 5, F.col("role") == "user", F.col("text")
    stamp = F.lit("2026-03-01T10:00:00Z").alias("timestamp")
    content = F.array(F.struct(text.alias("text")))
    codex = F.struct(F.lit("response_item").alias("type"), stamp, F.struct(
        F.lit("message").alias("type"), "role", content.alias("content")).alias("payload"))
    claude = F.struct(F.when(user, "user").otherwise("assistant").alias("type"), stamp, F.struct("role", text.alias("content")).alias("message"),
                      (F.col("turn") % 8 == 0).alias("isMeta"))
    copilot = F.struct(F.lit("user.message").alias("type"), stamp, F.struct(
        text.alias("content"), F.when(user, "typed").otherwise("system").alias("source")).alias("data"))
    wrapped = F.concat(F.lit("<USER_REQUEST>\n"), text, F.lit("\n</USER_REQUEST><ADDITIONAL_METADATA>now</ADDITIONAL_METADATA>"))
    typed = F.struct(F.lit("USER_INPUT").alias("type"), F.when(user, "USER_EXPLICIT").otherwise("MODEL").alias("source"),
                     F.lit("2026-03-02").alias("created_at"), wrapped.alias("content"))
    plain = F.struct(F.lit("message").alias("type"), "role", F.lit("soon").alias("timestamp"), text.alias("content"))
    line = F.when(c == 0, F.to_json(codex)).when(c == 1, F.to_json(claude)).when(c == 2, F.to_json(copilot)).when(
        c == 3, F.to_json(typed)).otherwise(F.to_json(plain))
    folder_name = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in _PATHS.items()])
    return table(spark, folder, "conversations").select(
        F.when((F.col("conv_id") + F.col("turn")) % 7 == 4, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value"),
        F.concat(folder_name, F.lit("/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"), F.col("turn").alias("line_id"), F.lit(None).cast("timestamp").alias("modified"))


@query("extract_messages", f"""
WITH l AS (SELECT *, {_SOURCE} AS source, {_CASE} || '/' || conv_id || '.jsonl' AS path FROM conversations)
SELECT substr(sha256(source || ':' || path), 1, 16) AS session_id, source, turn AS line_id,
       CASE conv_id % 5 WHEN 3 THEN '2026-03-02' WHEN 4 THEN 'undated' ELSE '2026-03-01' END AS date,
       sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_hash
FROM l WHERE role = 'user' AND (conv_id + turn) % 7 <> 4 AND NOT (conv_id % 5 = 1 AND turn % 8 = 0) AND trim(text) <> ''""")
def extract_messages(spark, folder):
    return logs.extract_messages(log_lines(spark, folder)).select(
        "session_id", "source", "line_id", "date", F.sha2("text", 256).alias("text_hash"))


@query("rejected_lines", f"""
SELECT {_CASE} || '/' || conv_id || '.jsonl' AS file_path, count(*) AS rejected FROM conversations
WHERE (conv_id + turn) % 7 = 4 AND (role = 'user' OR conv_id % 5 IN (2, 3)) GROUP BY 1""")
def rejected_lines(spark, folder):
    return logs.rejected_lines(log_lines(spark, folder))


@query("store_tables", """
WITH parts AS (
  SELECT conv_id, turn, role, generate_subscripts(string_split(text, chr(10)), 1) AS part, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT 's' || conv_id AS store_session, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS BIGINT) AS line_id,
       strftime(DATE '2026-01-01' + CAST(turn AS INTEGER), '%Y-%m-%d') AS date, sha256(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS text_hash
FROM parts WHERE role = 'user' AND trim(line) <> ''""")
def store_tables(spark, folder):
    c = table(spark, folder, "conversations").withColumn("id", F.format_string("m%08d-%04d", "conv_id", "turn"))
    start = 1767225600000  # 2026-01-01 in ms
    messages = c.select(
        "id", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        (F.lit(start).cast("bigint") + F.col("turn") * 86_400_000).alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    parts = c.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select(
        F.format_string("p%04d", "n").alias("id"), F.col("id").alias("message_id"), F.col("n").cast("bigint").alias("time_created"),
        F.to_json(F.struct(F.lit("text").alias("type"), F.col("line").alias("text"))).alias("data"))
    read = opencode.messages_from_tables(messages, parts, "/h/opencode/opencode.db")
    return read.select(F.regexp_extract("file_path", "::(.*)$", 1).alias("store_session"), "line_id", "date", F.sha2("text", 256).alias("text_hash"))


@query("corpus_reload", f"""
WITH {CONV_SQL}
SELECT session_id, source, date, sha256(text) AS text_hash FROM conv""")
def corpus_reload(spark, folder):
    messages = materialize(corpus.mine(conversation_messages(spark, folder), dedupe=False, redact=False), "messages")
    header = F.concat(corpus.header_text(), F.lit("\n"))
    block = F.concat(F.when(F.col("ordinal") == 0, header).otherwise(""), corpus.block_text())
    # One corpus file: sessions follow each other in order of their id, so a line's number is a running count.
    lines = messages.select("session_id", "ordinal", F.split(block, "\n").alias("lines")).withColumn("size", F.size("lines").cast("bigint"))
    chunks = [{"head": F.substring("session_id", 1, 4)}, {"head2": F.substring("session_id", 1, 2)}]
    placed = running(lines.withColumn("file_path", F.lit("/h/corpus.txt")), ["file_path"], ["session_id", "ordinal"], chunks,
                     sums={"before": F.col("size")})
    text = placed.select(
        "file_path", F.lit(0).cast("bigint").alias("block_start"), "before", F.posexplode("lines").alias("n", "value")).select(
        "value", "file_path", "block_start", (F.col("before") + F.col("n")).alias("line_id"))
    return corpus_text.messages_from_corpus(text).select("session_id", "source", "date", F.sha2("text", 256).alias("text_hash"))
