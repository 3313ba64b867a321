"""Usage report and quote trace queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from turnmill import constants as K
from turnmill.functions import identity as I, markers as M, text as T
from turnmill.operators.ordered import integer_chunks, previous, ranked
from turnmill.plans import trace, usage
from turnmill.queries import sqltext as S
from turnmill.queries.inputs import DOCS_SQL, document_messages
from turnmill.queries.registry import query, table
from turnmill.session import materialize

# Events become short prompts: every type has its own wording, and every user is a session.
_PROMPTS = {
    "click": "please run the click job again now", "view": "no, that is the wrong view of it",
    "signup": "as i said the signup page must stay", "purchase": "ok do it", "error": "Please run the error job again, now please!",
}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PROMPTS.items()) + " END"
PROMPTS_SQL = f"""
prompts AS (
  SELECT 'u' || (user_id % 2) AS owner_id, 's' || user_id AS session_id, 'custom' AS source,
         strftime(ts, '%Y-%m-%d') AS date, event_id AS line_id,
         {_CASE} || CASE WHEN event_id % 4 = 0 THEN '  !' WHEN event_id % 9 = 0 THEN ' ok' ELSE '' END AS text,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal
  FROM events
)"""


def prompts(spark, folder):
    rows = table(spark, folder, "events")
    base = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _PROMPTS.items()])
    tail = F.when(F.col("event_id") % 4 == 0, "  !").when(F.col("event_id") % 9 == 0, " ok").otherwise("")
    messages = rows.select(
        F.concat(F.lit("u"), (F.col("user_id") % 2).cast("string")).alias("owner_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.lit("custom").alias("source"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("line_id"), F.concat(base, tail).alias("text"))
    placed = ranked(messages, ["owner_id", "session_id"], ["line_id"], integer_chunks("line_id"), "ordinal")
    return materialize(placed.withColumn("ordinal", F.col("ordinal").cast("int")), "prompts")


_WORDS = S.usage_words("text")
_LINES = "length(text) - length(replace(text, chr(10), ''))"
_OVERLAP = "len(list_intersect(a.words, b.words)) >= 0.75 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))"
FINDINGS_SQL = f"""
live AS (
  SELECT *, row_number() OVER (PARTITION BY owner_id, session_id ORDER BY ordinal) - 1 AS place FROM (
    SELECT *, {S.usage_form('text')} AS normal, {_WORDS} AS words, {_LINES} AS breaks, {S.collapse('text')} AS quote FROM prompts)
  WHERE normal <> ''
),
paired AS (
  SELECT b.*, coalesce(a.normal = b.normal, false) AS same,
         coalesce(a.normal <> b.normal AND a.breaks <= 4 AND b.breaks <= 4 AND len(a.words) >= 6 AND len(b.words) >= 6 AND {_OVERLAP}, false) AS close
  FROM live b LEFT JOIN live a ON a.owner_id = b.owner_id AND a.session_id = b.session_id AND a.place = b.place - 1
),
numbered AS (
  SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER w AS repeat_run, sum(CASE WHEN close THEN 0 ELSE 1 END) OVER w AS reword_run
  FROM paired WINDOW w AS (PARTITION BY owner_id, session_id ORDER BY place)
),
repeats AS (
  SELECT owner_id, session_id, min(date) AS date, min(ordinal) AS ordinal, arg_min(quote, ordinal) AS text, count(*) AS n,
         arg_min(len(words), ordinal) AS word_count FROM numbered GROUP BY owner_id, session_id, repeat_run
),
rewords AS (
  SELECT owner_id, session_id, min(date) AS date, min(ordinal) AS ordinal, arg_min(quote, ordinal) AS text, count(*) AS n
  FROM numbered GROUP BY owner_id, session_id, reword_run
),
findings AS (
  SELECT owner_id, 'repeat_sends' AS finding, session_id, date, ordinal, text, '' AS marker, n FROM repeats WHERE n >= 3 AND word_count >= 4
  UNION ALL SELECT owner_id, 'reword_loops', session_id, date, ordinal, text, '', n FROM rewords WHERE n >= 3
  UNION ALL SELECT owner_id, 'restated_context', session_id, date, ordinal, quote,
    CASE {' '.join(f"WHEN contains(normal, {S.quote(m)}) THEN {S.quote(m)}" for m in K.RESTATED_MARKERS)} END, 1
    FROM live WHERE {S.contains_any('normal', K.RESTATED_MARKERS)}
  UNION ALL SELECT owner_id, 'corrections', session_id, date, ordinal, quote, '', 1 FROM live
    WHERE {S.starts_any('normal', K.CORRECTION_OPENERS)} AND NOT {S.starts_any('normal', K.CORRECTION_EXCLUSIONS)}
)"""


@query("usage_findings", f"""
WITH {PROMPTS_SQL}, {FINDINGS_SQL}
SELECT owner_id, finding, session_id, date, CAST(ordinal AS BIGINT) AS ordinal, text, marker, CAST(n AS BIGINT) AS n FROM findings""")
def usage_findings(spark, folder):
    return usage.findings(prompts(spark, folder)).select(
        "owner_id", "finding", "session_id", "date", F.col("ordinal").cast("bigint").alias("ordinal"), "text", "marker",
        F.col("count").alias("n"))


@query("usage_report", f"""
WITH {PROMPTS_SQL}, {FINDINGS_SQL},
keys AS (SELECT * FROM (SELECT owner_id, count(*) AS messages FROM prompts GROUP BY owner_id),
         unnest(['repeat_sends', 'restated_context', 'reword_loops', 'corrections']) k(finding)),
counted AS (SELECT k.owner_id, k.finding, k.messages, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS occurrences
            FROM keys k LEFT JOIN findings f USING (owner_id, finding) GROUP BY ALL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, finding, text ORDER BY n DESC, date, session_id, ordinal) AS c
           FROM findings) WHERE c = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, finding ORDER BY n DESC, date, session_id, ordinal) AS r
         FROM firsts) WHERE r <= 3)
SELECT c.owner_id, c.finding, c.occurrences,
       CASE c.finding WHEN 'restated_context' THEN occurrences >= 3 WHEN 'corrections' THEN 100 * occurrences // messages >= 5
         ELSE occurrences > 0 END AS flagged,
       coalesce((SELECT string_agg(b.n || ' ' || b.date || ' ' || b.session_id || ' ' || b.text, ' | ' ORDER BY r) FROM best b
         WHERE b.owner_id = c.owner_id AND b.finding = c.finding), '') AS samples
FROM counted c""")
def usage_report(spark, folder):
    messages = prompts(spark, folder)
    found = materialize(usage.findings(messages), "findings")
    shown = F.transform("receipts", lambda r: F.concat_ws(" ", r["count"].cast("string"), r["date"], r["session_id"], r["text"]))
    return usage.report(messages, found).select("owner_id", "finding", "occurrences", "flagged", F.array_join(shown, " | ").alias("samples"))


@query("usage_totals", f"""
WITH {PROMPTS_SQL}, counted AS (SELECT *, len({_WORDS}) AS words FROM prompts),
placed AS (SELECT owner_id, words, row_number() OVER (PARTITION BY owner_id ORDER BY words) - 1 AS r, count(*) OVER (PARTITION BY owner_id) AS n FROM counted)
SELECT owner_id, count(DISTINCT session_id) AS sessions, count(*) AS messages, min(date) AS first_date, max(date) AS last_date,
       count(*) FILTER (words <= 5) AS short_prompts,
       (SELECT CAST(min(p.words) AS BIGINT) FROM placed p WHERE p.owner_id = counted.owner_id AND p.r = p.n // 2) AS median_words
FROM counted GROUP BY owner_id""")
def usage_totals(spark, folder):
    return usage.totals(prompts(spark, folder)).withColumn("median_words", F.col("median_words").cast("bigint"))


@query("document_usage_totals", f"""
WITH {DOCS_SQL}, counted AS (SELECT *, len({_WORDS}) AS words FROM docs),
placed AS (SELECT owner_id, words, row_number() OVER (PARTITION BY owner_id ORDER BY words) - 1 AS r, count(*) OVER (PARTITION BY owner_id) AS n FROM counted)
SELECT owner_id, count(DISTINCT session_id) AS sessions, count(*) AS messages, min(nullif(date, 'undated')) AS first_date,
       max(nullif(date, 'undated')) AS last_date, count(*) FILTER (words <= 5) AS short_prompts,
       (SELECT CAST(min(p.words) AS BIGINT) FROM placed p WHERE p.owner_id = counted.owner_id AND p.r = p.n // 2) AS median_words
FROM counted GROUP BY owner_id""")
def document_usage_totals(spark, folder):
    return usage.totals(document_messages(spark, folder)).withColumn("median_words", F.col("median_words").cast("bigint"))


@query("sessions_by_source", f"""
WITH {DOCS_SQL} SELECT owner_id, source, count(DISTINCT session_id) AS sessions FROM docs GROUP BY owner_id, source""")
def sessions_by_source(spark, folder):
    return usage.sessions_by_source(document_messages(spark, folder))


@query("message_runs", f"""
WITH {PROMPTS_SQL}, {FINDINGS_SQL}
SELECT owner_id, session_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(repeat_run AS BIGINT) AS repeat_run,
       CAST(reword_run AS BIGINT) AS reword_run FROM numbered""")
def message_runs(spark, folder):
    return usage.message_runs(prompts(spark, folder)).select(
        "owner_id", "session_id", F.col("ordinal").cast("bigint").alias("ordinal"), "repeat_run", "reword_run")


@query("adjacent_overlap", f"""
WITH w AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, {_WORDS} AS words FROM documents)
SELECT b.source, b.doc_id, round(len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 9) AS overlap
FROM w b LEFT JOIN w a ON a.source = b.source AND a.place = b.place - 1""")
def adjacent_overlap(spark, folder):
    rows = table(spark, folder, "documents").select("source", "doc_id", T.usage_words(F.col("text")).alias("words"))
    placed = ranked(rows, ["source"], ["doc_id"], integer_chunks("doc_id"), "place")
    paired = previous(placed, ["source"], "place", {"prior": "words"})
    return paired.select("source", "doc_id", F.round(T.overlap(F.col("prior"), F.col("words")), 9).alias("overlap"))


@query("marker_flags", f"""
WITH n AS (SELECT conv_id, turn, {S.usage_form("CASE WHEN turn % 3 = 0 THEN 'No, ' || text WHEN turn % 3 = 1 THEN text || ' as I said.' ELSE 'no need ' || text END")} AS normal FROM conversations)
SELECT conv_id, turn, CASE {' '.join(f"WHEN contains(normal, {S.quote(m)}) THEN {S.quote(m)}" for m in K.RESTATED_MARKERS)} END AS marker,
       {S.starts_any('normal', K.CORRECTION_OPENERS)} AND NOT {S.starts_any('normal', K.CORRECTION_EXCLUSIONS)} AS corrects FROM n""")
def marker_flags(spark, folder):
    t, n = F.col("text"), F.col("turn") % 3
    said = F.when(n == 0, F.concat(F.lit("No, "), t)).when(n == 1, F.concat(t, F.lit(" as I said."))).otherwise(
        F.concat(F.lit("no need "), t))
    rows = table(spark, folder, "conversations").withColumn("normal", T.usage_form(said))
    return rows.select("conv_id", "turn", M.restated_marker(F.col("normal")).alias("marker"), M.is_correction(F.col("normal")).alias("corrects"))


# A profile quotes a document's sentences: straight marks around every second one, curly marks around the title line.
_PROFILE = r"""
profiles AS (
  SELECT 'u' || ((doc_id // 5) % 3) AS owner_id, doc_id AS profile_id,
         regexp_replace(regexp_replace(text, '\. ([^\n.]+)\. ', '. "\1". ', 'g'), '^([^\n.]+)', '“\1”') AS text
  FROM documents WHERE trim(text) <> ''
)"""


def profiles(spark, folder):
    quoted = F.regexp_replace(F.regexp_replace("text", r"\. ([^\n.]+)\. ", '. "$1". '), r"^([^\n.]+)", "“$1”")
    return table(spark, folder, "documents").filter("trim(text) != ''").select(
        F.concat(F.lit("u"), (F.floor(F.col("doc_id") / 5) % 3).cast("string")).alias("owner_id"),
        F.col("doc_id").alias("profile_id"), quoted.alias("text"))


_SPANS = rf""",
spans AS (
  SELECT owner_id, profile_id, raw, place FROM (
    SELECT owner_id, profile_id, unnest(all_spans) AS raw, generate_subscripts(all_spans, 1) AS place FROM (
      SELECT owner_id, profile_id, list_concat(
        regexp_extract_all(text, '{K.CURLY_QUOTE}', 1),
        flatten(list_transform(string_split(regexp_replace(text, '{K.CURLY_QUOTE}', ' ', 'g'), chr(10)),
          lambda line: list_filter(string_split(line, '"'), lambda v, i: (i - 1) % 2 = 1 AND i - 1 <= len(string_split(line, '"')) - 2)))) AS all_spans
      FROM profiles))
),
candidates AS (SELECT owner_id, profile_id, place, {S.strip('raw')} AS quote FROM spans),
kept AS (SELECT *, {S.quote_form('quote')} AS needle FROM candidates
  WHERE len(string_split({S.collapse('quote')}, ' ')) >= 4 AND regexp_matches(quote, '^[\p{{L}}\p{{N}}''’]') AND NOT contains(quote, '**') AND NOT contains(quote, '`')),
quotes AS (SELECT owner_id, profile_id, needle, arg_min(quote, place) AS quote FROM kept GROUP BY ALL)"""
QUOTES_SQL = _PROFILE + _SPANS
# In every seventh profile the title quote was never said.
_GARBLED = _PROFILE.replace("'“\\1”'", "CASE WHEN doc_id % 7 = 0 THEN '“\\1 zzqx”' ELSE '“\\1”' END")


@query("extract_quotes", f"WITH {QUOTES_SQL} SELECT owner_id, profile_id, quote, sha256(needle) AS needle_hash FROM quotes")
def extract_quotes(spark, folder):
    return trace.extract_quotes(profiles(spark, folder)).select(
        "owner_id", "profile_id", "quote", I.sha256(F.col("needle")).alias("needle_hash"))


_HAY = S.quote_form("'[' || date || '] ' || text")
# A session is searched as one text, and every eleventh profile quotes the end of a document and the start of the next.
_HAY_SQL = f"hay AS (SELECT owner_id, session_id, string_agg({_HAY}, ' ' ORDER BY line_id) AS t FROM docs GROUP BY owner_id, session_id)"
_CROSSING = f"""
crossing AS (
  SELECT owner_id, doc_id AS profile_id, '“' || left(right(h, 30) || ' ' || lead(h) OVER (PARTITION BY session_id ORDER BY line_id), 90) || ' ”' AS text
  FROM (SELECT *, regexp_replace({_HAY}, '[“”"*`]', '', 'g') AS h FROM docs)
)"""


def crossing(messages):
    """Quotes of the last 30 characters of a message and the first of the next one in its session, in normal form."""
    shown = T.quote_form(F.concat(F.lit("["), F.col("date"), F.lit("] "), F.col("text")))
    rows = messages.withColumn("h", F.regexp_replace(shown, '[“”"*`]', ""))
    # Sessions of the documents are five messages long.
    following = F.lead("h").over(Window.partitionBy("owner_id", "session_id").orderBy("ordinal"))
    text = F.concat(F.lit("“"), F.left(F.concat(F.right("h", F.lit(30)), F.lit(" "), following), F.lit(90)), F.lit(" ”"))
    return rows.select("owner_id", (F.col("file_path").cast("bigint") * 5 + F.col("ordinal")).alias("profile_id"), text.alias("text"))


@query("quote_trace", f"""
WITH {DOCS_SQL}, {_GARBLED.replace('profiles AS', 'titles AS')}, {_CROSSING},
profiles AS (SELECT * FROM titles UNION ALL SELECT * FROM crossing WHERE profile_id % 11 = 0 AND text IS NOT NULL){_SPANS}, {_HAY_SQL},
found AS (SELECT q.owner_id, q.profile_id, q.needle, count(DISTINCT h.session_id) AS sessions
          FROM quotes q LEFT JOIN hay h ON h.owner_id = q.owner_id AND contains(h.t, q.needle) GROUP BY ALL)
SELECT owner_id, profile_id, count(*) AS quotes_checked, count(*) FILTER (sessions = 0) AS unsupported, count(*) FILTER (sessions = 1) AS single_session
FROM found GROUP BY owner_id, profile_id""")
def quote_trace(spark, folder):
    garbled = F.when(F.col("profile_id") % 7 == 0, F.regexp_replace("text", "^“([^”]*)”", "“$1 zzqx”")).otherwise(F.col("text"))
    messages = document_messages(spark, folder).withColumnRenamed("line_id", "ordinal")
    across = crossing(messages).filter((F.col("profile_id") % 11 == 0) & F.col("text").isNotNull())
    texts = profiles(spark, folder).withColumn("text", garbled).unionByName(across)
    quotes = materialize(trace.extract_quotes(texts), "quotes")
    # A needle that many profiles quote is traced once, not once for each of them.
    found = trace.trace(quotes.select("owner_id", "needle").distinct(), messages)
    return trace.trace_summary(trace.trace_results(quotes, found))


@query("benchmark_spans", f"""
WITH hay AS (SELECT doc_id, {S.quote_form('text')} AS t FROM documents)
SELECT b.item_id, d.doc_id FROM benchmark b JOIN hay d ON contains(d.t, {S.quote_form('b.text')})""")
def benchmark_spans(spark, folder):
    items = table(spark, folder, "benchmark").select(
        F.lit("all").alias("owner_id"), "item_id", T.quote_form(F.col("text")).alias("needle"))
    texts = table(spark, folder, "documents").select(
        F.lit("all").alias("owner_id"), "doc_id", T.quote_form(F.col("text")).alias("haystack"))
    return trace.find_spans(items, texts, ["doc_id"]).join(items, ["owner_id", "needle"]).select("item_id", "doc_id")


@query("benchmark_trace_summary", f"""
WITH {DOCS_SQL}, {_HAY_SQL},
owners AS (SELECT DISTINCT owner_id FROM docs),
q AS (SELECT 'u' || (item_id % 3) AS owner_id, item_id, {S.quote_form('text')} AS needle FROM benchmark),
found AS (SELECT q.owner_id, q.item_id, count(DISTINCT h.session_id) AS sessions
          FROM q LEFT JOIN hay h ON h.owner_id = q.owner_id AND contains(h.t, q.needle) GROUP BY ALL)
SELECT owner_id, count(*) AS quotes_checked, count(*) FILTER (sessions = 0) AS unsupported, count(*) FILTER (sessions = 1) AS single_session
FROM found GROUP BY owner_id""")
def benchmark_trace_summary(spark, folder):
    needle = T.quote_form(F.col("text"))
    quotes = table(spark, folder, "benchmark").select(
        F.concat(F.lit("u"), (F.col("item_id") % 3).cast("string")).alias("owner_id"), F.col("item_id").alias("profile_id"),
        needle.alias("needle"))
    messages = document_messages(spark, folder).withColumnRenamed("line_id", "ordinal")
    results = trace.trace_results(quotes, trace.trace(quotes, messages))
    return trace.trace_summary(results.withColumn("profile_id", F.lit(0))).drop("profile_id")
