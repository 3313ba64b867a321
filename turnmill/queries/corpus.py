"""Corpus queries: noise, redaction, deduplication, sessions, text measures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C, identity as I, stats, text as T
from turnmill.operators.ordered import newest
from turnmill.plans import corpus
from turnmill.queries import sqltext as S
from turnmill.queries.inputs import CONV_SQL, DOCS_SQL, conversation_messages, document_messages
from turnmill.queries.registry import query, table
from turnmill.session import materialize, run_folder
from turnmill.sinks import corpus as sink
from turnmill.sources.corpus_text import messages_from_corpus, read_corpus_lines

# The first copy of a long text stays; sessions are read in order of their number.
KEPT_SQL = """
kept AS (
  SELECT * EXCLUDE (copy) FROM (
    SELECT *, row_number() OVER (PARTITION BY owner_id, {group} ORDER BY {order}) AS copy FROM {source}
  ) WHERE length(text) < 200 OR copy = 1
)"""
CONV_KEPT = KEPT_SQL.format(group="text", order="conv_id, line_id", source="conv")
DOCS_KEPT = KEPT_SQL.format(group="text", order="session_no, line_id", source="docs")
_CLEAN = S.redact("text")
MINED_SQL = """
mined AS (
  SELECT * EXCLUDE (text), clean AS text, clean <> text AS redacted,
         row_number() OVER (PARTITION BY owner_id, session_id ORDER BY line_id) - 1 AS ordinal
  FROM (SELECT *, {clean} AS clean FROM kept)
)"""
MINED = MINED_SQL.format(clean=_CLEAN)
_FOLDS_SQL = ",\n".join(
    f"""fold{n} AS (SELECT owner_id, session_id, source, place // 1024 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest
  FROM (SELECT owner_id, session_id, source, place AS place, digest FROM fold{n - 1}) GROUP BY owner_id, session_id, source, place // 1024)"""
    for n in range(1, 5))
ROLLED_SQL = f"""
fold0 AS (SELECT owner_id, session_id, source, ordinal AS place, sha256('[' || date || ']' || chr(10) || text) AS digest FROM mined),
{_FOLDS_SQL},
rolled AS (
  SELECT m.owner_id, m.session_id, m.source, coalesce(min(nullif(date, 'undated')), 'undated') AS first_date,
         coalesce(max(nullif(date, 'undated')), 'undated') AS last_date, count(*) AS message_count,
         CAST(greatest(1, sum(length(date) + length(text) + 3) // 4) AS BIGINT) AS tokens,
         sha256('===== session:' || m.session_id || ' source:' || m.source || ' =====' || chr(10) || any_value(f.digest)) AS content_hash
  FROM mined m JOIN fold4 f USING (owner_id, session_id, source) GROUP BY m.owner_id, m.session_id, m.source
)"""


@query("corpus_stats", f"""
WITH {CONV_SQL}, {CONV_KEPT}, {MINED}
SELECT owner_id, count(DISTINCT session_id) AS sessions, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars,
       count(*) FILTER (redacted) AS redactions, coalesce(min(nullif(date, 'undated')), '') AS first_date,
       coalesce(max(nullif(date, 'undated')), '') AS last_date, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens
FROM mined GROUP BY owner_id""")
def corpus_stats(spark, folder):
    return corpus.corpus_stats(corpus.mine(conversation_messages(spark, folder)))


@query("document_corpus_stats", f"""
WITH {DOCS_SQL}, {DOCS_KEPT}, {MINED}
SELECT owner_id, count(DISTINCT session_id) AS sessions, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars,
       count(*) FILTER (redacted) AS redactions, coalesce(min(nullif(date, 'undated')), '') AS first_date,
       coalesce(max(nullif(date, 'undated')), '') AS last_date, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens,
       (SELECT count(*) FROM docs d WHERE d.owner_id = mined.owner_id) - count(*) AS duplicates
FROM mined GROUP BY owner_id""")
def document_corpus_stats(spark, folder):
    messages = document_messages(spark, folder)
    return corpus.corpus_stats(corpus.mine(messages), corpus.count_duplicates(messages))


@query("session_rollup", f"""
WITH {CONV_SQL}, {CONV_KEPT}, {MINED}, {ROLLED_SQL}
SELECT owner_id, session_id, source, first_date, last_date, message_count, tokens, content_hash FROM rolled""")
def session_rollup(spark, folder):
    mined = materialize(corpus.mine(conversation_messages(spark, folder)), "messages")
    return corpus.roll_up(mined).select(
        "owner_id", "session_id", "source", "first_date", "last_date", "message_count", "tokens", "content_hash")


@query("extended_hashes", f"""
WITH {CONV_SQL}, {CONV_KEPT}, {MINED}, {ROLLED_SQL}
SELECT owner_id, session_id, source, content_hash FROM rolled""")
def extended_hashes(spark, folder):
    """Sessions hashed in three appends: every message is hashed once, and the last append of a session gives its hash."""
    mined = materialize(corpus.mine(conversation_messages(spark, folder)), "messages")
    stored, latest = None, None
    for n, part in enumerate((F.col("ordinal") < 1, (F.col("ordinal") >= 1) & (F.col("ordinal") < 3), F.col("ordinal") >= 3)):
        hashes, stored = corpus.extend_hashes(mined.filter(part), stored)
        marked = hashes.withColumn("append", F.lit(n))
        latest = marked if latest is None else latest.unionByName(marked)
    return newest(latest, ["owner_id", "session_id", "source"], ["append"]).drop("append")


_BACK = f"""
WITH {CONV_SQL}, {CONV_KEPT}, {MINED}
SELECT session_id, source, date, sha256(text) AS text_hash FROM mined"""


def _read_back(spark, path):
    return messages_from_corpus(read_corpus_lines(spark, path)).select("session_id", "source", "date", I.sha256(F.col("text")).alias("text_hash"))


@query("corpus_files", _BACK)
def corpus_files(spark, folder):
    """The corpus written to files, and the messages read back from them."""
    path = f"{run_folder(spark)}/corpus-{uuid.uuid4().hex}"
    sink.write_corpus(materialize(corpus.mine(conversation_messages(spark, folder)), "messages"), path)
    return _read_back(spark, path)


@query("chunk_files", _BACK)
def chunk_files(spark, folder):
    path = f"{run_folder(spark)}/chunks-{uuid.uuid4().hex}"
    sink.write_chunks(materialize(corpus.mine(conversation_messages(spark, folder)), "messages"), path)
    return _read_back(spark, path)


@query("dedupe_long", f"""
WITH {DOCS_SQL}, {DOCS_KEPT}
SELECT owner_id, session_id, line_id, sha256(text) AS text_hash FROM kept""")
def dedupe_long(spark, folder):
    return corpus.dedupe_long(document_messages(spark, folder)).select(
        "owner_id", "session_id", "line_id", I.sha256(F.col("text")).alias("text_hash"))


@query("message_ordinals", f"""
WITH {DOCS_SQL}, {DOCS_KEPT}
SELECT owner_id, session_id, line_id,
       CAST(row_number() OVER (PARTITION BY owner_id, session_id ORDER BY line_id) - 1 AS BIGINT) AS ordinal FROM kept""")
def message_ordinals(spark, folder):
    kept = corpus.number_messages(corpus.dedupe_long(document_messages(spark, folder)))
    return kept.select("owner_id", "session_id", "line_id", F.col("ordinal").cast("bigint").alias("ordinal"))


@query("redact_documents", f"""
SELECT doc_id, sha256(clean) AS clean_hash, clean <> text AS redacted FROM (SELECT doc_id, text, {_CLEAN} AS clean FROM documents)""")
def redact_documents(spark, folder):
    clean = T.redact(F.col("text"))
    return table(spark, folder, "documents").withColumn("clean", clean).select(
        "doc_id", I.sha256(F.col("clean")).alias("clean_hash"), (F.col("clean") != F.col("text")).alias("redacted"))


@query("redact_pages", f"""
SELECT page_id, sha256(clean) AS clean_hash, clean <> html AS redacted FROM (SELECT page_id, html, {S.redact('html')} AS clean FROM pages)""")
def redact_pages(spark, folder):
    return table(spark, folder, "pages").withColumn("clean", T.redact(F.col("html"))).select(
        "page_id", I.sha256(F.col("clean")).alias("clean_hash"), (F.col("clean") != F.col("html")).alias("redacted"))


_RULES = [(f"{n:02d} {r}", p) for n, (p, r) in enumerate(K.REDACTION_RULES, 1)]
_SQL_RULES = [(name, S.PHONE if name.endswith("[PHONE]") else p.replace("(?U)", "").replace("(?iU)", "(?i)"))
              for name, p in _RULES]


@query("redaction_rule_hits", " UNION ALL ".join(
    f"SELECT {S.quote(name)} AS rule, count(*) AS hits, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars "
    f"FROM documents WHERE regexp_matches(text, {S.quote(p)})" for name, p in _SQL_RULES))
def redaction_rule_hits(spark, folder):
    # One pass: every document lists the rules it meets, and the empty rules come from the same listing.
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.col("text").rlike(p).alias("hit")) for n, p in _RULES])
    rows = table(spark, folder, "documents").select(F.length("text").alias("n"), F.inline(hits))
    return rows.groupBy("rule").agg(
        F.count_if("hit").alias("hits"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).cast("bigint").alias("chars"))


# Documents have no harness noise, so a share of them gets some, by document number.
_NOISY_SQL = r"""
noisy AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  <summary>' || text
    WHEN doc_id % 13 = 0 THEN replace(text, '. ', '.' || chr(10) || '    at app.run ')
    WHEN doc_id % 7 = 0 THEN replace(text, ', ', chr(10) || 'main.py:7 ')
    ELSE text END AS text FROM documents
)"""


def _noisy(spark, folder):
    n, text = F.col("doc_id"), F.col("text")
    noisy = (
        F.when(n % 11 == 0, F.concat(F.lit("  <summary>"), text))
        .when(n % 13 == 0, F.replace(text, F.lit(". "), F.lit(".\n    at app.run ")))
        .when(n % 7 == 0, F.replace(text, F.lit(", "), F.lit("\nmain.py:7 "))).otherwise(text))
    return table(spark, folder, "documents").select("doc_id", noisy.alias("text"))


@query("noise_flags", f"""
WITH {_NOISY_SQL},
split AS (SELECT doc_id, text, {S.lines('text')} AS rows FROM noisy)
SELECT doc_id, {S.starts_any(S.replace_all('text', r'^\s+', ''), K.INJECTED_PREFIXES)} AS injected,
       CAST(len(rows) AS BIGINT) AS line_count,
       len(rows) >= 4 AND len(list_filter(rows, lambda x: regexp_matches(x, {S.quote(S.TRACE_LINE)}))) > len(rows) * 0.25 AS pasted_log
FROM split""")
def noise_flags(spark, folder):
    return _noisy(spark, folder).select(
        "doc_id", T.is_injected(F.col("text")).alias("injected"),
        F.size(T.lines(F.col("text"))).cast("bigint").alias("line_count"), T.is_pasted_log(F.col("text")).alias("pasted_log"))


_TAGS = K.ENVELOPE_TAGS


def _strip_sql(expression):
    for tag in _TAGS:
        expression = S.replace_all(expression, rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>", "")
    return S.strip(S.replace_all(expression, K.IMAGE_MARKER, ""))


_ENVELOPED = "CASE WHEN conv_id % 2 = 0 THEN '<' || tag || ' id=\"1\">' || text || '</' || tag || '> ' || role ELSE '<image name=\"a\">' || text || '</image> <' || tag || '>' END"


@query("strip_envelopes", f"""
SELECT conv_id, turn, length(clean) AS chars, sha256(clean) AS clean_hash FROM (
  SELECT conv_id, turn, {_strip_sql('raw')} AS clean FROM (
    SELECT conv_id, turn, {_ENVELOPED} AS raw FROM (
      SELECT *, [{', '.join(S.quote(t) for t in _TAGS)}][turn % {len(_TAGS)} + 1] AS tag FROM conversations)))""")
def strip_envelopes(spark, folder):
    tag = F.element_at(F.array(*[F.lit(t) for t in _TAGS]), (F.col("turn") % len(_TAGS) + 1).cast("int"))
    rows = table(spark, folder, "conversations").withColumn("tag", tag)
    wrapped = F.format_string('<%s id="1">%s</%s> %s', "tag", "text", "tag", "role")
    image = F.format_string('<image name="a">%s</image> <%s>', "text", "tag")
    clean = T.strip_envelopes(F.when(F.col("conv_id") % 2 == 0, wrapped).otherwise(image))
    return rows.withColumn("clean", clean).select(
        "conv_id", "turn", F.length("clean").cast("bigint").alias("chars"), I.sha256(F.col("clean")).alias("clean_hash"))


_FLAT = S.collapse("text")
_MD = r"regexp_replace(text, '([\\`*_{}\[\]<>#])', '\\\1', 'g')"


@query("text_measures", f"""
SELECT doc_id, CAST({S.tokens('length(text)')} AS BIGINT) AS tokens, len({S.usage_words('text')}) AS distinct_words,
       CASE WHEN {_FLAT} = '' THEN 0 ELSE len(string_split({_FLAT}, ' ')) END AS words,
       sha256({S.usage_form('text')}) AS usage_hash, sha256({S.fingerprint('text')}) AS fingerprint_hash,
       sha256({S.quote_form('text')}) AS quote_hash, sha256(trim(regexp_replace(lower(text), '[^a-z0-9 ]+', '', 'g'))) AS rule_hash,
       sha256({_MD}) AS markdown_hash,
       CASE WHEN length({_FLAT}) <= 120 THEN {_FLAT} ELSE rtrim(substr({_FLAT}, 1, 120)) || '...' END AS excerpt,
       length(text) - length(replace(text, chr(10), '')) AS line_breaks
FROM documents""")
def text_measures(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", T.estimate_tokens(F.length(t)).alias("tokens"), F.size(T.usage_words(t)).cast("bigint").alias("distinct_words"),
        T.word_count(t).cast("bigint").alias("words"), I.sha256(T.usage_form(t)).alias("usage_hash"),
        I.sha256(F.array_join(T.salience_tokens(t), " ")).alias("fingerprint_hash"),
        I.sha256(T.quote_form(t)).alias("quote_hash"), I.sha256(T.rule_form(t)).alias("rule_hash"),
        I.sha256(T.escape_markdown(t)).alias("markdown_hash"), T.excerpt(t).alias("excerpt"),
        T.line_breaks(t).cast("bigint").alias("line_breaks"))


@query("calendar_functions", f"""
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS p, CAST(o_totalprice * 10 AS BIGINT) AS n,
                  CASE WHEN o_orderkey % 10 = 0 THEN 'undated' ELSE strftime(o_orderdate + INTERVAL 100 DAY, '%Y-%m-%d') END AS e FROM orders)
SELECT o_orderkey, {S.quarter('d')} AS quarter,
       p || ':' || CASE WHEN e = 'undated' THEN 'undated' ELSE {S.quarter('e')} END AS stratum,
       p || ':' || substr(d, 1, 7) AS month_stratum,
       CAST(CASE WHEN e = 'undated' THEN 0 ELSE greatest(1, (CAST(substr(e, 1, 4) AS INTEGER) - CAST(substr(d, 1, 4) AS INTEGER)) * 12
         + CAST(substr(e, 6, 2) AS INTEGER) - CAST(substr(d, 6, 2) AS INTEGER) + 1) END AS BIGINT) AS months,
       CASE WHEN n >= 1000000 THEN format('{{:.1f}}M', n / 1000000.0) WHEN n >= 1000 THEN CAST(n // 1000 AS VARCHAR) || 'K' ELSE CAST(n AS VARCHAR) END AS short_n
FROM o""")
def calendar_functions(spark, folder):
    o = table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderpriority").alias("p"),
        F.round(F.col("o_totalprice") * 10).cast("bigint").alias("n"),
        F.when(F.col("o_orderkey") % 10 == 0, "undated").otherwise(
            F.date_format(F.date_add("o_orderdate", 100), "yyyy-MM-dd")).alias("e"))
    return o.select(
        "o_orderkey", C.quarter(F.col("d")).alias("quarter"), C.stratum(F.col("p"), F.col("e")).alias("stratum"),
        C.month_stratum(F.col("p"), F.col("d")).alias("month_stratum"),
        C.months_between(F.col("d"), F.col("e")).cast("bigint").alias("months"), C.short_count(F.col("n")).alias("short_n"))


@query("wilson_by_brand", """
WITH s AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 25) AS k FROM part GROUP BY p_brand),
w AS (SELECT *, 1.959963984540054::DOUBLE AS z FROM s)
SELECT p_brand, n, k,
       round(CASE WHEN k = 0 THEN 0.0 ELSE greatest(0.0, (k + z*z/2)/(n + z*z) - z*sqrt(k*(n-k)::DOUBLE/n + z*z/4)/(n + z*z)) END, 9) AS low,
       round(CASE WHEN k = n THEN 1.0 ELSE least(1.0, (k + z*z/2)/(n + z*z) + z*sqrt(k*(n-k)::DOUBLE/n + z*z/4)/(n + z*z)) END, 9) AS high
FROM w""")
def wilson_by_brand(spark, folder):
    rows = table(spark, folder, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("p_brand", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))
