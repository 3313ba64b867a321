"""Queries over text windows, labels and experiment records."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from turnmill.functions import calendar as C, identity as I, text as T
from turnmill.functions.identity import sha256
from turnmill.plans import experiment
from turnmill.queries import sqltext as S
from turnmill.queries.registry import query, table

_FLAT = S.collapse("text")


@query("excerpt_windows", f"""
WITH f AS (SELECT doc_id, {_FLAT} AS flat FROM documents),
p AS (SELECT *, position(lower(substr(flat, 150, 9)) IN lower(flat)) AS found FROM f),
s AS (SELECT *, CASE WHEN length(flat) < 158 THEN 0 ELSE greatest(0, found - 1 - 40) END AS start FROM p)
SELECT doc_id, CASE WHEN length(flat) <= 120 THEN flat
  ELSE (CASE WHEN start > 0 THEN '...' ELSE '' END) || rtrim(substr(flat, start + 1, 120)) || '...' END AS excerpt FROM s""")
def excerpt_windows(spark, folder):
    """Excerpts around a marker that stands in the middle of the text."""
    flat = T.collapse_space(F.col("text"))
    marker = F.when(F.length(flat) >= 158, F.lower(F.substring(flat, 150, 9)))
    return table(spark, folder, "documents").select("doc_id", T.excerpt(F.col("text"), marker).alias("excerpt"))


@query("utf8_prefixes", """
WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS line, 5 + doc_id % 50 AS most FROM documents)
SELECT doc_id, substr(line, 1, CAST(list_max(list_filter(range(0, least(length(line), 60) + 1), lambda i: strlen(substr(line, 1, i)) <= most)) AS BIGINT)) AS prefix FROM t""")
def utf8_prefixes(spark, folder):
    line = F.element_at(F.split("text", "\n"), 1)
    return table(spark, folder, "documents").select("doc_id", T.fit_utf8(line, 5 + F.col("doc_id") % 50).alias("prefix"))


_PATH = """CASE doc_id % 4 WHEN 0 THEN '/home/u/brain/' || source || '/.system_generated/logs/' || doc_id || '.jsonl'
  WHEN 1 THEN 'file:///logs/' || source || '/' || doc_id || '.jsonl' WHEN 2 THEN '/' || doc_id || '.jsonl' ELSE '/a%20b/' || lang || '/' || doc_id || '.jsonl' END"""


@query("session_labels", f"""
WITH p AS (SELECT doc_id, source, lang FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '/' || doc_id || '.jsonl' WHEN 1 THEN source || '/' || doc_id || '.jsonl'
  WHEN 2 THEN doc_id || '.jsonl' ELSE lang || '/' || doc_id || '.jsonl' END AS label FROM p""")
def session_labels(spark, folder):
    return table(spark, folder, "documents").select("doc_id", I.session_label(F.expr(_PATH)).alias("label"))


@query("observed_dates", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') END || 'T00:00:00Z' AS observed_at FROM events""")
def observed_dates(spark, folder):
    """The message's date where it has one, else the day the file changed."""
    n = F.col("event_id") % 3
    date = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd")).when(n == 1, "undated").otherwise("2024-13-45")
    return table(spark, folder, "events").select(
        "event_id", C.observed_at(date, F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("observed_at"))


# A user's events are the evaluations of a cell; some correct an earlier one, a later one or one that never was.
_EVALS = """
evals AS (SELECT user_id AS cell_id, event_id AS event_no, sha256('e' || event_id) AS sha,
  CASE event_id % 5 WHEN 1 THEN sha256('e' || prior) WHEN 2 THEN sha256('e' || later) WHEN 3 THEN sha256('x' || event_id) END AS supersedes,
  CASE WHEN event_id % 2 = 0 THEN 'typo' ELSE '' END AS reason
  FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prior, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS later FROM events))"""


def _evaluations(spark, folder):
    order, n = Window.partitionBy("user_id").orderBy("event_id"), F.col("event_id") % 5

    def digest(letter, number):
        return sha256(F.concat(F.lit(letter), number.cast("string")))

    rows = table(spark, folder, "events").withColumns({"prior": F.lag("event_id").over(order), "later": F.lead("event_id").over(order)})
    supersedes = F.when(n == 1, digest("e", F.col("prior"))).when(n == 2, digest("e", F.col("later"))).when(n == 3, digest("x", F.col("event_id")))
    return rows.select(
        F.col("user_id").alias("cell_id"), F.col("event_id").alias("event_no"), digest("e", F.col("event_id")).alias("sha256"),
        supersedes.alias("supersedes_sha256"), F.when(F.col("event_id") % 2 == 0, "typo").otherwise("").alias("supersession_reason"))


@query("supersession_issues", f"""
WITH {_EVALS}, j AS (SELECT e.*, (SELECT min(p.event_no) FROM evals p WHERE p.cell_id = e.cell_id AND p.sha = e.supersedes) AS prior_no FROM evals e WHERE supersedes IS NOT NULL)
SELECT * FROM (SELECT cell_id, event_no, CASE WHEN prior_no IS NULL OR prior_no >= event_no THEN 'no-prior-evaluation' WHEN reason = '' THEN 'reason-missing' END AS problem FROM j)
WHERE problem IS NOT NULL""")
def supersession_issues(spark, folder):
    return experiment.supersession_issues(_evaluations(spark, folder))


# Orders are published records; their line items are the stored events of three kinds.
_KINDS = "CASE l_linenumber % 3 WHEN 0 THEN 'reviews' WHEN 1 THEN 'attempts' ELSE 'evaluations' END"


def _stored(spark, folder):
    kind = F.expr(_KINDS)
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), kind.alias("kind"), F.col("l_linenumber").cast("bigint").alias("event_no")).agg(
        F.lit(1).alias("one")).select("cell_id", "kind", "event_no", sha256(F.concat_ws("-", F.col("cell_id").cast("string"), F.col("event_no").cast("string"))).alias("sha256"))


@query("binding_issues", f"""
WITH stored AS (SELECT DISTINCT l_orderkey AS cell_id, {_KINDS} AS kind, CAST(l_linenumber AS BIGINT) AS event_no FROM lineitem),
records AS (SELECT o_orderkey AS cell_id, unnest([{{'kind': 'attempts', 'n': 1}}, {{'kind': 'evaluations', 'n': 2}}, {{'kind': 'reviews', 'n': CASE WHEN o_orderkey % 2 = 0 THEN 3 END}}], recursive := true) FROM orders),
named AS (SELECT cell_id, kind, CAST(n AS BIGINT) AS n FROM records WHERE kind <> 'reviews' OR n IS NOT NULL),
last AS (SELECT cell_id, kind, max(event_no) AS last_no FROM stored GROUP BY ALL)
SELECT * FROM (SELECT n.cell_id, n.kind, CASE WHEN s.event_no IS NULL THEN 'not-in-store' WHEN n.n <> l.last_no THEN 'not-the-final-one' END AS problem
  FROM named n LEFT JOIN stored s ON s.cell_id = n.cell_id AND s.kind = n.kind AND s.event_no = n.n LEFT JOIN last l ON l.cell_id = n.cell_id AND l.kind = n.kind)
WHERE problem IS NOT NULL""")
def binding_issues(spark, folder):
    def at(line):
        return sha256(F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit(str(line))))

    records = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("cell_id"), at(1).alias("attempt_sha256"), at(2).alias("evaluation_sha256"),
        F.when(F.col("o_orderkey") % 2 == 0, at(3)).alias("review_sha256"))
    return experiment.binding_issues(records, _stored(spark, folder))


@query("matrix_issues", """
WITH cells AS (SELECT o_orderkey AS cell_id, o_orderkey // 2 AS pair_id, o_orderpriority AS family, CASE WHEN o_orderkey % 2 = 0 THEN 'cold' ELSE 'treated' END AS condition
  FROM orders WHERE o_orderkey % 19 <> 4),
records AS (SELECT o_orderkey AS cell_id, o_orderkey // 2 AS pair_id, CASE WHEN o_orderkey % 23 = 5 THEN 'other' ELSE o_orderpriority END AS family,
  CASE WHEN o_orderkey % 2 = 0 THEN 'cold' ELSE 'treated' END AS condition, CASE WHEN o_orderkey % 31 = 7 THEN 'lost' WHEN o_orderkey % 7 = 0 THEN 'invalid' ELSE 'valid' END AS review_status,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'someone' ELSE 'tie' END END AS preference,
  CASE WHEN o_orderkey % 14 = 0 THEN 'late' ELSE '' END AS invalidation_reason FROM orders WHERE o_orderkey % 17 <> 3
  UNION ALL SELECT o_orderkey, o_orderkey // 2, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'cold' ELSE 'treated' END, 'valid', NULL, '' FROM orders WHERE o_orderkey % 41 = 6),
seen AS (SELECT cell_id, count(*) AS n, max(pair_id) AS p, max(family) AS f, max(condition) AS c FROM records GROUP BY cell_id),
by_cell AS (SELECT CAST(cell_id AS VARCHAR) AS entity, CASE WHEN n IS NULL THEN 'missing-cell' WHEN pair_id IS NULL THEN 'unknown-cell' WHEN n > 1 THEN 'repeated-cell'
  WHEN pair_id <> p OR family <> f OR condition <> c THEN 'identity' END AS problem FROM cells FULL JOIN seen USING (cell_id)),
per_pair AS (SELECT pair_id, count(*) FILTER (preference IS NOT NULL OR review_status = 'invalid') AS contributions, count(*) FILTER (review_status NOT IN ('valid', 'invalid')) AS bad_status,
  count(*) FILTER (review_status = 'invalid' AND invalidation_reason = '') AS no_reason,
  count(*) FILTER (review_status = 'valid' AND preference IS NOT NULL AND preference NOT IN ('treated', 'cold', 'tie')) AS bad_preference FROM records GROUP BY pair_id),
by_pair AS (SELECT CAST(pair_id AS VARCHAR) AS entity, CASE WHEN bad_status > 0 THEN 'review-status' WHEN contributions <> 1 THEN 'one-review-per-pair' WHEN no_reason > 0 THEN 'reason-missing'
  WHEN bad_preference > 0 THEN 'preference' END AS problem FROM per_pair)
SELECT * FROM by_cell WHERE problem IS NOT NULL UNION ALL SELECT * FROM by_pair WHERE problem IS NOT NULL""")
def matrix_issues(spark, folder):
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    base = orders.select(
        k, k.alias("cell_id"), F.floor(k / 2).alias("pair_id"), F.col("o_orderpriority").alias("family"),
        F.when(k % 2 == 0, "cold").otherwise("treated").alias("condition"))
    cells = base.filter(k % 19 != 4).drop("o_orderkey")
    none = F.lit(None).cast("string")
    first = base.filter(k % 17 != 3).withColumns({
        "family": F.when(k % 23 == 5, "other").otherwise(F.col("family")),
        "review_status": F.when(k % 31 == 7, "lost").when(k % 7 == 0, "invalid").otherwise("valid"),
        "preference": F.when(k % 3 == 0, F.when(k % 5 == 0, "someone").otherwise("tie")),
        "invalidation_reason": F.when(k % 14 == 0, "late").otherwise("")})
    again = base.filter(k % 41 == 6).withColumns({"review_status": F.lit("valid"), "preference": none, "invalidation_reason": F.lit("")})
    records = first.unionByName(again).drop("o_orderkey").withColumn("publication_status", F.lit("eligible"))
    found = experiment.matrix_issues(cells, records)
    return found.select(F.col("entity").cast("string").alias("entity"), "problem")


@query("public_cells", """
SELECT o_orderkey AS cell_id, o_orderpriority AS family, o_orderstatus AS redaction_state,
       sha256('{"cell_id":' || o_orderkey || ',"family":"' || o_orderpriority || '","private_path":"/home/' || o_custkey || '","redaction_state":"' || o_orderstatus || '"}') AS record_sha256
FROM orders""")
def public_cells(spark, folder):
    """What a publication shows of each record, with a digest of the whole row."""
    records = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("redaction_state"),
        F.concat(F.lit("/home/"), F.col("o_custkey").cast("string")).alias("private_path"))
    return experiment.public_cells(records)
