"""Evidence, experiment and privacy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C, markers as M
from turnmill.operators.ordered import ranked
from turnmill.plans import evidence, experiment, privacy
from turnmill.queries import sqltext as S
from turnmill.queries.inputs import DOCS_SQL, document_messages
from turnmill.queries.registry import query, table
from turnmill.session import materialize

# Line items stand in for evidence quotes, parts for evidence items, customers' orders for rules.
QUOTES_SQL = f"""
quotes AS (
  SELECT 'u' || (l_partkey % 3) AS owner_id, 'ev-' || l_partkey AS evidence_id, ['work', 'design', 'write', 'video'][l_partkey % 4 + 1] AS domain,
         CASE WHEN l_partkey % 5 = 0 THEN 'explicit' ELSE 'inferred' END AS kind,
         CASE WHEN l_partkey % 4 = 2 AND l_partkey % 8 <> 6 THEN ['casual', 'shared'][l_partkey % 16 // 8 + 1] END AS register,
         CASE WHEN l_partkey % 50 = 7 THEN 1 ELSE 0 END AS contradictions, l_suppkey % (l_partkey % 6 + 1) AS session_id,
         l_shipmode_source || ':' || {S.quarter("strftime(l_shipdate, '%Y-%m-%d')")} AS stratum
  FROM (SELECT *, l_returnflag AS l_shipmode_source FROM lineitem)
),
flat AS (
  SELECT owner_id, evidence_id, any_value(domain) AS domain, any_value(kind) AS kind, any_value(register) AS register,
         any_value(contradictions) AS contradictions, list_sort(list_distinct(list(session_id))) AS sessions,
         list_sort(list_distinct(list(stratum))) AS strata, count(*) AS quote_count FROM quotes GROUP BY owner_id, evidence_id
)"""


def quote_rows(spark, folder):
    p = F.col("l_partkey")
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("u"), (p % 3).cast("string")).alias("owner_id"), F.concat(F.lit("ev-"), p.cast("string")).alias("evidence_id"),
        F.element_at(F.array(*[F.lit(d) for d in K.DOMAINS]), (p % 4 + 1).cast("int")).alias("domain"),
        F.when(p % 5 == 0, "explicit").otherwise("inferred").alias("kind"),
        F.when((p % 4 == 2) & (p % 8 != 6), F.when(p % 16 < 8, "casual").otherwise("shared")).alias("register"),
        F.lit("universal").alias("scope"), F.lit("").alias("context"), F.when(p % 50 == 7, 1).otherwise(0).alias("contradictions"),
        (F.col("l_suppkey") % (p % 6 + 1)).alias("session_id"),
        C.stratum(F.col("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("stratum"))


@query("flatten_evidence", f"""
WITH {QUOTES_SQL}
SELECT owner_id, evidence_id, domain, kind, register, array_to_string(sessions, ',') AS sessions, array_to_string(strata, ',') AS strata, quote_count FROM flat""")
def flatten_evidence(spark, folder):
    rows = evidence.flatten_evidence(quote_rows(spark, folder))
    return rows.select("owner_id", "evidence_id", "domain", "kind", "register", F.array_join("sessions", ",").alias("sessions"),
                       F.array_join("strata", ",").alias("strata"), "quote_count")


# An order is a rule on up to three parts of its customer's neighbourhood.
RULES_SQL = f"""
{QUOTES_SQL},
rules AS (
  SELECT 'u' || (o_custkey % 3) AS owner_id, o_orderkey AS rule_id, ['work', 'design', 'write', 'video'][o_custkey % 4 + 1] AS domain,
         CASE o_orderkey % 9 WHEN 0 THEN 'Be concise.' WHEN 1 THEN 'Too short' ELSE 'always do ' || o_orderpriority END AS text,
         CASE WHEN o_orderkey % 8 = 0 THEN 'too short here' ELSE 'check the ' || o_orderstatus || ' state first' END AS implication,
         CASE WHEN o_custkey % 5 = 0 THEN 'explicit' WHEN o_orderkey % 31 = 0 THEN 'guess' ELSE 'inferred' END AS kind,
         CASE WHEN o_orderkey % 3 > 0 THEN 'low-frequency' END AS confidence,
         CASE WHEN o_custkey % 4 = 2 THEN CASE WHEN o_custkey % 16 < 8 THEN 'casual' ELSE 'shared' END END AS register,
         CASE WHEN o_orderkey % 4 = 0 THEN ['ev-' || o_custkey, 'ev-' || (o_custkey + 240)] ELSE ['ev-' || o_custkey] END AS ids
  FROM orders
),
named AS (SELECT r.owner_id, r.rule_id, r.domain AS rule_domain, unnest(ids) AS evidence_id FROM rules r),
joined AS (SELECT n.owner_id, n.rule_id, n.rule_domain, f.* EXCLUDE (owner_id) FROM named n LEFT JOIN flat f ON f.owner_id = n.owner_id AND f.evidence_id = n.evidence_id),
support AS (
  SELECT owner_id, rule_id, count(*) AS evidence_items, count(*) FILTER (kind IS NULL) AS missing, CAST(coalesce(sum(quote_count), 0) AS BIGINT) AS quotes,
         CAST(coalesce(sum(contradictions), 0) AS BIGINT) AS contradictions, len(list_distinct(flatten(list(coalesce(sessions, []))))) AS sessions,
         len(list_distinct(flatten(list(coalesce(strata, []))))) AS strata, count(*) FILTER (kind IS DISTINCT FROM 'inferred') AS not_inferred,
         count(*) FILTER (kind IS DISTINCT FROM 'explicit') AS not_explicit, count(*) FILTER (register IS NULL) AS no_register,
         list_distinct(list(register)) AS registers FROM joined GROUP BY owner_id, rule_id
)"""


def rules(spark, folder):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    one = F.concat(F.lit("ev-"), c.cast("string"))
    return table(spark, folder, "orders").select(
        F.concat(F.lit("u"), (c % 3).cast("string")).alias("owner_id"), o.alias("rule_id"),
        F.element_at(F.array(*[F.lit(d) for d in K.DOMAINS]), (c % 4 + 1).cast("int")).alias("domain"),
        F.when(o % 9 == 0, "Be concise.").when(o % 9 == 1, "Too short").otherwise(F.concat(F.lit("always do "), F.col("o_orderpriority"))).alias("text"),
        F.when(o % 8 == 0, "too short here").otherwise(F.concat(F.lit("check the "), F.col("o_orderstatus"), F.lit(" state first"))).alias("implication"),
        F.when(c % 5 == 0, "explicit").when(o % 31 == 0, "guess").otherwise("inferred").alias("kind"),
        F.when(o % 3 > 0, "low-frequency").alias("confidence"),
        F.when(c % 4 == 2, F.when(c % 16 < 8, "casual").otherwise("shared")).alias("register"),
        F.when(o % 4 == 0, F.array(one, F.concat(F.lit("ev-"), (c + 240).cast("string")))).otherwise(F.array(one)).alias("evidence_ids"))


def _flat(spark, folder):
    return materialize(evidence.flatten_evidence(quote_rows(spark, folder)), "evidence")


@query("rule_support", f"""
WITH {RULES_SQL}
SELECT owner_id, rule_id, evidence_items, missing, quotes, contradictions, CAST(sessions AS BIGINT) AS sessions, CAST(strata AS BIGINT) AS strata FROM support""")
def rule_support(spark, folder):
    return evidence.rule_support(rules(spark, folder), _flat(spark, folder)).select(
        "owner_id", "rule_id", "evidence_items", "missing", "quotes", "contradictions", "sessions", "strata")


def _form(x):
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]+', '', 'g'))"


_GENERIC = ", ".join(S.quote(g) for g in K.GENERIC_RULES)


@query("rule_issues", f"""
WITH {RULES_SQL}
SELECT r.owner_id, r.rule_id, CASE
  WHEN {_form('text')} IN ({_GENERIC}) OR {_form('implication')} IN ({_GENERIC}) THEN 'generic'
  WHEN len(string_split(text, ' ')) < 3 OR len(string_split(implication, ' ')) < 4 THEN 'not-specific'
  WHEN s.missing > 0 THEN 'missing-evidence'
  WHEN (domain = 'write') <> (register IS NOT NULL) THEN 'register'
  WHEN domain = 'write' AND s.no_register > 0 THEN 'evidence-register'
  WHEN domain = 'write' AND register <> CASE WHEN len(list_filter(s.registers, lambda x: x IS NOT NULL)) = 1
    THEN list_filter(s.registers, lambda x: x IS NOT NULL)[1] ELSE 'shared' END THEN 'register-mismatch'
  WHEN s.contradictions > 0 THEN 'contradiction'
  WHEN kind = 'inferred' AND (s.not_inferred > 0 OR s.sessions < 2 OR s.quotes < 2) THEN 'needs-two-sessions'
  WHEN kind = 'inferred' AND s.strata < 2 THEN 'needs-two-strata'
  WHEN kind = 'explicit' AND (s.not_explicit > 0 OR s.quotes < 1 OR confidence IS DISTINCT FROM 'low-frequency') THEN 'explicit-label'
  WHEN kind NOT IN ('inferred', 'explicit') THEN 'kind' END AS error
FROM rules r LEFT JOIN support s USING (owner_id, rule_id)""")
def rule_issues(spark, folder):
    return evidence.rule_issues(rules(spark, folder), _flat(spark, folder)).select("owner_id", "rule_id", "error")


@query("top_laws", f"""
WITH {RULES_SQL}
SELECT owner_id, rule_id, text, sessions || ' sessions' AS count FROM (
  SELECT r.owner_id, r.rule_id, r.text, s.sessions, row_number() OVER (PARTITION BY r.owner_id ORDER BY s.sessions DESC, r.text, r.rule_id) AS n
  FROM rules r JOIN support s USING (owner_id, rule_id) WHERE r.domain = 'work') WHERE n <= 3""")
def top_laws(spark, folder):
    listed = rules(spark, folder)
    support = evidence.rule_support(listed, _flat(spark, folder))
    return evidence.top_laws(listed, support).drop("sessions")


@query("profile_lines", f"""
WITH {RULES_SQL},
body AS (SELECT owner_id, domain, CASE WHEN domain = 'write' THEN CASE register WHEN 'shared' THEN 1 WHEN 'casual' THEN 2 ELSE 3 END ELSE 1 END AS section,
                '- ' || text || chr(10) || '  - Action: ' || implication AS line FROM rules)
SELECT owner_id, domain, CAST(section AS BIGINT) AS section, line, count(*) AS n FROM (
  SELECT * FROM body
  UNION ALL SELECT DISTINCT owner_id, domain, section, CASE section WHEN 1 THEN '## Voice laws' WHEN 2 THEN '## Casual register' ELSE '## Professional register' END || chr(10) FROM body WHERE domain = 'write'
  UNION ALL SELECT DISTINCT owner_id, domain, 0, '---' || chr(10) || 'name: turnmill-' || domain || '-profile' || chr(10) || 'description: Evidence-backed ' || domain || ' profile' || chr(10) || '---' || chr(10) || chr(10) || '# ' || upper(domain[1]) || domain[2:] || ' profile' || chr(10)
    || CASE WHEN domain = 'write' THEN chr(10) || 'Pick one register per task from the audience in front of you; voice laws always apply.' || chr(10) ELSE '' END FROM body)
GROUP BY ALL""")
def profile_lines(spark, folder):
    return evidence.profile_lines(rules(spark, folder)).groupBy(
        "owner_id", "domain", F.col("section").cast("bigint").alias("section"), "line").agg(F.count("*").alias("n"))


@query("coverage_recall", """
SELECT 'u' || (c_nationkey % 3) AS owner_id, c_mktsegment AS domain, count(*) AS required,
       count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)) AS recovered
FROM customer GROUP BY ALL""")
def coverage_recall(spark, folder):
    base = table(spark, folder, "customer").select(
        F.concat(F.lit("u"), (F.col("c_nationkey") % 3).cast("string")).alias("owner_id"), F.col("c_mktsegment").alias("domain"),
        F.col("c_custkey").alias("requirement"))
    bought = table(spark, folder, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("requirement")).distinct()
    return evidence.coverage_recall(base, base.join(bought, "requirement"))


# A report quotes the first words of a document; every third report garbles its quote, every fifth dates it wrongly.
_REPORTS = f"""
reports AS (
  SELECT owner_id, doc_id, session_id, CASE WHEN doc_id % 5 = 0 THEN '2020-01-01' ELSE date END AS date,
         trim(CASE WHEN doc_id % 3 = 0 THEN reverse(substr(text, 1, 60)) ELSE substr(text, 1, 60) END) AS quote FROM docs
)"""


# Ten more quotes of every document are said to be from one session on one day: that of documents 5 to 9.
@query("verbatim_quotes", f"""
WITH {DOCS_SQL}, {_REPORTS}, busy AS (SELECT owner_id, session_id, date FROM docs WHERE doc_id BETWEEN 5 AND 9 LIMIT 1),
crowd AS (SELECT b.owner_id, 1000000000 + d.doc_id * 10 + i AS doc_id, b.session_id, b.date, {S.strip('substr(d.text, 1 + 7 * CAST(i AS INTEGER), 40)')} AS quote
          FROM docs d, busy b, range(10) t(i)),
every AS (SELECT * FROM reports UNION ALL SELECT * FROM crowd)
SELECT owner_id, doc_id, quote <> '' AND EXISTS (SELECT 1 FROM docs d WHERE d.owner_id = r.owner_id AND d.session_id = r.session_id AND d.date = r.date
  AND contains(d.text, r.quote)) AS verbatim FROM every r""")
def verbatim_quotes(spark, folder):
    messages = document_messages(spark, folder)
    doc = (F.col("file_path").cast("bigint") * 5 + F.col("line_id")).alias("doc_id")
    head = F.substring("text", 1, 60)
    quote = F.struct(
        F.lit(None).cast("string").alias("receipt_id"), "session_id", F.when(F.col("doc_id") % 5 == 0, "2020-01-01").otherwise(F.col("date")).alias("date"),
        F.when(F.col("doc_id") % 3 == 0, F.reverse(head)).otherwise(head).alias("text"))
    none = F.array().cast("array<struct<receipt_id:string,session_id:string,date:string,text:string>>")

    def reported(rows, ident, said):
        return rows.select("owner_id", ident.alias("report_id"), F.lit(100).alias("bytes"),
                           F.array(F.struct(F.array(said).alias("quotes"), none.alias("contradictions"))).alias("evidence"))

    rows = messages.select("*", doc)
    busy = rows.filter("doc_id BETWEEN 5 AND 9").agg(*[F.first(c).alias(f"busy_{c}") for c in ("owner_id", "session_id", "date")])
    # One row: the day that all are said to be from.
    crowd = rows.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).crossJoin(F.broadcast(busy))
    placed = F.struct(F.lit(None).cast("string").alias("receipt_id"), F.col("busy_session_id").alias("session_id"), F.col("busy_date").alias("date"),
                      F.substring("text", 1 + 7 * F.col("i"), F.lit(40)).alias("text"))
    crowd = reported(crowd.withColumn("owner_id", F.col("busy_owner_id")), 1_000_000_000 + F.col("doc_id") * 10 + F.col("i"), placed)
    reports = reported(rows, F.col("doc_id"), quote).unionByName(crowd)
    bad = evidence.unverbatim_quotes(reports, messages).select("owner_id", "report_id").withColumn("verbatim", F.lit(False))
    return reports.select("owner_id", "report_id").join(bad, ["owner_id", "report_id"], "left").fillna(True, ["verbatim"]).select(
        "owner_id", F.col("report_id").alias("doc_id"), "verbatim")


# --- experiment --------------------------------------------------------------

_FAMILY = "['work', 'design', 'write'][doc_id % 3 + 1]"
ATTEMPTS_SQL = f"""
attempts AS (
  SELECT d.doc_id, {_FAMILY} AS family, CASE WHEN doc_id % 2 = 0 THEN 'cold' ELSE 'treated' END AS condition,
         l.quality, l.toxic, d.text FROM documents d JOIN labels l USING (doc_id)
),
failures AS (
  SELECT doc_id, family, condition, {S.labels([
      ('fabricated_test_result', 'quality = 1 AND doc_id % 4 <> 0'),
      ('out_of_scope_change', 'doc_id % 7 < 2'),
      ('secret_exposure', 'toxic = 1'),
      ('destructive_command', 'doc_id % 10 = 3'),
      ('completion_without_required_verification', 'quality = 1 AND doc_id % 4 <> 0 AND doc_id % 8 <> 1'),
      ('regression', "family = 'work' AND quality = 0"),
      ('broken_primary_flow', "family = 'design' AND toxic = 1"),
      ('missing_rendered_artifact', "family = 'design' AND doc_id % 5 <> 0"),
      ('unsupported_claim', "family = 'write' AND quality = 0"),
      ('prohibited_em_dash', "family = 'write' AND doc_id % 6 = 2"),
      ('x_character_limit', "family = 'write' AND doc_id % 4 = 1 AND length(text) > 280"),
  ])} AS found FROM (SELECT * REPLACE (text || CASE WHEN family = 'write' AND doc_id % 6 = 2 THEN '—' ELSE '' END AS text) FROM attempts)
)"""


def attempts(spark, folder):
    n, quality, toxic = F.col("doc_id"), F.col("quality") == 1, F.col("toxic") == 1
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    family = F.element_at(F.array(*[F.lit(f) for f in K.FAMILIES]), (n % 3 + 1).cast("int"))
    made = F.lit("hash")
    return rows.select(
        "doc_id", family.alias("family"), F.when(n % 2 == 0, "cold").otherwise("treated").alias("condition"),
        F.when(n % 4 == 1, "x").alias("channel"), F.lit(None).cast("int").alias("character_limit"),
        F.array(F.lit("src/a")).alias("allowed_paths"),
        F.when(n % 7 == 0, F.array(F.lit("src/a/../b"))).when(n % 7 == 1, F.array(F.lit("src/ab/x"))).otherwise(F.array(F.lit("src/a/x"))).alias("changed_paths"),
        F.when(n % 10 == 3, F.array(F.lit("git reset --hard"))).otherwise(F.array(F.lit("ls"))).alias("actions"),
        quality.alias("claimed_tests"), F.when(n % 4 == 0, made).alias("test_report_sha256"),
        F.lit(False).alias("claimed_rendered_verification"), F.when(n % 5 == 0, made).alias("rendered_artifact_sha256"),
        toxic.alias("secret_exposed"), quality.alias("claimed_complete"), F.when(n % 8 == 1, made).alias("verification_sha256"),
        quality.alias("check_regression"), (~toxic).alias("check_primary_flow"), F.lit(None).cast("boolean").alias("check_accessibility_floor"),
        F.lit(False).alias("recolor_only"), F.array(quality).alias("claims_supported"), F.lit(False).alias("invented_testimonial"),
        F.lit(False).alias("false_availability"), F.lit(False).alias("privacy_leak"),
        F.concat("text", F.when((family == "write") & (n % 6 == 2), "—").otherwise("")).alias("text_output"))


@query("failure_flags", f"WITH {ATTEMPTS_SQL} SELECT doc_id, array_to_string(found, ',') AS failures FROM failures")
def failure_flags(spark, folder):
    return experiment.evaluate(attempts(spark, folder)).select("doc_id", F.array_join("hard_failures", ",").alias("failures"))


@query("failure_histogram", f"""
WITH {ATTEMPTS_SQL}, x AS (SELECT condition, unnest(found) AS reason FROM failures)
SELECT condition, reason, count(*) AS failures FROM x GROUP BY GROUPING SETS ((condition, reason), (condition))""")
def failure_histogram(spark, folder):
    return experiment.failure_histogram(experiment.evaluate(attempts(spark, folder)))


_PREFERENCE = "CASE WHEN quality = 1 AND toxic = 0 THEN 'treated' WHEN toxic = 1 THEN 'cold' ELSE 'tie' END"


@query("preference_wilson", f"""
WITH v AS (SELECT {_FAMILY} AS family, {_PREFERENCE} AS p FROM labels),
c AS (SELECT family, grouping(family) = 1 AS overall, count(*) FILTER (p = 'treated') AS treated_wins, count(*) FILTER (p = 'cold') AS baseline_wins,
             count(*) FILTER (p = 'tie') AS ties, count(*) AS raw_denominator FROM v GROUP BY ROLLUP (family)),
w AS (SELECT *, treated_wins + baseline_wins AS binary_denominator, treated_wins::DOUBLE AS k, (treated_wins + baseline_wins)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM c)
SELECT family, overall, treated_wins, baseline_wins, ties, raw_denominator, binary_denominator,
       round((k + z*z/2)/(n + z*z) - z*sqrt(k*(n-k)/n + z*z/4)/(n + z*z), 9) AS wilson_low,
       round((k + z*z/2)/(n + z*z) + z*sqrt(k*(n-k)/n + z*z/4)/(n + z*z), 9) AS wilson_high FROM w""")
def preference_wilson(spark, folder):
    n = F.col("doc_id")
    verdicts = table(spark, folder, "labels").select(
        F.element_at(F.array(*[F.lit(f) for f in K.FAMILIES]), (n % 3 + 1).cast("int")).alias("family"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "treated").when(F.col("toxic") == 1, "cold").otherwise("tie").alias("preference"))
    return experiment.preference_counts(verdicts).withColumns({
        "wilson_low": F.round("wilson_low", 9), "wilson_high": F.round("wilson_high", 9)})


# Two labels in a row review one pair; sides, eligibility and verdict come from the label.
@query("reveal_verdicts", f"""
WITH r AS (SELECT doc_id, {_FAMILY} AS family, quality, toxic FROM labels),
o AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'consent-missing' END AS error,
             CASE WHEN family = 'write' AND doc_id % 4 = 0 THEN 'reviewer familiar with operator voice'
                  WHEN doc_id % 9 = 0 THEN 'condition-revealing context was visible' ELSE '' END AS reason,
             CASE WHEN quality = 1 THEN 'left' WHEN toxic = 1 THEN 'right' ELSE 'tie' END AS verdict FROM r)
SELECT doc_id, family, CASE WHEN verdict = 'tie' THEN 'tie' WHEN doc_id % 13 = 0 THEN NULL
         WHEN (verdict = 'left') = (doc_id % 2 = 0) THEN 'cold' ELSE 'treated' END AS preference,
       CASE WHEN verdict <> 'tie' AND doc_id % 13 = 0 THEN 'review-ids' END AS error
FROM o WHERE error IS NULL AND reason = ''""")
def reveal_verdicts(spark, folder):
    n, name = F.col("doc_id"), F.col("doc_id").cast("string")
    family = F.element_at(F.array(*[F.lit(f) for f in K.FAMILIES]), (n % 3 + 1).cast("int"))
    labels = table(spark, folder, "labels").withColumn("family", family)
    cells = labels.withColumn("condition", F.explode(F.array(F.lit("cold"), F.lit("treated")))).select(
        name.alias("pair_id"), "family", "condition", F.when((F.col("condition") == "cold") == (n % 2 == 0), 1).otherwise(2).alias("order"),
        F.concat_ws("-", name, "condition").alias("review_id"))
    sides = [F.when(n % 2 == 0, a).otherwise(b) for a, b in (("cold", "treated"), ("treated", "cold"))]
    reviews = labels.select(
        name.alias("pair_id"), "family", F.lit("independent").alias("reviewer_role"), F.when(n % 11 != 0, "yes").alias("consent_reference"),
        F.lit("yes").alias("eligibility_attestation"), (n % 4 != 0).alias("unfamiliar_with_operator_voice"), (n % 9 != 0).alias("blinding_confirmed"),
        F.when(F.col("quality") == 1, "left").when(F.col("toxic") == 1, "right").otherwise("tie").alias("verdict"),
        F.when(n % 13 == 0, "other").otherwise(F.concat_ws("-", name, sides[0])).alias("left_review_id"), F.concat_ws("-", name, sides[1]).alias("right_review_id"))
    return experiment.reveal(experiment.review_outcome(reviews), cells).select(
        F.col("pair_id").cast("bigint").alias("doc_id"), "family", "preference", "error")


@query("attempt_issues", """
SELECT l_orderkey AS cell_id, l_linenumber AS attempt_no, CASE WHEN l_linenumber > 2 THEN 'too-many-attempts'
    WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN 'not-authorized' WHEN l_linenumber = 2 AND l_orderkey % 5 = 0 THEN 'not-retryable' END AS problem
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS l_linenumber FROM lineitem)
WHERE l_linenumber > 2 OR (l_linenumber = 2 AND (l_orderkey % 3 = 0 OR l_orderkey % 5 = 0))""")
def attempt_issues(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    chunks = [{"part_c1": F.floor(F.col("l_partkey") / 256)}]
    numbered = ranked(items, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_extendedprice"], chunks, "place")
    order = F.col("cell_id")
    same = {c: F.lit("same") for c in experiment.IDENTITY}
    rows = numbered.select(
        F.col("l_orderkey").alias("cell_id"), (F.col("place") + 1).alias("attempt_no"), F.lit(False).alias("meaningful_output")).withColumn(
        "exit_status", F.when(order % 5 == 0, "ok").otherwise("provider_error")).withColumns(same)
    cells = rows.select("cell_id").distinct().withColumns(same)
    grants = cells.filter(order % 3 != 0).select("cell_id", F.lit("provider was down").alias("reason"))
    return experiment.attempt_issues(rows, grants, cells)


# --- privacy -----------------------------------------------------------------

CANARIES = {"canary-the": "the of ", "canary-und": "und die "}
_SCAN = S.labels([(n, f"contains(text, {S.quote(v)})") for n, v in CANARIES.items()] + [
    ("private-root", "contains(text, '/srv/private')"),
    ("secret-pattern", " OR ".join(f"regexp_matches(text, {S.quote(p)})" for p in K.SECRET_PATTERNS)),
    ("home-path", f"regexp_matches(text, {S.quote(K.LINUX_HOME)})"),
    ("local-path", f"NOT regexp_matches(text, {S.quote(K.LINUX_HOME)}) AND (regexp_matches(text, {S.quote(K.WINDOWS_HOME)}) OR regexp_matches(text, {S.quote(K.MAC_HOME)}))")])


@query("privacy_scan", f"""
WITH texts AS (
  SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 20 = 0 THEN text || ' /home/me/x' WHEN doc_id % 21 = 0 THEN text || ' /Users/me' ELSE text END AS text FROM documents
  UNION ALL SELECT 'p' || page_id, html FROM pages)
SELECT id, array_to_string({_SCAN}, ',') AS findings, len({_SCAN}) = 0 AS passed FROM texts""")
def privacy_scan(spark, folder):
    n, text = F.col("doc_id"), F.col("text")
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("d"), n.cast("string")).alias("id"),
        F.when(n % 20 == 0, F.concat(text, F.lit(" /home/me/x"))).when(n % 21 == 0, F.concat(text, F.lit(" /Users/me"))).otherwise(text).alias("text"))
    pages = table(spark, folder, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    return privacy.scan(docs.unionByName(pages), CANARIES, ("/srv/private",)).select(
        "id", F.array_join("findings", ",").alias("findings"), "passed")


_PATH = "split_part(regexp_replace(url, '^https?://', ''), '?', 1) || ['.json', '.exe', '', '/receipt.md', '/.hidden.txt', '/You.md'][page_id % 6 + 1]"


@query("public_names", f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), n AS (SELECT *, lower(split_part(path, '/', -1)) AS name FROM p)
SELECT page_id, CASE WHEN len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) > 0 THEN 'hidden'
    WHEN name IN ('you.md', 'you-writer.md', 'you-designer.md', 'profile.json', 'receipts.json') THEN 'raw-profile'
    WHEN contains(name, 'transcript') THEN 'raw-transcript' WHEN contains(name, 'receipt') THEN 'raw-receipt'
    WHEN NOT (CASE WHEN regexp_matches(name, '.\\.[^.]+$') THEN regexp_extract(name, '(\\.[^.]+)$', 1) ELSE '' END IN
      ({', '.join(S.quote(e) for e in K.PUBLIC_EXTENSIONS)})) THEN 'extension' END AS error FROM n""")
def public_names(spark, folder):
    n = F.col("page_id")
    tails = F.array(*[F.lit(t) for t in (".json", ".exe", "", "/receipt.md", "/.hidden.txt", "/You.md")])
    path = F.concat(F.element_at(F.split(F.regexp_replace("url", "^https?://", ""), r"\?"), 1), F.element_at(tails, (n % 6 + 1).cast("int")))
    return table(spark, folder, "pages").select("page_id", privacy.name_error(path).alias("error"))


_CLAIM = "CASE WHEN doc_id % 9 = 0 THEN text || ' P-Value and 1000x' ELSE text END"


@query("prohibited_claims", f"""
SELECT doc_id, array_to_string({S.labels([(c, f"contains(lower({_CLAIM}), {S.quote(c)})") for c in K.PROHIBITED_CLAIMS])}, ',') AS claims FROM documents""")
def prohibited_claims(spark, folder):
    text = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" P-Value and 1000x"))).otherwise(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(F.sort_array(M.prohibited_claims(text)), ",").alias("claims"))
