"""Checks of model-written reports and drafts against the corpus, and the rules that survive.

A report is at most a few kilobytes, so whatever concerns one report alone is an expression over its own row. Only
the comparison with the corpus is a join. A check yields rows ``(phase, item, step, code)``; the least of them is the
error a strict reader would have stopped at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnmill import constants as K
from turnmill.functions import calendar as C, identity as I, text as T
from turnmill.operators.digest import set_digest
from turnmill.operators.ordered import newest, top_rows
from turnmill.plans.trace import find_spans
from turnmill.session import materialize

#: A rule's items with more sessions and strata than this are counted as rows, not in one list.
LISTED_ITEMS = 10_000

_QUOTE = "struct<receipt_id:string,session_id:string,date:string,text:string>"
_ITEM = (f"struct<evidence_id:string,domain:string,kind:string,register:string,scope:string,context:string,"
         f"signal_family:string,instruction:string,implication:string,quotes:array<{_QUOTE}>,contradictions:array<{_QUOTE}>>")
REPORT_SCHEMA = (
    "schema_version string, segment_hash string, packet_hash string, "
    "coverage struct<session_ids:array<string>,receipt_ids:array<string>,sources:array<string>,first_date:string,"
    "last_date:string,source_tokens:bigint>, domain_coverage map<string,string>, "
    f"evidence array<{_ITEM}>")
_ISSUE = "array<struct<phase:int,item:int,step:int,code:string>>"


def read_reports(spark: SparkSession, path: str, owner: str = "default") -> DataFrame:
    """One JSON document per file."""
    return parse_reports(spark.read.option("wholetext", "true").text(path).select(
        F.lit(owner).alias("owner_id"), F.col("value").alias("raw")))


def parse_reports(raw: DataFrame) -> DataFrame:
    """Decode ``owner_id, raw``; ``bytes`` is the size without insignificant blanks."""
    canonical = F.to_json(F.try_parse_json("raw"))
    return raw.select(
        "owner_id", I.sha256(F.col("raw")).alias("report_id"), F.octet_length(canonical).alias("bytes"),
        F.from_json("raw", REPORT_SCHEMA).alias("r")).select("owner_id", "report_id", "bytes", "r.*")


def _issues(phase: int, item: Column, checks: list[tuple[str, Column]]) -> Column:
    rows = [
        F.when(F.coalesce(bad, F.lit(True)), F.struct(
            F.lit(phase).alias("phase"), item.cast("int").alias("item"), F.lit(step).alias("step"), F.lit(code).alias("code")))
        for step, (code, bad) in enumerate(checks)]
    return F.array_compact(F.array(*rows)).cast(_ISSUE)


def _no(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _bad_register(domain: Column, register: Column) -> Column:
    return F.when(domain == "write", ~F.coalesce(register.isin(*K.REGISTERS), F.lit(False))).otherwise(
        register.isNotNull())


def _bad_domain_states(states: Column) -> Column:
    names = F.array(*[F.lit(d) for d in sorted(K.DOMAINS)])
    known = F.forall(F.map_values(states), lambda v: v.isin("evidence", "no-signal"))
    return F.coalesce((F.sort_array(F.map_keys(states)) != names) | ~known, F.lit(True))


def _states_disagree(states: Column, evidence: Column) -> Column:
    shown = F.transform(evidence, lambda e: e["domain"])
    return T.any_of([(states[d] == "evidence") != F.array_contains(shown, d) for d in K.DOMAINS])


def _repeated_before(evidence: Column, position: Column, ident: Column) -> Column:
    earlier = F.transform(F.slice(evidence, F.lit(1), position), lambda e: e["evidence_id"])
    return F.array_contains(earlier, ident)


def _per_item(evidence: Column, checks) -> Column:
    return F.flatten(F.transform(evidence, checks))


def _quotes(item: Column) -> Column:
    return F.concat(F.coalesce(item["quotes"], F.array().cast(f"array<{_QUOTE}>")),
                    F.coalesce(item["contradictions"], F.array().cast(f"array<{_QUOTE}>")))


def _first_error(base: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    order = F.struct("phase", "item", "step")
    first = issues.groupBy(*keys).agg(F.min_by("code", order).alias("error"), F.count("*").alias("issues"))
    return base.join(first, keys, "left").fillna(0, ["issues"]).withColumn("valid", F.col("issues") == 0)


def report_issues(reports: DataFrame, segments: DataFrame, messages: DataFrame) -> DataFrame:
    """All findings against segment reports: ``owner_id, report_id, phase, item, step, code``."""
    sessions = F.sort_array(F.transform("session_versions", lambda v: v["session_id"]))
    expected = segments.select(
        "owner_id", "segment_hash", sessions.alias("want_sessions"), F.col("source").alias("want_source"),
        F.col("first_date").alias("want_first"), F.col("last_date").alias("want_last"),
        F.col("source_tokens").alias("want_tokens"))
    joined = reports.join(expected, ["owner_id", "segment_hash"], "left")
    evidence, cover = F.col("evidence"), F.col("coverage")
    covered = F.sort_array(F.array_distinct(cover["session_ids"]))
    head = _issues(0, F.lit(0), [
        ("byte-ceiling", F.col("bytes") > K.REPORT_MAX_BYTES),
        ("schema-version", F.col("schema_version") != K.REPORT_VERSION),
        ("segment-hash", F.col("want_source").isNull()),
        ("coverage-sessions", covered != F.col("want_sessions")),
        ("coverage-metadata", (cover["sources"] != F.array("want_source")) | (cover["first_date"] != F.col("want_first"))
         | (cover["last_date"] != F.col("want_last")) | (cover["source_tokens"] != F.col("want_tokens"))),
        ("domain-coverage", _bad_domain_states(F.col("domain_coverage"))),
        ("evidence-count", evidence.isNull() | (F.size(evidence) > K.REPORT_MAX_EVIDENCE))])

    def item_checks(e, i):
        ident = F.coalesce(e["evidence_id"], F.lit(""))
        prefix = F.concat(F.lit("ev-"), F.substring("segment_hash", 1, 8), F.lit("-"))
        return _issues(1, i, [
            ("domain-or-kind", ~e["domain"].isin(*K.DOMAINS) | ~e["kind"].isin(*K.EVIDENCE_KINDS)),
            ("register", _bad_register(e["domain"], e["register"])),
            ("evidence-id", ~ident.startswith(prefix) | ~ident.rlike("^ev-[a-f0-9]{8}-[a-z0-9-]{3,64}$")
             | _repeated_before(evidence, i, ident)),
            ("missing-text", _no(e["instruction"]) | _no(e["implication"]) | (F.coalesce(F.size(e["quotes"]), F.lit(0)) <= 0)),
            ("contradictions", e["contradictions"].isNull()),
            ("unknown-session", ~F.forall(_quotes(e), lambda q: F.array_contains(cover["session_ids"], q["session_id"]))),
            ("quote-length", F.exists(_quotes(e), lambda q: F.length(q["text"]) > K.QUOTE_MAX_CHARS))])

    tail = _issues(2, F.lit(0), [("domain-evidence", _states_disagree(F.col("domain_coverage"), evidence))])
    every = F.concat(head, F.coalesce(_per_item(evidence, item_checks), F.array().cast(_ISSUE)), tail)
    own = joined.select("owner_id", "report_id", F.explode(every).alias("issue")).select("owner_id", "report_id", "issue.*")
    return own.unionByName(unverbatim_quotes(reports, messages))


def unverbatim_quotes(reports: DataFrame, messages: DataFrame) -> DataFrame:
    """Quotes that stand in no message of their session on their date.

    Quotes and messages of a day are told apart by its key; the quotes are looked for by what every task has of them, of bounded
    size, so a day may have any number of quotes and messages, and no list of its quotes is ever a row.
    """
    sized = reports.filter(F.col("bytes") <= K.REPORT_MAX_BYTES)
    quotes = sized.select("owner_id", "report_id", F.posexplode("evidence").alias("item", "e")).select(
        "owner_id", "report_id", "item", F.explode(_quotes(F.col("e"))).alias("q")).select(
        "owner_id", "report_id", "item", F.col("q.session_id").alias("session_id"),
        F.coalesce("q.date", F.lit("")).alias("date"), T.strip(F.coalesce("q.text", F.lit(""))).alias("quote"))
    quotes = materialize(quotes, "quotes")
    day = ["owner_id", "session_id", "date"]
    # Lengths keep different keys from running together.
    day_key = F.concat(*[x for c in day for x in (F.length(c).cast("string"), F.lit(":"), F.col(c))])
    wanted = quotes.filter("quote != '' and date != '' and session_id is not null").select(*day, "quote").distinct()
    near = messages.select(*day, "text").join(wanted.select(*day).distinct(), day, "left_semi")
    found = find_spans(
        wanted.select(day_key.alias("owner_id"), F.col("quote").alias("needle")),
        near.select(day_key.alias("owner_id"), F.col("text").alias("haystack")), [])
    found = found.select("owner_id", "needle").distinct().select(F.col("owner_id").alias("day"), F.col("needle").alias("quote"))
    return quotes.withColumn("day", day_key).join(found, ["day", "quote"], "left_anti").select(
        "owner_id", "report_id", F.lit(1).alias("phase"), "item", F.lit(9).alias("step"),
        F.lit("not-verbatim").alias("code")).distinct()


def check_reports(reports: DataFrame, segments: DataFrame, messages: DataFrame) -> DataFrame:
    """Every report with its first error, if any."""
    return _first_error(reports, report_issues(reports, segments, messages), ["owner_id", "report_id"])


def scout_issues(reports: DataFrame, packet_rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """Findings against reports on receipt packets."""
    expected = packet_rows.select(
        "owner_id", "packet_hash", F.col("receipt_ids").alias("want_ids"), F.col("source_tokens").alias("want_tokens"))
    joined = reports.join(expected, ["owner_id", "packet_hash"], "left")
    evidence = F.col("evidence")
    head = _issues(0, F.lit(0), [
        ("byte-ceiling", F.col("bytes") > K.SCOUT_REPORT_MAX_BYTES),
        ("schema-version", F.col("schema_version") != K.SCOUT_REPORT_VERSION),
        ("packet-hash", F.col("want_ids").isNull()),
        ("coverage-receipts", F.col("coverage.receipt_ids") != F.col("want_ids")),
        ("coverage-tokens", F.col("coverage.source_tokens") != F.col("want_tokens")),
        ("domain-coverage", _bad_domain_states(F.col("domain_coverage"))),
        ("evidence-list", evidence.isNull())])

    def item_checks(e, i):
        upto = F.slice(evidence, F.lit(1), i + 1)
        same = F.size(F.filter(upto, lambda o: o["domain"] == e["domain"]))
        return _issues(1, i, [
            ("domain", ~e["domain"].isin(*K.DOMAINS)),
            ("domain-ceiling", same > K.REPORT_MAX_EVIDENCE),
            ("evidence-id", _no(e["evidence_id"]) | _repeated_before(evidence, i, e["evidence_id"])),
            ("kind", ~e["kind"].isin(*K.EVIDENCE_KINDS)),
            ("register", _bad_register(e["domain"], e["register"])),
            ("scope", ~e["scope"].isin("universal", "contextual")),
            ("context", (e["scope"] == "contextual") & _no(T.strip(F.coalesce(e["context"], F.lit(""))))),
            ("signal-family", ~e["signal_family"].isin(*K.SIGNAL_FAMILIES)),
            ("missing-text", _no(e["instruction"]) | _no(e["implication"]) | (F.coalesce(F.size(e["quotes"]), F.lit(0)) <= 0)),
            ("contradictions", e["contradictions"].isNull()),
            ("receipt-not-assigned", ~F.forall(_quotes(e), lambda q: F.array_contains(F.col("want_ids"), q["receipt_id"])))])

    tail = _issues(2, F.lit(0), [("domain-evidence", _states_disagree(F.col("domain_coverage"), evidence))])
    every = F.concat(head, F.coalesce(_per_item(evidence, item_checks), F.array().cast(_ISSUE)), tail)
    own = joined.select("owner_id", "report_id", F.explode(every).alias("issue")).select("owner_id", "report_id", "issue.*")
    return own.unionByName(inexact_receipts(reports, receipts))


def inexact_receipts(reports: DataFrame, receipts: DataFrame) -> DataFrame:
    """Quotes whose session, date or text differs from the receipt they name."""
    fields = ["receipt_id", "session_id", "date", "text"]
    sized = reports.filter(F.col("bytes") <= K.SCOUT_REPORT_MAX_BYTES)
    quotes = sized.select("owner_id", "report_id", F.posexplode("evidence").alias("item", "e")).select(
        "owner_id", "report_id", "item", F.explode(_quotes(F.col("e"))).alias("q")).select(
        "owner_id", "report_id", "item", *[F.col(f"q.{f}").alias(f) for f in fields])
    return quotes.join(receipts.select("owner_id", *fields), ["owner_id", *fields], "left_anti").select(
        "owner_id", "report_id", F.lit(1).alias("phase"), "item", F.lit(11).alias("step"),
        F.lit("inexact-receipt").alias("code")).distinct()


def check_scout_reports(reports: DataFrame, packet_rows: DataFrame, receipts: DataFrame) -> DataFrame:
    return _first_error(reports, scout_issues(reports, packet_rows, receipts), ["owner_id", "report_id"])


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rest with the reason."""
    return checked.filter("valid").drop("error", "issues", "valid"), checked.filter("not valid")


def evidence_quotes(reports: DataFrame) -> DataFrame:
    """One row per evidence item and quote, with its stratum.

    Takes the report's source; a scout report has none, so join the receipts for it first. An id that more than one item
    carries names none of them: its rows are left out, and ``repeated_evidence`` lists it.
    """
    source = F.element_at("coverage.sources", 1)
    refused = repeated_evidence(reports).select("owner_id", "evidence_id")
    items = reports.select("owner_id", source.alias("source"), F.explode("evidence").alias("e")).select(
        "owner_id", "source", "e.evidence_id", "e.domain", "e.kind", "e.register",
        F.coalesce("e.scope", F.lit("universal")).alias("scope"), F.coalesce("e.context", F.lit("")).alias("context"),
        F.coalesce(F.size("e.contradictions"), F.lit(0)).alias("contradictions"), F.explode("e.quotes").alias("q")).select(
        "*", "q.session_id", "q.date", C.stratum(F.col("source"), F.col("q.date")).alias("stratum")).drop("q", "source")
    return items.join(refused, ["owner_id", "evidence_id"], "left_anti")


def flatten_evidence(quote_rows: DataFrame) -> DataFrame:
    """One row per evidence id: its sessions, strata and number of quotes."""
    first = ["domain", "kind", "register", "scope", "context", "contradictions"]
    return quote_rows.groupBy("owner_id", "evidence_id").agg(
        *[F.min(c).alias(c) for c in first],
        F.sort_array(F.collect_set("session_id")).alias("sessions"), F.sort_array(F.collect_set("stratum")).alias("strata"),
        F.count("*").alias("quote_count"))


def repeated_evidence(reports: DataFrame) -> DataFrame:
    """Evidence ids that more than one item carries."""
    return reports.select("owner_id", F.explode("evidence.evidence_id").alias("evidence_id")).groupBy(
        "owner_id", "evidence_id").agg(F.count("*").alias("uses")).filter("uses > 1")


def rule_support(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """What stands behind each rule: distinct sessions and strata, quotes, contradictions, missing ids.

    ``rules``: owner_id, rule_id and evidence_ids among others. ``evidence``: one row per id, as ``flatten_evidence``.
    """
    named = rules.select("owner_id", "rule_id", "domain", F.explode("evidence_ids").alias("evidence_id"))
    facts = evidence.select(
        "owner_id", "evidence_id", "quote_count", "contradictions", F.col("kind").alias("e_kind"), F.col("register").alias("e_register"),
        F.col("domain").alias("e_domain"), F.col("scope").alias("e_scope"),
        *[F.size(F.array_distinct(c)).alias(f"{c}_n") for c in ("sessions", "strata")])
    joined = named.join(facts, ["owner_id", "evidence_id"], "left")
    key = ["owner_id", "rule_id"]
    # No row carries a list of sessions; totals, and for how many a rule of one item has, need only their number.
    base = materialize(joined.groupBy(*key).agg(
        F.count("*").alias("evidence_items"), F.count_if(F.col("e_kind").isNull()).alias("missing"),
        F.coalesce(F.sum("quote_count"), F.lit(0)).alias("quotes"),
        F.coalesce(F.sum("contradictions"), F.lit(0)).alias("contradictions"),
        F.count_if(F.coalesce(F.col("e_kind") != "inferred", F.lit(True))).alias("not_inferred"),
        F.count_if(F.coalesce(F.col("e_kind") != "explicit", F.lit(True))).alias("not_explicit"),
        F.count_if(F.col("e_register").isNull()).alias("no_register"),
        F.collect_set("e_register").alias("e_registers"), F.collect_set("e_scope").alias("e_scopes"),
        F.count_if(~F.coalesce(F.col("e_domain") == F.col("domain"), F.lit(True))).alias("other_domain"),
        (F.min("evidence_id") != F.max("evidence_id")).alias("several"),
        F.coalesce(F.sum(F.coalesce("sessions_n", F.lit(0)) + F.coalesce("strata_n", F.lit(0))), F.lit(0)).alias("listed"),
        *[F.max(f"{c}_n").cast("bigint").alias(f"{c}_one") for c in ("sessions", "strata")]), "rule-totals")
    # A rule without an id counts no sessions.
    known = F.col("owner_id").isNotNull() & F.col("rule_id").isNotNull()
    several = base.filter(F.coalesce("several", F.lit(False)) & known)
    lists = named.select(*key, "evidence_id").join(several.select(*key, "listed"), key).join(
        evidence.select("owner_id", "evidence_id", "sessions", "strata"), ["owner_id", "evidence_id"])
    short = lists.filter(F.col("listed") <= LISTED_ITEMS).groupBy(*key).agg(
        *[F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("bigint").alias(f"{c}_all") for c in ("sessions", "strata")])
    counted = base.join(short, key, "left")
    long = several.filter(F.col("listed") > LISTED_ITEMS)
    if not long.isEmpty():
        for c in ("sessions", "strata"):
            counts = lists.filter(F.col("listed") > LISTED_ITEMS).select(*key, F.explode(c).alias("one")).distinct().groupBy(*key).agg(
                F.count("*").alias(f"{c}_long"))
            counted = counted.join(counts, key, "left").withColumn(f"{c}_all", F.coalesce(f"{c}_long", f"{c}_all")).drop(f"{c}_long")
    found = [F.when(F.coalesce("several", F.lit(False)), F.col(f"{c}_all")).when(known, F.col(f"{c}_one")).alias(c) for c in ("sessions", "strata")]
    kept = [c for c in base.columns if c not in ("several", "listed", "sessions_one", "strata_one")]
    return counted.select(*kept, *found).fillna(0, ["sessions", "strata"])


def rule_issues(rules: DataFrame, evidence: DataFrame, require_strata: bool = True) -> DataFrame:
    """Rules with the first reason they may not be installed, null when they may."""
    facts = rule_support(rules, evidence)
    r = rules.join(facts, ["owner_id", "rule_id"], "left")
    text, action = T.strip(F.coalesce("text", F.lit(""))), T.strip(F.coalesce("implication", F.lit("")))
    expected = F.when(F.size("e_registers") == 1, F.element_at("e_registers", 1)).otherwise("shared")
    wrong = F.lit(False)
    inferred, explicit, written = F.col("kind") == "inferred", F.col("kind") == "explicit", F.col("domain") == "write"
    needs = F.lit(require_strata) if "adequate_strata" not in rules.columns else F.col("adequate_strata")
    checks = [
        ("generic", T.rule_form(text).isin(*K.GENERIC_RULES) | T.rule_form(action).isin(*K.GENERIC_RULES)),
        ("not-specific", (T.word_count(text) < 3) | (T.word_count(action) < 4)),
        ("missing-evidence", F.coalesce(F.col("missing"), F.lit(1)) > 0),
        ("register", _bad_register(F.col("domain"), F.col("register"))),
        ("evidence-register", written & (F.col("no_register") > 0)),
        ("register-mismatch", written & (F.col("register") != expected)),
        ("contradiction", F.col("contradictions") > 0),
        ("needs-two-sessions", inferred & ((F.col("not_inferred") > 0) | (F.col("sessions") < 2) | (F.col("quotes") < 2))),
        ("needs-two-strata", inferred & needs & (F.col("strata") < 2)),
        ("explicit-label", explicit & ((F.col("not_explicit") > 0) | (F.col("quotes") < 1)
                                       | ~F.coalesce(F.col("confidence") == "low-frequency", wrong))),
        ("kind", ~F.coalesce(inferred | explicit, wrong))]
    error = F.coalesce(*[F.when(F.coalesce(bad, wrong), F.lit(code)) for code, bad in checks])
    return r.withColumn("error", error)


def domain_evidence_hash(evidence: DataFrame) -> DataFrame:
    """Digest per owner and domain of the evidence a draft was written from."""
    fields = [c for c in evidence.columns if c != "owner_id"]
    entry = I.canonical_json({c: F.col(c) for c in fields})
    return set_digest(evidence, ["owner_id", "domain"], entry, "evidence_set_hash")


def draft_issues(drafts: DataFrame, rules: DataFrame, evidence: DataFrame, tool: str = "turnmill",
                 require_strata: bool = True) -> DataFrame:
    """Domain drafts with their first error.

    ``drafts``: owner_id, domain, schema_version, evidence_set_hash, status, deepen_instruction, discarded, coverage
    struct. ``rules``: the rules of those drafts with owner_id, domain, rule_no, rule_id.
    """
    want = domain_evidence_hash(evidence).withColumnRenamed("evidence_set_hash", "want_hash")
    checked = rule_issues(rules, evidence, require_strata)
    scope_error = F.coalesce(
        F.when(F.col("other_domain") > 0, F.lit("other-domain-evidence")),
        F.when(F.array_contains("e_scopes", "contextual") & ~F.coalesce(F.col("scope") == "contextual", F.lit(False)),
               F.lit("scope-broadened")),
        F.when((F.col("scope") == "contextual") & _no(T.strip(F.coalesce("context", F.lit("")))), F.lit("context-missing")),
        F.col("error"))
    per_rule = checked.withColumn("rule_error", scope_error)
    firsts = per_rule.groupBy("owner_id", "domain").agg(
        F.count("*").alias("rule_count"), F.min_by("rule_error", F.when(F.col("rule_error").isNotNull(), F.col("rule_no"))).alias(
            "rule_error"))
    d = drafts.join(want, ["owner_id", "domain"], "left").join(firsts, ["owner_id", "domain"], "left").fillna(
        0, ["rule_count"])
    idle, live = F.col("status") == "inactive", F.col("status") == "active"
    no_rules = F.col("rule_count") == 0
    checks = [
        (F.lit("domain"), ~F.col("domain").isin(*K.DOMAINS)),
        (F.lit("schema-version"), F.col("schema_version") != K.DOMAIN_DRAFT_VERSION),
        (F.lit("evidence-set-hash"), ~F.col("evidence_set_hash").eqNullSafe(F.col("want_hash"))),
        (F.lit("work-must-be-active"), idle & (F.col("domain") == "work")),
        (F.lit("deepen-instruction"), idle & ~F.col("deepen_instruction").eqNullSafe(
            F.concat(F.lit(f"run {tool} and deepen "), F.col("domain")))),
        (F.lit("inactive-with-rules"), idle & ~no_rules),
        (F.lit("status"), ~F.coalesce(idle | live, F.lit(False))),
        (F.lit("rules-missing"), live & no_rules),
        (F.lit("discarded-missing"), live & F.col("discarded").isNull()),
        (F.col("rule_error"), live & F.col("rule_error").isNotNull()),
        (F.lit("coverage"), live & (F.col("coverage").isNull() | T.any_of(
            F.col(f"coverage.{c}").isNull()
            for c in ("evidence_items", "distinct_sessions", "strata", "unresolved_contradictions")))),
        (F.lit("unresolved-contradictions"), live & (F.col("coverage.unresolved_contradictions") > 0))]
    error = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in checks])
    return d.select("owner_id", "domain", "status", error.alias("error"))


def top_laws(rules: DataFrame, support: DataFrame, k: int = 3) -> DataFrame:
    """The work rules most sessions stand behind."""
    ranked_rules = rules.filter("domain = 'work'").join(support.select("owner_id", "rule_id", "sessions"), ["owner_id", "rule_id"])
    top = top_rows(ranked_rules, ["owner_id"], [F.desc("sessions"), F.col("text"), F.col("rule_id")], k)
    return top.select("owner_id", "rule_id", "text", F.format_string("%d sessions", "sessions").alias("count"), "sessions")


def law_issues(laws: DataFrame, rules: DataFrame, support: DataFrame) -> DataFrame:
    """Card laws that match no work rule, or whose count is not the rule's."""
    known = rules.filter("domain = 'work'").select("owner_id", "rule_id", "text").join(
        support.select("owner_id", "rule_id", "sessions"), ["owner_id", "rule_id"]).drop("rule_id")
    # A later rule of the same text takes the earlier one's place.
    known = newest(known, ["owner_id", "text"], ["sessions"])
    both = laws.select("owner_id", "text", "count").join(known, ["owner_id", "text"], "left")
    wrong = F.when(F.col("sessions").isNull(), "no-such-rule").when(
        F.col("count") != F.format_string("%d sessions", "sessions"), "wrong-count")
    return both.select("owner_id", "text", wrong.alias("problem")).filter("problem is not null")


def profile_lines(rules: DataFrame, product: str = "turnmill") -> DataFrame:
    """Lines of every domain profile: ``section`` and ``sort_key`` order them inside a domain.

    Rows rather than one text per profile, so a profile of any length is sorted and written by many tasks.
    """
    register = F.coalesce("register", F.lit("shared"))
    section = F.coalesce(*[F.when(register == r, F.lit(n)) for n, (r, _) in enumerate(K.REGISTER_HEADINGS, 1)])
    body = rules.select(
        "owner_id", "domain", F.when(F.col("domain") == "write", section).otherwise(1).alias("section"),
        F.struct("text", "implication", "rule_id").alias("sort_key"),
        F.concat(F.lit("- "), F.col("text"), F.lit("\n  - Action: "), F.col("implication")).alias("line"))
    empty = F.struct(F.lit("").alias("text"), F.lit("").alias("implication"), F.lit("").alias("rule_id"))
    title = F.coalesce(*[F.when(F.col("section") == n, F.lit(f"{h}\n")) for n, (_, h) in enumerate(K.REGISTER_HEADINGS, 1)])
    headings = body.filter("domain = 'write'").select("owner_id", "domain", "section").distinct().select(
        "*", empty.alias("sort_key"), title.alias("line"))
    name = F.concat(F.lit(f"---\nname: {product}-"), F.col("domain"), F.lit("-profile\ndescription: Evidence-backed "),
                    F.col("domain"), F.lit(" profile\n---\n\n# "), F.initcap("domain"), F.lit(" profile\n"))
    pick = "Pick one register per task from the audience in front of you; voice laws always apply.\n"
    heads = body.select("owner_id", "domain").distinct().select(
        "*", F.lit(0).alias("section"), empty.alias("sort_key"),
        F.concat(name, F.when(F.col("domain") == "write", F.lit("\n" + pick)).otherwise("")).alias("line"))
    return body.unionByName(headings).unionByName(heads)


def appendix_lines(evidence_ids: DataFrame, quote_rows: DataFrame) -> DataFrame:
    """Quotes behind the rules, escaped for Markdown; ordered by id, date, session, receipt."""
    return evidence_ids.distinct().join(quote_rows, ["owner_id", "evidence_id"]).select(
        "owner_id", "evidence_id", "date", "session_id", "receipt_id",
        F.concat(F.lit("- "), T.escape_markdown(F.col("session_id")), F.lit(" "), T.escape_markdown(F.col("date")),
                 F.lit(": "), T.escape_markdown(F.col("text"))).alias("line"))


def appendix_issues(appendix: DataFrame, referenced: DataFrame, quote_rows: DataFrame) -> DataFrame:
    """Referenced evidence that an appendix does not show: its id (missing-id), or the date or text of a quote (missing-quote).

    ``appendix``: owner_id, line, the blocks of its text in any cut that leaves no quote apart. ``referenced``: owner_id,
    evidence_id. ``quote_rows``: owner_id, evidence_id, date, text; both are looked for as the appendix writes them.
    """
    ids = referenced.select("owner_id", "evidence_id").distinct()
    shown = {c: T.escape_markdown(F.coalesce(c, F.lit(""))) for c in ("date", "text")}
    quotes = materialize(ids.join(quote_rows, ["owner_id", "evidence_id"]).select(
        "owner_id", "evidence_id", F.explode(F.array(*shown.values())).alias("needle")).distinct(), "appendix-quotes")
    wanted = ids.select("owner_id", "evidence_id", F.col("evidence_id").alias("needle"), F.lit("missing-id").alias("problem")).unionByName(
        quotes.filter("needle != ''").withColumn("problem", F.lit("missing-quote")))
    blocks = materialize(appendix.select("owner_id", F.col("line").alias("haystack")), "appendix-blocks")
    # Most needles are all of a line behind its opening. Only the others are looked for everywhere.
    sought = wanted.select("owner_id", "needle").distinct()
    left = materialize(sought.join(_line_bodies(blocks), ["owner_id", "needle"], "left_anti"), "appendix-needles")
    # Written, as the optimizer would search once for each part of ``wanted``.
    missing = materialize(left.join(find_spans(left, blocks, []).distinct(), ["owner_id", "needle"], "left_anti"), "appendix-missing").alias("m")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("owner_id", "needle")]
    return wanted.alias("w").join(missing, same, "left_semi").select("owner_id", "evidence_id", "problem").distinct()


def _line_bodies(blocks: DataFrame) -> DataFrame:
    """``owner_id, needle``: what follows the marks of a heading or the date of a quote, for each line of the blocks."""
    lines = blocks.select("owner_id", F.explode(F.split("haystack", "\n")).alias("line"))
    after = F.instr("line", ": ")
    body = F.when(F.col("line").startswith("- ") & (after > 0), F.substr("line", after + 2)).when(
        F.col("line").startswith("#"), F.regexp_replace("line", "^#+ ", ""))
    return lines.select("owner_id", body.alias("needle")).filter("needle != ''").distinct()


def coverage_recall(required: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovered over required per domain; both hold owner_id, domain, requirement."""
    key = ["owner_id", "domain", "requirement"]
    hit = required.select(*key).distinct().join(
        recovered.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return hit.groupBy("owner_id", "domain").agg(F.count("*").alias("required"), F.count("hit").alias("recovered"))
