import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from turnmill.functions.identity import sha256
from turnmill.plans import corpus, evidence, receipts, segments, trace, usage
from turnmill.session import materialize
from turnmill.sinks import corpus as sink, keyindex, tables
from turnmill.sources.corpus_text import messages_from_corpus, read_corpus_lines

SHAPE = ("owner_id string, session_id string, source string, file_path string, block_start long, line_id long, part_no long, "
         "date string, text string")


def messages(spark, *items):
    """Items are (session, line, date, text)."""
    return spark.createDataFrame([("o", s, "claude", s, 0, n, 0, d, t) for s, n, d, t in items], SHAPE)


def numbered(spark, *items):
    return messages(spark, *items).withColumn("ordinal", F.col("line_id").cast("int"))


# --- corpus --------------------------------------------------------------------

def test_long_copies_collapse_and_short_ones_stay(spark, rows):
    spec = "x" * 200
    raw = messages(spark, ("a", 0, "2026-01-01", spec), ("a", 1, "2026-01-01", "yes"), ("a", 2, "2026-01-02", spec),
                   ("b", 0, "undated", "yes"), ("b", 1, "undated", spec), ("b", 2, "undated", "mail me at a@b.org"), ("c", 0, "undated", spec))
    mined = corpus.mine(raw)
    assert rows(mined, "session_id", "ordinal", "redacted") == [("a", 0, False), ("a", 1, False), ("b", 0, False), ("b", 1, True)]
    stats = corpus.corpus_stats(mined, corpus.count_duplicates(raw)).first()
    assert (stats.sessions, stats.messages, stats.redactions, stats.duplicates, stats.first_date, stats.last_date) == (
        2, 4, 1, 3, "2026-01-01", "2026-01-01")
    assert corpus.mine(raw, dedupe=False).count() == 7


def test_sessions_hash_by_one_rule_at_every_size(spark):
    mined = numbered(spark, *[("big", i, "undated", f"message {i}") for i in range(2100)], ("small", 0, "undated", "hi"))
    hashes = {r.session_id: r.content_hash for r in corpus.roll_up(mined).collect()}

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for name, texts in (("big", [f"message {i}" for i in range(2100)]), ("small", ["hi"])):
        level = [digest(f"[undated]\n{t}") for t in texts]
        for _ in range(4):
            level = [digest("".join(level[i:i + 1024])) for i in range(0, len(level), 1024)]
        assert hashes[name] == digest(f"===== session:{name} source:claude =====\n{level[0]}")
    changed = mined.withColumn("text", F.when(F.col("ordinal") == 1500, "other").otherwise(F.col("text")))
    again = {r.session_id: r.content_hash for r in corpus.roll_up(changed).collect()}
    assert again["big"] != hashes["big"] and again["small"] == hashes["small"]


def test_corpus_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "PART_MESSAGES", 700)
    small = [(f"s{i:02d}", 0, f"2026-01-{i + 1:02d}", "words " * 20) for i in range(12)]
    mined = materialize(numbered(spark, *small, *[("huge", i, "2026-02-01", f"line {i}\nand more") for i in range(3000)]), "messages")
    sink.write_corpus(mined, str(tmp_path / "corpus"))
    sink.write_chunks(mined, str(tmp_path / "chunks"), 4)
    want = sorted((r.session_id, r.date, r.text) for r in mined.collect())
    for folder in ("corpus", "chunks"):
        back = messages_from_corpus(read_corpus_lines(spark, str(tmp_path / folder)))
        assert sorted((r.session_id, r.date, r.text) for r in back.collect()) == want
    one = numbered(spark, *small)
    sink.write_chunks(one, str(tmp_path / "even"), 4)
    names = sorted(p.name for p in (tmp_path / "even" / "owner_id=o").iterdir() if p.is_dir())
    assert names == [f"chunk=chunk-0{n}" for n in range(1, 5)]
    sink.write_chunks(one.filter("session_id < 's02'"), str(tmp_path / "even"), 1)
    assert [p.name for p in (tmp_path / "even" / "owner_id=o").iterdir() if p.is_dir()] == ["chunk=chunk-01"]


# --- receipts --------------------------------------------------------------------

def test_scores(spark):
    mined = numbered(spark, ("a", 0, "undated", "Never do that, it must stop"), ("a", 1, "undated", "same ask"), ("a", 2, "undated", "same ask"),
                     ("b", 0, "undated", "Same ask!"), ("b", 1, "undated", "look at this"))
    scored = {r.session_id + str(r.ordinal): r for r in receipts.score(receipts.ledger(mined)).collect()}
    assert scored["a0"].signal_families == ["correction", "directive"] and scored["a0"].salience == 1 + 24 + 20
    assert scored["a1"].recurrence_sessions == 2 and scored["a1"].signal_families == ["recurrence"] and scored["a1"].salience == 7
    assert scored["b1"].signal_families == ["exploration"] and scored["b1"].domain_hints == ["work"]
    assert all(r.receipt_id.startswith("rcpt-") and len(r.receipt_id) == 25 for r in scored.values())


def test_stage_b_leaves_stage_a_out(spark, rows):
    mined = numbered(spark, *[("s", i, "2026-01-01", f"always design the layout number {i}") for i in range(6)])
    ledger = receipts.ledger(mined)
    scored = materialize(receipts.score(ledger), "scored")
    first, packs = [materialize(df, "stage") for df in receipts.stage_plan(scored, "A")]
    assert first.count() == 6 and packs.count() == 1
    summary = receipts.stage_summary(first, packs, ledger).first()
    assert summary.planned_scout_calls == 1 and summary.selected_receipts == 6 and len(summary.plan_hash) == 64
    text = receipts.render_packets(packs, ledger).first().text
    assert text.count("===== receipt:") == 6 and text.endswith("\n")
    assert receipts.missing_receipts(packs, ledger.limit(5)).count() == 1
    drafts = spark.createDataFrame([("o", "design", True), ("o", "work", False)], "owner_id string, domain string, needs_deepening boolean")
    half = first.filter("position < 4")
    weak, second, _ = receipts.next_stage(scored, half, drafts)
    assert rows(weak.select(F.array_join("planned_domains", ","))) == [("design",)]
    assert {r[0] for r in second.select("receipt_id").collect()} == {r[0] for r in first.filter("position >= 4").select("receipt_id").collect()}


# --- segments --------------------------------------------------------------------

def sessions_of(spark, count, words=100, edit=None, extra=()):
    items = [(f"{i:016x}", 0, f"2026-01-{i + 1:02d}", ("edited " if i == edit else "") + f"word{i} " * words) for i in range(count)]
    return materialize(corpus.roll_up(numbered(spark, *items, *extra)), "sessions")


def sealed(spark, count, target, words=100):
    return materialize(segments.seal(sessions_of(spark, count, words), target), "index")


def hashes(df, active=True):
    return {r.segment_hash for r in df.filter(F.col("active") == active).collect()}


def test_sync_touches_only_what_changed(spark):
    index = sealed(spark, 8, 400)
    assert index.count() > 2
    same = segments.sync(index, sessions_of(spark, 8), 400)
    assert hashes(same) == hashes(index) and not hashes(same, False)
    grown = segments.sync(index, sessions_of(spark, 8, extra=[("f" * 16, 0, "2026-02-01", "new words here")]), 400)
    assert hashes(grown) > hashes(index) and len(hashes(grown)) == len(hashes(index)) + 1
    edited = materialize(segments.sync(index, sessions_of(spark, 8, edit=3), 400), "index")
    assert len(hashes(index) - hashes(edited)) == 1 and len(hashes(edited, False)) == 1
    back = segments.sync(edited, sessions_of(spark, 8), 400)
    assert hashes(back) == hashes(index)
    assert segments.broken_segments(index, sessions_of(spark, 8)).isEmpty()
    assert [r.problem for r in segments.broken_segments(index, sessions_of(spark, 8, edit=3)).collect()] == ["missing-session"]


def test_plan_of_an_unchanged_corpus_is_empty(spark, rows):
    index = sealed(spark, 6, 400)
    open_plan = segments.approval_hash(segments.plan(index, index.limit(0)))
    row = open_plan.first()
    assert row.planned_worker_calls == row.selected_segments and row.planned_reducer_calls == 1
    done = segments.plan(index, index, index.select("owner_id")).first()
    assert (done.planned_worker_calls, done.planned_reducer_calls) == (0, 0)
    moved = segments.approval_hash(segments.plan(index, index.limit(1)))
    assert rows(segments.drifted(open_plan, moved)) == [("o",)] and segments.drifted(open_plan, open_plan).isEmpty()


def test_oversize_session_stands_alone(spark):
    index = sealed(spark, 3, 100, 400).collect()
    assert len(index) == 3 and all(r.oversize for r in index)


# --- usage --------------------------------------------------------------------------

ASK = "please rebuild the whole index now"


def finding_rows(spark, rows, *items):
    return rows(usage.findings(numbered(spark, *items)), "finding", "session_id", "ordinal", "count", "marker")


def test_repeats(spark, rows):
    assert finding_rows(spark, rows, *[("a", i, "2026-01-01", ASK + "!" * i) for i in range(3)]) == [("repeat_sends", "a", 0, 3, "")]
    assert finding_rows(spark, rows, *[("a", i, "2026-01-01", ASK) for i in range(2)], ("b", 0, "2026-01-01", ASK)) == []
    assert finding_rows(spark, rows, *[("a", i, "2026-01-01", "ok do it") for i in range(4)]) == []
    split = [("a", 0, "x", ASK), ("a", 1, "x", " !? "), ("a", 2, "x", ASK), ("a", 3, "x", ASK), ("a", 4, "x", "other thing"), ("a", 5, "x", ASK)]
    assert finding_rows(spark, rows, *split) == [("repeat_sends", "a", 0, 3, "")]


def test_rewords(spark, rows):
    turns = [f"fix the broken login page on mobile {w}" for w in ("today", "now", "please")]
    assert finding_rows(spark, rows, *[("a", i, "x", t) for i, t in enumerate(turns)]) == [("reword_loops", "a", 0, 3, "")]
    block = [t + "\n" * 5 + "x" for t in turns]
    assert finding_rows(spark, rows, *[("a", i, "x", t) for i, t in enumerate(block)]) == []


def test_report(spark, rows):
    items = [("a", i, "2026-01-01", t) for i, t in enumerate(
        ["as i said use tabs", "like i said use tabs", "as i said use tabs", "no, not that one", "no need for that", "a b c d e f g h"])]
    found = {r.finding: r for r in usage.report(numbered(spark, *items)).collect()}
    assert found["restated_context"].occurrences == 3 and found["restated_context"].flagged
    assert [r.text for r in found["restated_context"].receipts] == ["as i said use tabs", "like i said use tabs"]
    assert found["corrections"].occurrences == 1 and found["corrections"].correction_rate == 16 and found["corrections"].flagged
    assert not found["repeat_sends"].flagged and found["repeat_sends"].receipts == []
    totals = usage.totals(numbered(spark, *items)).first()
    assert (totals.messages, totals.median_words, totals.short_prompts) == (6, 5, 5)


def test_hashes_of_growing_sessions(spark, rows, monkeypatch):
    monkeypatch.setattr(corpus, "_FOLD", 3)
    every = numbered(spark, *[(s, n, "undated", f"{s} says {n}") for s, n in [("a", n) for n in range(70)] + [("b", n) for n in range(9)] + [("c", 0)]])
    every = materialize(every, "messages")
    stored, latest = None, {}
    for lo, hi in ((0, 1), (1, 4), (4, 9), (9, 27), (27, 69), (69, 70)):
        hashes, stored = corpus.extend_hashes(every.filter(F.col("ordinal").between(lo, hi - 1)), stored)
        latest.update({r.session_id: r.content_hash for r in hashes.collect()})
        scratch = {r.session_id: r.content_hash for r in corpus.content_hashes(every.filter(F.col("ordinal") < hi)).collect()}
        assert latest == scratch
        # Two of three children a level at most are open.
        assert stored.groupBy("session_id").count().agg(F.max("count")).first()[0] <= 2 * corpus._FOLDS


# --- trace ------------------------------------------------------------------------------

CORPUS = [("aaa111", 0, "2026-01-01", "always run the full test suite first"), ("aaa111", 1, "2026-01-02", "keep the commit small and plain"),
          ("bbb222", 0, "2026-01-03", "Always  run the full\ntest suite first"), ("bbb222", 1, "2026-01-04", "don’t touch the old migration files")]


@pytest.mark.parametrize("profile, want", [
    ('rule "run the full test suite" stands', [("run the full test suite", 2)]),
    ('x "never ship on a friday" y', [("never ship on a friday", 0)]),
    ('“keep the commit small” and “Keep the  commit small”', [("keep the commit small", 1)]),
    ('"one two" then the prose between them "three four"', []),
    ("say \"don't touch the old migration\" please", [("don't touch the old migration", 1)]),
    ('odd "keep the commit small and" "dangling mark', [("keep the commit small and", 1)]),
    ('"** bold words are skipped"', []), ('"uns the full test suit"', [("uns the full test suit", 0)]),
    ('"un the full test suit"', [("un the full test suit", 2)]),
])
def test_trace(spark, rows, profile, want):
    quotes = trace.extract_quotes(spark.createDataFrame([("o", 1, profile)], "owner_id string, profile_id int, text string"))
    results = trace.trace_results(quotes, trace.trace(quotes, numbered(spark, *CORPUS)))
    assert rows(results, "quote", "sessions") == want


def test_results_from_needles_traced_once(spark, rows):
    profiles = [("o", 1, '"run the full test suite"'), ("o", 2, '"Run the full test suite" and "never said by anyone here"'), ("p", 1, '"run the full test suite"')]
    quotes = trace.extract_quotes(spark.createDataFrame(profiles, "owner_id string, profile_id int, text string"))
    traced = trace.trace(quotes.select("owner_id", "needle").distinct(), numbered(spark, *CORPUS))
    assert traced.count() == traced.select("needle", "session_id").distinct().count() > 0
    each = trace.trace_results(quotes, trace.trace(quotes, numbered(spark, *CORPUS)))
    assert rows(trace.trace_results(quotes, traced), *each.columns) == rows(each)


def test_trace_over_the_borders_of_messages(spark, rows):
    long = " ".join(f"w{n}" for n in range(4000))
    said = [("s1", n, "2026-01-0%d" % (n % 9 + 1), t) for n, t in enumerate(["we start here", "ok", long, "then stop", long + " end of it"])]
    said += [("s2", n, "undated", "ok") for n in range(3000)] + [("s3", 0, "undated", "then stop"), ("s3", 7, "undated", "and go on")]
    quotes = ["start here [2026-01-02] ok [2026-01-03] w0 w1 w2", "w3998 w3999 [2026-01-04] then stop", "then stop [2026-01-05] w0", "w3999 end of it",
              "ok [undated] ok [undated] ok [undated] ok", "stop [undated] and go", "then stop [2026-01-01] w0", "w5 w6 w7 w9", "w2000 w2001 w2002 w2003"]
    profile = "\n".join(f"“{q}”" for q in quotes)
    sessions = {}
    for session, _, date, text in said:
        sessions[session] = sessions.get(session, "") + f"[{date}] {text} "
    wanted = sorted((q, sum(q in t for t in sessions.values())) for q in quotes)
    found = trace.extract_quotes(spark.createDataFrame([("o", 1, profile)], "owner_id string, profile_id int, text string"))
    messages = spark.createDataFrame([("o", *m) for m in said], "owner_id string, session_id string, ordinal int, date string, text string").repartition(5)
    assert rows(trace.trace_results(found, trace.trace(found, messages)), "quote", "sessions") == wanted
    assert [n for _, n in wanted] != [0] * len(quotes)


def test_spans_by_automaton_and_by_word_runs(spark, rows):
    rng = random.Random(8)
    word = lambda: rng.choice("the cat sat on a mat by door ß é x".split())
    texts = [(rng.choice("pq"), n, " ".join(word() for _ in range(rng.randint(0, 40)))) for n in range(120)]
    needles = {(rng.choice("pq"), " ".join(word() for _ in range(rng.randint(1, 6)))) for _ in range(60)} | {("p", "at on"), ("q", "t s"), ("p", "a"), ("q", "")}
    wanted = sorted((o, n, needle) for o, n, t in texts for own, needle in needles if own == o and needle and needle in t)
    hay = spark.createDataFrame(texts, "owner_id string, n int, haystack string").repartition(3)
    sought = spark.createDataFrame(sorted(needles) * 2, "owner_id string, needle string")
    for options in ({}, {"shard_chars": 60}, {"shard_chars": 60, "most_passes": 2}):
        assert rows(trace.find_spans(sought, hay, ["n"], **options), "owner_id", "n", "needle") == sorted(wanted, key=str)
    assert trace.find_spans(sought.limit(0), hay, ["n"]).count() == 0


# --- evidence ------------------------------------------------------------------------------

def report_case(spark):
    mined = numbered(spark, ("0" * 16, 0, "2026-01-01", "always run the tests before you push"), ("0" * 16, 1, "2026-01-02", "keep it short"))
    segment = segments.seal(corpus.roll_up(mined), 1000)
    s = segment.first()
    quote = {"session_id": "0" * 16, "date": "2026-01-01", "text": "run the tests before"}
    body = {
        "schema_version": "2", "segment_hash": s.segment_hash,
        "coverage": {"session_ids": ["0" * 16], "sources": ["claude"], "first_date": "2026-01-01", "last_date": "2026-01-02",
                     "source_tokens": s.source_tokens},
        "domain_coverage": {"work": "evidence", "design": "no-signal", "write": "no-signal", "video": "no-signal"},
        "evidence": [{"evidence_id": f"ev-{s.segment_hash[:8]}-tests", "domain": "work", "kind": "inferred", "instruction": "run tests",
                      "implication": "before each push", "quotes": [quote], "contradictions": []}]}
    return mined, segment, body


MUTATIONS = [
    (None, None), ("schema-version", lambda b: b.update(schema_version="1")), ("segment-hash", lambda b: b.update(segment_hash="f" * 64)),
    ("coverage-sessions", lambda b: b["coverage"].update(session_ids=[])), ("coverage-metadata", lambda b: b["coverage"].update(first_date="x")),
    ("domain-coverage", lambda b: b["domain_coverage"].pop("video")), ("domain-evidence", lambda b: b["domain_coverage"].update(design="evidence")),
    ("evidence-id", lambda b: b["evidence"][0].update(evidence_id="ev-x")), ("evidence-id", lambda b: b["evidence"].append(b["evidence"][0])),
    ("register", lambda b: b["evidence"][0].update(register="casual")), ("domain-or-kind", lambda b: b["evidence"][0].update(kind="guess")),
    ("missing-text", lambda b: b["evidence"][0].update(quotes=[])), ("contradictions", lambda b: b["evidence"][0].pop("contradictions")),
    ("unknown-session", lambda b: b["evidence"][0]["quotes"][0].update(session_id="1" * 16)),
    ("quote-length", lambda b: b["evidence"][0]["quotes"][0].update(text="x" * 201)),
    ("not-verbatim", lambda b: b["evidence"][0]["quotes"][0].update(text="never said this")),
    ("not-verbatim", lambda b: b["evidence"][0]["quotes"][0].update(date="2026-01-02")),
    ("byte-ceiling", lambda b: b["evidence"][0].update(instruction="x" * 9000)),
    (None, lambda b: (b.update(evidence=[]), b["domain_coverage"].update(work="no-signal"))),
]


def test_report_mutations(spark):
    mined, segment, body = report_case(spark)
    raw, want = [], {}
    for n, (error, change) in enumerate(MUTATIONS):
        copy = json.loads(json.dumps(body))
        if change:
            change(copy)
        text = json.dumps({**copy, "note": n})
        raw.append(("o", text))
        want[n] = error
    df = spark.createDataFrame(raw, "owner_id string, raw string")
    ids = {r[0]: r[1] for r in df.select(sha256(F.col("raw")), F.get_json_object("raw", "$.note").cast("int")).collect()}
    checked = evidence.check_reports(evidence.parse_reports(df), segment, mined)
    got = {ids[r.report_id]: r.error for r in checked.collect()}
    assert got == want
    good, bad = evidence.quarantine(checked)
    assert good.count() == 2 and bad.count() == len(MUTATIONS) - 2


def test_scout_report(spark):
    mined = numbered(spark, ("s", 0, "2026-01-01", "always check the layout twice"))
    ledger = receipts.ledger(mined)
    packs = materialize(receipts.stage_plan(materialize(receipts.score(ledger), "scored"), "A")[1], "packs")
    p, r = packs.first(), ledger.first()
    item = {"evidence_id": "e1", "domain": "design", "kind": "explicit", "scope": "universal", "signal_family": "directive", "instruction": "i",
            "implication": "j", "quotes": [{"receipt_id": r.receipt_id, "session_id": "s", "date": "2026-01-01", "text": r.text}], "contradictions": []}
    body = {"schema_version": "3", "packet_hash": p.packet_hash, "coverage": {"receipt_ids": p.receipt_ids, "source_tokens": p.source_tokens},
            "domain_coverage": {"work": "no-signal", "design": "evidence", "write": "no-signal", "video": "no-signal"}, "evidence": [item]}

    def error(change):
        copy = json.loads(json.dumps(body))
        change(copy)
        df = spark.createDataFrame([("o", json.dumps(copy))], "owner_id string, raw string")
        return evidence.check_scout_reports(evidence.parse_reports(df), packs, ledger).first().error

    assert error(lambda b: None) is None
    assert error(lambda b: b["evidence"][0].update(scope="contextual")) == "context"
    assert error(lambda b: b["evidence"][0]["quotes"][0].update(text="other")) == "inexact-receipt"
    assert error(lambda b: b["evidence"][0].update(signal_family="luck")) == "signal-family"


def test_rule_support_counts_sessions_once(spark, rows, monkeypatch):
    def written(df, label):
        assert not {"sessions", "strata"} & set(df.columns), "lists of sessions are not written once more for every rule"
        return df

    monkeypatch.setattr(evidence, "materialize", written)
    facts = spark.createDataFrame([
        ("o", "e1", "work", "inferred", None, "universal", 0, ["a", "b"], ["x:1", "x:2"], 2), ("o", "e2", "work", "inferred", None, "universal", 0, ["b", "c"], ["x:1"], 3),
        ("o", "e3", "work", "inferred", None, "universal", 0, [], [], 0)],
        "owner_id string, evidence_id string, domain string, kind string, register string, scope string, contradictions int, sessions array<string>, "
        "strata array<string>, quote_count long")
    named = [("o", 1, ["e1"]), ("o", 2, ["e1", "e2", "e3"]), ("o", 3, ["e1", "e1", None]), ("o", 4, ["zz"]), ("o", 4, ["e2"]), ("o", 5, ["zz"]), ("o", 6, ["e3"])]
    rules = spark.createDataFrame([(o, r, "work", ids) for o, r, ids in named], "owner_id string, rule_id int, domain string, evidence_ids array<string>")
    for most in (10_000, 2):
        monkeypatch.setattr(evidence, "LISTED_ITEMS", most)
        assert rows(evidence.rule_support(rules, facts), "rule_id", "evidence_items", "missing", "quotes", "sessions", "strata") == [
            (1, 1, 0, 2, 2, 2), (2, 3, 0, 5, 3, 2), (3, 3, 1, 4, 2, 2), (4, 2, 1, 3, 2, 1), (5, 1, 1, 0, 0, 0), (6, 1, 0, 0, 0, 0)]


def test_rules_and_drafts(spark, rows):
    shape = ("owner_id string, evidence_id string, domain string, kind string, register string, scope string, context string, contradictions int, "
             "sessions array<string>, strata array<string>, quote_count long")
    facts = spark.createDataFrame([
        ("o", "e1", "work", "inferred", None, "universal", "", 0, ["a", "b"], ["x:1", "x:2"], 2),
        ("o", "e2", "work", "inferred", None, "contextual", "", 0, ["a"], ["x:1"], 1),
        ("o", "e3", "work", "explicit", None, "universal", "", 0, ["a"], ["x:1"], 1),
        ("o", "e4", "work", "inferred", None, "universal", "", 2, ["a", "b"], ["x:1", "x:2"], 2)], shape)
    rule = ("owner_id string, rule_id int, rule_no int, domain string, text string, implication string, kind string, confidence string, "
            "register string, scope string, context string, evidence_ids array<string>")
    text, action = "always run tests", "run the full suite first"
    listed = [
        (1, text, action, "inferred", None, None, "universal", ["e1"], None), (2, "be helpful", action, "inferred", None, None, None, ["e1"], "generic"),
        (3, "short", action, "inferred", None, None, None, ["e1"], "not-specific"), (4, text, action, "inferred", None, None, None, ["zz"], "missing-evidence"),
        (5, text, action, "inferred", None, "casual", None, ["e1"], "register"), (6, text, action, "inferred", None, None, None, ["e4"], "contradiction"),
        (7, text, action, "inferred", None, None, None, ["e2"], "needs-two-sessions"), (8, text, action, "explicit", None, None, None, ["e3"], "explicit-label"),
        (9, text, action, "explicit", "low-frequency", None, None, ["e3"], None), (10, text, action, "other", None, None, None, ["e1"], "kind")]
    rules = spark.createDataFrame([("o", i, i, "work", t, a, k, c, r, s, "", ids) for i, t, a, k, c, r, s, ids, _ in listed], rule)
    got = {r.rule_id: r.error for r in evidence.rule_issues(rules, facts).collect()}
    assert got == {i: e for i, *_, e in listed}
    want = evidence.domain_evidence_hash(facts).first().evidence_set_hash
    draft = ("owner_id string, domain string, schema_version string, evidence_set_hash string, status string, deepen_instruction string, "
             "discarded array<string>, coverage struct<evidence_items:int,distinct_sessions:int,strata:int,unresolved_contradictions:int>")

    def error(rule_ids, status="active", domain="work", instruction=None):
        drafts = spark.createDataFrame([("o", domain, "2", want if domain == "work" else None, status, instruction, [], (1, 2, 2, 0))], draft)
        return evidence.draft_issues(drafts, rules.filter(F.col("rule_id").isin(rule_ids)), facts).first().error

    assert error([1, 9]) is None and error([1, 3]) == "not-specific" and error([]) == "rules-missing"
    assert error([], "inactive") == "work-must-be-active"
    assert error([], "inactive", "video", "run turnmill and deepen video") is None and error([], "inactive", "video") == "deepen-instruction"


def test_many_quotes_of_one_day(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("keep it small and plain or ask".split())
    said = [("s", n, rng.choice(["2026-01-01", "2026-01-02"]), " ".join(word() for _ in range(30)) + rng.choice(["", "\n tail"])) for n in range(40)]
    quotes = [("s", rng.choice(["2026-01-01", "2026-01-02", "2026-01-03", None]), " ".join(word() for _ in range(rng.randint(1, 5)))) for _ in range(400)]
    quotes += [("s", "2026-01-01", " "), ("t", "2026-01-01", "keep"), (None, "2026-01-01", "keep"), ("s", "2026-01-01", None)]
    rows = [("o", n, 100, [([(None, *q)], [])]) for n, q in enumerate(quotes)]
    kind = "array<struct<receipt_id:string,session_id:string,date:string,text:string>>"
    reports = spark.createDataFrame(rows, f"owner_id string, report_id int, bytes int, evidence array<struct<quotes:{kind},contradictions:{kind}>>")
    bad = {r.report_id for r in evidence.unverbatim_quotes(reports, numbered(spark, *said)).collect()}
    good = {n for n, (s, d, q) in enumerate(quotes) if q and q.strip() and any(s == w and d == day and q.strip() in t for w, _, day, t in said)}
    assert bad == set(range(len(quotes))) - good and good


def test_appendix_searches_only_for_what_no_line_is(spark, rows, monkeypatch):
    asked = []

    def spans(needles, texts, key):
        asked.append(needles.select("needle").distinct())
        return trace.find_spans(needles, texts, key)

    monkeypatch.setattr(evidence, "find_spans", spans)
    ids = spark.createDataFrame([("o", "ev-1"), ("o", "ev-2"), ("o", "ev-3"), ("p", "ev-1"), (None, None), ("o", None)], "owner_id string, evidence_id string")
    said = [("o", "ev-1", "2026", "ask: first"), ("o", "ev-1", "2026", "keep *it* small"), ("o", "ev-2", "2027", "never shown"), ("o", "ev-2", None, "ask: first"),
            ("p", "ev-1", "2026", "plain"), ("o", "ev-3", "2026", "two\nlines"), ("o", "ev-3", "2026", "small")]
    lines = [("o", "## ev-1\n\n- s 2026: ask: first"), ("o", "- s 2026: keep \\*it\\* small\n# ev-22"), ("o", "- s 2026: two\nlines"), ("p", "# ev-1"), ("p", "- s: quite plain"), ("o", None)]
    found = evidence.appendix_issues(
        spark.createDataFrame(lines, "owner_id string, line string"), ids, spark.createDataFrame(said, "owner_id string, evidence_id string, date string, text string"))
    assert rows(found) == sorted([("o", "ev-2", "missing-quote"), ("o", "ev-3", "missing-id"), ("p", "ev-1", "missing-quote"),
                                  (None, None, "missing-id"), ("o", None, "missing-id")], key=str)
    # Not sought any more: ev-1 of both owners and the first two texts.
    assert rows(asked[0]) == sorted([("ev-2",), ("ev-3",), (None,), ("2026",), ("2027",), ("never shown",), ("plain",), ("two\nlines",), ("small",)], key=str)


# --- sinks ------------------------------------------------------------------------------------

def test_a_batch_opens_only_files_with_its_keys(spark, tmp_path):
    path, batch = str(tmp_path / "log"), lambda lo, hi: spark.range(lo, hi).select("id", (F.col("id") * 2).alias("v"))
    for n in range(6):
        tables.append_once(batch(n * 1000, n * 1000 + 1000), path, ["id"])
    opened = lambda df: len(tables.files_for(spark, path, df.withColumn("key_hash", keyindex.key_hash(["id"]))))
    assert opened(batch(2100, 2300)) == 1 and opened(batch(2900, 3100)) == 2
    # Strangers open a file once in twenty thousand times.
    assert opened(batch(10_000, 10_200)) <= 1 and opened(batch(0, 6000)) == 6
    before = spark.read.parquet(f"{path}/rows").count()
    # An interrupted batch: rows without an index do not count, and sending it again stores them.
    batch(9000, 9010).withColumn("content_sha256", F.lit("x")).withColumn("key_hash", keyindex.key_hash(["id"])).write.parquet(
        f"{path}/rows/appended_batch={'0' * 32}")
    assert tables.read_appended(spark, path).count() == before == 6000
    assert tables.append_once(batch(9000, 9010), path, ["id"]).isEmpty() and tables.read_appended(spark, path).count() == 6010


def test_append_once_and_publish(spark, rows, tmp_path):
    def table(*items):
        return spark.createDataFrame(items, "id string, v int")

    path = str(tmp_path / "log")
    assert tables.append_once(table(("a", 1), ("b", 2)), path, ["id"]).isEmpty()
    clash = tables.append_once(table(("a", 1), ("b", 3), ("c", 4)), path, ["id"])
    assert rows(clash, "id", "v") == [("b", 3)]
    assert rows(tables.read_appended(spark, path), "id", "v") == [("a", 1), ("b", 2), ("c", 4)]
    assert rows(tables.append_once(table(("d", 1), ("d", 2), ("e", 1), ("e", 1), (None, 5)), path, ["id"]), "id", "v") == [("d", 1), ("d", 2)]
    assert rows(tables.append_once(table((None, 5), ("e", 2)), path, ["id"]), "id", "v") == [("e", 2)]
    assert rows(tables.read_appended(spark, path), "id", "v") == sorted([("a", 1), ("b", 2), ("c", 4), ("e", 1), (None, 5)], key=str)
    root = str(tmp_path / "versions")
    first = tables.publish(table(("a", 1), ("b", 2)), root)
    assert tables.publish(table(("b", 2), ("a", 1)).repartition(3), root) == first
    tables.publish(table(("a", 1)), root)
    assert rows(tables.current(spark, root)) == [("a", 1)]
