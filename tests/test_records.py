import hashlib

import pytest
from pyspark.sql import functions as F

from turnmill import constants as K
from turnmill.functions import identity as I
from turnmill.plans import accounts, experiment, privacy, review
from turnmill.session import materialize
from turnmill.sinks import tables

CANDIDATE = ("owner_id string, candidate_id string, schema_version string, kind string, domain string, statement string, scope array<string>, "
             "evidence array<struct<observed_at:string,receipt_id:string,session_id:string,time_stratum:string>>, contradiction_count int, "
             "risk_categories array<string>, source_packet_hash string, prompt_contract_version string, created_at string")
NAMED = ("schema_version", "kind", "domain", "statement", "scope", "evidence", "contradiction_count", "risk_categories",
         "source_packet_hash", "prompt_contract_version")


def proof(n, session, month="2026-01"):
    return (f"{month}-01T00:00:00Z", f"rcpt_{n:020x}", f"{session:016x}", month)


GOOD = [proof(1, 1), proof(2, 2, "2026-02"), proof(3, 3)]


def candidate(spark, **changes):
    row = {"kind": "directive", "domain": "work", "statement": "run tests", "scope": ["a", "b"], "evidence": GOOD, "contradiction_count": 0,
           "risk_categories": [], "source_packet_hash": "a" * 64, "created_at": "2026-03-01T00:00:00Z", **changes}
    df = spark.createDataFrame([(
        "o", "", review.schema_name("candidate"), row["kind"], row["domain"], row["statement"], row["scope"], row["evidence"],
        row["contradiction_count"], row["risk_categories"], row["source_packet_hash"], review.schema_name("candidate-prompt"), row["created_at"])],
        CANDIDATE)
    return df.withColumn("candidate_id", I.content_id("cand_", {c: F.col(c) for c in NAMED}))


@pytest.mark.parametrize("changes, auto, want", [
    ({}, True, ("safe", "repeated-explicit-low-risk")), ({}, False, ("review", "auto-disabled")),
    ({"risk_categories": ["mystery"]}, True, ("reject", "unknown-risk-category")), ({"risk_categories": ["legal"]}, True, ("review", "prohibited-risk")),
    ({"kind": "retirement"}, True, ("review", "retirement")), ({"contradiction_count": 1}, True, ("review", "contradiction")),
    ({"evidence": GOOD[:2]}, True, ("review", "insufficient-sessions")),
    ({"evidence": [proof(n, n) for n in range(3)]}, True, ("review", "insufficient-time-strata"))])
def test_policy(spark, changes, auto, want):
    row = review.with_policy(candidate(spark, **changes), auto).first()
    assert (row.policy_class, row.policy_reason) == want


@pytest.mark.parametrize("changes, want", [
    ({}, None), ({"kind": "other"}, "kind"), ({"statement": ""}, "statement"), ({"statement": "a\tb"}, "control-character"),
    ({"scope": ["b", "a"]}, "scope-order"), ({"scope": ["A"]}, "scope-item"), ({"evidence": []}, "evidence"),
    ({"evidence": [GOOD[0], GOOD[0]]}, "evidence-repeat"), ({"evidence": [("x", *GOOD[0][1:])]}, "evidence-row"),
    ({"contradiction_count": 1001}, "contradictions"), ({"source_packet_hash": "x"}, "packet-hash"), ({"created_at": "2026-13-01T00:00:00Z"}, "created-at")])
def test_candidate_contract(spark, changes, want):
    assert candidate(spark, **changes).select(review.candidate_error()).first()[0] == want


def test_identity_is_part_of_the_contract(spark):
    changed = candidate(spark).withColumn("statement", F.lit("something else"))
    assert changed.select(review.candidate_error()).first()[0] == "identity"


def test_decisions_and_queue(spark, rows):
    good = candidate(spark)
    both = materialize(good.unionByName(candidate(spark, risk_categories=["mystery"])), "candidates")
    good_id = good.first().candidate_id
    verdicts = both.select("owner_id", "candidate_id").crossJoin(spark.createDataFrame(
        [("reject", "first-look", "2026-03-01T00:00:00Z"), ("approve", "looks-right", "2026-03-02T00:00:00Z")],
        "decision string, reason string, decided_at string"))
    made, refused = review.record_decisions(both, verdicts)
    made = materialize(made, "decisions")
    assert refused.count() == 1 and made.count() == 3
    assert made.select(review.decision_error()).distinct().collect()[0][0] is None
    queue = {r.candidate_id: r.decision for r in review.review_queue(both, made).collect()}
    assert queue[good_id] == "approve" and sorted(queue.values()) == ["approve", "reject"]
    assert review.blocked_candidates(both.select("owner_id", "candidate_id"), made).count() == 1
    head = spark.createDataFrame([("o", "other")], "owner_id string, candidate_id string")
    assert review.active_statements(head, good.select("owner_id", "candidate_id"), both).count() == 1


def test_rollback_and_pull(spark, rows):
    chain = spark.createDataFrame([("o", "g1", None), ("o", "g2", "g1"), ("o", "g3", "g2"), ("o", "x2", "g1")],
                                  "owner_id string, generation_id string, parent_generation_id string")

    def at(name):
        return spark.createDataFrame([("o", name)], "owner_id string, generation_id string")

    targets = spark.createDataFrame([("o", g) for g in ("g1", "g3", "x2")], "owner_id string, generation_id string")
    assert rows(review.rollback(chain, at("g3"), targets), "generation_id", "is_ancestor") == [("g1", True), ("g3", False), ("x2", False)]
    for local, want in (("g1", "activated"), ("x2", "conflict"), ("g3", "unchanged")):
        assert review.pull_status(chain, at(local), at("g3"), 8).first().status == want


def test_inbox_bounds(spark):
    def scan(*texts):
        df = spark.createDataFrame([("o", "0" * 16, "claude", "2026-01-01", n, t) for n, t in enumerate(texts)],
                                   "owner_id string, session_id string, source string, date string, ordinal int, text string")
        receipts, truncated = review.inbox_receipts(df.withColumn("modified", F.lit("2026-02-01").cast("timestamp")))
        return receipts, truncated

    receipts, truncated = scan("mail a@b.org", "   ", "x" * 2001)
    assert receipts.count() == 2 and truncated.first().truncated_message_count == 1
    receipts, truncated = scan(*["é" * 2000] * 20)
    kept = receipts.count()
    assert kept == 17 and truncated.first().truncated_message_count == 20 - 16
    receipts, truncated = scan(*["y"] * 260)
    assert receipts.count() == 256 and truncated.first().truncated_message_count == 4
    files = spark.createDataFrame([("o", "0" * 16, 10, 20)], "owner_id string, session_id string, size long, mtime_ns long").withColumn(
        "quiet_since", F.lit("2026-02-01 00:02:00").cast("timestamp"))
    items = materialize(review.inbox(*scan("one", "two"), files), "inbox")
    assert items.select(review.inbox_error()).first()[0] is None
    assert items.first().created_at == "2026-02-01T00:02:00Z"
    assert review.new_items(items, items).isEmpty()


# --- experiment ---------------------------------------------------------------

def matrix(spark):
    systems = spark.createDataFrame([(s, s, "t" * 64, "p" * 64) for s in ("one", "two")],
                                    "system_id string, host string, tool_policy_sha256 string, permission_policy_sha256 string")
    tasks = spark.createDataFrame([(f"{f}-{v}", "f" * 64, "i" * 64) for f in K.FAMILIES for v in K.VARIANTS],
                                  "task_id string, fixture_sha256 string, instruction_sha256 string")
    budgets = spark.createDataFrame([(f, (10, 60)) for f in K.FAMILIES], "family string, budget struct<max_turns:int,time_seconds:int>")
    return materialize(experiment.build_cells(systems, tasks, budgets, "m" * 64, "s" * 64), "cells")


def test_matrix(spark, rows):
    cells = matrix(spark)
    assert cells.count() == 48 and cells.select("pair_id").distinct().count() == 24 and cells.select("review_id").distinct().count() == 48
    assert {r[0] for r in cells.groupBy("pair_id").agg(F.sum("order")).select("sum(order)").collect()} == {3}
    assert {r[0] for r in cells.filter("condition = 'cold'").select("order").distinct().collect()} == {1, 2}
    assert matrix(spark).exceptAll(cells).isEmpty()
    records = cells.select("cell_id", "pair_id", "family", "condition", F.lit("eligible").alias("publication_status"), F.lit("valid").alias("review_status"),
                           F.when(F.col("order") == 1, "tie").alias("preference"), F.lit("").alias("invalidation_reason"))
    assert experiment.matrix_issues(cells, records).isEmpty()
    lost = records.filter(F.col("cell_id") != records.first().cell_id)
    assert "missing-cell" in {r.problem for r in experiment.matrix_issues(cells, lost).collect()}
    every = records.withColumn("preference", F.lit("tie"))
    assert {r.problem for r in experiment.matrix_issues(cells, every).collect()} == {"one-review-per-pair"}
    assert set(experiment.public_cells(records).columns) >= {"cell_id", "record_sha256"}
    assert len(experiment.approval_digest(records).first()[0]) == 64


def test_paths_stay_inside(spark):
    cases = {"src/foo/a.py": False, "src/foobar/a.py": True, "src/foo": False, "src/foo/../x": True, "src\\foo\\a": False, "./src/foo/a": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = df.select("p", experiment._outside(F.array("p"), F.array(F.lit("src/foo")))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_supersession_and_binding(spark, rows):
    events = spark.createDataFrame([("c", "evaluations", 1, "a"), ("c", "evaluations", 2, "b"), ("c", "attempts", 1, "t")],
                                   "cell_id string, kind string, event_no int, sha256 string")
    records = spark.createDataFrame([("c", "t", "a", None)], "cell_id string, attempt_sha256 string, evaluation_sha256 string, review_sha256 string")
    assert rows(experiment.binding_issues(records, events)) == [("c", "evaluations", "not-the-final-one")]
    evaluations = spark.createDataFrame([("c", 1, "a", None, None), ("c", 2, "b", "a", "typo"), ("c", 3, "d", "zz", "x"), ("c", 4, "e", "a", "")],
                                        "cell_id string, event_no int, sha256 string, supersedes_sha256 string, supersession_reason string")
    assert rows(experiment.supersession_issues(evaluations)) == [("c", 3, "no-prior-evaluation"), ("c", 4, "reason-missing")]


# --- privacy --------------------------------------------------------------------

def test_privacy(spark):
    cases = {"plain": [], "the bird": ["canary"], "/home/me/x and C:\\Users\\me": ["home-path"], "/Users/me": ["local-path"],
             "token: abc": ["secret-pattern"], "at /srv/private": ["private-root"]}
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: r.findings for r in privacy.scan(df, {"canary": "bird"}, ("/srv/private",)).collect()}
    assert got == cases
    files = spark.createDataFrame([
        ("a.json", b"{}"), ("b.png", "x bird".encode("utf-16le")), ("c.exe", b""), ("d.txt", b"\xff\xfe"), (".h/e.md", b"")], "path string, content binary")
    got = {r.path: (r.error, r.findings, r.passed) for r in privacy.scan_tree(files, {"canary": "bird"}).collect()}
    assert got["a.json"] == (None, [], True) and got["b.png"] == (None, ["canary"], False) and got["c.exe"][0] == "extension"
    assert got["d.txt"][0] == "not-utf8" and got[".h/e.md"][0] == "hidden"


# --- accounts -------------------------------------------------------------------

@pytest.mark.parametrize("kind, status, cancels, want", [
    ("revoked", "active", False, "ended"), ("past_due", "active", False, "past_due"), ("canceled", "active", True, "active"),
    ("canceled", "trialing", True, "trialing"), ("canceled", "active", False, "ended"), ("updated", "trialing", False, "trialing"),
    ("updated", "unpaid", False, "ended"), ("updated", "odd", False, None), ("updated", "active", None, None)])
def test_states(spark, kind, status, cancels, want):
    df = spark.createDataFrame([(f"subscription.{kind}", status, cancels)], "t string, s string, c boolean")
    assert df.select(accounts.entitlement_state(F.col("t"), F.col("s"), F.col("c"))).first()[0] == want


def test_event_outcomes(spark):
    data = [(1, "e5", "a", "c1", "2026-01-05"), (2, "e3", "a", "c1", "2026-01-03"), (3, "e5", "a", "c1", "2026-01-09"),
            (4, "e6", "a", "c1", "2026-01-05"), (5, "e7", "zz", "c9", "2026-01-01"), (6, "e8", "b", "c1", "2026-01-01"), (7, "e9", "b", "c2", "2026-01-01")]
    events = spark.createDataFrame(data, "arrival long, event_id string, account_id string, customer_id string, effective_at string")
    known = spark.createDataFrame([("a",), ("b",)], "account_id string")
    got = {r.arrival: r.status for r in accounts.event_status(events, known).collect()}
    assert got == {1: "applied", 2: "stale", 3: "duplicate", 4: "applied", 5: "unknown-account", 6: "customer-conflict", 7: "applied"}


def test_heads(spark, rows):
    data = [("a", "g1", None, 1), ("a", "g2", "g1", 2), ("a", "x2", "g1", 3), ("a", "g4", "g3", 4), ("a", "g3", "g2", 5), ("a", "g2", "g1", 6)]
    uploads = spark.createDataFrame(data, "account_id string, generation_id string, parent_generation_id string, arrival long")
    moved, tips = accounts.advance_heads(uploads)
    assert rows(moved.filter("head_advanced"), "generation_id") == [("g1",), ("g2",), ("g3",)] and rows(tips) == [("a", "g3")]
    later = spark.createDataFrame([("a", "g5", "g3", 1), ("a", "r", None, 2)], uploads.schema)
    assert rows(accounts.advance_heads(later, tips)[1]) == [("a", "g5")]


def test_long_chains(spark, rows):
    chain = materialize(spark.range(800).select(
        F.lit("a").alias("account_id"), F.format_string("g%04d", "id").alias("generation_id"),
        F.when(F.col("id") > 0, F.format_string("g%04d", F.col("id") - 1)).alias("parent_generation_id"), F.col("id").alias("arrival")), "chain")
    moved, tips = accounts.advance_heads(chain)
    assert rows(tips) == [("a", "g0799")] and moved.filter("head_advanced").count() == 800
    generations = chain.withColumnRenamed("account_id", "owner_id")

    def at(*names):
        return spark.createDataFrame([("a", n) for n in names], "owner_id string, generation_id string")

    assert rows(review.rollback(generations, at("g0799"), at("g0001", "g0799", "x")), "generation_id", "is_ancestor") == [
        ("g0001", True), ("g0799", False), ("x", False)]
    for local, want in (("g0799", "unchanged"), ("g0400", "activated"), ("g0001", "chain-too-long"), ("x", "chain-too-long")):
        assert review.pull_status(generations, at(local), at("g0799")).first().status == want
    assert review.pull_status(generations, at("x"), at("g0300")).first().status == "conflict"
    accepted = accounts.within_quota(chain, spark.createDataFrame([("a", 20)], "account_id string, generations int"))
    assert accepted.filter("accepted").count() == 480


def test_quota_refuses_bytes_as_well_as_generations(spark, rows):
    import random

    rng, sent = random.Random(4), [("b", "x", 1, 60), ("b", "y", 2, 50), ("b", "x", 3, 60), ("b", "z", 4, 40), ("b", "w", 5, 1)]
    for account in ("c", "d", "e"):
        sent += [(account, f"g{i}", i, rng.choice([0, 1, 5, 9, 30])) for i in range(40)]
    # Sizes that fall and rise inside one class, where what fits comes late.
    sent += [("f", f"g{i}", i, size) for i, size in enumerate([40, 50, 63, 62, 35, 61, 60, 35, 34, 3, 2, 2, 2, 33, 1, 1, 1, 1, 1])]
    for account in range(40):
        sent += [(f"r{account}", f"g{i}", i, rng.randint(0, rng.choice([3, 20, 60, 120]))) for i in range(rng.randint(1, 60))]
    held = {"c": (3, 20), "e": (0, 101)}
    want, seen, used = [], {}, {}
    for a, g, n, size in sent:
        if (a, g) not in seen:
            count, stored = used.get(a, held.get(a, (0, 0)))
            seen[a, g] = count < 12 and stored + size <= 100
            if seen[a, g]:
                used[a] = count + 1, stored + size
        want.append((a, g, n, seen[a, g]))
    uploads = spark.createDataFrame(sent, "account_id string, generation_id string, arrival long, bytes long")
    stored = spark.createDataFrame([(a, *x) for a, x in held.items()], "account_id string, generations int, bytes long")
    got = accounts.within_quota(uploads, stored, 12, 100)
    assert rows(got, "account_id", "generation_id", "arrival", "accepted") == sorted(want, key=str)
    moved, _ = accounts.advance_heads(uploads.withColumn("parent_generation_id", F.lit(None).cast("string")), None, stored, 12, 100)
    first = {a: min(n for b, _, n, taken in want if taken and a == b) for a, _, _, taken in want if taken}
    assert sorted(tuple(r) for r in moved.filter("head_advanced").select("account_id", "arrival").collect()) == sorted(first.items())
    assert ("b", "y", 2, False) in want and ("b", "z", 4, True) in want and not any(r[3] for r in want if r[0] == "e")


def test_inbox_reads_and_redacts_its_messages_once(spark):
    said = [("o", "s", "custom", "undated", n, f"say {n} password: hunter2hunter2") for n in range(300)]
    messages = spark.createDataFrame(said, "owner_id string, session_id string, source string, date string, ordinal bigint, text string").withColumn(
        "modified", F.lit("2026-02-01").cast("timestamp"))
    receipts, truncated = review.inbox_receipts(messages)
    assert "REDACTED" not in receipts._jdf.queryExecution().optimizedPlan().toString()
    assert receipts.count() == 256 and truncated.first().truncated_message_count == 44


def test_appended_digests_travel_as_bytes(spark, tmp_path, monkeypatch):
    kinds, write = [], tables.materialize
    monkeypatch.setattr(tables, "materialize", lambda df, *rest: kinds.append(dict(df.dtypes)["content_sha256"]) or write(df, *rest))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert tables.append_once(first, f"{tmp_path}/t", ["id"]).count() == 0
    clash = tables.append_once(spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, v string"), f"{tmp_path}/t", ["id"])
    assert kinds == ["binary"] * 4
    stored = {r.id: r.content_sha256 for r in tables.read_appended(spark, f"{tmp_path}/t").collect()}
    digest = lambda n, v: hashlib.sha256(f'{{"id":{n},"v":"{v}"}}'.encode()).hexdigest()
    assert stored == {1: digest(1, "a"), 2: digest(2, "b"), 3: digest(3, "d")}
    assert [tuple(r) for r in clash.collect()] == [(2, "c", digest(2, "c"))]


def test_packet_texts_mines_messages_once(spark, tmp_path, monkeypatch):
    # The ledger of the packets used to be mined, and so redacted, a second time.
    from turnmill.plans import corpus
    from turnmill.queries import QUERIES

    texts = [(i, f"please fix the failing build of part {i} and tell me why it broke again", "en", "a") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    mine, calls = corpus.mine, []
    monkeypatch.setattr(corpus, "mine", lambda *args, **more: calls.append(1) or mine(*args, **more))
    found = QUERIES["packet_texts"](spark, str(tmp_path))
    assert found.count() >= 3 and len(calls) == 1
