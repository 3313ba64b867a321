import random
from datetime import datetime

from turnmill.plans import generations

OPS = "owner_id string, op long, operation string, target long, created_at timestamp"


def sequential(ops, chosen):
    """Generations as (owner, op, members), one operation after the other."""
    made = []
    for owner in sorted({o[0] for o in ops}):
        held, history = set(), []
        for _, op, operation, target, _ in sorted(o for o in ops if o[0] == owner):
            picks = {c: ok for w, n, c, ok in chosen if w == owner and n == op}
            if operation == "activate":
                new = set(picks) - held
                if not new or not all(picks[c] for c in new):
                    continue
                held = held | new
            else:
                past = [m for n, m in history if n == target]
                if not past or history[-1][0] == target:
                    continue
                held = past[0]
            history.append((op, held))
            made.append((owner, op, sorted(held)))
    return made


def test_replay_against_one_by_one(spark):
    rng = random.Random(7)
    ops, chosen = [], []
    for owner in ("a", "b", "c"):
        for op in range(40):
            back = rng.random() < 0.35
            ops.append((owner, op, "rollback" if back else "activate", rng.randint(0, op + 1) if back else None, datetime(2026, 1, 1)))
            if not back:
                chosen += [(owner, op, f"c{n}", rng.random() < 0.85) for n in rng.sample(range(25), rng.randint(0, 4))]
    frame = spark.createDataFrame(ops, OPS).repartition(3)
    picks = spark.createDataFrame(chosen, "owner_id string, op long, candidate_id string, allowed boolean")
    for shard in (20_000, 9):
        made, members = generations.replay(frame, picks, shard)
        rows, spans = sorted(tuple(r) for r in made.collect()), [tuple(r) for r in members.collect()]
        want = sequential(ops, chosen)
        assert [(r[0], r[1], r[5]) for r in rows] == [(o, n, len(m)) for o, n, m in want]
        for owner, op, held in want:
            assert sorted(c for w, c, since, until in spans if w == owner and since <= op and (until is None or op < until)) == held
        for before, row in zip([None, *rows], rows):
            assert row[7] == (before[6] if before and before[0] == row[0] else None)
        # Equal members at another place are another generation.
        assert len({r[6] for r in rows}) == len(rows)


def test_small_owners_are_replayed_in_one_pass(spark, monkeypatch):
    def guess(*_):
        raise AssertionError("small owners need no guesses")

    monkeypatch.setattr(generations, "_replay_large", guess)
    # Every rollback depends on the operation before it, so guesses would be renewed once an operation.
    ops = [("a", n, "rollback" if n % 2 else "activate", n - 1 if n % 4 == 1 else n - 3 if n % 2 else None, datetime(2026, 1, 1)) for n in range(40)]
    chosen = [("a", n, f"c{n % 6}", n % 5 != 0 or n == 0) for n in range(0, 40, 2)] + [("a", 2, None, True), (None, 2, "c", True), ("a", 1, "no", True)]
    made, _ = generations.replay(spark.createDataFrame(ops, OPS), spark.createDataFrame(chosen, "owner_id string, op long, candidate_id string, allowed boolean"))
    want = sequential(ops, [c for c in chosen if c[0] and c[2]])
    assert sorted((r.owner_id, r.op, r.members) for r in made.collect()) == [(o, n, len(m)) for o, n, m in want]


def test_newest_decision_by_then(spark):
    at = lambda day: datetime(2026, 1, day)
    decisions = [("o", "x", "d1", "approve", "safe", at(2)), ("o", "x", "d2", "reject", "safe", at(4)), ("o", "x", "d3", "approve", "review", at(4)),
                 ("o", "y", "d4", "approve", "reject", at(1))]
    chosen = [("o", n, "x", at(n)) for n in (1, 2, 3, 4, 9)] + [("o", 3, "y", at(3)), ("o", 3, "z", at(3))]
    got = generations.allowed_at(
        spark.createDataFrame(chosen, "owner_id string, op long, candidate_id string, created_at timestamp"),
        spark.createDataFrame(decisions, "owner_id string, candidate_id string, decision_id string, decision string, policy_class string, decided_at timestamp"))
    assert sorted((r.candidate_id, r.op, r.allowed) for r in got.collect()) == [
        ("x", 1, False), ("x", 2, True), ("x", 3, True), ("x", 4, True), ("x", 9, True), ("y", 3, False), ("z", 3, False)]
