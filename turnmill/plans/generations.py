"""Generations of approved statements, replayed from the operations that were asked for.

An activation adds the chosen candidates to what is active, a rollback makes active again what an earlier generation held.
Whether an operation makes a generation depends on what is active before it: an activation does if it brings something new and
nothing new is blocked, a rollback if its target is a generation before the head. No member list is kept per generation.
What is stored is one row per stretch in which a candidate is active, and a generation is named by the sum of its members'
hashes, which an operation changes by what it adds and takes away.

Owners of few operations are replayed whole, many in a task. The candidates of the others are replayed in shards, each with
the rollbacks of its owner, for a given guess of which operations made a generation; the guess is then renewed from what was found, until it stays. Operations before the first wrong guess are right
and stay so, therefore the last guess is the sequential result, whatever order owners and shards are worked in.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.functions import identity as I
from turnmill.operators.ordered import integer_chunks, previous, running
from turnmill.session import materialize

SHARD_CHOICES = 20_000
#: Steps of small owners that one task replays at a time.
GROUP_STEPS = 100_000
HASH_DIGITS = 15
HASH = "decimal(38,0)"


def allowed_at(chosen: DataFrame, decisions: DataFrame) -> DataFrame:
    """``chosen`` with ``allowed``: whether the newest decision by then approves the candidate and its class may be activated.

    ``chosen``: owner_id, candidate_id, created_at. ``decisions``: owner_id, candidate_id, decision_id, decision, policy_class,
    decided_at. Both times are timestamps.
    """
    key = ["owner_id", "candidate_id"]
    allows = (F.col("decision") == "approve") & F.col("policy_class").isin("safe", "review")
    made = decisions.select(*key, F.col("decided_at").alias("at"), F.struct("decided_at", "decision_id", allows.alias("allows")).alias("made"))
    asked = chosen.withColumns({"at": F.col("created_at"), "made": F.lit(None).cast(made.schema["made"].dataType)})
    both = made.unionByName(asked, allowMissingColumns=True).withColumn("asks", F.col("made").isNull().cast("int"))
    days = [{"day": F.to_date("at")}, {"year": F.year("at")}]
    # A decision of the same moment counts.
    seen = running(materialize(both, "decisions"), key, ["at", "asks"], days, maxes={"newest": F.col("made")})
    return seen.filter("asks = 1").select(*chosen.columns, F.coalesce("newest.allows", F.lit(False)).alias("allowed"))


class _Member:
    """When a candidate became active and inactive, in turn."""

    def __init__(self):
        self.turns: list[int] = []

    def active(self, op: int) -> bool:
        """Whether it is active after an operation."""
        return bisect_right(self.turns, op) % 2 == 1

    def turn(self, op: int, active: bool) -> None:
        if (len(self.turns) % 2 == 1) != active:
            self.turns.append(op)


def _replay(rows: pa.Table) -> pa.Table:
    """One shard of an owner's candidates: which choices were new, and when candidates were active."""
    owner = rows.column("owner_id")[0].as_py()
    members: dict[str, _Member] = {}
    found = []
    for op, target, candidate, allowed, made in sorted(zip(*[rows.column(n).to_pylist() for n in ("op", "target", "candidate_id", "allowed", "made")]),
                                                       key=lambda r: (r[0], r[2] or "")):
        if candidate is None:
            for member in members.values() if made else ():
                member.turn(op, member.active(target))
            continue
        member = members.setdefault(candidate, _Member())
        new = len(member.turns) % 2 == 0
        found.append((owner, op, candidate, new, new and not allowed, None))
        if made:
            member.turn(op, True)
    for candidate, member in members.items():
        for at in range(0, len(member.turns), 2):
            found.append((owner, member.turns[at], candidate, None, None, member.turns[at + 1] if at + 1 < len(member.turns) else -1))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64())
    names = ("owner_id", "op", "candidate_id", "new", "blocked", "until")
    return pa.table([pa.array([r[n] for r in found], kind) for n, kind in enumerate(kinds)], names=names)


def _in_order(rows: pa.Table) -> pa.Table:
    """Whole owners, one operation after the other: the generations (with a place) and the stretches of their members."""
    rows = rows.sort_by([("owner_id", "ascending"), ("op", "ascending"), ("candidate_id", "ascending")])
    owners = rows.column("owner_id").combine_chunks().dictionary_encode()
    owners = owners.combine_chunks() if isinstance(owners, pa.ChunkedArray) else owners
    at, ops, until, place = [], [], [], []
    members: dict[str, tuple[int, _Member]] = {}
    places: dict[int, int] = {}
    last, head, picked, picks = None, None, None, []

    def close():
        for n, member in members.values():
            for start in range(0, len(member.turns), 2):
                at.append(n)
                ops.append(member.turns[start])
                until.append(member.turns[start + 1] if start + 1 < len(member.turns) else None)
                place.append(None)

    columns = [rows.column(n).to_pylist() for n in ("op", "target", "candidate_id", "allowed", "operation")]
    # The row of an operation follows those of its choices, as nulls come last.
    for n, (owner, op, target, candidate, allowed, operation) in enumerate(zip(owners.indices.to_pylist(), *columns)):
        if owner != last:
            close()
            members, places, last, head, picked = {}, {}, owner, None, None
        if candidate is not None:
            if op != picked:
                picked, picks = op, []
            picks.append((n, candidate, allowed))
            continue
        made = False
        if operation == "activate" and picked == op:
            new = [(i, c, ok) for i, c, ok in picks if c not in members or len(members[c][1].turns) % 2 == 0]
            made = bool(new) and all(ok for _, _, ok in new)
            for i, c, _ in new if made else ():
                members.setdefault(c, (i, _Member()))[1].turn(op, True)
        elif operation == "rollback" and target in places and target != head:
            made = True
            for _, member in members.values():
                member.turn(op, member.active(target))
        if made:
            at.append(n)
            ops.append(op)
            until.append(None)
            place.append(len(places))
            places[op], head = len(places), op
    close()
    found = rows.select(["owner_id", "operation", "created_at", "candidate_id"]).take(pa.array(at, pa.int64()))
    for name, values in (("op", ops), ("until", until), ("place", place)):
        found = found.append_column(name, pa.array(values, pa.int64()))
    return found


def replay(ops: DataFrame, chosen: DataFrame, shard_choices: int = SHARD_CHOICES) -> tuple[DataFrame, DataFrame]:
    """Generations and memberships that operations lead to.

    ``ops``: owner_id, op (a whole number from 0, unique and in order per owner), operation (activate or rollback), target (the
    op of the generation to go back to) and created_at. ``chosen``: owner_id, op, candidate_id, allowed, for activations.
    Returns generations (owner_id, op, place, operation, created_at, members, generation_id, parent_generation_id) and
    memberships (owner_id, candidate_id, since and until: the ops of the generations, until null while active).
    An owner of at most ``shard_choices`` operations and choices is replayed by one task, many such owners at a time.
    """
    key = ["owner_id", "op"]
    ops = materialize(ops.select(
        "owner_id", F.col("op").cast("bigint").alias("op"), "operation", F.col("target").cast("bigint").alias("target"), "created_at").dropna(
        subset=key), "ops")
    wanted = chosen.select("owner_id", F.col("op").cast("bigint").alias("op"), F.col("candidate_id").cast("string").alias("candidate_id"), "allowed")
    wanted = materialize(wanted.dropna(subset=[*key, "candidate_id"]).groupBy(*key, "candidate_id").agg(F.bool_and("allowed").alias("allowed")), "choices")
    steps = ops.unionByName(wanted, allowMissingColumns=True)
    sizes = materialize(steps.groupBy("owner_id").agg(F.count("*").alias("steps")), "sizes")
    # At most one owner in ``shard_choices`` rows.
    large = F.broadcast(sizes.filter(F.col("steps") > shard_choices).select("owner_id"))
    groups = -(-(sizes.agg(F.sum("steps").alias("n")).first()["n"] or 1) // GROUP_STEPS)
    small = steps.join(large, "owner_id", "left_anti").withColumn("group", F.pmod(F.xxhash64("owner_id"), F.lit(groups)))
    kinds = ops.schema["owner_id"].dataType.simpleString(), ops.schema["created_at"].dataType.simpleString()
    found = materialize(small.groupBy("group").applyInArrow(
        _in_order, f"owner_id {kinds[0]}, operation string, created_at {kinds[1]}, candidate_id string, op bigint, until bigint, place bigint"), "replayed")
    generations = found.filter("place is not null").select(*key, "operation", "created_at", F.col("place").alias("before"))
    memberships = found.filter("place is null").select("owner_id", "candidate_id", F.col("op").alias("since"), "until")
    if not sizes.filter(F.col("steps") > shard_choices).isEmpty():
        made, spans = _replay_large(ops.join(large, "owner_id", "left_semi"), wanted.join(large, "owner_id", "left_semi"), shard_choices)
        generations, memberships = generations.unionByName(made), memberships.unionByName(spans)
    return _named(generations, memberships), memberships


def _replay_large(ops: DataFrame, wanted: DataFrame, shard_choices: int) -> tuple[DataFrame, DataFrame]:
    """Generations and memberships of owners of any size, by renewed guesses."""
    key = ["owner_id", "op"]
    ops = materialize(ops, "ops")
    wanted = wanted.join(ops.filter("operation = 'activate'").select(*key), key)
    shards = wanted.groupBy("owner_id").agg(F.ceil(F.count("*") / shard_choices).cast("int").alias("shards"))
    wanted = wanted.join(shards, "owner_id").withColumn("shard", F.pmod(F.xxhash64("candidate_id"), F.col("shards")).cast("int")).drop("shards")
    back = ops.filter("operation = 'rollback' AND target < op").join(shards, "owner_id").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*key, "target", "shard")
    rows = materialize(wanted.unionByName(back, allowMissingColumns=True), "steps")
    made = ops.select(*key, F.lit(True).alias("made"))
    while True:
        steps = rows.join(made, key).select("owner_id", "shard", "op", "target", "candidate_id", "allowed", "made")
        found = materialize(steps.groupBy("owner_id", "shard").applyInArrow(
            _replay, "owner_id string, op bigint, candidate_id string, new boolean, blocked boolean, until bigint"), "replayed")
        choices = found.filter("until is null").groupBy(*key).agg(F.bool_or("new").alias("new"), F.bool_or("blocked").alias("blocked"))
        counted = running(materialize(ops.join(made, key), "guess"), ["owner_id"], ["op"], integer_chunks("op"), sums={"before": F.col("made").cast("bigint")})
        counted = materialize(counted, "counted")
        targets = counted.select("owner_id", F.col("op").alias("target"), F.col("made").alias("is_generation"), F.col("before").alias("place"))
        joined = counted.join(choices, key, "left").join(targets, ["owner_id", "target"], "left")
        goes_back = (F.col("target") < F.col("op")) & F.col("is_generation") & (F.col("before") > F.col("place") + 1)
        now = F.when(F.col("operation") == "activate", F.col("new") & ~F.col("blocked")).otherwise(goes_back)
        renewed = materialize(joined.select(*key, F.coalesce(now, F.lit(False)).alias("made"), F.col("made").alias("guessed")), "renewed")
        made = renewed.select(*key, "made")
        if renewed.filter("made != guessed").isEmpty():
            break
    memberships = found.filter("until is not null").select(
        "owner_id", "candidate_id", F.col("op").alias("since"), F.when(F.col("until") >= 0, F.col("until")).alias("until"))
    return counted.filter("made").select(*key, "operation", "created_at", "before"), memberships


def member_hash(candidate: Column) -> Column:
    return F.conv(F.substring(I.sha256(candidate), 1, HASH_DIGITS), 16, 10).cast(HASH)


def _named(generations: DataFrame, memberships: DataFrame) -> DataFrame:
    """Generations with the number of their members, their names and their parents'."""
    key = ["owner_id", "op"]
    added = memberships.select("owner_id", F.col("since").alias("op"), member_hash(F.col("candidate_id")).alias("hash"), F.lit(1).cast("bigint").alias("n"))
    gone = memberships.filter("until is not null").select(
        "owner_id", F.col("until").alias("op"), (-member_hash(F.col("candidate_id"))).cast(HASH).alias("hash"), F.lit(-1).cast("bigint").alias("n"))
    steps = added.unionByName(gone).groupBy(*key).agg(F.sum("hash").cast(HASH).alias("hash"), F.sum("n").alias("n"))
    rows = generations.select(*key, "operation", "created_at", F.col("before").alias("place")).join(steps, key, "left").fillna(0, ["n"]).withColumn(
        "hash", F.coalesce("hash", F.lit(0).cast(HASH)))
    summed = running(materialize(rows, "generations"), ["owner_id"], ["place"], integer_chunks("place"),
                     sums={"hash_before": F.col("hash"), "members_before": F.col("n")})
    named = summed.withColumns({
        "members": F.col("members_before") + F.col("n"),
        "generation_id": F.concat(F.lit("gen_"), I.short_hash(F.concat_ws(
            "|", "owner_id", F.col("place").cast("string"), "operation", (F.col("hash_before") + F.col("hash")).cast(HASH).cast("string")), 20))})
    linked = previous(named, ["owner_id"], "place", {"parent_generation_id": "generation_id"})
    return linked.select("owner_id", "op", "place", "operation", "created_at", "members", "generation_id", "parent_generation_id")
