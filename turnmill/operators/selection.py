"""Selection under a token budget, in the order a round-robin over queues would take.

Each pick lowers the budget, so once an item does not fit, no later item of that size does. That bounds how far down
a queue a pick can lie, and lets Spark trim every queue before one task per owner replays the rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from turnmill import constants as K
from turnmill.functions.calendar import quarter
from turnmill.operators.ordered import hash_chunks, outside_in, ranked, top_rows
from turnmill.session import materialize

LANE = ["domain", "source", "quarter", "family"]
BATCH_ROWS = 200_000

_STATE = "owner_id string, kind int, lane string, depth long, size long, receipt_id string, tokens long, position long"


def lane_rank(scored: DataFrame) -> DataFrame:
    """One row per receipt and lane, with its place in the lane by falling salience."""
    lanes = (
        scored.withColumn("quarter", quarter(F.col("date")))
        .withColumn("domain", F.explode("domain_hints"))
        .withColumn("family", F.explode("signal_families"))
        .select("owner_id", *LANE, "receipt_id", F.col("tokens").cast("bigint").alias("tokens"),
                (-F.col("salience")).alias("neg_salience"))
    )
    chunks = hash_chunks("receipt_id", prefix=("neg_salience",), skip=5)
    return ranked(lanes, ["owner_id", *LANE], ["neg_salience", "receipt_id"], chunks, "lane_rank")


def _replay(budget: int):
    """Continue the rounds of one owner over the queue parts at hand.

    Row kinds: 0 queue item, 1 picked receipt, 2 lane (depth read so far, full size), 3 cursor (depth = 1 when this
    round already picked something, size = 1 when finished, tokens = budget spent, lane = where to go on).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        owner = rows["owner_id"].iloc[0]
        lanes = rows[rows["kind"] == 2].sort_values("lane")
        names = lanes["lane"].tolist()
        depth = dict(zip(names, lanes["depth"].tolist()))
        full = dict(zip(names, lanes["size"].tolist()))
        picked = rows[rows["kind"] == 1]
        taken = set(picked["receipt_id"])
        position = len(taken)
        cursor = rows[rows["kind"] == 3]
        spent, progressed, at = 0, False, 0
        if len(cursor):
            spent = int(cursor["tokens"].iloc[0])
            progressed = bool(cursor["depth"].iloc[0])
            at = names.index(cursor["lane"].iloc[0])
        items = rows[rows["kind"] == 0].sort_values(["lane", "depth"])
        queues = {
            lane: (part["receipt_id"].tolist(), part["tokens"].tolist()) for lane, part in items.groupby("lane")
        }
        read = {lane: 0 for lane in names}
        new, short = [], None
        while short is None:
            while at < len(names):
                lane = names[at]
                ids, sizes = queues.get(lane, ((), ()))
                i = read[lane]
                while i < len(ids) and ids[i] in taken:
                    i += 1
                read[lane] = i
                if i == len(ids):
                    if depth[lane] + i < full[lane]:
                        short = lane
                        break
                else:
                    read[lane] = i + 1
                    if spent + sizes[i] <= budget:
                        new.append((ids[i], sizes[i], position))
                        taken.add(ids[i])
                        spent += sizes[i]
                        position += 1
                        progressed = True
                at += 1
            if short is None:
                if not progressed:
                    break
                progressed, at = False, 0
        out = [(owner, 1, None, 0, 0, r, t, p) for r, t, p in new]
        out += [(owner, 2, lane, depth[lane] + read[lane], full[lane], None, 0, 0) for lane in names]
        out.append((owner, 3, short, int(progressed), int(short is None), None, spent, 0))
        return pd.DataFrame(out, columns=["owner_id", "kind", "lane", "depth", "size", "receipt_id", "tokens", "position"])

    return run


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["neg_salience", "receipt_id"])
    room, position, out = int(rows["room"].iloc[0]), int(rows["next_position"].iloc[0]), []
    for receipt, size in zip(rows["receipt_id"], rows["tokens"]):
        if size <= room:
            out.append((rows["owner_id"].iloc[0], receipt, size, position))
            room -= size
            position += 1
    return pd.DataFrame(out, columns=["owner_id", "receipt_id", "tokens", "position"])


def select_stage(
    scored: DataFrame, source_tokens: int, packet_tokens: int, excluded: DataFrame | None = None,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Receipts picked for one stage: ``owner_id, receipt_id, tokens, position``.

    Rounds over the lanes in key order take one receipt per lane, then the rest of the budget goes to what still fits
    by salience. A replay task sees at most about ``batch_rows`` queue rows of an owner; if the rounds reach deeper,
    another replay goes on from there.
    """
    scored = scored.filter(F.col("tokens") <= packet_tokens)
    if excluded is not None:
        scored = scored.join(excluded.select("owner_id", "receipt_id"), ["owner_id", "receipt_id"], "left_anti")
    lanes = materialize(
        lane_rank(scored).select("owner_id", F.concat_ws("\x01", *LANE).alias("lane"), "lane_rank", "receipt_id", "tokens"),
        "lanes")
    sizes = lanes.groupBy("owner_id", "lane").agg(F.count("*").alias("size"))
    state = sizes.selectExpr("owner_id", "2 as kind", "lane", "0L as depth", "size", "cast(null as string) as receipt_id",
                             "0L as tokens", "0L as position")
    state = materialize(state, "lane-state")
    while True:
        lane_state = state.filter("kind = 2")
        width = lane_state.groupBy("owner_id").agg(F.count("*").alias("lane_count"))
        window = lane_state.join(width, "owner_id").select(
            "owner_id", "lane", "depth", (F.col("depth") + F.greatest(F.lit(1), F.lit(batch_rows).cast("bigint") / F.col(
                "lane_count")).cast("bigint")).alias("until"))
        # One state row per lane, and a lane may hold much of the table: copy the state row, spread the lane.
        queue = lanes.join(window, ["owner_id", "lane"]).filter(
            "lane_rank >= depth and lane_rank < until")
        items = queue.selectExpr("owner_id", "0 as kind", "lane", "lane_rank as depth", "0L as size", "receipt_id",
                                 "tokens", "0L as position")
        open_owners = lane_state.select("owner_id").distinct()
        finished = state.filter("kind = 3 and size = 1").select("owner_id")
        feed = state.unionByName(items).join(open_owners.join(finished, "owner_id", "left_anti"), "owner_id", "left_semi")
        moved = feed.groupBy("owner_id").applyInPandas(_replay(source_tokens), _STATE)
        kept = state.join(finished, "owner_id", "left_semi").unionByName(state.join(
            finished, "owner_id", "left_anti").filter("kind = 1"))
        state = materialize(kept.unionByName(moved), "lane-state")
        if state.filter("kind = 3 and size = 0").isEmpty():
            break

    picked = state.filter("kind = 1").select("owner_id", "receipt_id", "tokens", "position")
    room = state.filter("kind = 3").select("owner_id", (F.lit(source_tokens) - F.col("tokens")).alias("room")).join(
        picked.groupBy("owner_id").agg(F.count("*").alias("next_position")), "owner_id", "left"
    ).fillna(0, ["next_position"])
    left = scored.select("owner_id", "receipt_id", F.col("tokens").cast("bigint").alias("tokens"),
                         (-F.col("salience")).alias("neg_salience"))
    left = left.join(picked.select("owner_id", "receipt_id"), ["owner_id", "receipt_id"], "left_anti")
    left = left.join(room.filter("room > 0"), ["owner_id"]).filter("tokens <= room")
    near = ranked(left, ["owner_id", "tokens"], ["neg_salience", "receipt_id"],
                  hash_chunks("receipt_id", prefix=("neg_salience",), skip=5), "place")
    near = near.filter(F.expr("place < room div tokens"))
    filled = near.groupBy("owner_id").applyInPandas(
        _fill, "owner_id string, receipt_id string, tokens long, position long")
    return picked.unionByName(filled)


def temporal_queue(segments: DataFrame) -> DataFrame:
    """Add ``queue_position``: segments of a source read from both ends of its time line inwards."""
    keys = ["owner_id", "source"]
    placed = ranked(segments, keys, ["first_date", "segment_hash"],
                    hash_chunks("segment_hash", prefix=("first_date",), digits=(3, 1)), "__place")
    counts = segments.groupBy(*keys).agg(F.count("*").alias("__count"))
    return placed.join(counts, keys).withColumn(
        "queue_position", outside_in(F.col("__place"), F.col("__count"))).drop("__place", "__count")


def _take_segments(count: int, max_tokens: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        queues = {s: p.sort_values("queue_position") for s, p in rows.groupby("source")}
        lists = {s: list(zip(q["segment_hash"], q["source_tokens"])) for s, q in queues.items()}
        at, total, taken = {s: 0 for s in lists}, 0, []
        moved = True
        while moved and len(taken) < count:
            moved = False
            for source in sorted(lists):
                queue = lists[source]
                while at[source] < len(queue):
                    name, tokens = queue[at[source]]
                    at[source] += 1
                    if total + tokens <= max_tokens:
                        taken.append(name)
                        total += tokens
                        moved = True
                        break
                if len(taken) >= count:
                    break
        return pd.DataFrame({"owner_id": rows["owner_id"].iloc[0], "segment_hash": taken})

    return run


def select_segments(segments: DataFrame, count: int, max_tokens: int = K.STARTER_MAX_TOKENS) -> DataFrame:
    """Segments of a bounded preview: one per source and round, skipping what does not fit, until ``count``."""
    usable = segments.filter(F.col("active") & ~F.col("oversize") & (F.col("source_tokens") <= max_tokens))
    queue = temporal_queue(usable.select("owner_id", "source", "first_date", "segment_hash", "source_tokens"))
    # Of one size in one queue only the first ``count`` can be taken, and taken ones are always the first.
    near = top_rows(queue, ["owner_id", "source", "source_tokens"], [F.col("queue_position")], count)
    chosen = near.groupBy("owner_id").applyInPandas(
        _take_segments(count, max_tokens), "owner_id string, segment_hash string")
    return segments.join(chosen, ["owner_id", "segment_hash"], "left_semi")


def select_run_segments(segments: DataFrame, known: DataFrame, count: int, max_tokens: int = K.STARTER_MAX_TOKENS):
    """Split into segments already reported on, new ones to work on now, and how many new ones wait."""
    active = segments.filter(F.col("active") & ~F.col("oversize"))
    keys = ["owner_id", "segment_hash"]
    retained = active.join(known.select(*keys), keys, "left_semi")
    new = active.join(known.select(*keys), keys, "left_anti")
    work = select_segments(new, count, max_tokens)
    waiting = new.join(work.select(*keys), keys, "left_anti").groupBy("owner_id").agg(F.count("*").alias("waiting"))
    return retained.unionByName(work), work, waiting
