import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from turnmill.plans import accounts as plans
from turnmill.sinks.tables import append_once, read_appended
from turnmill.sources import tail
from turnmill.sources.growing import file_states, file_status, read_growing
from turnmill.sources.logs import extract_messages
from turnmill.streaming import accounts, sessions


def put(folder, name, *records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records) + "\n")


def test_quiet_sessions(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.schema("owner_id string, session_id string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
        sessions.quiet_sessions(stream).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return {(r.session_id, r.events) for r in spark.read.parquet(out).collect()}

    def said(session, time):
        return {"owner_id": "o", "session_id": session, "ts": f"2026-01-01T{time}Z"}

    put(src, "1.json", said("a", "10:00:00"), said("a", "10:01:00"), said("b", "10:01:30"))
    assert run() == set()
    put(src, "2.json", said("b", "10:03:00"))
    run()
    put(src, "3.json", said("c", "10:30:00"))
    assert run() == {("a", 2), ("b", 2)}


@pytest.fixture
def one_partition(spark):
    """State of one partition: each one has a Python worker of its own, which a small test only waits for."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def account_events(n=120, seed=6):
    """Events with repeated ids, unknown accounts, customers that change hands and times out of order."""
    rng = random.Random(seed)
    events = []
    for arrival in range(n):
        account = f"a{rng.randint(0, 9)}"
        events.append({"arrival": arrival, "event_id": f"e{rng.randint(0, n)}", "account_id": account,
                       "customer_id": rng.choice([f"c{account}", f"c{account}", f"ca{rng.randint(0, 9)}", None]),
                       "effective_at": f"2026-01-{rng.randint(1, 28):02d}", "state": rng.choice(["active", "ended", "past_due"])})
    return events


def test_stream_and_batch_give_events_one_status(spark, rows, tmp_path, one_partition):
    src, root, events = tmp_path / "in", str(tmp_path / "state"), account_events()
    known = spark.createDataFrame([(f"a{n}",) for n in range(8)], "account_id string")
    schema = "arrival long, event_id string, account_id string, customer_id string, effective_at string, state string"

    def run():
        stream = spark.readStream.schema(schema).json(str(src))
        accounts.start_entitlements(stream, root, str(tmp_path / "check"), known).awaitTermination()

    shuffled = random.Random(1)
    for n, at in enumerate(range(0, len(events), 60)):
        some = events[at:at + 60]
        shuffled.shuffle(some)
        put(src, f"{n}-a.json", *some[:30])
        put(src, f"{n}-b.json", *some[30:])
        run()
    wanted = plans.event_status(spark.createDataFrame([tuple(e.values()) for e in events], schema), known)
    assert rows(accounts.event_log(spark, root), "arrival", "event_id", "account_id", "status") == rows(wanted, "arrival", "event_id", "account_id", "status")
    assert {r.status for r in wanted.collect()} == {"applied", "stale", "duplicate", "unknown-account", "customer-conflict"}
    current = plans.entitlements(wanted.filter("status = 'applied'"))
    assert rows(accounts.current_entitlements(spark, root), "account_id", "event_id", "state") == rows(current, "account_id", "event_id", "state")


def test_entitlements_survive_a_repeated_batch(spark, rows, tmp_path, one_partition):
    src, root = tmp_path / "in", str(tmp_path / "state")

    def run(check="check"):
        stream = spark.readStream.schema(
            "arrival long, event_id string, account_id string, customer_id string, effective_at string, state string").json(str(src))
        accounts.start_entitlements(stream, root, str(tmp_path / check), keep_ids=timedelta(days=30)).awaitTermination()
        return rows(accounts.current_entitlements(spark, root), "account_id", "state")

    def event(n, account, ident, state, at):
        return {"arrival": n, "account_id": account, "event_id": ident, "customer_id": account, "state": state, "effective_at": at}

    put(src, "1.json", event(1, "a", "e1", "active", "2026-01-02"), event(2, "b", "e2", "trialing", "2026-01-01"))
    assert run() == [("a", "active"), ("b", "trialing")]
    put(src, "2.json", event(3, "a", "e0", "ended", "2026-01-01"), event(4, "b", "e3", "ended", "2026-01-05"), event(5, "a", "e1", "ended", "2026-01-09"))
    assert run() == [("a", "active"), ("b", "ended")]
    assert rows(accounts.event_log(spark, root), "arrival", "status") == [(1, "applied"), (2, "applied"), (3, "stale"), (4, "applied"), (5, "duplicate")]
    assert run("again") == [("a", "active"), ("b", "ended")]


def test_heads_across_batches(spark, rows, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "heads")

    def run():
        stream = spark.readStream.schema(
            "account_id string, generation_id string, parent_generation_id string, arrival long").json(str(src))
        accounts.start_heads(stream, root, str(tmp_path / "check")).awaitTermination()
        return rows(accounts.current_heads(spark, root), "account_id", "generation_id")

    put(src, "1.json", {"account_id": "a", "generation_id": "g1", "arrival": 1},
        {"account_id": "a", "generation_id": "g2", "parent_generation_id": "g1", "arrival": 2})
    assert run() == [("a", "g2")]
    put(src, "2.json", {"account_id": "a", "generation_id": "g3", "parent_generation_id": "g2", "arrival": 3},
        {"account_id": "a", "generation_id": "x3", "parent_generation_id": "g2", "arrival": 4})
    assert run() == [("a", "g3")]


def test_log_stream_reads_lines_in_order(spark, tmp_path):
    logs = tmp_path / ".claude" / "projects"
    put(logs, "s.jsonl", *[{"type": "user", "timestamp": "2026-01-01", "message": {"role": "user", "content": f"ask {i}"}} for i in range(5)])
    extract_messages(sessions.stream_lines(spark, str(logs))).writeStream.format("memory").queryName("asked").trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start().awaitTermination()
    got = spark.table("asked").orderBy("line_id").select(F.col("text"), "source").collect()
    assert [tuple(r) for r in got] == [(f"ask {i}", "claude") for i in range(5)]


def test_a_growing_file_is_read_again(spark, tmp_path):
    logs, state, store = tmp_path / ".claude" / "projects", str(tmp_path / "state"), str(tmp_path / "store")

    def ask(*numbers):
        return [{"type": "user", "timestamp": "2026-01-01", "message": {"role": "user", "content": f"ask {i}"}} for i in numbers]

    def run():
        lines, done = read_growing(spark, [str(logs)], state)
        if lines is not None:
            append_once(extract_messages(lines).select("session_id", "line_id", "text"), store, ["session_id", "line_id"])
        done()
        return 0 if lines is None else lines.count()

    put(logs, "a.jsonl", *ask(1, 2))
    put(logs, "b.jsonl", *ask(3))
    assert run() == 3 and run() == 0
    put(logs, "a.jsonl", *ask(1, 2, 4))
    before = file_states(spark, [str(logs)])
    assert run() == 3 and run() == 0
    assert sorted(r.text for r in read_appended(spark, store).collect()) == ["ask 1", "ask 2", "ask 3", "ask 4"]
    gone = file_status(before.filter("file_path like '%a.jsonl'"), before)
    assert sorted(r.status for r in gone.collect()) == ["gone", "processed"]


def test_a_tail_reads_only_what_files_have_grown_by(spark, tmp_path):
    logs, state, out = tmp_path / ".claude" / "projects", str(tmp_path / "state"), str(tmp_path / "out")

    def ask(*numbers):
        return "".join(json.dumps({"type": "user", "timestamp": "2026-01-01", "message": {"role": "user", "content": f"ask {i}"}}) + "\n" for i in numbers)

    def add(name, text, mode="a"):
        path = logs / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, mode, newline="") as file:
            file.write(text)

    def run():
        before = spark.read.parquet(out).count() if (tmp_path / "out").exists() else 0
        lines = tail.tail_lines(spark, [str(logs)], state, shards=3)
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(
            availableNow=True).start().awaitTermination()
        stored = spark.read.parquet(out)
        got = extract_messages(stored.withColumn("file_size", F.lit(0)))
        return stored.count() - before, sorted(r.text for r in got.collect())

    add("p/a.jsonl", ask(1, 2))
    add("q/deep/b.jsonl", ask(3) + ask(4)[:-9])
    add("c.jsonl", ask(5).replace("\n", "\r\n"))
    add("p/subagents/x.jsonl", ask(99))
    assert run() == (4, ["ask 1", "ask 2", "ask 3", "ask 5"])
    assert run()[0] == 0
    add("q/deep/b.jsonl", ask(4)[-9:] + ask(6))
    add("r/new.jsonl", ask(7))
    assert run() == (3, [f"ask {n}" for n in range(1, 8)])
    # A shorter file, and one of the same length that begins differently, are read from their start.
    add("p/a.jsonl", ask(8), "w")
    add("c.jsonl", ask(9).replace("\n", "\r\n"), "w")
    assert run() == (2, [f"ask {n}" for n in range(1, 10)])
    assert len(list((tmp_path / "state").iterdir())) <= 3


def test_a_tail_reads_a_batch_again_as_it_was(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK_BYTES", 7)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("one\ntwo\n\nlonger than a block\nopen")
    reader = tail.TailReader({"roots": json.dumps([str(logs)]), "state": str(tmp_path / "state"), "shards": "2"})

    def read(start, end):
        found = [b for n in range(2) for b in reader.read(tail.Shard(start, end, n))]
        return [(v, n) for b in found for v, n in zip(b.column("value").to_pylist(), b.column("line_id").to_pylist())]

    assert reader.latestOffset() == {"scan": 1}
    first = read(0, 1)
    assert first == [("one", 0), ("two", 4), ("", 8), ("longer than a block", 9)]
    with open(logs / "a.jsonl", "a") as file:
        file.write(" now\nnext\n")
    assert read(0, 1) == first and reader.latestOffset() == {"scan": 2}
    assert read(1, 2) == [("open now", 29), ("next", 38)]


def test_an_inbox_takes_every_item_once(spark, rows, tmp_path, one_partition):
    src, root = tmp_path / "in", str(tmp_path / "inbox")

    def run(check):
        stream = spark.readStream.schema("session_id string, size long, ts timestamp").json(str(src))
        sessions.start_inbox(sessions.emit_once(stream, "ts", "session_id"), build, root, str(tmp_path / check)).awaitTermination()
        return rows(read_appended(spark, f"{root}/items"), "inbox_id", "size")

    def build(batch):
        return batch.select(F.concat(F.lit("inbox_"), "session_id").alias("inbox_id"), "size")

    def quiet(session, size):
        return {"session_id": session, "size": size, "ts": "2026-01-01T10:00:00Z"}

    put(src, "1.json", quiet("a", 1), quiet("a", 1), quiet("b", 2))
    assert run("check") == [("inbox_a", 1), ("inbox_b", 2)]
    put(src, "2.json", quiet("b", 2), quiet("c", 3))
    assert run("check") == [("inbox_a", 1), ("inbox_b", 2), ("inbox_c", 3)]
    # All batches again, as after a lost checkpoint: nothing is stored twice.
    assert run("again") == [("inbox_a", 1), ("inbox_b", 2), ("inbox_c", 3)]
    assert spark.read.parquet(f"{root}/items/rows").count() == 3
