import hashlib
import json

from pyspark.sql import functions as F

from turnmill.plans import corpus
from turnmill.sources import corpus_text, files, logs, opencode


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records) + "\n", encoding="utf-8")


def user(text, **extra):
    return {"type": "user", "timestamp": "2026-03-01T10:00:00Z", "message": {"role": "user", "content": text}, **extra}


def codex(text, role="user", kind="response_item"):
    return {"type": kind, "timestamp": "2026-03-02T10:00:00Z", "payload": {"type": "message", "role": role, "content": [{"type": "t", "text": text}]}}


def test_dialects(spark, rows, tmp_path):
    put(tmp_path / ".claude" / "projects" / "p" / "a.jsonl", user("first"), user([{"text": "second"}, {"text": "third"}, "bare"]),
        user("meta", isMeta=True), user("side", isSidechain=True), user("tool", toolUseResult=None), user("compact", isCompactSummary=True),
        user("human", isMeta=False, origin={"kind": "human"}), user("robot", origin={"kind": "agent"}),
        user("desktop", promptSource="sdk"), user("headless", promptSource="sdk", entrypoint="sdk-cli"),
        '{"type":"user", broken', '["role", "\\"role\\":\\"user\\""]', user("<command-name>x"), user("   "),
        {"type": "assistant", "message": {"role": "assistant", "content": "no \"role\":\"user\""}})
    put(tmp_path / ".claude" / "projects" / "subagents" / "x.jsonl", user("agent"))
    put(tmp_path / ".claude" / "projects" / "my-subagents-notes" / "n.jsonl", user("kept note"))
    put(tmp_path / ".codex" / "sessions" / "c.jsonl", codex("hi <heartbeat>x</heartbeat>there"), codex("answer", role="assistant"),
        codex("<heartbeat>only</heartbeat>"), codex("raw <heartbeat>x</heartbeat>", kind="event"))
    put(tmp_path / ".copilot" / "state" / "s1" / "events.jsonl",
        {"type": "user.message", "timestamp": "2026-03-03T00:00:00Z", "data": {"content": "copilot ask"}},
        {"type": "user.message", "data": {"content": "steer", "source": "system"}})
    brain = tmp_path / "antigravity" / "brain"
    put(brain / "conv" / ".system_generated" / "logs" / "transcript.jsonl",
        {"type": "USER_INPUT", "source": "USER_EXPLICIT", "created_at": "2026-03-04T00:00:00Z",
         "content": "<USER_REQUEST>\nask one\n</USER_REQUEST><ADDITIONAL_METADATA>x</ADDITIONAL_METADATA><USER_REQUEST>ask two</USER_REQUEST>"},
        {"type": "USER_INPUT", "source": "MODEL", "content": "no"},
        {"type": "USER_INPUT", "source": "USER_EXPLICIT", "content": "plain ask"})
    lines = logs.read_lines(spark, [str(tmp_path / d) for d in (".claude", ".codex", ".copilot")] + [str(brain)])
    got = rows(logs.extract_messages(lines), "source", "date", "text")
    assert got == sorted([
        ("claude", "2026-03-01", t) for t in ("first", "second", "third", "human", "desktop", "kept note")] + [
        ("codex", "2026-03-02", "hi there"), ("codex", "2026-03-02", "raw <heartbeat>x</heartbeat>"),
        ("copilot", "2026-03-03", "copilot ask"), ("antigravity", "2026-03-04", "ask one"), ("antigravity", "2026-03-04", "ask two"),
        ("antigravity", "undated", "plain ask")], key=str)
    assert rows(logs.rejected_lines(lines), "rejected") == [(1,)]
    mined = corpus.mine(logs.read_messages(spark, [str(tmp_path / ".claude")], ["claude"]))
    order = mined.filter(F.col("file_path").endswith("a.jsonl")).orderBy("ordinal").select("text").collect()
    assert [r[0] for r in order] == ["first", "second", "third", "human", "desktop"]


def test_store_tables(spark, rows):
    ms = 1783963834101
    messages = spark.createDataFrame([
        ("m2", "ses", ms + 5, '{"role":"user"}'), ("m1", "ses", ms, '{"role":"user"}'), ("m3", "ses", ms, '{"role":"assistant"}')],
        "id string, session_id string, time_created long, data string")
    parts = spark.createDataFrame([
        ("p1", "m1", ms, '{"type":"text","text":"one"}'), ("p2", "m1", ms, '{"type":"text","text":"made up","synthetic":true}'),
        ("p3", "m2", ms, '{"type":"text","text":" two "}'), ("p4", "m2", ms, '{"type":"tool","text":"no"}'),
        ("p5", "m3", ms, '{"type":"text","text":"answer"}'), ("p6", "m1", ms + 1, '{"type":"text","text":"one b"}')],
        "id string, message_id string, time_created long, data string")
    got = opencode.messages_from_tables(messages, parts, "/x/opencode/opencode.db")
    assert rows(got, "line_id", "source", "date", "text") == [
        (0, "opencode", "2026-07-13", "one"), (1, "opencode", "2026-07-13", "one b"), (2, "opencode", "2026-07-13", "two")]
    assert rows(opencode.sessions_of(messages)) == [("ses",)]


def test_store_tree(spark, rows, tmp_path):
    root = tmp_path / "export"
    put(root / "storage" / "session" / "proj" / "ses1.json", {"id": "ses1"})
    put(root / "storage" / "message" / "ses1" / "msg_1.json", {"id": "msg_1", "role": "user", "time": {"created": 1783963834101}})
    put(root / "storage" / "message" / "ses1" / "msg_2.json", {"id": "msg_2", "role": "assistant"})
    put(root / "storage" / "part" / "msg_1" / "b.json", {"type": "text", "text": "second"})
    put(root / "storage" / "part" / "msg_1" / "a.json", {"type": "text", "text": "first"})
    put(root / "storage" / "part" / "msg_2" / "a.json", {"type": "text", "text": "answer"})
    got = opencode.messages_from_tree(spark, str(root))
    assert rows(got, "line_id", "source", "date", "text") == [
        (0, "custom", "2026-07-13", "first"), (1, "custom", "2026-07-13", "second")]


def test_corpus_round_trip(spark, rows, tmp_path):
    put(tmp_path / "c.txt", "===== session:aaa111 source:claude =====", "[2026-01-01]", "hello", "there", "[undated]", "bye",
        "===== session:bbb222 source:codex =====", "[2026-01-02]", "again")
    lines = corpus_text.read_corpus_lines(spark, str(tmp_path / "c.txt"))
    assert rows(corpus_text.messages_from_corpus(lines), "session_id", "source", "date", "text") == [
        ("aaa111", "claude", "2026-01-01", "hello\nthere"), ("aaa111", "claude", "undated", "bye"), ("bbb222", "codex", "2026-01-02", "again")]


def test_files(spark, rows, tmp_path):
    put(tmp_path / "t" / "a.txt", "one")
    put(tmp_path / "t" / "sub" / "b.txt", "two")
    before = files.file_digests(spark, str(tmp_path / "t"))
    assert rows(before, "path", "size") == [("a.txt", 4), ("sub/b.txt", 4)]
    manifest = before.withColumn("sha256", F.when(F.col("path") == "a.txt", "x").otherwise(F.col("sha256"))).unionByName(
        spark.createDataFrame([("gone", 1, "y")], "path string, size long, sha256 string"))
    assert rows(files.check_manifest(before, manifest)) == [("a.txt", "changed"), ("gone", "missing")]
    first = files.tree_digest(before).first()[0]
    put(tmp_path / "t" / "a.txt", "onf")
    assert files.tree_digest(files.file_digests(spark, str(tmp_path / "t"))).first()[0] != first


def test_a_file_over_two_gigabytes_is_digested_in_blocks(spark, tmp_path):
    (tmp_path / "big files").mkdir()
    with open(tmp_path / "big files" / "large one.bin", "wb") as file:
        file.truncate((1 << 31) + 5)
    (tmp_path / "big files" / "small.bin").write_bytes(b"x")
    want = hashlib.sha256()
    for _ in range(1 << 11):
        want.update(bytes(1 << 20))
    want.update(bytes(5))
    got = {r.path: (r.size, r.sha256) for r in files.file_digests(spark, str(tmp_path / "big files")).collect()}
    assert got == {"large one.bin": ((1 << 31) + 5, want.hexdigest()), "small.bin": (1, hashlib.sha256(b"x").hexdigest())}
