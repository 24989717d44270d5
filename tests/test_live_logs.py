import json

from pyspark.sql import functions as F

from tracelode.sources import live_logs, sinks
from tracelode.sources.files import split_lines


def bronze(spark, records, agent="codex", path="p"):
    return split_lines(spark.createDataFrame([(path, "\n".join(map(json.dumps, records)) + "\n")], "path string, text string"), agent)


def test_transcripts(spark):
    msg = lambda t, s: {"type": "event_msg", "timestamp": f"2026-01-01T00:00:{s:02d}Z", "payload": {"type": t}}
    b = bronze(spark, [{"type": "session_meta", "payload": {"id": "x", "source": {"subagent": "review"}}}, {"type": "turn_context", "payload": {"collaboration_mode": {"mode": "plan"}}}, msg("task_started", 1), msg("token_count", 2), msg("task_complete", 3), msg("task_started", 4), msg("exec_approval_request", 5)])
    s = live_logs.transcript_signals(b)
    assert [(r.kind, r.mode) for r in s.orderBy("ordinal").collect()] == [(k, "plan") for k in ("task_started", "task_complete", "task_started", "exec_approval_request")]
    assert live_logs.latest_signal(s).first().status == "waiting"
    turn = live_logs.open_turn(s).first()
    assert turn.open and turn.started_at.second == 4 and live_logs.auxiliary(b).count() == 1


def test_runtime_logs(spark):
    now = F.lit("2026-01-01 10:00:30").cast("timestamp")
    t = 1767261600000
    k = bronze(spark, [{"type": "turn.prompt", "time": t}, {"type": "context.append_loop_event", "time": t + 1000, "event": {"type": "step.end", "finishReason": "tool_use"}}, {"type": "permission.request", "time": t + 2000}], "kimi-code")
    assert live_logs.runtime_sessions(k, "kimi-code", now).first().status == "waiting"
    d = bronze(spark, [{"type": "turn/start", "time": t}, {"type": "turn/end", "time": t + 1000, "data": {"reason": {"kind": "blocked"}}}], "deepseek-harness")
    assert live_logs.runtime_sessions(d, "deepseek-harness", now).first().status == "error"
    assert live_logs.runtime_sessions(d, "deepseek-harness", F.lit("2026-01-01 11:00:00").cast("timestamp")).count() == 0


def test_latest_turn_ties(spark):
    s = spark.createDataFrame([("a",)], "id string")
    turns = spark.createDataFrame([("a", "done", 5, 1), ("a", "running", 5, 2), ("a", "done", 1, 9)], "session_id string, status string, started_at long, tool_call_count long")
    r = live_logs.latest_turns(s, turns).first()
    assert (r.status, r.tool_calls) == ("running", 3)


def test_account_pages(spark):
    body = lambda *e: json.dumps({"usageEventsDisplay": [json.dumps({"id": i}) for i in e]})
    rows = live_logs.account_pages(spark.createDataFrame([(1, body(1, 2, 3)), (2, body(2, 3, 4)), (3, body(5,))], "page long, body string")).orderBy("page", "position").collect()
    assert [json.loads(r.event)["id"] for r in rows] == [1, 2, 3, 4, 5]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("h1", "s1"), ("h2", "s2")], "source_hash string, session string")
    sinks.publish({"sessions": a}, str(tmp_path), "1")
    again = sinks.replace_sessions(sinks.current(spark, str(tmp_path), "sessions"), spark.createDataFrame([("h2", "s2b")], a.schema))
    sinks.publish({"sessions": again}, str(tmp_path), "2")
    assert sorted(r.session for r in sinks.current(spark, str(tmp_path), "sessions").collect()) == ["s1", "s2b"]
    gone = sinks.tombstones(a, again, ["session"], F.lit("2026-01-01").cast("timestamp")).collect()
    assert [r.session for r in gone] == ["s2"]
    now, key = F.lit("2026-01-01 00:00:00").cast("timestamp"), bytes(range(32))
    box = sinks.sealed(spark.createDataFrame([("e1", "secret")], "event_id string, value string"), key, now)
    assert sinks.opened(box, key, now).first().value == "secret"
    assert sinks.opened(box.withColumn("event_id", F.lit("e2")), key, now).first().value is None
    assert sinks.opened(box, key, F.lit("2026-01-09").cast("timestamp")).count() == 0
    days = spark.createDataFrame([("2026-01-01",), ("2025-11-01",)], "date string")
    assert sinks.pruned(days, "date", "2026-01-10", 30).count() == 1
