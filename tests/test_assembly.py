"""Session records: log lines and database rows to counters, and on to the profile."""

from pyspark.sql import functions as F

from tests.test_sources import bronze, database  # noqa: F401
from tracelode.operators import assembly, profile
from tracelode.sources import adapters, sqlite


def codex(spark, tmp_path):
    at = lambda n: f"2026-01-01T10:00:{n:02d}Z"
    msg = lambda n, **p: {"type": "event_msg", "timestamp": at(n), "payload": p}
    call = lambda n, name, i, text: {"type": "response_item", "timestamp": at(n), "payload": {"type": "custom_tool_call", "name": name, "call_id": i, "input": text}}
    script = 'await Promise.all([tools.exec_command({"cmd":"cargo test"}), tools.exec_command({"cmd":"git diff"})])'
    patch = "*** Begin Patch\n*** Update File: docs/readme.md\n+one\n-two\n*** Add File: src/styles/a.css\n+x\n*** End Patch"
    records = [
        {"type": "session_meta", "timestamp": at(0), "payload": {"id": "one", "cwd": "/w/shop"}}, {"type": "turn_context", "timestamp": at(1), "payload": {"model": "gpt-5.5"}}, msg(2, type="task_started"),
        msg(3, type="user_message", message="- fix the file\n- tests must pass\n- now"), call(5, "exec", "a", script), call(6, "apply_patch", "b", patch), call(7, "update_plan", "c", "{}"),
        {"type": "turn_context", "timestamp": at(8), "payload": {"model": "gpt-5.4"}}, msg(9, type="token_count", info={"total_token_usage": {"input_tokens": 50, "cached_input_tokens": 20, "output_tokens": 5}}),
        msg(10, type="error"), msg(11, type="thread_rolled_back"), msg(12, type="sub_agent_activity", kind="started"), msg(13, type="context_compacted"), msg(14, type="task_complete", duration_ms=900),
        msg(15, type="mcp_tool_call_end", result={"is_error": True}),
    ]
    return adapters.normalised({"codex": bronze(spark, tmp_path, "codex", records)})


def test_counters_of_a_session(spark, tmp_path):
    row = adapters.sessions(codex(spark, tmp_path)).first().asDict()
    wanted = {
        "session_id": "one", "project": "shop", "model": "gpt-5.4", "model_switches": 1, "active_seconds": 15, "time_to_first_tool_ms": 2000, "has_commit": False, "title": "fix the file - tests must pass - now",
        "prompt_count": 1, "structured_prompts": 1, "acceptance_criteria_prompts": 1, "file_scope_prompts": 1, "human_interventions": 1, "parallel_batches": 1, "tool_calls": 4, "plan_events": 1, "test_events": 1, "git_review_events": 1, "verification_events": 2,
        "edit_events": 1, "files_touched": 2, "lines_changed": 3, "document_events": 1, "style_events": 1, "instruction_file_events": 0, "errors": 2, "failed_tools": 1, "successful_tools": 0, "rollbacks": 1, "context_compactions": 1, "subagent_starts": 1, "subagent_count": 1,
        "task_starts": 1, "task_completions": 1, "completed_task_duration_ms": 900, "total_tokens": 55, "cache_read_tokens": 20,
    }
    assert {k: row[k] for k in wanted} == wanted
    hidden = adapters.sessions(codex(spark, tmp_path), structure=False).first()
    assert (hidden.prompt_count,) == (1,) and "structured_prompts" not in hidden


def test_sessions_feed_the_profile(spark, tmp_path):
    s = adapters.sessions(codex(spark, tmp_path), committed=spark.createDataFrame([("one",), ("one",)], "session_id string"))
    sums = profile.sums(s, F.lit("2026-01-01 10:00:00").cast("timestamp"), 90).first()
    assert (sums.session_count, sums.tool_calls, sums.committed, sums.tests) == (1, 4.0, 1.0, 1.0)
    days = assembly.session_days(codex(spark, tmp_path), adapters.events(codex(spark, tmp_path)), adapters.usage(codex(spark, tmp_path))).collect()
    assert [(str(d.date), d.active_seconds, d.tool_calls, d.errors, d.verification_events, d.total_tokens) for d in days] == [("2026-01-01", 15, 4, 2, 2, 55)]


def test_no_rows_no_sessions(spark, tmp_path):
    assert adapters.sessions(codex(spark, tmp_path).where("false")).count() == 0


def test_database_sessions(spark, database):  # noqa: F811
    sessions = sqlite.read_table(spark, database, "sessions", sqlite.HERMES_SESSIONS)
    joined = sqlite.hermes_events(sessions.withColumn("tool_call_count", F.lit(7).cast("long")), sqlite.read_table(spark, database, "messages", sqlite.HERMES_MESSAGES))
    row = assembly.database_sessions(joined).first()
    assert (row.session_id, row.model, row.input_tokens, row.prompt_count, row.tool_calls) == ("s", "m", 60, 1, 7)
