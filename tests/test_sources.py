import json
import sqlite3

import pytest
import zstandard
from pyspark.sql import functions as F

from tracelode.operators import joins, usage as usage_ops
from tests.against_sql import both
from tracelode.sources import adapters, files, sqlite


def bronze(spark, tmp_path, agent, records, name="a.jsonl"):
    tmp_path.mkdir(exist_ok=True, parents=True)
    (tmp_path / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
    return files.json_lines(spark, str(tmp_path), agent)


def test_lines_malformed_and_unterminated(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"type":"a"}\n{not-json\n\n{"type":"b"}\n{"type":"c')
    rows = files.json_lines(spark, str(tmp_path), "codex").orderBy("ordinal").collect()
    assert [(r.ordinal, r.malformed) for r in rows] == [(0, False), (1, True), (3, False)]
    seen = files.listing(spark, str(tmp_path)).withColumn("version", F.lit(files.PARSER_VERSION))
    assert files.changed(files.listing(spark, str(tmp_path)), seen).count() == 0
    assert files.changed(files.listing(spark, str(tmp_path)), seen.withColumn("size", F.col("size") + 1)).count() == 1


def test_zstd_lines_and_broken_frames(spark, tmp_path):
    data = "\n".join(json.dumps({"type": "turn/start", "seq": i, "time": 1700000000000 + i}) for i in range(50)) + "\nbad\n"
    packed = zstandard.ZstdCompressor().compress(data.encode())
    (tmp_path / "session.jsonl.zstd").write_bytes(packed)
    assert files.zstd_lines(spark, str(tmp_path), "deepseek-harness").count() == 50
    (tmp_path / "session.jsonl.zstd").write_bytes(packed[: len(packed) - 5])
    assert files.zstd_lines(spark, str(tmp_path), "deepseek-harness").count() <= 50


def test_claude(spark, tmp_path):
    t = "2026-01-01T10:00:0{}Z"
    u = lambda o: {"input_tokens": 10, "output_tokens": o, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 7, "cache_creation": {"ephemeral_1h_input_tokens": 3}}
    records = [
        {"type": "user", "timestamp": t.format(0), "sessionId": "s", "message": {"role": "user", "content": "Build it"}},
        {"type": "assistant", "timestamp": t.format(1), "sessionId": "s", "message": {"id": "m1", "model": "claude-opus-4-6", "content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "cargo test"}}], "usage": u(4)}},
        {"type": "assistant", "timestamp": t.format(2), "sessionId": "s", "message": {"id": "m1", "model": "claude-opus-4-6", "content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "cargo test"}}], "usage": u(9)}},
        {"type": "user", "timestamp": t.format(3), "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "is_error": True}]}},
        {"type": "system", "subtype": "turn_duration", "durationMs": 1500, "timestamp": t.format(4)}, {"type": "odd"},
    ]
    rows = adapters.normalised({"claude": bronze(spark, tmp_path, "claude-code", records)}).persist()
    total = adapters.usage(rows).agg(*[F.sum(n) for n in adapters.USAGE_FIELDS]).first()
    assert tuple(total) == (10, 9, 5, 4, 3, 0)
    e = adapters.events(rows).orderBy("sequence").collect()
    assert [(x.event_type, x.category, x.success) for x in e] == [("tool", "test", None), ("tool-result", "tool-result", False), ("complete", "complete", True)]
    assert adapters.prompts(rows).count() == 1 and rows.where("unknown").count() == 1


def test_codex_totals_identity_and_patches(spark, tmp_path):
    call = lambda patch: {"type": "response_item", "timestamp": "2026-01-01T10:00:00Z", "payload": {"type": "custom_tool_call", "name": "apply_patch", "call_id": "c", "input": patch}}
    result = lambda ok: {"type": "event_msg", "payload": {"type": "patch_apply_end", "success": ok, "changes": {"src/a.rs": {"type": "update", "unified_diff": "--- a\n+++ b\n+one\n-two"}}}}
    count = lambda i, c, o: {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}}
    patch = "*** Begin Patch\n*** Update File: src/a.rs\n+one\n+more\n-two\n*** End Patch"
    head = [{"type": "session_meta", "payload": {"id": "mine"}}, {"type": "session_meta", "payload": {"id": "parent"}}, {"type": "turn_context", "payload": {"model": "gpt-5.5"}}, count(100, 40, 10), count(150, 60, 30), count(20, 0, 5)]

    def run(name, *more):
        return adapters.normalised({"codex": bronze(spark, tmp_path / name, "codex", [*head, *more])})

    rows = run("request", call(patch))
    assert {r.session_id for r in rows.collect()} == {"mine"}
    assert tuple(adapters.usage(rows).agg(F.sum("input_tokens"), F.sum("cache_read_tokens"), F.sum("output_tokens")).first()) == (90, 60, 30)
    lines = lambda rows: tuple(adapters.patches(rows).agg(F.coalesce(F.sum("added"), F.lit(0)), F.coalesce(F.sum("removed"), F.lit(0))).first())
    assert lines(rows) == (2, 1)
    assert lines(run("applied", call(patch), result(True))) == (1, 1)
    assert lines(run("failed", call(patch), result(False))) == (0, 0)


def test_three_agents_once_each(spark, tmp_path):
    kimi = [{"type": "usage.record", "id": "u1", "time": 1767261600000, "sessionId": "k", "model": "k2", "provider": "moon", "usage": {"inputOther": 700, "output": 60, "inputCacheRead": 5000, "inputCacheCreation": 41}}, {"type": "context.append_loop_event", "time": 1767261601000, "event": {"type": "step.end", "finishReason": "end_turn"}}, {"type": "context.append_loop_event", "time": 1767261602000, "event": {"type": "step.end", "finishReason": "tool_use"}}]
    claw = [{"type": "tool_call", "id": "x", "timestamp": "2026-01-01T00:00:00Z", "sessionId": "o", "name": "exec", "arguments": {"command": "npm test"}}, {"type": "message", "id": "y", "message": {"role": "user", "content": "Build"}, "usage": {"input": 5, "output": 6}}]
    deep = [{"version": 1, "id": "d", "createdAt": 1767261600000, "cwd": "/p"}, {"type": "user/message", "seq": 1, "time": 1767261600001, "data": {"source": {"kind": "user"}, "content": "Build the feature"}}, {"type": "user/message", "seq": 2, "time": 1767261600002, "data": {"source": {"kind": "plugin"}, "content": "ctx"}}, {"type": "assistant/message", "seq": 3, "time": 1767261600003, "data": {"usage": {"inputTokens": 10, "cacheReadTokens": 3}}}, {"type": "tool/call", "seq": 4, "time": 1767261600004, "data": {"name": "read", "arguments": "{}"}}, {"type": "turn/end", "seq": 5, "time": 1767261600005, "data": {"reason": {"kind": "completed"}}}]
    rows = adapters.normalised({"kimi": bronze(spark, tmp_path / "k", "kimi-code", kimi * 2), "openclaw": bronze(spark, tmp_path / "o", "openclaw", claw * 2), "deepseek": bronze(spark, tmp_path / "d", "deepseek-harness", deep)}).persist()
    u = {r.agent: r for r in usage_ops.session_totals(adapters.usage(rows).withColumn("session_id", F.col("agent"))).withColumnRenamed("session_id", "agent").collect()}
    assert u["kimi-code"].total_tokens == 5801 and u["openclaw"].total_tokens == 11 and u["deepseek-harness"].total_tokens == 13
    e = adapters.events(rows).groupBy("agent", "event_type", "category").count().collect()
    got = {(r.agent, r.event_type, r.category): r["count"] for r in e}
    assert got[("kimi-code", "complete", "complete")] == 1 and got[("openclaw", "tool", "test")] == 1 and got[("deepseek-harness", "tool", "read")] == 1
    assert {r.agent: r["count"] for r in adapters.prompts(rows).groupBy("agent").count().collect()} == {"openclaw": 1, "deepseek-harness": 1}
    assert rows.where("unknown").count() == 0


def test_zcode_replays(spark, tmp_path):
    io = lambda i, *said, **more: {"type": "model_io", "id": i, "sessionId": "z", "startedAt": "2026-01-01T00:00:00Z", "request": {"messages": [{"role": "user", "content": s} for s in said]}, "response": {"text": "ok", "usage": {"totalTokens": 50}, "toolCalls": [{"id": f"t{i}", "name": "Read", "input": {}}]}, **more}
    rows = adapters.normalised({"zcode-model-io": bronze(spark, tmp_path, "zcode", [io("1", "first"), io("2", "first"), io("3", "first", "second"), io("3", "first", "second"), io("4", "x", querySource="compact")])})
    assert rows.where("human").count() == 2
    assert adapters.usage(rows).agg(F.sum("input_tokens")).first()[0] == 200


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "h.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE sessions (id TEXT, model TEXT, started_at REAL, ended_at REAL, input_tokens INT, title TEXT)")
        c.execute("INSERT INTO sessions VALUES ('s', 'm', 1767261600.5, NULL, 60, 't')")
        c.execute("CREATE TABLE messages (id INT, session_id TEXT, role TEXT, content TEXT, tool_calls TEXT, timestamp REAL)")
        rows = [(1, "s", "user", "hi", None, 1.0), (2, "s", "assistant", None, json.dumps([{"function": {"name": "terminal"}}, {"name": "x"}]), 2.0), (3, "s", "assistant", None, "[" + " " * (1 << 20) + "]", 3.0)]
        c.executemany("INSERT INTO messages VALUES (?,?,?,?,?,?)", rows)
    return path


def test_embedded_database(spark, database):
    sessions = sqlite.read_table(spark, database, "sessions", sqlite.HERMES_SESSIONS)
    row = sessions.first()
    assert (row.id, row.input_tokens, row.actual_cost_usd) == ("s", 60, None)
    e = sqlite.hermes_events(sessions, sqlite.read_table(spark, database, "messages", sqlite.HERMES_MESSAGES, partitions=2)).collect()
    assert sorted((x.event_type, x.name) for x in e if x.event_type != "response") == [("prompt", None), ("tool", "terminal"), ("tool", "x")]
    assert sum(x.oversized for x in e) == 1
    with open(database + "-journal", "wb") as f:
        f.write(b"hot")
    with pytest.raises(Exception, match="hot rollback"):
        sqlite.read_table(spark, database, "sessions", sqlite.HERMES_SESSIONS).collect()


def test_cursor_union(spark):
    a = spark.createDataFrame([("c1", "T", None, "m", 1767261600000), (" ", "x", None, None, 1)], sqlite.SUMMARIES)
    b = spark.createDataFrame([("h1", "c1", None, 1767261600001, None, "s"), ("h2", "c1", 1767261600002, 5, None, "s"), ("h3", "gone", None, 7, None, "s")], sqlite.CODE_HASHES)
    rows = sqlite.cursor_history(a, b).collect()
    assert sorted((r.kind, r.event_id or "") for r in rows) == [("edit", "h1"), ("edit", "h2"), ("summary", "")]


def test_git_skills_roots(spark):
    log = "\x1eabc\x1f2026-01-01T00:00:00Z\x1ffix\n\n3\t1\tsrc/a.rs\n-\t-\timg.png\n\x1edef\x1f2026-01-02T00:00:00Z\x1fadd\n2\t0\tb\n"
    rows = files.git_log(spark.createDataFrame([("r", log)], "path string, text string")).collect()
    assert sorted((r.commit, r.file, r.added, r.removed) for r in rows) == [("abc", "img.png", 0, 0), ("abc", "src/a.rs", 3, 1), ("def", "b", 2, 0)]
    skills = files.skill_files(spark.createDataFrame([("/h/skills/pdf/SKILL.md", "---\nname: PDF\n---\n"), ("/h/plugins/github/skills/yeet/SKILL.md", "none")], "path string, text string"))
    assert {r.skill for r in skills.collect()} == {"pdf", "github:yeet"}
    assert files.roots(spark, "/h", {"CODEX_HOME": "/x"}).where("agent = 'codex'").first().path == "/x/sessions"
    assert files.capabilities(spark).count() == 8 and joins.page_overlap([1, 2, 3], [2, 3, 4]) == 2


def test_calls_inside_exec_wrappers(spark, tmp_path):
    script = "const results = await Promise.all([tools.exec_command({cmd: \"cargo test\"}), tools.exec_command({cmd: \"rg -n 'cargo test' README.md\"}), tools.exec_command({command: \"npm run build\"})]);"
    record = {"type": "response_item", "timestamp": "2026-07-19T00:00:00Z", "payload": {"type": "custom_tool_call", "call_id": "c", "name": "exec", "input": script}}
    rows = adapters.normalised({"codex": bronze(spark, tmp_path, "codex", [record])})
    assert {r.category: r["count"] for r in adapters.events(rows).groupBy("category").count().collect()} == {"test": 1, "shell": 1, "build": 1}


def test_literal_calls_only():
    from tracelode.sources.exec_wrapper import tool_calls

    assert tool_calls("const p = `*** Begin`; await tools.apply_patch(p); // tools.exec_command({cmd: 'no'})") == [("apply_patch", "*** Begin")]
    assert tool_calls("tools.exec_command({cmd: `a ${b}`}); tools.exec_command({timeout: f({cmd: 'x'}), cmd}); 'tools.exec_command({cmd: 1})'") == []
    assert tool_calls("let cmd = 'ls \\'x\\''; tools.exec_command({cmd, n: 1})") == [("exec_command", "ls 'x'")]


def _numbers(path, rows, tail=""):
    with sqlite3.connect(path) as c:
        c.execute(f"CREATE TABLE t (a TEXT, b INTEGER, v INTEGER, PRIMARY KEY (a, b)){tail}")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    c.close()


def test_all_tasks_read_one_state_of_a_database_that_is_written_to(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "live.db")
    _numbers(path, [("x", i, i) for i in range(100)])
    reader = sqlite._Reader(spark.createDataFrame([], "b long, v long, missing string").schema, {"path": path, "dbtable": "t", "partitions": "4", "snapshots": str(tmp_path / "sqlite-a")})
    got = []
    for part in reader.partitions():
        got += list(reader.read(part))
        with sqlite3.connect(path) as c:  # a writer between the tasks
            c.execute("UPDATE t SET v = -1")
            c.execute("DELETE FROM t WHERE b % 3 = 0")
        c.close()
    assert sorted(got) == [(i, i, None) for i in range(100)]


def test_ranges_hold_the_same_number_of_rows_wherever_the_keys_lie(spark, tmp_path):
    gaps = [("x", i, i) for i in range(90)] + [("x", 10**12 + i, i) for i in range(10)]
    for name, tail in (("plain", ""), ("keyed", " WITHOUT ROWID")):
        path = str(tmp_path / f"{name}.db")
        _numbers(path, gaps + [("y", i, i) for i in range(100)], tail)
        reader = sqlite._Reader(spark.createDataFrame([], "a string, b long").schema, {"path": path, "dbtable": "t", "partitions": "8", "snapshots": str(tmp_path / f"sqlite-{name}")})
        parts = [list(reader.read(p)) for p in reader.partitions()]
        assert [len(p) for p in parts] == [25] * 8 and len({r for p in parts for r in p}) == 200
        assert sqlite.read_table(spark, path, "t", "a string, b long", partitions=300).distinct().count() == 200
    _numbers(str(tmp_path / "none.db"), [])
    assert sqlite.read_table(spark, str(tmp_path / "none.db"), "t", "a string", partitions=3).count() == 0


def test_frozen_copies_go_at_once_and_abandoned_ones_after_a_day(spark, tmp_path):
    import os

    path = str(tmp_path / "f.db")
    _numbers(path, [("x", i, i) for i in range(5)])
    with sqlite.frozen(spark, path) as copy:
        with sqlite3.connect(path) as c:
            c.execute("DELETE FROM t")
        c.close()
        assert [sqlite.read_table(spark, copy, "t", "v long", partitions=n).count() for n in (1, 2)] == [5, 5]
    assert not os.path.exists(copy.removesuffix(sqlite.FROZEN))
    for name, age in (("sqlite-old", 2 * sqlite.DAY), ("sqlite-new", 60), ("other", 9 * sqlite.DAY)):
        (tmp_path / "base" / name).mkdir(parents=True)
        os.utime(tmp_path / "base" / name, (0, __import__("time").time() - age))
    assert [os.path.basename(p) for p in sqlite.remove_abandoned(str(tmp_path / "base"))] == ["sqlite-old"]
    assert sorted(os.listdir(tmp_path / "base")) == ["other", "sqlite-new"]


#: A session of more events than a limit ever was, beside small ones.
LONG_SESSION = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * i AS ts, CASE WHEN i % 3000 = 0 THEN i // 3000 ELSE 0 END AS user_id, ['click', 'error', 'view', 'purchase', 'signup'][i % 5 + 1] AS event_type, (i % 900)::DOUBLE AS value FROM range(12000) t(i)"


def test_all_events_of_a_long_session_are_summed_up(spark, tmp_path):
    got, want = both(spark, tmp_path, "log_claude", {"events": LONG_SESSION})
    assert got == want and sum(n for _, what, n in got if what == "error:error:false") == 2400


def test_events_of_a_log_have_no_cut_of_their_own(spark, tmp_path):
    got, want = both(spark, tmp_path, "log_codex", {"events": LONG_SESSION})
    assert got == want and sum(n for _, what, n in got if what == "error:error:false") == 2400
    rows = adapters.normalised({"codex": bronze(spark, tmp_path / "log", "codex", [{"type": "event_msg", "payload": {"type": "error"}}] * 4500)})
    e = adapters.events(rows).agg(F.count("*"), F.max("sequence"), F.count_distinct("fingerprint")).first()
    assert tuple(e) == (4500, 4500, 4500) and adapters.events(rows, limit=7).count() == 7
