"""Plans of the log sources: the events table written as each agent's log records, read back by its adapter.

A user's events are one log file. What each record says is a template over the event; SQL counts what must come out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators import assembly
from tracelode.operators.graph import kept
from tracelode.plans.base import plan
from tracelode.sources import adapters, files, live_logs
from tracelode.streaming import envelopes

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _fill(template: str, values: dict[str, Column]) -> Column:
    """template with each $name$ replaced by a column."""
    parts = re.split(r"\$(\w+)\$", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def _lines(t, templates: dict[str, str], header: str | None = None) -> DataFrame:
    """(path, n, line): a log line of each event whose type has a template, after the file's header."""
    e = t.events.select(
        "user_id", F.col("event_id").alias("n"), "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").cast("string").alias("i"), F.date_format("ts", ISO).alias("iso"), F.unix_millis("ts").cast("string").alias("ms"),
        F.floor("value").cast("string").alias("v"), F.col("user_id").cast("string").alias("u"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false").alias("b"),
    )
    values = {x: F.col(x) for x in ("i", "iso", "ms", "v", "u", "b")}
    line = F.lit(None).cast("string")
    for kind, template in templates.items():
        line = F.when(F.col("event_type") == kind, _fill(template, values)).otherwise(line)
    rows = e.select("path", "n", line.alias("line")).where("line IS NOT NULL")
    if header is not None:
        rows = rows.unionByName(e.select("path", F.lit(-1).cast("long").alias("n"), _fill(header, {"u": F.col("u")}).alias("line")).distinct())
    return rows


def _texts(lines: DataFrame) -> DataFrame:
    """(path, text): whole log files."""
    return lines.groupBy("path").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def _summary(rows: DataFrame) -> DataFrame:
    """(session_id, what, n): events by type, category and success, prompts, and output tokens."""
    # Written once, so that three branches do not parse the logs three times.
    rows = kept(rows, "log-rows")
    success = F.coalesce(F.col("success").cast("string"), F.lit("?"))
    e = adapters.events(rows).select("session_id", F.concat_ws(":", "event_type", "category", success).alias("what"), F.lit(1).cast("long").alias("n"))
    p = adapters.prompts(rows).select("session_id", F.lit("prompt").alias("what"), F.lit(1).cast("long").alias("n"))
    u = adapters.usage(rows).select("session_id", F.lit("tokens").alias("what"), F.col("output_tokens").alias("n"))
    return e.unionByName(p).unionByName(u).groupBy("session_id", "what").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Log:
    """An adapter's name and agent, a file's header, and by event type a record's template with what it must give (SQL of a name and an amount)."""

    adapter: str
    agent: str
    header: str | None
    records: dict[str, tuple[str, tuple[tuple[str, str], ...]]]
    session: str = "'s' || CAST(user_id AS VARCHAR)"

    def sql(self) -> str:
        parts = [f"SELECT {self.session} AS session_id, {name} AS what, {amount} AS n FROM events WHERE event_type = '{kind}'" for kind, (_, given) in self.records.items() for name, amount in given]
        return f"SELECT session_id, what, CAST(sum(n) AS BIGINT) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"

    def rows(self, t) -> DataFrame:
        lines = _lines(t, {kind: template for kind, (template, _) in self.records.items()}, self.header)
        return adapters.normalised({self.adapter: files.split_lines(_texts(lines), self.agent)})


ONE, TOKENS = "1", "CAST(floor(value) AS BIGINT)"
RESULT = ("'tool-result:tool-result:' || CASE WHEN event_id % 2 = 0 THEN 'false' ELSE 'true' END", ONE)
PROMPT = ("'prompt'", ONE)


def _event(name: str) -> tuple[str, str]:
    return f"'{name}'", ONE


USED = ("'tokens'", TOKENS)
CLAUDE = Log("claude", "claude-code", None, {
    "signup": ('{"type":"user","timestamp":"$iso$","sessionId":"s$u$","message":{"role":"user","content":"Prompt $i$"}}', (PROMPT,)),
    "click": ('{"type":"assistant","timestamp":"$iso$","sessionId":"s$u$","message":{"id":"m$i$","model":"claude-opus-4-6","content":[{"type":"tool_use","id":"t$i$","name":"Bash","input":{"command":"cd x && cargo test"}}],"usage":{"input_tokens":1,"output_tokens":$v$}}}', (_event("tool:test:?"), USED)),
    "view": ('{"type":"user","timestamp":"$iso$","sessionId":"s$u$","message":{"role":"user","content":[{"type":"tool_result","is_error":$b$}]}}', (RESULT,)),
    "purchase": ('{"type":"system","subtype":"turn_duration","durationMs":7,"timestamp":"$iso$","sessionId":"s$u$"}', (_event("complete:complete:true"),)),
    "error": ('{"type":"system","subtype":"api_error","timestamp":"$iso$","sessionId":"s$u$"}', (_event("error:error:false"),)),
})
CODEX = Log("codex", "codex", '{"type":"session_meta","payload":{"id":"s$u$","cwd":"/w"}}', {
    "signup": ('{"type":"event_msg","timestamp":"$iso$","payload":{"type":"user_message","message":"Prompt $i$"}}', (PROMPT,)),
    "click": ('{"type":"response_item","timestamp":"$iso$","payload":{"type":"function_call","name":"shell","call_id":"c$i$","arguments":"{\\"cmd\\":\\"npm run lint\\"}"}}', (_event("tool:lint:?"),)),
    # Running totals: what they add up to is the last of them.
    "view": ('{"type":"event_msg","timestamp":"$iso$","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":$i$,"cached_input_tokens":0,"output_tokens":$i$}}}}', (("'tokens'", "event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0)"),)),
    "purchase": ('{"type":"event_msg","timestamp":"$iso$","payload":{"type":"task_complete","duration_ms":5}}', (_event("complete:complete:true"),)),
    "error": ('{"type":"event_msg","timestamp":"$iso$","payload":{"type":"error"}}', (_event("error:error:false"),)),
})
KIMI = Log("kimi", "kimi-code", None, {
    "signup": ('{"type":"turn.prompt","id":"k$i$","sessionId":"s$u$","time":$ms$,"prompt":"Prompt $i$"}', (PROMPT, _event("start:start:?"))),
    "click": ('{"type":"context.append_loop_event","id":"k$i$","sessionId":"s$u$","time":$ms$,"event":{"type":"tool.call","id":"t$i$","name":"Grep","args":{}}}', (_event("tool:search:?"),)),
    "view": ('{"type":"context.append_loop_event","id":"k$i$","sessionId":"s$u$","time":$ms$,"event":{"type":"tool.result","result":{"isError":$b$}}}', (RESULT,)),
    "purchase": ('{"type":"usage.record","id":"k$i$","sessionId":"s$u$","time":$ms$,"model":"kimi-k2.6","usage":{"inputOther":1,"output":$v$}}', (USED,)),
    "error": ('{"type":"turn.cancel","id":"k$i$","sessionId":"s$u$","time":$ms$}', (_event("abort:abort:?"),)),
})
DEEPSEEK = Log("deepseek", "deepseek-harness", '{"version":1,"id":"s$u$","cwd":"/w","createdAt":1704067200000}', {
    "signup": ('{"type":"user/message","seq":$i$,"time":$ms$,"data":{"source":{"kind":"user"},"content":"Prompt $i$"}}', (PROMPT,)),
    "click": ('{"type":"tool/call","seq":$i$,"time":$ms$,"data":{"name":"edit_file","arguments":{}}}', (_event("tool:edit:?"),)),
    "view": ('{"type":"assistant/message","seq":$i$,"time":$ms$,"data":{"message":{"content":"x"},"usage":{"inputTokens":1,"outputTokens":$v$}}}', (USED,)),
    "purchase": ('{"type":"turn/end","seq":$i$,"time":$ms$,"data":{"reason":{"kind":"completed"}}}', (_event("complete:complete:true"),)),
    "error": ('{"type":"turn/end","seq":$i$,"time":$ms$,"data":{"reason":{"kind":"error"}}}', (_event("error:error:false"), _event("abort:abort:?"))),
})
OPENCLAW = Log("openclaw", "openclaw", None, {
    "signup": ('{"type":"message","id":"o$i$","sessionId":"s$u$","time":$ms$,"message":{"role":"user","content":"Prompt $i$"}}', (PROMPT,)),
    "click": ('{"type":"tool_call","id":"o$i$","sessionId":"s$u$","time":$ms$,"name":"web_fetch","arguments":{}}', (_event("tool:web:?"),)),
    "view": ('{"type":"tool_result","id":"o$i$","sessionId":"s$u$","time":$ms$,"isError":$b$}', (RESULT,)),
    "purchase": ('{"type":"message","id":"o$i$","sessionId":"s$u$","time":$ms$,"message":{"role":"assistant","content":"done","model":"m"},"usage":{"input":1,"output":$v$}}', (USED,)),
    "error": ('{"type":"note","id":"o$i$","sessionId":"s$u$","time":$ms$}', ()),
})
CURSOR = Log("cursor", "cursor", None, {
    "signup": ('{"role":"user","message":{"content":[{"type":"text","text":"Prompt $i$"}]}}', (PROMPT,)),
    "click": ('{"role":"assistant","message":{"content":[{"type":"tool_use","id":"t$i$","name":"read_file","input":{}}]}}', (_event("tool:read:?"),)),
    "view": ('{"role":"user","message":{"content":[{"type":"tool_result"}]}}', ()),
    "purchase": ('{"role":"assistant","message":{"content":"ok"}}', ()),
}, "substr(sha256('u' || CAST(user_id AS VARCHAR)), 1, 16)")
ZCODE = Log("zcode-model-io", "zcode", None, {
    "signup": ('{"type":"model_io","id":"z$i$","sessionId":"s$u$","time":$ms$,"request":{"messages":[{"role":"user","content":"Prompt $i$"}]}}', (PROMPT,)),
    "click": ('{"type":"model_io","id":"z$i$","sessionId":"s$u$","time":$ms$,"response":{"toolCalls":[{"id":"t$i$","name":"task","input":{}}]}}', (_event("tool:subagent:?"),)),
    "view": ('{"type":"model_io","id":"z$i$","sessionId":"s$u$","time":$ms$,"response":{"usage":{"inputTokens":1,"outputTokens":$v$}}}', (USED,)),
    "purchase": ('{"type":"model_io","id":"z$i$","sessionId":"s$u$","time":$ms$,"querySource":"compact"}', (_event("compaction:compaction:?"),)),
    "error": ('{"type":"model_io","id":"z$i$","sessionId":"s$u$","time":$ms$,"error":{"m":1}}', (_event("error:error:false"),)),
})


@plan(CLAUDE.sql())
def log_claude(t):
    return _summary(CLAUDE.rows(t))


@plan(CODEX.sql())
def log_codex(t):
    return _summary(CODEX.rows(t))


@plan(KIMI.sql())
def log_kimi(t):
    return _summary(KIMI.rows(t))


@plan(DEEPSEEK.sql())
def log_deepseek(t):
    return _summary(DEEPSEEK.rows(t))


@plan(OPENCLAW.sql())
def log_openclaw(t):
    return _summary(OPENCLAW.rows(t))


@plan(CURSOR.sql())
def log_cursor(t):
    return _summary(CURSOR.rows(t))


@plan(ZCODE.sql())
def log_zcode(t):
    return _summary(ZCODE.rows(t))


@plan("""
SELECT 's' || CAST(user_id AS VARCHAR) AS session_id, count(*) FILTER (event_type = 'signup') AS prompts, count(*) AS messages FROM events GROUP BY 1""")
def log_zcode_snapshots(t):
    message = F.concat(F.lit('{"role":"'), F.when(F.col("event_type") == "signup", "user").otherwise("assistant"), F.lit('","content":"Text '), F.col("event_id").cast("string"), F.lit('"}'))
    rows = t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(message)), ",").alias("m"))
    texts = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit('{"meta":{"taskId":"s'), F.col("user_id").cast("string"), F.lit('"},"messages":['), "m", F.lit("]}")).alias("text"))
    rows = adapters.normalised({"zcode": files.json_document_or_lines(texts, "zcode")})
    return rows.groupBy("session_id").agg(F.count_if("human").alias("prompts"), F.count("*").alias("messages"))


@plan("SELECT 'u' || CAST(user_id AS VARCHAR) AS path, count(*) FILTER (event_id % 7 = 0) AS malformed, count(*) AS records, CAST(max(event_id) FILTER (event_id % 7 <> 0) AS BIGINT) AS last_id FROM events GROUP BY 1")
def json_line_scan(t):
    line = F.when(F.col("event_id") % 7 == 0, "{not json").otherwise(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}")))
    lines = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("n"), line.alias("line"))
    # A last line without its end is not a record yet.
    texts = _texts(lines).withColumn("text", F.concat("text", F.lit('\n{"id":99')))
    return files.split_lines(texts, "codex").groupBy("path").agg(F.count_if("malformed").alias("malformed"), F.count("*").alias("records"), F.max(F.try_variant_get("record", "$.id", "bigint")).alias("last_id"))


@plan("SELECT user_id, CAST(value AS BIGINT) AS v, count(DISTINCT event_type) AS n FROM (SELECT user_id, floor(value) AS value, event_type FROM events WHERE event_type <> 'view') GROUP BY 1, 2")
def unseen_receipts(t):
    line = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","id":"'), F.floor("value").cast("string"), F.lit('","v":'), F.floor("value").cast("string"), F.lit("}"))
    lines = t.events.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("n"), line.alias("line"), "event_type")
    records = files.receipts(files.split_lines(_texts(lines.drop("event_type")), "codex"))
    known = files.receipts(files.split_lines(_texts(lines.where("event_type = 'view'").drop("event_type")), "codex"))
    new = files.unseen(records, known)
    return new.groupBy(F.col("path").cast("long").alias("user_id"), F.try_variant_get("record", "$.v", "bigint").alias("v")).agg(F.count("*").alias("n"))


SIGNALS = {
    "signup": '{"type":"event_msg","timestamp":"$iso$","payload":{"type":"task_started"}}', "click": '{"type":"event_msg","timestamp":"$iso$","payload":{"type":"exec_approval_request"}}', "view": '{"type":"event_msg","timestamp":"$iso$","payload":{"type":"unheard_of"}}',
    "purchase": '{"type":"event_msg","timestamp":"$iso$","payload":{"type":"task_complete"}}', "error": '{"type":"event_msg","timestamp":"$iso$","payload":{"type":"error"}}',
}


@plan("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'view'),
b AS (SELECT user_id, event_type = 'signup' AS open, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT 'u' || CAST(r.user_id AS VARCHAR) AS path, CASE event_type WHEN 'signup' THEN 'running' WHEN 'click' THEN 'waiting' WHEN 'purchase' THEN 'completed' ELSE 'error' END AS status, CASE event_type WHEN 'signup' THEN 'thinking' WHEN 'click' THEN 'needs-you' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS phase, b.open
FROM r LEFT JOIN b ON b.user_id = r.user_id AND b.r = 1 WHERE r.r = 1""")
def transcript_states(t):
    signals = live_logs.transcript_signals(files.split_lines(_texts(_lines(t, SIGNALS)), "codex"))
    return live_logs.latest_signal(signals).join(live_logs.open_turn(signals).select("path", "open"), "path", "left").select("path", "status", "phase", "open")


NOW = "2024-01-30 23:58:00"
#: What shows: running and waiting of the last ten minutes, completions of the last ninety seconds.
RUNTIME_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type IN ('signup', 'error')),
s AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'running' ELSE 'completed' END AS status, floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ts)) AS age FROM r WHERE r = 1)
SELECT 'u' || CAST(user_id AS VARCHAR) AS path, status FROM s WHERE age >= 0 AND age <= CASE status WHEN 'completed' THEN 90 * 3600 ELSE 600 * 3600 END"""


@plan(RUNTIME_SQL)
def runtime_states(t):
    # Times are brought 3600 times nearer to now, as the events lie a month apart; parts of a millisecond away from now, so that none crosses a bound.
    age = F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds("ts")
    near = F.unix_millis(F.lit(NOW).cast("timestamp")) - F.sign(age).cast("long") * F.ceil(F.abs(age) * 10 / 36)
    values = {"ms": near.cast("string"), "i": F.col("event_id").cast("string"), "u": F.col("user_id").cast("string")}
    line = F.when(F.col("event_type") == "signup", _fill(KIMI.records["signup"][0], values)).otherwise(_fill(KIMI.records["error"][0], values))
    lines = t.events.where("event_type IN ('signup', 'error')").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("n"), line.alias("line"))
    return live_logs.runtime_sessions(files.split_lines(_texts(lines), "kimi-code"), "kimi-code", F.lit(NOW).cast("timestamp")).select("path", "status")


HOOKS = {"signup": "UserPromptSubmit", "click": "PreToolUse", "view": "SomethingElse", "purchase": "Stop", "error": "PostToolUseFailure"}


@plan("""
SELECT event_id, substr(sha256('claude-code:s' || CAST(user_id AS VARCHAR)), 1, 16) AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status,
  CASE event_type WHEN 'signup' THEN 'thinking' WHEN 'click' THEN 'using-tool' WHEN 'purchase' THEN 'done' ELSE 'tool-failed' END AS phase, CASE WHEN event_type = 'click' THEN 'Bash' ELSE CASE event_type WHEN 'signup' THEN 'UserPromptSubmit' WHEN 'purchase' THEN 'Stop' ELSE 'PostToolUseFailure' END END AS label, 'app' AS project_label
FROM events WHERE event_type <> 'view' AND NOT (event_type = 'purchase' AND event_id % 5 = 0) AND event_id % 13 <> 0""")
def canonical_envelopes(t):
    foreign = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), F.lit(',"conversation_id":"c"')).otherwise(F.lit(""))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in HOOKS.items() for x in kv]), F.col("event_type"))
    tool = F.when(F.col("event_type") == "click", F.lit(',"tool_name":"Bash"')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"provider":"claude-code","received_at":"2024-02-01T00:00:00Z","payload":{"session_id":"s'), F.col("user_id").cast("string"), F.lit('","hook_event_name":"'), name, F.lit('","event_id":"'), F.col("event_id").cast("string"), F.lit('","cwd":"/work/app","timestamp":"'), F.date_format("ts", ISO), F.lit('"'), tool, foreign, F.lit("}}"))
    # One envelope in thirteen is cut off.
    value = F.when(F.col("event_id") % 13 == 0, F.substring(body, 1, 60)).otherwise(body)
    return envelopes.canonical(t.events.select(value.alias("value"))).select(F.col("event_id").cast("long").alias("event_id"), "id", "status", "phase", "label", "project_label")


@plan("""
SELECT 'c' || CAST(o_custkey AS VARCHAR) AS path, 'h' || CAST(o_orderkey AS VARCHAR) AS "commit", 'Order ' || CAST(o_orderkey AS VARCHAR) AS subject, 'f' || CAST(l_partkey AS VARCHAR) AS file, CAST(sum(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_linenumber END) AS BIGINT) AS added, CAST(sum(l_suppkey) AS BIGINT) AS removed
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""")
def git_history(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_linenumber"), "o_orderkey")
    # Binary files have dashes for numbers.
    added = F.when(F.col("l_linenumber") == 3, "-").otherwise(F.col("l_linenumber").cast("string"))
    stat = F.concat_ws("\t", added, F.col("l_suppkey").cast("string"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")))
    commits = o.groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.array_join(F.array_sort(F.collect_list(stat)), "\n").alias("stats"))
    head = F.concat(F.lit("\x1e h"), F.col("o_orderkey").cast("string"), F.lit(" \x1f "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" \x1f Order "), F.col("o_orderkey").cast("string"), F.lit("\n\n"), F.col("stats"))
    texts = _texts(commits.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").alias("n"), head.alias("line")))
    return files.git_log(texts).groupBy("path", "commit", "subject", "file").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


@plan("""
SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN lower(p_brand) || ':' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN lower(replace(p_name, ' ', '-')) ELSE 'folder' || CAST(p_size AS VARCHAR) END AS skill FROM part""")
def installed_skills(t):
    path = F.concat(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/home/plugins/"), F.col("p_brand"))).otherwise("/home/skills"), F.lit("/x/folder"), F.col("p_size").cast("string"), F.lit("/SKILL.md"))
    body = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("---\nname: '"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("'\ndescription: d\n---\nText"))).otherwise("Text only")
    return files.skill_files(t.part.select(path.alias("path"), body.alias("text")))


@plan("""
SELECT 1 + event_id // 1000 AS page, CAST(count(*) AS BIGINT) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""")
def account_usage_pages(t):
    # Each page begins with the last three events of the page before.
    number = F.floor(F.col("event_id") / 1000) + 1
    again = (F.col("event_id") % 1000 >= 997) & (F.col("event_id") < F.lit(1000) * F.floor(F.lit(t.events.count() - 1) / 1000))
    rows = t.events.select(number.alias("page"), "event_id").unionByName(t.events.where(again).select((number + 1).alias("page"), "event_id"))
    entry = F.to_json(F.struct(F.col("event_id").alias("id")))
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))), lambda x: x["e"]), ",").alias("b"))
    found = live_logs.account_pages(pages.select(F.col("page").cast("long").alias("page"), F.concat(F.lit('{"usageEventsDisplay":['), "b", F.lit("]}")).alias("body")))
    return found.groupBy("page").agg(F.count("*").alias("events"), F.sum(F.get_json_object("event", "$.id").cast("long")).alias("ids"))


#: Events of a session in the log's order, with milliseconds as the log has them.
LOGGED = "(SELECT 's' || CAST(user_id AS VARCHAR) AS session_id, event_id, event_type, value, (epoch_us(ts) // 1000) AS ms, lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY event_id) AS before, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM events)"
FAILED = "event_type = 'error' OR (event_type = 'view' AND event_id % 2 = 0)"


@plan(f"""
WITH e AS (SELECT *, CAST(trunc((ms - before) / 1000.0) AS BIGINT) AS gap FROM {LOGGED}),
runs AS (SELECT session_id, run, arg_min(ms, event_id) FILTER (event_type <> 'signup') AS began, max(ms) FILTER (event_type = 'signup') AS asked FROM e GROUP BY 1, 2),
closed AS (SELECT session_id, began, coalesce(lead(asked) OVER (PARTITION BY session_id ORDER BY run), (SELECT max(ms) FROM e WHERE e.session_id = runs.session_id)) AS ended FROM runs),
longest AS (SELECT session_id, max(greatest(CAST(trunc((ended - began) / 1000.0) AS BIGINT), 0)) AS longest_uninterrupted_seconds FROM closed WHERE began IS NOT NULL GROUP BY 1),
s AS (SELECT session_id, min(ms) AS started, max(ms) AS ended, CAST(sum(CASE WHEN gap BETWEEN 0 AND 600 THEN gap ELSE 0 END) AS BIGINT) AS active_seconds,
  count(*) FILTER (event_type = 'signup') AS prompt_count, CAST(coalesce(sum(length('Prompt ' || event_id)) FILTER (event_type = 'signup'), 0) AS BIGINT) AS prompt_characters,
  count(*) FILTER (event_type = 'click') AS tool_calls, count(*) FILTER (event_type = 'click') AS test_events, count(*) FILTER (event_type = 'click') AS verification_events,
  count(*) FILTER (event_type = 'view' AND event_id % 2 = 1) AS successful_tools, count(*) FILTER (event_type = 'view' AND event_id % 2 = 0) AS failed_tools, count(*) FILTER ({FAILED}) AS errors,
  count(*) FILTER (event_type = 'purchase') AS task_completions, 7 * count(*) FILTER (event_type = 'purchase') AS completed_task_duration_ms, CAST(coalesce(sum(1 + {TOKENS}) FILTER (event_type = 'click'), 0) AS BIGINT) AS total_tokens,
  greatest(arg_min(ms, event_id) FILTER (event_type = 'click') - arg_min(ms, event_id) FILTER (event_type = 'signup'), 0) AS time_to_first_tool_ms, 'Prompt ' || min(event_id) FILTER (event_type = 'signup') AS title FROM e GROUP BY 1)
SELECT s.*, coalesce(longest_uninterrupted_seconds, 0) AS longest_uninterrupted_seconds FROM s LEFT JOIN longest USING (session_id)""".replace("greatest(arg_min(ms, event_id) FILTER (event_type = 'click') - arg_min(ms, event_id) FILTER (event_type = 'signup'), 0)", "CASE WHEN count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'signup') > 0 THEN greatest(arg_min(ms, event_id) FILTER (event_type = 'click') - arg_min(ms, event_id) FILTER (event_type = 'signup'), 0) END"))
def session_records_of_log(t):
    s = adapters.sessions(kept(CLAUDE.rows(t), "log-rows"))
    at = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    counters = ("prompt_count", "prompt_characters", "tool_calls", "test_events", "verification_events", "successful_tools", "failed_tools", "errors", "task_completions", "completed_task_duration_ms", "total_tokens")
    return s.select("session_id", at("started_at").alias("started"), at("ended_at").alias("ended"), "active_seconds", "longest_uninterrupted_seconds", "time_to_first_tool_ms", "title", *counters)


@plan(f"""
WITH e AS (SELECT *, CAST(trunc((ms - before) / 1000.0) AS BIGINT) AS gap FROM {LOGGED}),
d AS (SELECT session_id, CAST(make_timestamp(before * 1000) AS DATE) AS date, gap AS active_seconds, 0 AS tool_calls, 0 AS errors, 0 AS verification_events, 0 AS total_tokens FROM e WHERE gap BETWEEN 1 AND 600
  UNION ALL SELECT session_id, CAST(make_timestamp(ms * 1000) AS DATE), 0, CAST(event_type = 'click' AS INTEGER), CAST(({FAILED}) AS INTEGER), CAST(event_type = 'click' AS INTEGER), CASE WHEN event_type = 'click' THEN 1 + {TOKENS} ELSE 0 END FROM e)
SELECT session_id, date, CAST(sum(active_seconds) AS BIGINT) AS active_seconds, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(verification_events) AS BIGINT) AS verification_events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM d GROUP BY 1, 2 HAVING sum(active_seconds) + sum(tool_calls) + sum(errors) + sum(total_tokens) > 0""")
def session_days_of_log(t):
    rows = kept(CLAUDE.rows(t), "log-rows")
    days = assembly.session_days(rows, adapters.events(rows), adapters.usage(rows))
    return days.select("session_id", F.col("date").cast("date").alias("date"), "active_seconds", "tool_calls", "errors", "verification_events", "total_tokens")


@plan("""
SELECT 's' || user_id AS session_id, CASE event_id % 4 WHEN 0 THEN 'src/f' || CAST(floor(value) AS BIGINT) % 9 || '.py' WHEN 1 THEN '[external]/x' || CAST(floor(value) AS BIGINT) % 3 || '.md' ELSE 'doc.md' END AS path, count(*) AS changes,
  CAST(sum(CASE WHEN event_id % 4 = 2 THEN 1 ELSE 2 END) AS BIGINT) AS added, CAST(sum(CASE WHEN event_id % 4 = 2 THEN 0 ELSE 3 END) AS BIGINT) AS removed
FROM events WHERE event_type IN ('click', 'view') AND event_id % 4 <> 3 GROUP BY 1, 2""")
def files_that_edit_tools_name(t):
    """Edits of two agents: arguments as an object and as text, files inside, outside and above the project."""
    i, v = F.col("event_id"), F.floor("value")
    name = F.when(i % 4 == 0, F.concat(F.lit("/w/p/src/f"), (v % 9).cast("string"), F.lit(".py"))).when(i % 4 == 1, F.concat(F.lit("/other/x"), (v % 3).cast("string"), F.lit(".md"))).when(i % 4 == 2, F.lit("./doc.md")).otherwise(F.lit("../up.md"))
    given = F.when(i % 4 == 2, F.to_json(F.struct(name.alias("path"), F.lit("one line").alias("content")))).otherwise(F.to_json(F.struct(name.alias("file_path"), F.lit("a\nb").alias("new_string"), F.lit("1\n2\n3\n").alias("old_string"))))
    session, ts = F.concat(F.lit("s"), F.col("user_id").cast("string")), F.date_format("ts", ISO)
    # One record a path keeps sessions of both agents apart from their order.
    claude = F.to_json(F.struct(F.lit("assistant").alias("type"), session.alias("sessionId"), F.lit("/w/p").alias("cwd"), ts.alias("timestamp"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), i.cast("string").alias("id"), F.lit("Edit").alias("name"), F.try_parse_json(given).alias("input"))).alias("content")).alias("message")))
    kimi = F.to_json(F.struct(F.lit("context.append_loop_event").alias("type"), i.cast("string").alias("id"), session.alias("sessionId"), F.lit("/w/p").alias("cwd"), ts.alias("timestamp"), F.struct(F.lit("tool.call").alias("type"), F.lit("WriteFile").alias("name"), given.alias("args")).alias("event")))
    rows = t.events.select(F.concat_ws("-", session, "event_type").alias("path"), i.alias("n"), "event_type", F.when(F.col("event_type") == "click", claude).otherwise(kimi).alias("line"))
    made = [adapters.normalised({name: files.split_lines(_texts(rows.where(F.col("event_type") == kind).drop("event_type")), agent)}) for name, agent, kind in (("claude", "claude-code", "click"), ("kimi", "kimi-code", "view"))]
    found = adapters.edits(made[0].unionByName(made[1]))
    return found.groupBy("session_id", "path").agg(F.count("*").alias("changes"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
