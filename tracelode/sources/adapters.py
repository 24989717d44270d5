"""Session logs of each agent as one event model.

An adapter is a projection of bronze records (VARIANT) to the same columns: session, time, person or not, prompt and
result text, model, usage, and an array of event structs. `events`, `usage` and `prompts` then explode or order those
columns for all agents alike. Nothing depends on how records are spread: order comes from (path, ordinal).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.functions.hashing import event_fingerprint, stable_hash
from tracelode.functions.timefn import instant
from tracelode.operators.assembly import session_records
from tracelode.operators.sequence import replay_free, same_id_delta
from tracelode.sources.exec_wrapper import expanded

EVENT = "struct<event_type:string,name:string,command:string,success:boolean,duration_ms:bigint,source_event_id:string,detail:string>"
USAGE_FIELDS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens", "reasoning_tokens")
COLUMNS = ("path", "agent", "ordinal", "session_id", "cwd", "ts_raw", "human", "prompt", "result", "model", "usage", "message_id", "cumulative", "position", "events", "unknown")


def get(c: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(c) if isinstance(c, str) else c, path, kind)


def first_of(c: Column | str, *paths: str, kind: str = "string") -> Column:
    return F.coalesce(*[get(c, p, kind) for p in paths])


def items(c: Column | str, path: str) -> Column:
    return F.coalesce(get(c, path, "array<variant>"), F.array().cast("array<variant>"))


def message_text(c: Column | str, path: str) -> Column:
    """A message's text: the string itself, or the first text item of its parts."""
    parts = get(c, path, "array<variant>")
    texts = F.filter(F.transform(parts, lambda x: F.coalesce(get(x, "$.text"), F.when(get(x, "$.type").isNull(), get(x, "$")))), lambda x: x.isNotNull())
    return F.when(parts.isNotNull(), F.try_element_at(texts, F.lit(1))).otherwise(get(c, path))


def event(kind: str | Column, name: str | Column | None = None, command: Column | None = None, success: Column | bool | None = None, duration: Column | None = None, source_id: Column | None = None, detail: Column | None = None) -> Column:
    as_col = lambda x: F.lit(x) if x is None or isinstance(x, (str, bool)) else x
    fields = (("event_type", kind, "string"), ("name", name, "string"), ("command", command, "string"), ("success", success, "boolean"), ("duration_ms", duration, "bigint"), ("source_event_id", source_id, "string"), ("detail", detail, "string"))
    return F.struct(*[as_col(v).cast(t).alias(n) for n, v, t in fields])


def only(*branches: tuple[Column, Column]) -> Column:
    """An array of the events whose conditions hold."""
    return F.array_compact(F.array(*[F.when(cond, e) for cond, e in branches])).cast(f"array<{EVENT}>")


def many(c: Column, make) -> Column:
    return F.transform(c, make).cast(f"array<{EVENT}>")


def usage_struct(**fields: Column) -> Column:
    return F.struct(*[F.coalesce(fields.get(n, F.lit(None)), F.lit(0)).cast("bigint").alias(n) for n in USAGE_FIELDS])


def _row(df: DataFrame, **given: Column) -> DataFrame:
    empty = {
        "session_id": F.lit(None).cast("string"), "cwd": F.lit(None).cast("string"), "ts_raw": F.lit(None).cast("string"), "human": F.lit(False), "prompt": F.lit(None).cast("string"), "result": F.lit(None).cast("string"),
        "model": F.lit(None).cast("string"), "usage": F.lit(None).cast("struct<" + ",".join(f"{n}:bigint" for n in USAGE_FIELDS) + ">"), "message_id": F.lit(None).cast("string"), "cumulative": F.lit("none"),
        "position": F.lit(None).cast("bigint"), "events": F.array().cast(f"array<{EVENT}>"), "unknown": F.lit(False),
    }
    given = {k: F.coalesce(v, F.lit(False)) if k in ("human", "unknown") else v for k, v in given.items()}
    return df.where(~F.col("malformed")).select("path", "agent", "ordinal", *[(given.get(n, d)).alias(n) for n, d in empty.items()])


def command_of(c: Column) -> Column:
    """The shell command in a tool's arguments, given as an object or as its text."""
    inner = F.try_parse_json(get(c, "$"))
    return F.coalesce(first_of(c, "$.cmd", "$.command"), first_of(inner, "$.cmd", "$.command"))


def millis(c: Column) -> Column:
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def once(records: DataFrame, *ids: str) -> DataFrame:
    """Bronze records without later copies in the same file: by kind and id, else by their whole text."""
    ident = F.coalesce(*[get("record", p) for p in ids]) if ids else F.lit(None).cast("string")
    receipt = stable_hash(F.coalesce(F.when(ident.isNotNull(), F.concat_ws(":", get("record", "$.type"), ident)), F.to_json("record")))
    first = F.row_number().over(Window.partitionBy("path", "__r").orderBy("ordinal"))
    return records.withColumn("__r", receipt).withColumn("__n", first).where("__n = 1").drop("__r", "__n")


def claude(b: DataFrame) -> DataFrame:
    r = "record"
    kind, content = get(r, "$.type"), items(r, "$.message.content")
    results = F.filter(content, lambda x: get(x, "$.type") == "tool_result")
    only_results = (F.size(content) > 0) & (F.size(results) == F.size(content))
    human = (kind == "user") & (get(r, "$.message.role") == "user") & ~only_results
    hour = F.coalesce(get(r, "$.message.usage.cache_creation.ephemeral_1h_input_tokens", "bigint"), F.lit(0))
    u = lambda n: F.coalesce(get(r, f"$.message.usage.{n}", "bigint"), F.lit(0))
    usage = usage_struct(input_tokens=u("input_tokens"), output_tokens=u("output_tokens"), cache_read_tokens=u("cache_read_input_tokens"), cache_write_tokens=F.greatest(u("cache_creation_input_tokens") - hour, F.lit(0)), cache_write_1h_tokens=hour)
    sub = get(r, "$.subtype")
    duration = F.coalesce(get(r, "$.durationMs", "bigint"), get(r, "$.duration_ms", "bigint"))
    events = F.concat(
        F.when(kind == "user", many(results, lambda x: event("tool-result", success=~F.coalesce(get(x, "$.is_error", "boolean"), F.lit(False))))).otherwise(only()),
        F.when(kind == "assistant", many(F.filter(content, lambda x: get(x, "$.type") == "tool_use"), lambda x: event("tool", F.coalesce(get(x, "$.name"), F.lit("other")), command_of(get(x, "$.input", "variant")), source_id=get(x, "$.id"), detail=F.to_json(get(x, "$.input", "variant"))))).otherwise(only()),
        only(
            ((kind == "system") & (sub == "compact_boundary"), event("compaction")), ((kind == "system") & (sub == "turn_duration") & duration.isNotNull(), event("complete", duration=duration, success=True)),
            ((kind == "system") & sub.isin("api_error", "error"), event("error", success=False)), ((kind == "system") & (sub == "retry"), event("retry")),
        ),
    )
    return _row(
        b, session_id=get(r, "$.sessionId"), cwd=get(r, "$.cwd"), ts_raw=get(r, "$.timestamp"), human=human, prompt=F.when(kind == "user", message_text(r, "$.message.content")), result=F.when(kind == "assistant", message_text(r, "$.message.content")),
        model=F.when(kind == "assistant", get(r, "$.message.model")), usage=F.when((kind == "assistant") & get(r, "$.message.usage", "variant").isNotNull(), usage), message_id=F.when(kind == "assistant", F.coalesce(get(r, "$.message.id"), F.lit(""))), cumulative=F.lit("by-id"), events=events,
        unknown=~F.coalesce(kind, F.lit("unknown")).isin("user", "assistant", "system", "file-history-snapshot", "last-prompt"),
    )


def codex(b: DataFrame) -> DataFrame:
    r = "record"
    kind, sub = get(r, "$.type"), get(r, "$.payload.type")
    p = lambda n, t="string": get(r, f"$.payload.{n}", t)
    msg, item = kind == "event_msg", kind == "response_item"
    is_ = lambda where, *names: where & F.coalesce(sub, F.lit("")).isin(*names)
    total = lambda n: F.coalesce(p(f"info.total_token_usage.{n}", "bigint"), F.lit(0))
    usage = usage_struct(input_tokens=F.greatest(total("input_tokens") - total("cached_input_tokens"), F.lit(0)), output_tokens=total("output_tokens"), cache_read_tokens=total("cached_input_tokens"), reasoning_tokens=total("reasoning_output_tokens"))
    raw = F.coalesce(p("input"), p("arguments"))
    inner = F.try_parse_json(raw)
    patch = F.coalesce(get(inner, "$.patch"), get(inner, "$.input"), raw)
    name = F.coalesce(p("name"), F.lit("other"))
    call_id = F.coalesce(p("call_id"), p("id"))
    patching = F.contains(name, F.lit("apply_patch"))
    success = F.coalesce(p("success", "boolean"), get(F.try_parse_json(p("output")), "$.success", "boolean"), get(F.try_parse_json(p("output")), "$.metadata.exit_code", "bigint") == 0)
    duration = F.coalesce(p("duration_ms", "bigint"), (get(F.try_parse_json(p("output")), "$.metadata.duration_seconds", "double") * 1000).cast("bigint"))
    events = only(
        (kind == "compacted", event("compaction")), (is_(msg, "context_compacted"), event("compaction")), (is_(msg, "task_started"), event("start")), (is_(msg, "task_complete"), event("complete", success=True, duration=p("duration_ms", "bigint"))),
        (is_(msg, "turn_aborted"), event("abort")), (is_(msg, "thread_rolled_back"), event("rollback")), (is_(msg, "thread_goal_updated"), event("goal-change")), (is_(msg, "sub_agent_activity"), event("subagent", F.coalesce(p("kind"), F.lit("unknown")))),
        (is_(msg, "mcp_tool_call_end"), event("tool-result", success=~F.coalesce(p("result.is_error", "boolean"), p("result.isError", "boolean"), F.lit(False)), duration=p("duration", "bigint"))), (is_(msg, "web_search_end"), event("tool", "web_search")),
        (is_(msg, "error"), event("error", success=False)), (is_(msg, "retry"), event("retry")), (is_(msg, "patch_apply_end"), event("patch-result", success=F.coalesce(p("success", "boolean"), F.lit(False)), detail=F.to_json(p("changes", "variant")))),
        (is_(item, "custom_tool_call", "function_call"), event("tool", name, F.when(~patching, F.coalesce(get(inner, "$.cmd"), get(inner, "$.command"))), source_id=call_id, detail=F.when(patching, patch).otherwise(raw))),
        (is_(item, "custom_tool_call_output", "function_call_output") & success.isNotNull(), event("tool-result", success=success, duration=duration)), (is_(item, "agent_message"), event("subagent", "interacted")),
    )
    known_msg = ("user_message", "token_count", "agent_message", "context_compacted", "task_started", "task_complete", "turn_aborted", "thread_rolled_back", "thread_goal_updated", "sub_agent_activity", "mcp_tool_call_end", "web_search_end", "agent_reasoning", "thread_settings_applied", "item_completed", "image_generation_end", "error", "retry", "patch_apply_end")
    known_item = ("custom_tool_call", "function_call", "custom_tool_call_output", "function_call_output", "agent_message", "message", "reasoning", "web_search_call")
    unknown = ~F.coalesce(kind, F.lit("unknown")).isin("session_meta", "turn_context", "event_msg", "response_item", "compacted") | (msg & ~F.coalesce(sub, F.lit("")).isin(*known_msg)) | (item & ~F.coalesce(sub, F.lit("")).isin(*known_item))
    said = F.coalesce(message_text(r, "$.payload.message"), message_text(r, "$.payload.text"))
    given = dict(
        session_id=F.when(kind == "session_meta", F.nullif(p("id"), F.lit(""))), cwd=F.when(kind.isin("session_meta", "turn_context"), p("cwd")), ts_raw=get(r, "$.timestamp"), human=is_(msg, "user_message"),
        prompt=F.when(is_(msg, "user_message"), said), result=F.when(is_(msg, "agent_message"), said).when(is_(item, "message") & (p("role") == "assistant"), message_text(r, "$.payload.content")), model=F.when(kind == "turn_context", p("model")),
        usage=F.when(is_(msg, "token_count") & p("info.total_token_usage", "variant").isNotNull(), usage), cumulative=F.lit("total"), events=events, unknown=unknown,
    )
    # Told by the record, so that other rows' events are made once and not for a test of them.
    wraps = F.coalesce(p("name") == "exec", F.lit(False))
    return _row(b.where(~wraps), **given).withColumn("parallel", F.lit(False)).unionByName(expanded(_row(b.where(wraps), **given), EVENT))


def cursor(b: DataFrame) -> DataFrame:
    """Transcripts without times: a session's anchor is its file's, given by the listing."""
    r = "record"
    content = items(r, "$.message.content")
    tools = F.filter(content, lambda x: get(x, "$.type").isin("tool_use", "tool_call", "tool-call"))
    results = F.filter(content, lambda x: get(x, "$.type").isin("tool_result", "tool-result"))
    human = (get(r, "$.role") == "user") & ((F.size(content) == 0) | (F.size(results) < F.size(content)))
    calls = many(tools, lambda x: event("tool", F.coalesce(first_of(x, "$.name", "$.tool_name"), F.lit("tool")), command_of(F.coalesce(get(x, "$.input", "variant"), get(x, "$.arguments", "variant"))), source_id=get(x, "$.id")))
    return _row(b, human=human, prompt=F.when(human, message_text(r, "$.message.content")), result=F.when(get(r, "$.role") == "assistant", message_text(r, "$.message.content")), events=calls, unknown=get(r, "$.role").isNull())


def deepseek(b: DataFrame) -> DataFrame:
    r = "record"
    header = get(r, "$.version", "variant").isNotNull() & get(r, "$.id", "variant").isNotNull()
    kind, reason = get(r, "$.type"), get(r, "$.data.reason.kind")
    d = lambda n, t="string": get(r, f"$.data.{n}", t)
    human = (kind == "user/message") & (d("source.kind") == "user")
    u = lambda n: d(f"usage.{n}", "bigint")
    usage = usage_struct(input_tokens=u("inputTokens"), output_tokens=u("outputTokens"), cache_read_tokens=u("cacheReadTokens"), cache_write_tokens=u("cacheWriteTokens"), cache_write_1h_tokens=u("cacheWrite1hTokens"), reasoning_tokens=u("reasoningTokens"))
    seq = get(r, "$.seq", "bigint").cast("string")
    failed = (kind == "turn/end") & reason.isin("error", "blocked")
    error = d("error", "variant")
    events = only(
        (kind == "turn/start", event("start")), ((kind == "turn/end") & reason.isin("completed", "max-tokens"), event("complete", success=True)), (failed, event("error", success=False)),
        (failed | ((kind == "turn/end") & (reason == "aborted")), event("abort")), (kind == "tool/call", event("tool", F.coalesce(d("name"), F.lit("tool")), command_of(d("arguments", "variant")), source_id=seq, detail=d("arguments"))),
        (kind == "tool/result", event("tool-result", success=error.isNull() | F.is_variant_null(error))), (kind == "approval/asked", event("waiting", "approval", source_id=seq)), (kind == "compaction/start", event("compaction")),
        (kind.isin("subagent/descriptor", "tool-workflow/agent-start"), event("subagent", "started")), (kind == "tool-workflow/agent-end", event("subagent", "interacted")),
    )
    families = "session/|request/|user/|assistant/|turn/|tool/|approval/|compaction/|subagent/|tool-workflow/|step/|command/|todo/|agent/|permission/|sandbox/|agent-preset/|reasoning-chunks|text-chunks|tool-call-chunks"
    return _row(
        b, session_id=F.when(header, get(r, "$.id")), cwd=F.when(header, get(r, "$.cwd")), ts_raw=millis(F.when(header, get(r, "$.createdAt", "bigint")).otherwise(get(r, "$.time", "bigint"))), human=human,
        prompt=F.when(human, message_text(r, "$.data.content")), result=F.when(kind == "assistant/message", message_text(r, "$.data.message.content")), model=F.when(kind == "request/context", d("model")),
        usage=F.when((kind == "assistant/message") & d("usage", "variant").isNotNull(), usage), events=F.when(header, only()).otherwise(events), unknown=~header & ~F.coalesce(kind, F.lit("")).rlike(f"^(?:{families})"),
    )


def kimi(b: DataFrame) -> DataFrame:
    r = "record"
    kind, inner = get(r, "$.type"), get(r, "$.event.type")
    loop = kind == "context.append_loop_event"
    model, provider = F.nullif(F.trim(get(r, "$.model")), F.lit("")), F.nullif(F.trim(get(r, "$.provider")), F.lit(""))
    u = lambda n: get(r, f"$.usage.{n}", "bigint")
    usage = usage_struct(input_tokens=u("inputOther"), output_tokens=u("output"), cache_read_tokens=u("inputCacheRead"), cache_write_tokens=u("inputCacheCreation"))
    events = only(
        (kind == "turn.prompt", event("start")), (loop & (inner == "tool.call"), event("tool", F.coalesce(get(r, "$.event.name"), F.lit("other")), command_of(get(r, "$.event.args", "variant")), source_id=first_of(r, "$.event.id", "$.event.toolCallId", "$.id"), detail=F.to_json(get(r, "$.event.args", "variant")))),
        (loop & (inner == "tool.result"), event("tool-result", success=~F.coalesce(first_of(r, "$.event.result.isError", "$.event.result.is_error", kind="boolean"), F.lit(False)))),
        (loop & (inner == "step.end") & (get(r, "$.event.finishReason") == "end_turn"), event("complete", success=True)), (kind == "turn.steer", event("goal-change")), (kind == "turn.cancel", event("abort")),
        (kind.isin("full_compaction.begin", "context.apply_compaction"), event("compaction")),
    )
    user = (kind == "context.append_message") & (F.coalesce(get(r, "$.message.role"), get(r, "$.role")) == "user")
    known = "usage\\.record|turn\\.|context\\.|llm\\.|full_compaction\\.|metadata|config\\.|tools\\.|permission\\."
    return _row(
        once(b, "$.id", "$.uuid"), session_id=first_of(r, "$.sessionId", "$.session_id"), cwd=first_of(r, "$.workspacePath", "$.cwd", "$.workdir"), ts_raw=F.coalesce(get(r, "$.timestamp"), millis(get(r, "$.time", "bigint"))), human=kind == "turn.prompt",
        prompt=F.when(kind == "turn.prompt", F.coalesce(message_text(r, "$.prompt"), message_text(r, "$.message"), message_text(r, "$.content"))).when(user, message_text(r, "$.message.content")),
        result=F.when(loop & (inner == "content.part") & (get(r, "$.event.part.type") == "text"), get(r, "$.event.part.text")), model=F.when(kind == "usage.record", F.when(F.contains(model, F.lit("/")) | provider.isNull(), model).otherwise(F.concat_ws("/", provider, model))),
        usage=F.when((kind == "usage.record") & get(r, "$.usage", "variant").isNotNull(), usage), events=events, unknown=~F.coalesce(kind, F.lit("unknown")).rlike(f"^(?:{known})"),
    )


def openclaw(b: DataFrame) -> DataFrame:
    r = "record"
    kind = F.coalesce(first_of(r, "$.type", "$.event"), F.lit("unknown"))
    role = first_of(r, "$.message.role", "$.role")
    said = F.coalesce(message_text(r, "$.message.content"), message_text(r, "$.content"))
    u = lambda a, c: first_of(r, f"$.usage.{a}", f"$.usage.{c}", kind="bigint")
    usage = usage_struct(input_tokens=u("input_tokens", "input"), output_tokens=u("output_tokens", "output"), cache_read_tokens=u("cache_read_tokens", "cache_read"), cache_write_tokens=u("cache_write_tokens", "cache_write"), reasoning_tokens=u("reasoning_tokens", "reasoning"))
    tool, done = F.contains(kind, F.lit("tool")), kind.rlike("result|output")
    failed = get(r, "$.error", "variant").isNotNull() | F.coalesce(get(r, "$.isError", "boolean"), F.lit(False))
    events = only((tool & done, event("tool-result", success=~failed, duration=get(r, "$.duration_ms", "bigint"))), (tool & ~done, event("tool", F.coalesce(first_of(r, "$.name", "$.tool_name"), F.lit("tool")), command_of(get(r, "$.arguments", "variant")), source_id=get(r, "$.id"), detail=F.to_json(get(r, "$.arguments", "variant")))))
    return _row(
        once(b, "$.id"), session_id=first_of(r, "$.sessionId", "$.session_id"), cwd=first_of(r, "$.cwd", "$.workdir"), ts_raw=F.coalesce(get(r, "$.timestamp"), millis(first_of(r, "$.created_at", "$.time", kind="bigint"))), human=role == "user",
        prompt=F.when(role == "user", said), result=F.when(role == "assistant", said), model=first_of(r, "$.model", "$.message.model"), usage=F.when(get(r, "$.usage", "variant").isNotNull(), usage), events=events,
    )


def zcode(b: DataFrame) -> DataFrame:
    """Model-io records: prompts are cumulative requests' last user messages, without replays."""
    r = "record"
    messages = items(r, "$.request.messages")
    users = F.filter(F.transform(messages, lambda x, i: F.struct(i.cast("bigint").alias("i"), x.alias("m"))), lambda x: get(x["m"], "$.role") == "user")
    last = F.try_element_at(users, F.lit(-1))
    said = message_text(last["m"], "$.content")
    source = get(r, "$.querySource")
    asking = source.isNull() | (source == "main_turn")
    u = lambda *n: F.coalesce(*[get(r, f"$.{w}.{x}", "bigint") for w in ("response.usage", "usage") for x in n])
    known = usage_struct(input_tokens=u("inputTokens", "input_tokens", "promptTokens"), output_tokens=u("outputTokens", "output_tokens", "completionTokens"), cache_read_tokens=u("cacheReadTokens", "cachedInputTokens", "cache_read_tokens"), cache_write_tokens=u("cacheWriteTokens", "cache_write_tokens"), reasoning_tokens=u("reasoningTokens", "reasoning_tokens"))
    whole = u("totalTokens", "total_tokens")
    none = (known["input_tokens"] + known["output_tokens"] + known["cache_read_tokens"] + known["cache_write_tokens"]) == 0
    usage = F.when(none & whole.isNotNull(), usage_struct(input_tokens=whole)).otherwise(known)
    has = get(r, "$.response.usage", "variant").isNotNull() | get(r, "$.usage", "variant").isNotNull()
    ident = F.coalesce(get(r, "$.id"), stable_hash(F.to_json(r)))
    calls = F.transform(items(r, "$.response.toolCalls"), lambda x, i: event("tool", F.coalesce(first_of(x, "$.name", "$.toolName"), F.lit("tool")), command_of(get(x, "$.input", "variant")), source_id=F.coalesce(get(x, "$.id"), stable_hash(F.concat_ws("|", ident, F.lit("tool"), i.cast("string"))))))
    events = F.concat(only((source == "compact", event("compaction")), (source == "subagent", event("subagent", "interacted")), (get(r, "$.error", "variant").isNotNull(), event("error", success=False))), calls.cast(f"array<{EVENT}>"))
    rows = _row(
        once(b, "$.id"), session_id=get(r, "$.sessionId"), cwd=first_of(r, "$.workspacePath", "$.cwd"), ts_raw=F.coalesce(first_of(r, "$.startedAt", "$.timestamp"), millis(first_of(r, "$.startedAt", "$.time", kind="bigint"))), human=asking & (F.trim(said) != ""),
        prompt=F.when(asking, said), result=first_of(r, "$.response.text", "$.response.reasoningText"), model=first_of(r, "$.model.modelId", "$.model.model", "$.modelId"), usage=F.when(has, usage), position=F.when(get(last["m"], "$.cacheControl", "variant").isNotNull(), last["i"]), events=events,
        unknown=F.coalesce(get(r, "$.type"), F.lit("")) != "model_io",
    )
    fingerprint = F.when(F.col("human"), stable_hash(F.trim("prompt")))
    asked = replay_free(rows.where("human").withColumn("__f", fingerprint), ["path"], ["ordinal"], "__f", "position").select("path", "ordinal").withColumn("__new", F.lit(True))
    return rows.join(asked, ["path", "ordinal"], "left").withColumn("human", F.coalesce("__new", F.lit(False))).withColumn("prompt", F.when(F.col("human"), F.col("prompt"))).drop("__new").select(*COLUMNS)


def zcode_snapshot(b: DataFrame) -> DataFrame:
    """Whole-file snapshots: their meta and messages as records in order."""
    r = "record"
    parts = b.where(~F.col("malformed")).select("path", "agent", get(r, "$.meta.taskId").alias("task"), get(r, "$.meta.sessionId").alias("sid"), get(r, "$.meta.workspacePath").alias("ws"), get(r, "$.meta.model").alias("mm"), F.posexplode(items(r, "$.messages")).alias("ordinal", "record"), F.lit(False).alias("malformed"))
    m = _row(
        parts, session_id=F.coalesce("task", "sid"), cwd=F.col("ws"), ts_raw=F.coalesce(get(r, "$.timestamp"), millis(first_of(r, "$.timestamp", "$.createdAt", kind="bigint"))), human=get(r, "$.role") == "user",
        prompt=F.when(get(r, "$.role") == "user", message_text(r, "$.content")), result=F.when(get(r, "$.role") == "assistant", message_text(r, "$.content")), model=F.coalesce(get(r, "$.model"), F.col("mm")),
    )
    return m.withColumn("ordinal", F.col("ordinal").cast("bigint"))


ADAPTERS = {"claude": claude, "codex": codex, "cursor": cursor, "deepseek": deepseek, "kimi": kimi, "openclaw": openclaw, "zcode-model-io": zcode, "zcode": zcode_snapshot}


def normalised(bronze: dict[str, DataFrame]) -> DataFrame:
    """All agents' records in the common columns, with session and model carried along each file."""
    made = [ADAPTERS[name](df) for name, df in bronze.items()]
    rows = reduce(DataFrame.unionByName, [df if "parallel" in df.columns else df.withColumn("parallel", F.lit(False)) for df in made])
    w = Window.partitionBy("path").orderBy("ordinal")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.when(F.col("agent").isin("codex", "deepseek-harness", "cursor"), F.first("session_id", ignorenulls=True).over(whole)).otherwise(F.last("session_id", ignorenulls=True).over(whole))
    seen = F.when(tx.real_model(F.col("model")), F.trim("model"))
    return rows.withColumn("session_id", F.coalesce(own, stable_hash(F.col("path")))).withColumn("observed_model", seen).withColumn("model", F.last(seen, ignorenulls=True).over(upto)).withColumn("ts", instant(F.col("ts_raw")))


def usage(rows: DataFrame) -> DataFrame:
    """Usage increments: running totals and repeated message ids as differences; rows without tokens go."""
    u = rows.where(F.col("usage").isNotNull()).select("path", "agent", "ordinal", "session_id", "ts_raw", "ts", "model", "message_id", "cumulative", *[F.col(f"usage.{n}").alias(n) for n in USAGE_FIELDS])
    w = Window.partitionBy("path").orderBy("ordinal")
    delta = same_id_delta(u, ["path"], ["ordinal"], "message_id", list(USAGE_FIELDS))
    pick = lambda n: F.when(F.col("cumulative") == "by-id", F.col(f"{n}_delta")).when(F.col("cumulative") == "total", F.greatest(F.col(n) - F.lag(n, 1, 0).over(w), F.lit(0))).otherwise(F.col(n))
    out = delta.withColumns({f"{n}_d": pick(n) for n in USAGE_FIELDS}).select("path", "agent", "ordinal", "session_id", "ts_raw", "ts", "model", *[F.col(f"{n}_d").alias(n) for n in USAGE_FIELDS])
    return out.where(sum((F.col(n) for n in USAGE_FIELDS[:5]), F.lit(0)) > 0)


def events(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Canonical events: one a tool call (once an id), result or lifecycle change, with category, sequence and fingerprint; all of a session, or its first `limit`."""
    e = rows.select("path", "agent", "ordinal", "session_id", "ts_raw", "ts", "model", F.posexplode("events").alias("i", "e")).select("path", "agent", "ordinal", "i", "session_id", "ts_raw", "ts", "model", "e.*")
    first = F.row_number().over(Window.partitionBy("session_id", "event_type", "source_event_id").orderBy("path", "ordinal", "i"))
    e = e.withColumn("__n", F.when(F.col("source_event_id").isNotNull() & (F.col("event_type") == "tool"), first).otherwise(1)).where("__n = 1").drop("__n")
    category = F.when(F.col("event_type") == "tool", tx.event_category(F.col("name"), F.col("command"))).otherwise(F.col("event_type"))
    w = Window.partitionBy("session_id").orderBy("path", "ordinal", "i")
    e = e.withColumn("category", category).withColumn("name", tx.tool_name(F.coalesce("name", "category"))).withColumn("provenance", F.lit("observed"))
    e = e.withColumn("base", event_fingerprint(F.col("event_type"), F.col("category"), F.col("name"), F.col("success"), F.col("duration_ms"), F.col("ts"), F.col("provenance")))
    again = F.row_number().over(Window.partitionBy("session_id", "event_type", "category", "name", "success", "duration_ms", "ts_raw").orderBy("path", "ordinal", "i")) - 1
    e = e.withColumn("__a", again).withColumn("fingerprint", F.when(F.col("__a") == 0, F.col("base")).otherwise(stable_hash(F.concat_ws("|", "base", F.col("__a").cast("string")))))
    e = e.withColumn("sequence", F.row_number().over(w)).drop("__a", "base", "i", "command")
    return e if limit is None else e.where(F.col("sequence") <= limit)


def sessions(rows: DataFrame, structure: bool = True, committed: DataFrame | None = None) -> DataFrame:
    """Session records of normalised rows, ready for the ledger and the profile.

    The rows are read by several branches: give a written table (or a persisted one), so that logs are parsed once.
    """
    every = events(rows)
    return session_records(rows, every, prompts(rows), usage(rows), patches(rows).unionByName(edits(rows)), structure=structure, committed=committed)


def prompts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("human") & tx.prompt_eligible(F.coalesce("prompt", F.lit("")))).select("path", "agent", "ordinal", "session_id", "ts_raw", "ts", "prompt")


def edits(rows: DataFrame) -> DataFrame:
    """File changes that edit tools of any agent name in their arguments: the file, and lines of the new and the old text.

    A path becomes one inside the project, of the record's folder or the session's first one; those that climb out or hold a secret go.
    """
    first = F.first("cwd", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("path", "ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = rows.select("session_id", "ordinal", "ts", "events", "path", F.coalesce("cwd", first).alias("cwd")).select("session_id", "ordinal", "ts", "cwd", F.explode("events").alias("e"))
    tool = (F.col("e.event_type") == "tool") & (tx.tool_category(F.coalesce("e.name", F.lit(""))) == "edit")
    given = e.where(tool).withColumn("j", F.try_parse_json("e.detail")).where(F.col("j").isNotNull())
    # Arguments may be an object or its text.
    given = given.withColumn("j", F.coalesce(F.try_parse_json(get("j", "$")), F.col("j")))
    lines = lambda *paths: F.coalesce(tx.line_count(first_of("j", *paths)), F.lit(0))
    path = tx.project_path(F.coalesce("cwd", F.lit("")), first_of("j", "$.file_path", "$.path", "$.filePath"))
    out = given.select("session_id", "ordinal", "ts", path.alias("path"), F.lit("modified").alias("kind"), lines("$.new_string", "$.content").alias("added"), lines("$.old_string").alias("removed"))
    return out.where(F.col("path").isNotNull())


def patches(rows: DataFrame) -> DataFrame:
    """File changes of codex sessions: requests count only where the session has no patch result; failed results change nothing."""
    e = rows.select("session_id", "path", "ordinal", "ts", F.explode("events").alias("e")).select("session_id", "path", "ordinal", "ts", "e.*")
    results = e.where(F.col("event_type") == "patch-result")
    changed = results.where("success").select("session_id", "ordinal", "ts", F.explode(F.from_json("detail", "map<string,struct<type:string,move_path:string,unified_diff:string,content:string>>")).alias("file", "c"))
    lines = lambda c: F.when(c.isNull() | (c == ""), 0).otherwise(F.size(F.split(F.regexp_replace(c, "\n$", ""), "\n"))).cast("long")
    diff = tx.diff_counts(F.col("c.unified_diff"))
    from_results = changed.select(
        "session_id", "ordinal", "ts", F.coalesce("c.move_path", "file").alias("path"), F.when(F.col("c.type") == "add", "added").when(F.col("c.type") == "delete", "deleted").otherwise("modified").alias("kind"),
        F.when(F.col("c.type") == "add", lines(F.col("c.content"))).otherwise(F.coalesce(diff["added"], F.lit(0))).alias("added"), F.when(F.col("c.type") == "delete", lines(F.col("c.content"))).otherwise(F.coalesce(diff["removed"], F.lit(0))).alias("removed"),
    )
    wanted = e.where((F.col("event_type") == "tool") & F.contains("name", F.lit("apply_patch"))).join(results.select("session_id").distinct(), "session_id", "left_anti")
    line = wanted.select("session_id", "ordinal", "ts", F.posexplode(F.split("detail", "\n")).alias("i", "line"))
    head = F.regexp_extract("line", r"^\*\*\* (Add|Update|Delete) File: (.+)$", 2)
    kind = F.regexp_extract("line", r"^\*\*\* (Add|Update|Delete) File: ", 1)
    w = Window.partitionBy("session_id", "ordinal").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("path", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(w)).withColumn("k", F.last(F.nullif(kind, F.lit("")), ignorenulls=True).over(w)).where(F.col("path").isNotNull())
    plus = F.startswith("line", F.lit("+")) & ~F.startswith("line", F.lit("+++"))
    minus = F.startswith("line", F.lit("-")) & ~F.startswith("line", F.lit("---"))
    from_requests = line.groupBy("session_id", "ordinal", "ts", "path", "k").agg(F.count_if(plus).alias("added"), F.count_if(minus).alias("removed")).select("session_id", "ordinal", "ts", "path", F.when(F.col("k") == "Add", "added").when(F.col("k") == "Delete", "deleted").otherwise("modified").alias("kind"), "added", "removed")
    return from_results.unionByName(from_requests)
