"""Live state read from logs: transcript signals and turns, runtime sessions, paged account usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.timefn import instant, is_recent
from tracelode.operators.live import COMPLETED_WINDOW, LIVE_WINDOW
from tracelode.sources.adapters import first_of, get, millis

# Transcript messages that tell a state, with status and phase.
SIGNALS = {
    "task_started": ("running", "thinking"), "user_message": ("running", "thinking"), "agent_message": ("running", "working"), "agent_reasoning": ("running", "thinking"), "exec_command_begin": ("running", "using-tool"),
    "exec_approval_request": ("waiting", "needs-you"), "apply_patch_approval_request": ("waiting", "needs-you"), "request_user_input": ("waiting", "needs-you"),
    "task_complete": ("completed", "done"), "turn_aborted": ("completed", "aborted"), "error": ("error", "failed"),
}
OPENS, CLOSES = ("task_started",), ("task_complete", "turn_aborted")


def transcript_signals(bronze: DataFrame) -> DataFrame:
    """(path, ordinal, kind, status, phase, ts, mode): whitelisted messages only, with the collaboration mode carried along."""
    r = "record"
    kind = get(r, "$.payload.type")
    table = F.create_map(*[x for k, (s, p) in SIGNALS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("status"), F.lit(p).alias("phase")))])
    w = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    mode = F.last(F.when(get(r, "$.type") == "turn_context", first_of(r, "$.payload.collaboration_mode.mode", "$.payload.collaboration_mode")), ignorenulls=True).over(w)
    rows = bronze.where(~F.col("malformed")).select("path", "ordinal", kind.alias("kind"), instant(F.coalesce(get(r, "$.timestamp"), F.lit(""))).alias("ts"), mode.alias("mode"), (get(r, "$.type") == "event_msg").alias("m"))
    return rows.where(F.col("m") & F.col("kind").isin(*SIGNALS)).withColumn("s", F.try_element_at(table, F.col("kind"))).select("path", "ordinal", "kind", "s.status", "s.phase", "ts", "mode")


def auxiliary(bronze: DataFrame) -> DataFrame:
    """Paths of transcripts that another session began: reviewers and subagents, told by their metadata."""
    source = F.to_json(F.try_variant_get("record", "$.payload.source", "variant"))
    meta = bronze.where(F.try_variant_get("record", "$.type", "string") == "session_meta")
    return meta.where(F.coalesce(source, F.lit("")).rlike("subagent|review|guardian")).select("path").distinct()


def latest_signal(signals: DataFrame) -> DataFrame:
    """The last signal of each transcript in file order: the only one a poll shows."""
    rest = [c for c in signals.columns if c not in ("path", "ordinal")]
    return signals.groupBy("path").agg(F.max(F.struct("ordinal", *rest)).alias("s")).select("path", "s.*")


def open_turn(signals: DataFrame) -> DataFrame:
    """Per transcript whether its last boundary opens a turn, and since when."""
    bounds = signals.where(F.col("kind").isin(*OPENS, *CLOSES))
    last = F.max(F.struct("ordinal", F.col("kind").isin(*OPENS).alias("open"), "ts")).alias("b")
    return bounds.groupBy("path").agg(last).select("path", F.col("b.open").alias("open"), F.when(F.col("b.open"), F.col("b.ts")).alias("started_at"))


def _status(kind: Column, table: dict[str, str]) -> Column:
    out = F.lit(None)
    for k, s in table.items():
        out = F.when(kind == k, F.lit(s)).otherwise(out)
    return out


# What the last telling record of a runtime's log says.
KIMI = {"turn.prompt": "running", "permission.request": "waiting", "permission.required": "waiting", "turn.cancel": "completed", "end_turn": "completed", "turn.error": "error"}
DEEPSEEK = {"turn/start": "running", "approval/asked": "waiting", "approval/decided": "running", "completed": "completed", "max-tokens": "completed", "aborted": "completed", "error": "error", "blocked": "error"}


def runtime_sessions(bronze: DataFrame, agent: str, now: Column) -> DataFrame:
    """(path, agent, status, updated_at) of runtime logs: the last telling record, if it is recent enough to show."""
    r = "record"
    if agent == "kimi-code":
        kind = F.when(get(r, "$.event.type") == "step.end", get(r, "$.event.finishReason")).otherwise(get(r, "$.type"))
        status, at = _status(kind, KIMI), F.coalesce(get(r, "$.timestamp"), millis(get(r, "$.time", "bigint")))
    elif agent == "deepseek-harness":
        kind = F.when(get(r, "$.type") == "turn/end", get(r, "$.data.reason.kind")).otherwise(get(r, "$.type"))
        status, at = _status(kind, DEEPSEEK), millis(get(r, "$.time", "bigint"))
    else:
        raise ValueError(f"no runtime log of {agent!r}")
    rows = bronze.where(~F.col("malformed")).select("path", "ordinal", status.alias("status"), instant(at).alias("updated_at")).where(F.col("status").isNotNull())
    last = rows.groupBy("path").agg(F.max(F.struct("ordinal", "status", "updated_at")).alias("s")).select("path", F.lit(agent).alias("agent"), "s.status", "s.updated_at")
    return last.where(is_recent(F.col("updated_at"), now, F.when(F.col("status") == "completed", COMPLETED_WINDOW).otherwise(LIVE_WINDOW)))


def latest_turns(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with their latest turns, ties and all: running if a latest turn runs."""
    newest = turns.withColumn("__r", F.rank().over(Window.partitionBy("session_id").orderBy(F.desc_nulls_last("started_at")))).where("__r = 1")
    state = newest.groupBy("session_id").agg(F.bool_or(F.col("status") == "running").alias("running"), F.max("started_at").alias("started_at"), F.sum("tool_call_count").alias("tool_calls"))
    return sessions.join(state, sessions.id == state.session_id, "inner").drop("session_id").withColumn("status", F.when(F.col("running"), "running").otherwise("completed"))


def disappeared(known: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Sessions of a polled source that its latest poll no longer shows."""
    return known.join(found.select(key), key, "left_anti")


def account_pages(pages: DataFrame) -> DataFrame:
    """Events of paged account usage (page long, body string): each page's events without those that repeat the end of the page before.

    Only the numbers of pages are put in order; bodies meet by the number of the page before. An overlap can be so long only where
    the end of the page before begins with the page's first event, so few ends are compared as a whole.
    """
    events = F.from_json(F.get_json_object("body", "$.usageEventsDisplay"), "array<string>")
    numbers = pages.select("page").withColumn("before", F.lag("page").over(Window.orderBy("page")))
    parsed = pages.select("page", events.alias("e"))
    rows = parsed.join(numbers, "page").join(parsed.select(F.col("page").alias("before"), F.col("e").alias("b")), "before", "left")
    sizes = F.sequence(F.lit(0), F.least(F.size("e"), F.coalesce(F.size("b"), F.lit(0))))
    first = F.try_element_at("e", F.lit(1))
    fits = F.filter(sizes, lambda n: F.when(n == 0, True).when(F.try_element_at("b", F.size("b") - n + 1) == first, F.slice("b", F.size("b") - n + 1, n) == F.slice("e", F.lit(1), n)))
    fresh = F.when(F.col("b").isNull(), F.col("e")).otherwise(F.slice("e", F.array_max(fits) + 1, F.size("e") - F.array_max(fits)))
    return rows.select("page", F.posexplode(fresh).alias("position", "event"))
