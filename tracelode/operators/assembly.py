"""Session records out of log rows: one row a session with the counters that the ledger and the profile read.

All counters of a session are sums over rows of four kinds (prompts, events, changed files, usage). The rows are brought
to the same narrow columns, so that one aggregation with partial sums counts them all in one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.functions.timefn import local_date
from tracelode.operators import sequence
from tracelode.operators.pricing import priced, token_total
from tracelode.operators.usage import file_changes

ORDER = ["path", "ordinal"]
#: Tool categories with a counter of their own, by the counter's name.
CATEGORY_COUNTERS = {f"{c.replace('-', '_')}_events": c for c in ("test", "build", "lint", "typecheck", "git-review", "read", "search", "edit", "shell", "deploy", "dependency", "preview")}
#: Lifecycle events with a counter of their own, by the counter's name.
LIFECYCLE_COUNTERS = {"task_starts": "start", "task_completions": "complete", "task_aborts": "abort", "goal_changes": "goal-change", "context_compactions": "compaction", "rollbacks": "rollback"}
FILE_COUNTERS = {"document_events": "document", "style_events": "style", "test_file_events": "test", "infrastructure_events": "infrastructure", "automation_events": "automation", "instruction_file_events": "instruction"}


def prompt_counters(prompt: Column, structure: bool = True) -> dict[str, Column]:
    """What a person's prompt adds; without leave to look at its structure only that there is one."""
    one = {"prompt_count": F.lit(1)}
    if structure:
        said = F.trim(prompt)
        one |= {"prompt_characters": F.length(said), "structured_prompts": tx.structured_prompt(said), "acceptance_criteria_prompts": tx.mentions(said, tx.ACCEPTANCE_WORDS), "file_scope_prompts": tx.mentions(said, tx.SCOPE_WORDS)}
    return one


def event_counters() -> dict[str, Column]:
    """What an event adds, by its type, category, name, success and duration."""
    kind, category, name = F.col("event_type"), F.col("category"), F.col("name")
    tool, result, sub = kind == "tool", kind == "tool-result", kind == "subagent"
    failed = result & ~F.coalesce("success", F.lit(True))
    return {
        "tool_calls": tool, "plan_events": tool & tx.is_plan_tool(name), "verification_events": tool & category.isin(*tx.VERIFYING),
        **{n: tool & (category == c) for n, c in CATEGORY_COUNTERS.items()}, **{n: kind == c for n, c in LIFECYCLE_COUNTERS.items()},
        "subagent_count": (tool & (category == "subagent")) | (sub & (name == "started")), "subagent_starts": sub & (name == "started"), "subagent_interactions": sub & (name == "interacted"), "subagent_interruptions": sub & (name == "interrupted"),
        "successful_tools": result & F.coalesce("success", F.lit(False)), "failed_tools": failed, "errors": failed | (kind == "error"),
        "tool_duration_ms": F.when(result, F.col("duration_ms")), "completed_task_duration_ms": F.when(kind == "complete", F.col("duration_ms")),
    }


def _part(rows: DataFrame, keys: list[str], counters: dict[str, Column]) -> DataFrame:
    return rows.select(*keys, *[c.cast("long").alias(n) for n, c in counters.items()])


def _summed(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sums of every counter by keys; a counter that no row of a key has is 0."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns if c not in keys])


def signals(rows: DataFrame, events: DataFrame, prompts: DataFrame, usage: DataFrame, changes: DataFrame, key: str = "session_id", structure: bool = True) -> DataFrame:
    """Every counter of each session: prompts, tools, results, lifecycle, subagents, files, tokens.

    events must hold all events of a session, not only those that the replay shows. A file counts once as touched and
    at each change for its labels.
    """
    files = file_changes(changes, [key])
    labels = tx.file_kinds(F.col("path"))
    parts = [
        _part(rows, [key], {"human_interventions": F.coalesce("human", F.lit(False)), "parallel_batches": F.coalesce("parallel", F.lit(False))}), _part(prompts, [key], prompt_counters(F.col("prompt"), structure)), _part(events, [key], event_counters()),
        _part(files, [key], {"files_touched": F.lit(1), "lines_changed": F.col("added") + F.col("removed"), **{n: F.when(labels[c], F.col("changes")) for n, c in FILE_COUNTERS.items()}}),
        _part(usage, [key], {"total_tokens": token_total(), "cache_read_tokens": F.col("cache_read_tokens")}),
    ]
    return _summed(parts, [key])


def session_days(rows: DataFrame, events: DataFrame, usage: DataFrame, key: str = "session_id", tz: str = "UTC") -> DataFrame:
    """(session, date): active seconds by the day they begin on, tool calls, errors, verifications, tokens, cost where a price is known."""
    gaps = sequence.activity_gaps(timed(rows), [key], ORDER).where("active_seconds > 0")
    counted = event_counters()
    paid = priced(usage)
    parts = [
        _part(gaps.withColumn("date", local_date(F.col("prev_ts"), tz)), [key, "date"], {"active_seconds": F.col("active_seconds")}),
        _part(events.withColumn("date", local_date(F.col("ts"), tz)), [key, "date"], {n: counted[n] for n in ("tool_calls", "errors", "verification_events")}),
        paid.select(key, local_date(F.col("ts"), tz).alias("date"), token_total().cast("long").alias("total_tokens"), "cost"),
    ]
    days = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where("date IS NOT NULL")
    whole = ("active_seconds", "tool_calls", "errors", "verification_events", "total_tokens")
    out = days.groupBy(key, "date").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in whole], F.sum("cost").alias("cost"))
    return out.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in whole]))


def timed(rows: DataFrame) -> DataFrame:
    """Rows that carry a time, readable or not; one that is not readable still breaks a chain of activity."""
    return rows.where(F.coalesce("ts_raw", F.lit("")) != "")


def session_records(
    rows: DataFrame, events: DataFrame, prompts: DataFrame, usage: DataFrame, changes: DataFrame, key: str = "session_id", structure: bool = True, committed: DataFrame | None = None,
) -> DataFrame:
    """One row a session of `rows`: what it is, when, how long, and its counters.

    committed holds the keys of sessions with a commit. A session without prompts, tools or usage has nulls where there
    is no first one, and zero counters. Every part is grouped by the session first, so the joins need no other shuffle.
    """
    base = rows.groupBy(key).agg(
        F.min("agent").alias("agent"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.struct(*ORDER))).alias("cwd"),
        F.min(F.nullif("ts_raw", F.lit(""))).alias("started_at"), F.max(F.nullif("ts_raw", F.lit(""))).alias("ended_at"), F.count_if(F.coalesce("unknown", F.lit(False))).alias("unknown_records"),
    ).withColumn("project", tx.project_label(F.col("cwd"))).drop("cwd")
    titled = prompts.groupBy(key).agg(F.min(F.struct(*ORDER, "prompt")).getField("prompt").alias("__first")).select(key, tx.title(F.col("__first")).alias("title"))
    active = sequence.activity_gaps(timed(rows), [key], ORDER).groupBy(key).agg(F.sum("active_seconds").alias("active_seconds"))
    runs = sequence.agent_runs(timed(rows), [key], ORDER, F.col("human")).groupBy(key).agg(F.max("seconds").alias("longest_uninterrupted_seconds"))
    asked = prompts.select(key, *ORDER, F.lit(1).alias("step"), F.lit("prompt").alias("event_type"), "ts")
    called = events.where("event_type = 'tool'").select(key, *ORDER, (F.col("sequence") + 1).alias("step"), "event_type", "ts")
    seen = timed(rows).select(key, *ORDER, F.lit(0).alias("step"), F.lit("record").alias("event_type"), "ts")
    first = sequence.first_tool(seen.unionByName(asked).unionByName(called), [key], [*ORDER, "step"])
    named = rows.where(F.col("observed_model").isNotNull())
    model = sequence.primary_value(named, [key], "observed_model").select(key, F.col("primary_observed_model").alias("model"))
    changed = sequence.switches(named, [key], ORDER, "observed_model").withColumnRenamed("switches", "model_switches")
    cost = priced(usage).groupBy(key).agg(F.sum("cost").alias("cost"), F.sum("covered_tokens").alias("covered_tokens"))
    commits = (committed.select(key).distinct() if committed is not None else base.select(key).where("false")).withColumn("has_commit", F.lit(True))
    out = reduce(lambda a, b: a.join(b, key, "left"), [titled, model, active, runs, first, changed, cost, commits, signals(rows, events, prompts, usage, changes, key, structure)], base)
    zero = {c: 0 for c in ("active_seconds", "longest_uninterrupted_seconds", "model_switches", "covered_tokens")}
    return out.fillna(zero).fillna({"has_commit": False})


def database_sessions(joined: DataFrame) -> DataFrame:
    """Sessions of an embedded database out of their rows joined to events.

    The tool calls are those seen or those declared, whichever are more; the tokens and the estimate of the cost are the
    database's own. A session without events stays.
    """
    own = ("model", "title", "started_at", "ended_at", "tool_call_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "estimated_cost_usd")
    kind = F.col("event_type")
    out = joined.groupBy("session_id").agg(
        *[F.max(c).alias(c) for c in own], F.count_if(kind == "prompt").alias("prompt_count"), F.count_if(kind == "tool").alias("__tools"),
        F.count_if((kind == "tool") & tx.is_plan_tool(F.col("name"))).alias("plan_events"), F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at"),
    )
    at = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("long"))
    used = F.when(tx.real_model(F.col("model")), F.trim("model"))
    tokens = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
    return out.select(
        "session_id", used.alias("model"), tx.title(F.col("title")).alias("title"), F.coalesce(at("started_at"), "first_event_at").alias("started_at"), F.coalesce(at("ended_at"), "last_event_at").alias("ended_at"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in tokens], F.col("estimated_cost_usd").alias("cost"), "prompt_count", "plan_events", F.greatest("__tools", F.coalesce("tool_call_count", F.lit(0))).alias("tool_calls"),
    )
