"""Small relations beside sessions: details, watches, feedback, visible agents, excerpts, guarded merges, observed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text as tx
from tracelode.functions.hashing import stable_hash
from tracelode.operators.attention import FEEDBACK, ORDER

#: The order in which account providers are listed.
PROVIDERS = ("claude", "codex", "cursor")
ACTIVE = ("idle", "running")


def watched(sessions: DataFrame, watches: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions whose transcript is followed; a session with several watches comes once."""
    return sessions.join(watches.select(key), key, "left_semi")


def details(sessions: DataFrame, tasks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Sessions with their task's title and their open episodes: how many, and the most urgent kind. tasks: one row a task_id."""
    rank = F.lit(9)
    for kind, n in ORDER.items():
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    open_ = episodes.where(F.col("resolved_at").isNull()).groupBy("session_id").agg(F.count("*").alias("open_episodes"), F.min_by("kind", rank).alias("attention"))
    named = tasks.select("task_id", F.col("title").alias("task_title"))
    return sessions.join(named, "task_id", "left").join(open_, "session_id", "left").withColumn("open_episodes", F.coalesce("open_episodes", F.lit(0)))


#: Events of a session that its detail shows, as its replay does.
SHOWN_EVENTS = 4000


def session_detail(sessions: DataFrame, events: DataFrame, files: DataFrame, usage: DataFrame, commits: DataFrame, most_events: int = SHOWN_EVENTS) -> DataFrame:
    """sessions with what happened in each: arrays of events, files, usage by model and commits, empty where there is nothing.

    events: session_id, sequence, ts, event_type, category, name, success; files: session_id, path, kind, added, removed,
    changes; usage: session_id, model, total_tokens, cost; commits: session_id, committed_at, commit, subject. Give the sessions
    that are asked for: the other tables are cut to them before anything is gathered. The first events in order are shown,
    and tasks hand on no more than those; `event_count` counts all. Costs are null where one of a model's is.
    """
    asked = sessions.select("session_id").distinct()
    of = lambda rows: rows.join(asked, "session_id", "left_semi")

    def listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        return rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("sequence"))
    first = of(events).withColumn("__n", place).where(F.col("__n") <= most_events)
    counted = of(events).groupBy("session_id").agg(F.count("*").alias("event_count"))
    spent = of(usage).groupBy("session_id", F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.sum("total_tokens").alias("total_tokens"), F.when(F.count("cost") == F.count("*"), F.sum("cost")).alias("cost"))
    parts = {
        "events": listed(first, "events", "sequence", "ts", "event_type", "category", "name", "success"), "files": listed(of(files), "files", "path", "kind", "added", "removed", "changes"),
        "usage": listed(spent, "usage", "model", "total_tokens", "cost"), "commits": listed(of(commits).dropDuplicates(["session_id", "commit"]), "commits", "committed_at", "commit", "subject"),
    }
    out = sessions.join(counted, "session_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))
    for name, rows in parts.items():
        out = out.join(rows, "session_id", "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out


def with_feedback(episodes: DataFrame, feedback: DataFrame, snooze_seconds: int = 3600) -> DataFrame:
    """Episodes with their latest feedback of the four known kinds: a snoozed one sleeps for a while, any other ends it.

    Decision: the sources do not say how long a snooze lasts, so it is a parameter.
    """
    latest = feedback.where(F.col("feedback").isin(*FEEDBACK)).groupBy("episode_id").agg(F.max(F.struct("given_at", "feedback")).alias("f"))
    rows = episodes.join(latest, "episode_id", "left")
    snoozed = F.col("f.feedback") == "snoozed"
    return rows.select(
        *[F.col(c) for c in episodes.columns if c != "resolved_at"], F.col("f.feedback").alias("feedback"), F.coalesce("resolved_at", F.when(~snoozed, F.col("f.given_at"))).alias("resolved_at"),
        F.when(snoozed, F.col("f.given_at") + F.make_interval(secs=F.lit(snooze_seconds))).alias("snoozed_until"),
    )


def notifiable(availability: Column, status: Column, origin: Column) -> Column:
    """Whether a session's change may notify: its state is available, and completions only of terminal sessions."""
    return F.coalesce(availability == "available", F.lit(False)) & ((status != "completed") | F.coalesce(origin == "cli", F.lit(False)))


def default_agents(sources: DataFrame, usage: DataFrame) -> DataFrame:
    """Agents shown at first: available, selected, with sessions and with usage."""
    used = usage.where(F.col("value") > 0).select(F.col("label").alias("agent"))
    return sources.where(F.col("available") & F.col("selected") & (F.col("session_count") > 0)).join(used, "agent", "left_semi").select("agent")


def filter_agents(sources: DataFrame) -> DataFrame:
    """Agents that a filter offers: available ones, and those with any live capability."""
    return sources.where(F.col("available") | (F.col("live_capability") != "none")).select("agent")


def metric_visible(shown: Column, metric: Column) -> Column:
    """A metric is visible unless the map of choices says otherwise."""
    return F.coalesce(F.try_element_at(shown, metric), F.lit(True))


def provider_rank(provider: Column) -> Column:
    out = F.lit(len(PROVIDERS))
    for i, name in enumerate(PROVIDERS):
        out = F.when(provider == name, i).otherwise(out)
    return out


def recap_session(sessions: DataFrame) -> DataFrame:
    """The session that a card shows by default: the newest with changed files or lines, else the newest."""
    changed = (F.col("files") > 0) | (F.col("lines") > 0)
    return sessions.orderBy(F.desc(F.coalesce(changed, F.lit(False))), F.desc("started_at"), "session_id").limit(1)


def excerpt(rows: DataFrame, source: str) -> DataFrame:
    """(path, prompt, output) of the one log whose path hashes to source: its first prompt that a person wrote and its last result, bounded and redacted."""
    own = rows.where(stable_hash(F.col("path")) == source)
    asked = F.when(F.col("human") & tx.prompt_eligible(F.coalesce("prompt", F.lit(""))), F.col("prompt"))
    both = own.groupBy("path").agg(F.min(F.when(asked.isNotNull(), F.struct("ordinal", asked.alias("t")))).alias("p"), F.max(F.when(F.col("result").isNotNull(), F.struct("ordinal", F.col("result").alias("t")))).alias("r"))
    return both.select("path", tx.bounded_text(F.col("p.t"), tx.PROMPT_CHARS).alias("prompt"), tx.bounded_text(F.col("r.t"), tx.RESULT_CHARS).alias("output"))


def observed_events(sessions: DataFrame) -> DataFrame:
    """Stored events of sessions that a poll of a runtime found, named after their status and last action (kind, label).

    Such events have no id of their own; their fingerprint makes a poll that sees the same state again add nothing.
    """
    kind = F.col("action.kind")
    running = F.when(kind == "tool", "PreToolUse").when(kind == "compact", "PreCompact").otherwise("Resume")
    name = F.when(F.col("status") == "waiting", "PermissionRequest").when(F.col("status") == "completed", "SessionEnd").when(F.col("status") == "error", "PostToolUseFailure").otherwise(running)
    payload = F.when(kind == "tool", F.to_json(F.struct(tx.tool_name(F.col("action.label")).alias("tool_name")))).otherwise(F.lit("{}"))
    return sessions.select(
        F.col("updated_at").alias("occurred_at"), "agent", "source_session_id", stable_hash(F.concat_ws("|", "agent", "source_session_id", name, "status", "order_key")).alias("fingerprint"),
        name.alias("event_name"), "project_label", payload.alias("payload_json"), "status", "phase",
    )


def guarded_merge(signals: DataFrame, key: str = "id") -> DataFrame:
    """Sessions after their transcript signals (at, order_key, status, reason, live), in order, under three guards.

    A completion that was not read live counts only for a session that is completed already; `running` does not end
    waiting or error, unless the turn was paused; equal places in the order count once. Which signals count follows from
    the last unconditional one before each, so one sort a session is enough and no state is carried by hand.
    """
    w = Window.partitionBy(key).orderBy("at", "order_key")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("status").isin("waiting", "error", "idle") | ((F.col("status") == "completed") & F.col("live"))
    rows = signals.dropDuplicates([key, "at", "order_key"]).withColumn("__sets", sets)
    rows = rows.withColumn("__last", F.last(F.when(F.col("__sets"), F.struct("status", "reason")), ignorenulls=True).over(so_far))
    sticky = F.coalesce(F.col("__last.status").isin("waiting", "error") & ~F.col("__last.reason").eqNullSafe("turn-paused"), F.lit(False))
    rows = rows.withColumn("__counts", F.col("__sets") | ((F.col("status") == "running") & ~sticky))
    rows = rows.withColumn("__was", F.last(F.when(F.col("__counts"), F.col("status")), ignorenulls=True).over(before))
    again = (F.col("status") == "completed") & ~F.col("live") & F.coalesce(F.col("__was") == "completed", F.lit(False))
    kept = rows.where(F.col("__counts") | again)
    resumed = (F.col("status") == "running") & F.coalesce(F.col("__was").isin("waiting", "error", "completed"), F.lit(False))
    stopped = ~F.col("status").isin(*ACTIVE) & F.coalesce(F.col("__was").isin(*ACTIVE), F.lit(True))
    out = kept.groupBy(key).agg(
        F.max(F.struct("at", "order_key", "status")).alias("n"), F.coalesce(F.max(F.when(resumed, F.col("at"))), F.min("at")).alias("started_at"), F.max(F.when(stopped, F.col("at"))).alias("__stopped"),
    )
    return out.select(key, F.col("n.status").alias("status"), F.col("n.at").alias("updated_at"), "started_at", F.when(~F.col("n.status").isin(*ACTIVE), F.col("__stopped")).alias("activity_ended_at"))
