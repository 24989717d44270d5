"""Attention episodes: stuck rules, queue order, quality report, notification leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEEDBACK = ("handled", "not-relevant", "not-stuck", "snoozed")
EXPIRY_SECONDS = 86_400
ORDER = {"waiting": 0, "error": 1, "stuck": 2, "completion": 3}


def repeated(rows: DataFrame, key: list[str], ts: str, seconds: int, times: int) -> DataFrame:
    """Rows that are at least the times-th of their key within the seconds up to them, with repeats."""
    w = Window.partitionBy(*key).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("repeats", F.count("*").over(w)).where(F.col("repeats") >= times)


def stuck(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Sessions that repeat themselves: three equal failures or subagent start failures in ten minutes, or three equal starts without progress between.

    Progress (a success, an edit, a prompt) sets the count of starts back.
    """
    w = Window.partitionBy(session).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    progress = F.sum((F.coalesce("success", F.lit(False)) | F.col("event_type").isin("edit", "prompt")).cast("long")).over(w)
    rows = events.withColumn("__p", progress)
    failed = repeated(rows.where(~F.coalesce("success", F.lit(True))), [session, "event_type", "name"], "ts", 600, 3).withColumn("rule", F.when(F.col("event_type") == "subagent-start", "subagent-start-failures").otherwise("repeated-failure"))
    started = repeated(rows.where((F.col("event_type") == "start")), [session, "name", "__p"], "ts", 600, 3).withColumn("rule", F.lit("repeated-start"))
    both = failed.unionByName(started)
    return both.groupBy(session, "rule").agg(F.min("ts").alias("opened_at"), F.max("repeats").alias("repeats"))


def queue(episodes: DataFrame, now: Column) -> DataFrame:
    """Open episodes in order of urgency; handled ones and those older than a day are gone, snoozed ones wait."""
    rank = F.lit(9)
    for kind, n in ORDER.items():
        rank = F.when(F.col("kind") == kind, n).otherwise(rank)
    live = F.col("resolved_at").isNull() & (F.unix_seconds(now) - F.unix_seconds("opened_at") <= EXPIRY_SECONDS)
    awake = F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= now)
    return episodes.where(live & awake).withColumn("rank", rank).orderBy("rank", "opened_at", "episode_id")


def quality_report(episodes: DataFrame) -> DataFrame:
    """Precision and false positives over judged stuck episodes, latency at 95 percent, jump rate, and the gate over them."""
    stuck_rows = F.col("kind") == "stuck"
    judged = stuck_rows & F.col("feedback").isin("handled", "not-stuck", "not-relevant")
    wrong = F.col("feedback").isin("not-stuck", "not-relevant")
    rate = lambda a, b: F.when(b > 0, a / b)
    n = F.count_if(judged)
    out = episodes.agg(
        n.alias("samples"), rate(F.count_if(judged & ~wrong), n).alias("precision"), rate(F.count_if(judged & wrong), n).alias("false_positive_rate"),
        F.percentile("latency_seconds", 0.95).alias("p95_latency_seconds"), rate(F.count_if("jumped"), F.count_if(F.col("jumped").isNotNull())).alias("jump_rate"),
    )
    gate = (F.col("samples") >= 100) & (F.col("precision") >= 0.9) & (F.col("false_positive_rate") <= 0.1) & (F.col("p95_latency_seconds") < 2) & (F.col("jump_rate") >= 0.95)
    return out.withColumn("gate", F.coalesce(gate, F.lit(False)))


def claims(episodes: DataFrame, leases: DataFrame, now: Column, lease_seconds: int = 5) -> DataFrame:
    """Episodes to notify: neither confirmed nor under a lease that still runs; one notification an episode."""
    busy = leases.where(F.col("confirmed") | (F.unix_seconds(now) - F.unix_seconds("claimed_at") < lease_seconds)).select("episode_id").distinct()
    return episodes.dropDuplicates(["episode_id"]).join(busy, "episode_id", "left_anti")


def completed_tray(completed: DataFrame, tombstones: DataFrame, active: DataFrame) -> DataFrame:
    """Completed sessions that are neither running again nor deleted after their completion."""
    gone = tombstones.groupBy("session_id").agg(F.max("deleted_at").alias("__gone"))
    latest = completed.groupBy("session_id").agg(F.max("completed_at").alias("completed_at"), F.max_by("seen", "completed_at").alias("seen"))
    left = latest.join(gone, "session_id", "left").where(F.col("__gone").isNull() | (F.col("__gone") < F.col("completed_at"))).drop("__gone")
    return left.join(active.select("session_id").distinct(), "session_id", "left_anti")


def tray_after(completed: DataFrame, actions: DataFrame, active: DataFrame) -> DataFrame:
    """The completed tray after what users did: (session_id, completed_at, seen).

    actions: (kind, session_id, token, at). `delete` takes one session's completions up to then, `clear` those of all under a
    token, `undo` gives back what its token's clear took, `seen` marks. A clear counts unless it was undone later; clears are
    few, and only the latest one that counts matters.
    """
    latest = completed.groupBy("session_id").agg(F.max("completed_at").alias("completed_at"))
    mine = actions.where(F.col("kind").isin("delete", "seen")).groupBy("session_id").agg(F.max(F.when(F.col("kind") == "delete", F.col("at"))).alias("__deleted"), F.max(F.when(F.col("kind") == "seen", F.col("at"))).alias("__seen"))
    tokens = actions.where(F.col("kind").isin("clear", "undo")).groupBy("token").agg(F.max(F.when(F.col("kind") == "clear", F.col("at"))).alias("cleared"), F.max(F.when(F.col("kind") == "undo", F.col("at"))).alias("undone"))
    last = tokens.where("cleared IS NOT NULL AND (undone IS NULL OR undone < cleared)").agg(F.max("cleared").alias("__cleared"))
    rows = latest.join(mine, "session_id", "left").withColumn("__one", F.lit(1)).join(F.broadcast(last.withColumn("__one", F.lit(1))), "__one")  # one row
    kept = lambda c: F.col(c).isNull() | (F.col(c) < F.col("completed_at"))
    left = rows.where(kept("__deleted") & kept("__cleared")).select("session_id", "completed_at", F.coalesce(F.col("__seen") >= F.col("completed_at"), F.lit(False)).alias("seen"))
    return left.join(active.select("session_id").distinct(), "session_id", "left_anti")
