"""Live sessions in batch form: latest state by a total order, freshness, pulse, order, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.mathfn import nonnegative
from tracelode.functions.timefn import gap_seconds, is_recent

# Seconds.
FRESH, AGING = 30, 120
COMPLETED_TTL, OTHER_TTL = 45, 6 * 3600
LIVE_WINDOW, COMPLETED_WINDOW = 600, 90
#: Status by urgency.
PRIORITY = ("waiting", "error", "stuck", "running", "completed", "idle")


def order_key(sequence: Column, source_time: Column, rank: Column, digest: Column) -> Column:
    """Breaks ties at one instant: numbered events first among kinds, then timed ones, then derived; all as text."""
    tail = F.concat(F.lit(":"), rank.cast("string"), F.lit(":"), digest)
    return (
        F.when(sequence.isNotNull(), F.concat(F.lit("sequence:"), F.lpad(sequence.cast("string"), 20, "0"), tail))
        .when(source_time.isNotNull(), F.concat(F.lit("source"), tail))
        .otherwise(F.concat(F.lit("derived"), tail))
    )


def latest_state(events: DataFrame, key: list[str], at: str = "updated_at", tie: str = "order_key") -> DataFrame:
    """The state after the newest event of each key by (instant, order key): whatever order events came in."""
    rest = [c for c in events.columns if c not in (*key, at, tie)]
    newest = F.max(F.struct(at, tie, *rest)).alias("n")
    return events.groupBy(*key).agg(newest).select(*key, *[f"n.{c}" for c in (*rest, at)])


def freshness(updated_at: Column, now: Column) -> Column:
    age = nonnegative(gap_seconds(now, updated_at))
    return F.when(age <= FRESH, "fresh").when(age <= AGING, "aging").otherwise("lost-update")


def alive(status: Column, updated_at: Column, now: Column) -> Column:
    age = nonnegative(gap_seconds(now, updated_at))
    return age <= F.when(status == "completed", COMPLETED_TTL).otherwise(OTHER_TTL)


def status_rank(status: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for i, s in enumerate(PRIORITY):
        out = F.when(status == s, i).otherwise(out)
    return out


def ordered(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.orderBy(status_rank(F.col("status")), F.asc("started_at"), F.asc(key))


def numbered(rows: DataFrame, name: str = "n") -> DataFrame:
    """Sorted rows with their number in the order, from 1: each partition is counted, then numbered behind those before it.

    The partitions of a sort are ranges in order, so one number a partition is all that goes between them.
    """
    from tracelode.operators.graph import kept

    # Written once, so that the ranges are the same when they are counted and when they are numbered.
    placed = kept(rows.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__before"))
    return placed.withColumn("__part", part).join(starts, "__part").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__id", "__before")


def pulse(rows: DataFrame, capabilities: DataFrame, now: Column) -> DataFrame:
    """rows plus four independent dimensions; one that the source cannot tell is unknown. capabilities: one row an agent."""
    c = rows.join(capabilities, "agent", "left")
    known = lambda flag, value: F.when(F.coalesce(F.col(flag), F.lit(False)), value).otherwise(F.lit("unknown"))
    return c.withColumn(
        "pulse",
        F.struct(
            known("reports_activity", F.when(F.col("status") == "running", "working").otherwise("still")).alias("activity"),
            known("reports_waiting", F.when(F.col("status") == "waiting", "needs-you").otherwise("none")).alias("attention"),
            known("reports_outcome", F.when(F.col("status").isin("completed", "error"), F.col("status")).otherwise("open")).alias("outcome"),
            freshness(F.col("updated_at"), now).alias("freshness"),
        ),
    ).drop("reports_activity", "reports_waiting", "reports_outcome")


def last_actions(rows: DataFrame, key: list[str], order: list[str], label: str, k: int = 3) -> DataFrame:
    """The last k labels of each key in order. Each partition keeps k a key before the shuffle; nothing longer is collected."""
    ranked = F.row_number().over(_desc(key, order))
    few = rows.withColumn("__r", ranked).where(F.col("__r") <= k)
    return few.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("r"), F.col(label).alias("l")))), lambda x: x["l"]).alias("actions"))


def _desc(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])


def newest(rows: DataFrame, ts: str, now: Column, seconds: int, k: int, tie: str) -> DataFrame:
    """The k newest rows of the last seconds: a listing's feature, so its limit stays."""
    return rows.where(is_recent(F.col(ts), now, seconds)).orderBy(F.desc(ts), tie).limit(k)


def counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("agent").agg(F.count_if(F.col("status").isin("running", "waiting")).alias("active"), F.count_if(F.col("status") == "waiting").alias("waiting"), F.count_if(F.col("status") == "error").alias("errors"))


def urgent(queue_rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """The first queue item's session that is live, else the first session in order."""
    q = queue_rows.join(sessions.select("session_id"), "session_id", "left_semi").select("session_id", F.lit(0).alias("__s"), F.col("rank").alias("__r"))
    s = sessions.select("session_id", F.lit(1).alias("__s"), status_rank(F.col("status")).alias("__r"))
    return q.unionByName(s).orderBy("__s", "__r", "session_id").limit(1).select("session_id")


def wing(rows: DataFrame, now: Column) -> DataFrame:
    """What the notch shows at its right: needs you, blocking error, stuck, a completion of the last 5 s, running, recent."""
    fresh_completion = (F.col("status") == "completed") & (gap_seconds(now, F.col("updated_at")) < 5)
    rank = F.when(F.col("status") == "waiting", 0).when(F.col("status") == "error", 1).when(F.col("status") == "stuck", 2).when(fresh_completion, 3).when(F.col("status") == "running", 4).otherwise(5)
    return rows.withColumn("__r", rank).orderBy("__r", F.desc("updated_at"), "session_id").limit(1).drop("__r")


def concurrency(spans: DataFrame, key: str = "agent") -> DataFrame:
    """(agent, at, running): how many sessions run after each start or end, by one running sum."""
    edges = spans.select(key, F.explode(F.array(F.struct(F.col("started_at").alias("at"), F.lit(1).alias("d")), F.struct(F.col("ended_at").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.at", "e.d")
    steps = edges.where(F.col("at").isNotNull()).groupBy(key, "at").agg(F.sum("d").alias("d"))
    return steps.select(key, "at", F.sum("d").over(Window.partitionBy(key).orderBy("at")).alias("running"))


# Fields of a point of the timeline; none of them holds what a person or a tool said.
POINT = ("event_id", "occurred_at", "agent", "project_label", "event_name", "status", "source_session_id")


def timeline(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """The points of a period, each stored event once: the earliest of its identity (agent, session, event id)."""
    inside = events.where(F.col("occurred_at").between(start, end)).select(*POINT)
    rest = [c for c in POINT if c not in ("agent", "source_session_id", "event_id")]
    first = inside.groupBy("agent", "source_session_id", "event_id").agg(F.min(F.struct(*rest)).alias("p"))
    return first.select("agent", "source_session_id", "event_id", "p.*").select(*POINT)


def history(points: DataFrame, skip: int = 0, take: int | None = None) -> DataFrame:
    """The last point of each session, newest first, with its place; a page of it where skip or take say so."""
    rest = [c for c in POINT if c not in ("agent", "source_session_id")]
    last = points.groupBy("agent", "source_session_id").agg(F.max(F.struct("occurred_at", "event_id", *[c for c in rest if c not in ("occurred_at", "event_id")])).alias("p"))
    rows = numbered(last.select("agent", "source_session_id", "p.*").orderBy(F.desc("occurred_at"), "agent", "source_session_id"), "place")
    return rows.where((F.col("place") > skip) & (F.lit(True) if take is None else F.col("place") <= skip + take))


def lanes(points: DataFrame) -> DataFrame:
    """Per agent the sessions of a period by what they last were, and their projects in order."""
    last = points.groupBy("agent", "source_session_id").agg(F.max(F.struct("occurred_at", "event_id", "status", "project_label")).alias("p"))
    of = lambda status: F.count_if(F.col("p.status") == status)
    return last.groupBy("agent").agg(
        F.count("*").alias("session_count"), *[of(s).alias(f"{s}_count") for s in ("waiting", "error", "running", "completed")], F.array_sort(F.collect_set("p.project_label")).alias("projects"),
    )
