"""Ordered-sequence plans over events: user_id stands for the session, event_id for the record's place in its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.functions import hashing, timefn
from tracelode.operators import activity, sequence
from tracelode.plans.base import plan

KEY, ORDER = ["user_id"], ["event_id"]
GAP = "CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id))) / 1000000.0) AS BIGINT)"


def _active(max_gap: int) -> str:
    return f"""
    SELECT strftime(prev_ts, '%Y-%m-%d') AS day, user_id, CAST(sum(CASE WHEN gap BETWEEN 0 AND {max_gap} THEN gap ELSE 0 END) AS BIGINT) AS active_seconds, CAST(count(*) AS BIGINT) AS gaps
    FROM (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_ts, {GAP} AS gap FROM events)
    WHERE prev_ts IS NOT NULL AND gap BETWEEN 0 AND {max_gap} GROUP BY 1, 2"""


def _active_plan(t, max_gap: int):
    rows = sequence.activity_gaps(t.events.select("user_id", "event_id", "ts"), KEY, ORDER, max_gap=max_gap)
    gap = timefn.gap_seconds(F.col("ts"), F.col("prev_ts"))
    return rows.where(gap.between(0, max_gap)).groupBy(timefn.local_date(F.col("prev_ts")).alias("day"), "user_id").agg(F.sum("active_seconds").alias("active_seconds"), F.count("*").alias("gaps"))


@plan(_active(600))
def active_seconds_daily(t):
    return _active_plan(t, 600)


@plan(_active(86_400))
def active_seconds_daily_wide(t):
    return _active_plan(t, 86_400)


@plan("""
WITH m AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run, event_type = 'purchase' AS human FROM events),
r AS (SELECT user_id, run, arg_min(ts, event_id) FILTER (NOT human AND ts IS NOT NULL) AS started, max(ts) FILTER (human) AS human_ts, max(ts) AS latest FROM m GROUP BY 1, 2),
c AS (SELECT user_id, started, coalesce(lead(human_ts) OVER (PARTITION BY user_id ORDER BY run), max(latest) OVER (PARTITION BY user_id)) AS ended FROM r)
SELECT user_id, count(*) AS runs, max(greatest(CAST(trunc((epoch_us(ended) - epoch_us(started)) / 1000000.0) AS BIGINT), 0)) AS longest_seconds FROM c WHERE started IS NOT NULL GROUP BY 1""")
def agent_run_longest(t):
    runs = sequence.agent_runs(t.events.select("user_id", "event_id", "ts", "event_type"), KEY, ORDER, F.col("event_type") == "purchase")
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("seconds").alias("longest_seconds"))


@plan("""
WITH v AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 50 AS n FROM events)
SELECT user_id, CAST(sum(greatest(n - coalesce(lag_n, 0), 0)) AS BIGINT) AS total FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS lag_n FROM v) GROUP BY 1""")
def cumulative_delta(t):
    rows = t.events.select("user_id", "event_id", F.pmod(F.floor("value"), F.lit(50)).alias("n"))
    return sequence.cumulative_delta(rows, KEY, ORDER, ["n"]).groupBy("user_id").agg(F.sum("n_delta").alias("total"))


@plan("""
WITH v AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_partkey % 3 AS id, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
d AS (SELECT l_suppkey, CASE WHEN coalesce(CAST(id AS VARCHAR), '') = lag(coalesce(CAST(id AS VARCHAR), '')) OVER w THEN greatest(q - lag(q) OVER w, 0) ELSE q END AS delta FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, q))
SELECT l_suppkey, CAST(sum(delta) AS BIGINT) AS total FROM d GROUP BY 1""")
def consecutive_id_delta(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 3).alias("id"), F.col("l_quantity").cast("long").alias("q"))
    out = sequence.same_id_delta(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "q"], "id", ["q"])
    return out.groupBy("l_suppkey").agg(F.sum("q_delta").alias("total"))


@plan("""
SELECT user_id, event_type AS primary_event_type, n AS observations FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def primary_value(t):
    return sequence.primary_value(t.events.select("user_id", "event_type"), KEY, "event_type")


@plan("""
SELECT user_id, count(*) FILTER (event_type <> before) AS switches FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type IS NOT NULL) GROUP BY 1""")
def model_switches(t):
    return sequence.switches(t.events.select("user_id", "event_id", "event_type"), KEY, ORDER, "event_type")


@plan("""
SELECT user_id, event_id, CAST(r AS INTEGER) AS sequence FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 40""")
def event_sequence_cap(t):
    return sequence.numbered(t.events.select("user_id", "event_id"), KEY, ORDER, limit=40)


@plan("""
WITH f AS (SELECT user_id, event_id, substr(sha256(event_type || '|' || strftime(ts, '%Y-%m-%d')), 1, 16) AS base FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, base ORDER BY event_id) - 1 AS ordinal FROM f)
SELECT event_id, ordinal, CASE WHEN ordinal = 0 THEN base ELSE substr(sha256(base || '|' || CAST(ordinal AS VARCHAR)), 1, 16) END AS fingerprint FROM n""")
def fingerprint_ordinal(t):
    rows = t.events.select("user_id", "event_id", hashing.stable_hash(F.concat_ws("|", "event_type", timefn.local_date(F.col("ts")))).alias("base"))
    out = sequence.duplicate_ordinal(rows, KEY, ["base"], ORDER)
    own = F.when(F.col("ordinal") == 0, F.col("base")).otherwise(hashing.stable_hash(F.concat_ws("|", "base", F.col("ordinal").cast("string"))))
    return out.select("event_id", F.col("ordinal").cast("long").alias("ordinal"), own.alias("fingerprint"))


@plan("""
SELECT user_id, count(*) AS kept FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS NULL OR event_type IS DISTINCT FROM before GROUP BY 1""")
def adjacent_dedup(t):
    rows = t.events.select("user_id", "event_id", "event_type")
    return sequence.without_adjacent_repeats(rows, KEY, ORDER, F.col("event_type")).groupBy("user_id").agg(F.count("*").alias("kept"))


@plan("""
WITH n AS (SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2)
SELECT * FROM (SELECT user_id, event_type, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, length(event_type) DESC, event_type) AS INTEGER) AS rank FROM n) WHERE rank <= 3""")
def top_per_group(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return sequence.top_per_group(counts, KEY, [F.desc("n"), F.desc(F.length("event_type")), F.asc("event_type")], 3)


@plan("""
WITH m AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
SELECT user_id, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM m""")
def carried_forward(t):
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return sequence.carried(rows, KEY, ORDER, ["v"])


@plan("""
WITH h AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM h)
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM i GROUP BY 1, 2, 3""")
def phases_islands(t):
    rows = sequence.islands(t.events.select("user_id", "event_id", "event_type", "ts"), KEY, ORDER, "event_type")
    return rows.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("started"), F.max("ts").cast("timestamp_ntz").alias("ended"))


@plan("""
WITH k AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'prompt' WHEN event_type = 'click' THEN 'tool' ELSE event_type END AS kind, ts FROM events),
f AS (SELECT user_id, arg_min(ts, event_id) FILTER (kind = 'prompt') AS p, arg_min(ts, event_id) FILTER (kind = 'tool') AS o FROM k GROUP BY 1)
SELECT user_id, greatest(CAST(trunc((epoch_us(o) - epoch_us(p)) / 1000.0) AS BIGINT), 0) AS time_to_first_tool_ms FROM f WHERE o IS NOT NULL AND p IS NOT NULL""")
def first_prompt_and_tool(t):
    kind = F.when(F.col("event_type") == "view", "prompt").when(F.col("event_type") == "click", "tool").otherwise(F.col("event_type"))
    out = sequence.first_tool(t.events.select("user_id", "event_id", kind.alias("kind"), "ts"), KEY, ORDER, kind="kind")
    return out.where(F.col("first_prompt_at").isNotNull() & F.col("first_tool_at").isNotNull()).select("user_id", "time_to_first_tool_ms")


@plan("""
WITH n AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS active_days, round(CASE WHEN count(*) > 1 THEN stddev_pop(n) / avg(n) ELSE 1.0 END, 9) AS variation FROM n GROUP BY 1""")
def day_variation(t):
    rows = t.events.select("user_id", timefn.local_date(F.col("ts")).alias("day"))
    return activity.day_variation(rows, KEY, "day").withColumn("variation", F.round("variation", 9))
