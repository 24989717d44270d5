"""Plans of logs that grow: large files in ranges, records kept up to date, transcripts handed from a batch to a stream."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.operators import increments
from tracelode.plans.base import plan
from tracelode.plans.streams import _ISO, _pick, _shared
from tracelode.sources import files, sinks, tail
from tracelode.streaming import fusion, handover


@plan("""
SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS ordinal, CASE WHEN event_id % 9 <> 0 THEN event_id END AS id, event_id % 9 = 0 AS malformed FROM events""")
def log_lines_in_ranges(t):
    """One file of all events and a broken line at its end, in many ranges."""
    folder = f"{_shared(t.spark)}/lines"
    line = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.repeat(F.lit("é"), (F.col("event_id") % 50).cast("int")).alias("text"))))
    rows = t.events.select(F.col("event_id").alias("n"), line.alias("value"))
    end = t.spark.createDataFrame([(1 << 62, '{"id": 1, "te')], "n long, value string")
    sinks.one_file(rows.unionByName(end), f"{folder}/lines.txt", ["n"])
    name = "spark.sql.files.maxPartitionBytes"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, "20000")
    try:
        found = files.json_lines(t.spark, folder, "codex", "*.txt")
        found = found.select("ordinal", F.try_variant_get("record", "$.id", "bigint").alias("id"), "malformed")
        # Written here, as the width of ranges is a setting of the session.
        found.write.parquet(f"{folder}-found")
    finally:
        t.spark.conf.set(name, before)
    return t.spark.read.parquet(f"{folder}-found").where(F.col("ordinal") < t.events.count())


@plan("""
WITH r AS (
  SELECT CAST(user_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, CASE WHEN event_id % 17 <> 0 THEN make_timestamp(epoch_us(ts) // 60) END AS ts, event_id % 13 <> 0 AS timed, event_type = 'signup' AND event_id % 17 <> 0 AS human,
    CASE WHEN event_type IN ('click', 'view') THEN 'm' || event_id % 3 END AS model, CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100) AS BIGINT) END AS total, event_type = 'click' AS tool, event_type = 'error' AS failed FROM events
), t AS (
  SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY o) AS before, sum(human::INT) OVER (PARTITION BY session ORDER BY o) AS run, max(ts) OVER (PARTITION BY session) AS latest FROM r WHERE timed
), a AS (SELECT session, sum(CASE WHEN trunc((epoch_us(ts) - epoch_us(before)) / 1000000.0) BETWEEN 0 AND 600 THEN trunc((epoch_us(ts) - epoch_us(before)) / 1000000.0) ELSE 0 END) AS active FROM t GROUP BY session),
i AS (SELECT session, run, arg_min(ts, o) FILTER (NOT human AND ts IS NOT NULL) AS opened, max(ts) FILTER (human) AS human_ts FROM t GROUP BY session, run),
e AS (SELECT session, max(ts) AS ended FROM r GROUP BY session),
l AS (
  SELECT session, max(greatest(CAST(trunc((epoch_us(coalesce(nxt, ended)) - epoch_us(opened)) / 1000000.0) AS BIGINT), 0)) AS longest
  FROM (SELECT *, lead(human_ts) OVER (PARTITION BY session ORDER BY run) AS nxt FROM i) JOIN e USING (session) WHERE opened IS NOT NULL GROUP BY session
), m AS (SELECT session, model, count(*) AS n FROM r WHERE model IS NOT NULL GROUP BY 1, 2),
p AS (SELECT session, arg_min(model, (-n, model)) AS model FROM m GROUP BY session),
s AS (SELECT session, count(*) AS switches FROM (SELECT session, model, lag(model) OVER (PARTITION BY session ORDER BY o) AS b FROM r WHERE model IS NOT NULL) WHERE model <> b GROUP BY session),
k AS (SELECT session, sum(greatest(total - b, 0)) AS tokens FROM (SELECT session, total, lag(total, 1, 0) OVER (PARTITION BY session ORDER BY o) AS b FROM r WHERE total IS NOT NULL) GROUP BY session)
SELECT r.session, min(ts) AS started_at, max(ts) AS ended_at, CAST(coalesce(any_value(active), 0) AS BIGINT) AS active_seconds, coalesce(any_value(longest), 0) AS longest_run, any_value(p.model) AS model, CAST(coalesce(any_value(switches), 0) AS BIGINT) AS model_switches,
  CAST(coalesce(any_value(tokens), 0) AS BIGINT) AS tokens, count(*) FILTER (human) AS prompts, count(*) FILTER (tool) AS tool_calls, count(*) FILTER (failed) AS errors, count(*) AS rows_read
FROM r LEFT JOIN a USING (session) LEFT JOIN l USING (session) LEFT JOIN p USING (session) LEFT JOIN s USING (session) LEFT JOIN k USING (session) GROUP BY r.session""")
def records_kept_up_to_date(t):
    """Sessions advanced by five increments, some rows of which come twice; rows_read counts each row once."""
    folder, id_ = _shared(t.spark), F.col("event_id")
    ordinal = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.col("event_type")
    rows = t.events.select(
        F.col("user_id").cast("string").alias("session"), ordinal.cast("long").alias("ordinal"), F.when(id_ % 17 != 0, F.timestamp_micros(F.expr("unix_micros(ts) div 60"))).alias("ts"), (id_ % 13 != 0).alias("timed"), ((kind == "signup") & (id_ % 17 != 0)).alias("human"),
        F.when(kind.isin("click", "view"), F.concat(F.lit("m"), (id_ % 3).cast("string"))).alias("model"), F.when(kind == "purchase", F.floor(F.col("value") * 100)).alias("total"), (kind == "click").alias("tool"), (kind == "error").alias("failed"),
    )
    # Sessions are cut at places of their own; an increment also brings the last rows of the one before again.
    place = F.col("ordinal") + F.pmod(F.xxhash64("session"), F.lit(15))
    known = increments.empty(t.spark)
    for i in range(5):
        part = rows.where(place.between(18 * i - 3, 18 * i + 18 if i < 4 else 1 << 60))
        path = f"{folder}/known-{i}"
        increments.replaced(known, increments.advance(known, part)).write.parquet(path)
        known = t.spark.read.parquet(path)
    out = increments.records(known)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


@plan("""
WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'task_started' WHEN 'purchase' THEN 'task_complete' WHEN 'error' THEN 'error' WHEN 'click' THEN 'exec_command_begin' END AS kind, CASE WHEN event_type = 'view' THEN 'm' || event_id % 4 END AS mode FROM events),
m AS (SELECT *, last_value(mode IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS now FROM e),
s AS (SELECT user_id, arg_max(kind, event_id) AS kind, max_by({'now': now, 'ts': ts}, event_id) AS s FROM m WHERE kind IS NOT NULL GROUP BY user_id),
b AS (SELECT user_id, arg_max(kind, event_id) = 'task_started' AS open, arg_max(ts, event_id) AS ts FROM m WHERE kind IN ('task_started', 'task_complete') GROUP BY user_id)
SELECT user_id, coalesce(open, false) AS open, CASE WHEN open THEN b.ts END AS started_at, kind, CASE kind WHEN 'task_complete' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END AS status, s.ts AS signal_at, s.now AS mode
FROM s LEFT JOIN b USING (user_id)""")
def transcripts_handed_over(t):
    """Each transcript read by a batch up to a line of its own, then followed from that byte with the batch's state."""
    folder, spark = _shared(t.spark), t.spark
    kind = _pick(F.col("event_type"), signup="task_started", purchase="task_complete", error="error", click="exec_command_begin")
    stamp = F.date_format("ts", _ISO).alias("timestamp")
    said = F.to_json(F.struct(F.lit("event_msg").alias("type"), stamp, F.struct(kind.alias("type")).alias("payload")))
    turn = F.to_json(F.struct(F.lit("turn_context").alias("type"), stamp, F.struct(F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("collaboration_mode")).alias("payload")))
    lines = t.events.select(F.col("user_id").alias("session"), "event_id", F.when(F.col("event_type") == "view", turn).otherwise(said).alias("value"))
    sinks.log_files(lines, f"{folder}/logs", "session", ["event_id"])
    logs = f"{folder}/logs".removeprefix("file://")
    whole = tail.tail(spark, logs, "*.txt", last_bytes=1 << 62)
    place = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    batch = whole.withColumn("n", place).where(F.col("n") <= F.pmod(F.xxhash64("path"), F.lit(90))).drop("n")
    handover.bootstrap(batch).write.parquet(f"{folder}/known")
    known = spark.read.parquet(f"{folder}/known")
    begin = f"{folder}/begin.json".removeprefix("file://")
    with open(begin, "w", encoding="utf-8") as f:
        json.dump({r.path: r.next for r in known.select("path", "next").collect()}, f)  # one number a followed file, as the follower's offset holds
    changes = fusion.run_to_end(handover.followed(tail.follow(spark, logs, "*.txt", begin), known), f"{folder}/run")
    out = handover.latest(known, changes.drop("batch"))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return out.where("kind IS NOT NULL").select(F.regexp_extract("path", "session=([0-9]+)/", 1).cast("long").alias("user_id"), "open", at("started_at"), "kind", "status", at("signal_at"), "mode")
