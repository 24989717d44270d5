"""Streaming plans: events replayed through the state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators.graph import shared_folder
from tracelode.plans.base import plan
from tracelode.sources import sinks, tail
from tracelode.streaming import attention, envelopes, fusion, machine


def _canonical(df):
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "purchase", "completed").when(kind == "signup", "waiting").otherwise("running")
    return df.select(
        F.col("user_id").cast("string").alias("id"), F.lit("codex").alias("agent"), status.alias("status"), kind.alias("phase"), kind.alias("label"), F.col("ts").cast("timestamp").alias("updated_at"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("order_key"), F.col("event_id").cast("string").alias("event_id"),
    )


def _shared(spark) -> str:
    return shared_folder(spark, "stream")


@plan("""
SELECT user_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'waiting' ELSE 'running' END AS status, event_type AS phase, ts AS updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, sha256(CAST(event_id AS VARCHAR)) DESC) AS r FROM events) WHERE r = 1""")
def live_stream_equivalence(t):
    stream = t.spark.readStream.schema(t.spark.read.parquet(f"{t.folder}/events.parquet").schema).parquet(f"{t.folder}/events.parquet*")
    cards = machine.replay(_canonical(stream), _shared(t.spark))
    return cards.select(F.col("id").cast("long").alias("user_id"), "status", "phase", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@plan("""
WITH s AS (SELECT user_id, event_id, ts, sha256(CAST(event_id AS VARCHAR)) AS k, event_type IN ('error', 'signup') AS o FROM events),
h AS (SELECT *, CASE WHEN o AND NOT coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY ts, k), false) THEN 1 ELSE 0 END AS head FROM s),
n AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts, k ROWS UNBOUNDED PRECEDING) AS n FROM h)
SELECT user_id, CAST(n AS BIGINT) AS n, min(ts) AS opened_at, count(*) FILTER (o) AS facts, CASE WHEN min(ts) FILTER (NOT o) <= min(ts) + INTERVAL 24 HOURS THEN min(ts) FILTER (NOT o) END AS resolved_at FROM n WHERE n > 0 GROUP BY 1, 2""")
def attention_episodes(t):
    out = machine.episodes(_canonical(t.events))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select(F.col("id").cast("long").alias("user_id"), "n", ntz("opened_at"), "facts", ntz("resolved_at"))


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
_HALF_DAY = 43_200


def _pick(kind, **names):
    """What stands for each kind of event."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _dealt(t):
    """The events by the source that they are dealt to: envelopes, transcript lines and polls of half days, each as its source writes it."""
    e = t.events.select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("session"), F.date_format("ts", _ISO).alias("at"))
    hook = e.where("event_id % 3 = 0").withColumn("name", _pick(F.col("kind"), error="PostToolUseFailure", purchase="Stop", signup="PermissionRequest", click="PreToolUse", view="UserPromptSubmit"))
    payload = F.struct("session", F.col("session").alias("session_id"), F.col("name").alias("hook_event_name"), F.col("at").alias("timestamp"), F.col("event_id").cast("string").alias("event_id"), F.col("kind").alias("tool_name"))
    hooks = hook.select("event_id", F.to_json(F.struct(F.lit("kimi-code").alias("provider"), payload.alias("payload"))).alias("value"))
    paused = (F.col("kind") == "signup") & (F.col("event_id") % 2 == 0)
    said = F.when(paused, "turn_aborted").otherwise(_pick(F.col("kind"), error="error", purchase="task_complete", signup="request_user_input", click="exec_command_begin", view="agent_message"))
    line = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.col("at").alias("timestamp"), "event_id", F.struct(said.alias("type"), F.when(paused, "paused").alias("reason")).alias("payload")))
    lines = e.where("event_id % 3 = 1").select("event_id", "session", line.alias("value"))
    half = F.floor(F.unix_seconds("ts") / _HALF_DAY)
    status = _pick(F.col("kind"), error="error", purchase="completed", signup="waiting", click="running", view="running")
    shown = e.where("event_id % 3 = 2").groupBy(half.alias("half"), "session").agg(F.max(F.struct("ts", "event_id", "at", status.alias("status"), "kind")).alias("s"))
    bounds = t.events.where("event_id % 3 = 2").agg(F.min(half).alias("low"), F.max(half).alias("high"))
    poll = F.date_format(F.timestamp_seconds((F.col("half") + 1) * _HALF_DAY), _ISO).alias("poll")
    rows = shown.select("half", poll, F.lit("kimi-code").alias("agent"), "session", F.col("s.status").alias("status"), F.col("s.kind").alias("phase"), F.col("s.kind").alias("label"), F.col("s.at").alias("updated_at"))
    ends = bounds.select(F.explode(F.sequence("low", "high")).alias("half")).select("half", poll, F.lit("kimi-code").alias("agent"), *[F.lit(None).cast("string").alias(c) for c in ("session", "status", "phase", "label", "updated_at")])
    return hooks, lines, rows.unionByName(ends)


@plan("""
WITH RECURSIVE e AS (SELECT event_id, user_id AS u, ts, event_type AS kind, event_id % 3 AS src, CAST(floor(epoch_us(ts) / 43200000000) AS BIGINT) AS half FROM events),
seen AS (SELECT u, half, max(ts) AS ts, arg_max(kind, (ts, event_id)) AS kind FROM e WHERE src = 2 GROUP BY u, half),
f AS (
  SELECT u, ts, 'hook' AS origin, CASE kind WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'waiting' ELSE 'running' END AS status,
    CASE kind WHEN 'error' THEN 'tool-failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'needs-you' WHEN 'click' THEN 'using-tool' ELSE 'thinking' END AS phase, kind AS label, CASE kind WHEN 'signup' THEN 'needs-you' END AS reason, true AS live FROM e WHERE src = 0
  UNION ALL
  SELECT u, ts, 'transcript', CASE kind WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'paused' ELSE 'waiting' END ELSE 'running' END,
    CASE kind WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'aborted' ELSE 'needs-you' END WHEN 'click' THEN 'using-tool' ELSE 'working' END,
    CASE kind WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'task_complete' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'turn_aborted' ELSE 'request_user_input' END WHEN 'click' THEN 'exec_command_begin' ELSE 'agent_message' END,
    CASE WHEN kind = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'turn-paused' ELSE 'request_user_input' END END, event_id % 4 <> 0 FROM e WHERE src = 1
  UNION ALL
  SELECT u, ts, 'poll', CASE kind WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'waiting' ELSE 'running' END, kind, kind, NULL, true FROM seen
  UNION ALL
  SELECT s.u, to_timestamp((s.half + 2) * 43200)::TIMESTAMP, 'gone', NULL, NULL, NULL, NULL, true FROM seen s LEFT JOIN seen n ON n.u = s.u AND n.half = s.half + 1
  WHERE n.u IS NULL AND s.half < (SELECT max(half) FROM seen)
), o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, origin) AS r, count(*) OVER (PARTITION BY u) AS n FROM f),
s AS (
  SELECT DISTINCT u, CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS phase, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS TIMESTAMP) AS started, CAST(NULL AS TIMESTAMP) AS updated, CAST(NULL AS TIMESTAMP) AS ended, CAST([] AS VARCHAR[]) AS actions FROM o
  UNION ALL
  SELECT u, r, CASE op WHEN 0 THEN NULL WHEN 1 THEN s_status ELSE status END, CASE op WHEN 0 THEN NULL WHEN 1 THEN s_phase ELSE phase END, CASE op WHEN 0 THEN NULL WHEN 1 THEN s_reason ELSE reason END,
    CASE WHEN op = 0 THEN NULL WHEN op = 1 THEN started WHEN op = 2 OR (act AND NOT was) THEN ts ELSE started END, CASE op WHEN 0 THEN NULL WHEN 1 THEN updated ELSE ts END,
    CASE WHEN op = 0 THEN NULL WHEN op = 1 THEN ended WHEN act THEN NULL WHEN op = 2 OR was THEN ts ELSE ended END,
    CASE WHEN op = 0 THEN [] WHEN op = 1 THEN actions WHEN op = 2 OR (act AND s_status = 'completed') THEN [label] ELSE list_append(actions, label)[-3:] END
  FROM (
    SELECT o.*, s.status AS s_status, s.phase AS s_phase, s.reason AS s_reason, s.started, s.updated, s.ended, s.actions, o.status = 'running' AS act, s.status = 'running' AS was,
      CASE WHEN origin = 'gone' THEN 0 WHEN origin = 'transcript' AND (s.status IS NULL OR (o.status = 'completed' AND NOT live AND s.status <> 'completed')
        OR (o.status = 'running' AND s.status IN ('waiting', 'error') AND s.reason IS DISTINCT FROM 'turn-paused')) THEN 1 WHEN s.status IS NULL THEN 2 ELSE 3 END AS op
    FROM s JOIN o ON o.u = s.u AND o.r = s.r + 1
  )
)
SELECT substr(sha256('kimi-code:' || s.u), 1, 16) AS id, s.status, s.phase, s.reason, s.started AS started_at, s.updated AS updated_at, s.ended AS activity_ended_at, array_to_string(s.actions, ',') AS actions
FROM s JOIN (SELECT DISTINCT u, n FROM o) l ON l.u = s.u AND l.n = s.r WHERE s.status IS NOT NULL""")
def three_sources_in_one_state(t):
    """Sessions from hooks, transcripts and polls that arrive out of order, in two runs of one query, some facts repeated."""
    folder, spark = _shared(t.spark), t.spark
    hooks, lines, polls = _dealt(t)
    landed = F.pmod(F.xxhash64("event_id"), F.lit(2))
    for turn in (0, 1):
        # What the first run had comes again in part; snapshots of odd half days come before the even ones.
        hooks.where((landed == turn) | (F.col("event_id") % 20 == 0)).select("value").write.mode("append").text(f"{folder}/hooks")
        sinks.log_files(lines.where(landed == turn), f"{folder}/lines", "session", ["event_id"], f"part-{turn}.txt")
        polls.where(F.pmod("half", F.lit(2)) == 1 - turn).withColumn("name", F.format_string(f"{turn}-%012d", "half")).drop("half").repartition("name").write.mode("append").partitionBy("name").json(f"{folder}/polls")
        facts = (
            fusion.hook_facts(envelopes.canonical(spark.readStream.text(f"{folder}/hooks")))
            .unionByName(fusion.transcript_facts(tail.follow(spark, f"{folder}/lines".removeprefix("file://"), "*.txt", listings=f"{folder}/listings".removeprefix("file://")), "kimi-code", F.regexp_extract("path", "session=([^/]+)/", 1), F.get_json_object("raw", "$.event_id").cast("long") % 4 != 0))
            .unionByName(fusion.poll_facts(fusion.polled(spark, f"{folder}/polls")))
        )
        # The second time this is a new query over the first one's checkpoint.
        changes = fusion.run_to_end(fusion.fused_sessions(facts), f"{folder}/run")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return fusion.latest_cards(changes).select("id", "status", "phase", "reason", *map(ntz, fusion.TIMES), F.array_join("actions", ",").alias("actions"))


_ATTENTION_DELAY, _ATTENTION_WINDOW = 48 * 3600, 5 * 86_400


def _open(kind: str, opens: str, rule: str) -> str:
    """SQL for the open episode of a kind after the row: kept, closed, opened or touched."""
    return f"""CASE WHEN {opens} AND ({kind} IS NULL OR ends_{kind} IS NOT NULL) THEN {{'opened': tm, 'last': tm, 'facts': 1::BIGINT, 'rule': {rule}, 'feedback': NULL::VARCHAR, 'snoozed': NULL::TIMESTAMP}}
      WHEN {kind} IS NULL OR ends_{kind} IS NOT NULL THEN NULL
      WHEN {opens} THEN {{'opened': {kind}.opened, 'last': tm, 'facts': {kind}.facts + 1, 'rule': {kind}.rule, 'feedback': {kind}.feedback, 'snoozed': {kind}.snoozed}}
      WHEN kind = 'feedback' AND name = '{kind}' THEN {{'opened': {kind}.opened, 'last': {kind}.last, 'facts': {kind}.facts, 'rule': {kind}.rule, 'feedback': category, 'snoozed': CASE WHEN category = 'snoozed' THEN tm + INTERVAL 1 HOUR END}}
      ELSE {kind} END"""


def _ends(kind: str, resolves: str) -> str:
    return f"CASE WHEN s.{kind} IS NULL THEN NULL WHEN f.tm > s.{kind}.opened + INTERVAL 24 HOURS THEN 'expired' WHEN {resolves} THEN 'resolved' END AS ends_{kind}"


def _given(kind: str) -> str:
    """SQL for the episode that a row ended, or that is left open at the end and whose day the watermark has passed or not."""
    columns = f"'{kind}' AS kind, x.{kind}.rule AS rule, x.{kind}.opened AS opened_at, x.{kind}.last AS last_at, x.{kind}.facts AS facts, x.{kind}.feedback AS feedback, x.{kind}.snoozed AS snoozed_until"
    day = f"x.{kind}.opened + INTERVAL 24 HOURS"
    return f"""SELECT x.u, {columns}, t.ends_{kind} AS state, CASE t.ends_{kind} WHEN 'expired' THEN {day} ELSE t.tm END AS closed_at FROM s t JOIN s x ON x.u = t.u AND x.r = t.r - 1 WHERE t.ends_{kind} IS NOT NULL
    UNION ALL SELECT x.u, {columns}, CASE WHEN {day} < w.tm THEN 'expired' ELSE 'open' END, CASE WHEN {day} < w.tm THEN {day} END FROM s x JOIN n ON n.u = x.u AND n.n = x.r, w WHERE x.{kind} IS NOT NULL"""


_EPISODE = "STRUCT(opened TIMESTAMP, last TIMESTAMP, facts BIGINT, rule VARCHAR, feedback VARCHAR, snoozed TIMESTAMP)"


@plan(f"""
WITH RECURSIVE f AS (
  SELECT user_id AS u, ts AS tm, 'f' || event_id AS id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'waiting' WHEN 'purchase' THEN 'progress' ELSE 'start' END AS kind, 'n' || event_id % 3 AS name,
    CASE event_id % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'subagent-start' ELSE 'tool' END AS category FROM events
  UNION ALL
  SELECT user_id, ts + INTERVAL 1 SECOND, 'g' || event_id, 'feedback', ['waiting', 'error', 'stuck'][event_id % 3 + 1], ['handled', 'not-relevant', 'not-stuck', 'snoozed'][event_id % 4 + 1] FROM events WHERE event_id % 7 = 3
), o AS (SELECT *, CASE category WHEN 'subagent-start' THEN category ELSE name END AS what, row_number() OVER (PARTITION BY u ORDER BY tm, id) AS r FROM f),
n AS (SELECT u, max(r) AS n FROM o GROUP BY u),
w AS (SELECT max(tm) - INTERVAL 48 HOURS AS tm FROM f),
s AS (
  SELECT DISTINCT u, CAST(0 AS BIGINT) AS r, CAST(NULL AS TIMESTAMP) AS tm, CAST(NULL AS {_EPISODE}) AS waiting, CAST(NULL AS {_EPISODE}) AS error, CAST(NULL AS {_EPISODE}) AS stuck,
    CAST([] AS STRUCT(what VARCHAR, tm TIMESTAMP)[]) AS failures, CAST([] AS VARCHAR[]) AS starts, CAST(NULL AS VARCHAR) AS ends_waiting, CAST(NULL AS VARCHAR) AS ends_error, CAST(NULL AS VARCHAR) AS ends_stuck FROM o
  UNION ALL
  SELECT u, r, tm,
    {_open('waiting', "kind = 'waiting'", "'waiting'")},
    {_open('error', "kind = 'failure'", "'error'")},
    {_open('stuck', "again", "CASE WHEN kind = 'start' THEN 'repeated-start' WHEN what = 'subagent-start' THEN 'subagent-start-failures' ELSE 'repeated-failure' END")},
    CASE WHEN kind = 'progress' THEN [] WHEN kind = 'failure' AND category <> 'read' THEN list_append(failures, {{'what': what, 'tm': tm}}) ELSE failures END,
    CASE WHEN kind = 'progress' THEN [] WHEN kind = 'start' AND category <> 'read' THEN list_append(starts, name) ELSE starts END,
    ends_waiting, ends_error, ends_stuck
  FROM (
    SELECT f.u, f.r, f.tm, f.kind, f.name, f.category, f.what, s.waiting, s.error, s.stuck, s.failures, s.starts,
      {_ends('waiting', "f.kind IN ('progress', 'start')")}, {_ends('error', "f.kind IN ('progress', 'start')")}, {_ends('stuck', "f.kind = 'progress'")},
      f.category <> 'read' AND ((f.kind = 'failure' AND len(list_filter(s.failures, lambda x: x.what = f.what AND x.tm >= f.tm - INTERVAL 5 DAYS)) >= 2)
        OR (f.kind = 'start' AND len(list_filter(s.starts, lambda x: x = f.name)) >= 2)) AS again
    FROM s JOIN o f ON f.u = s.u AND f.r = s.r + 1
  )
)
SELECT u AS user_id, kind, rule, opened_at, last_at, facts, feedback, snoozed_until, state, closed_at FROM ({' UNION ALL '.join(map(_given, attention.KINDS))})""")
def attention_in_a_stream(t):
    """Facts and feedback arrive up to 36 hours late in six parts, each a run of its own over one checkpoint, some of them twice."""
    folder, spark, id_ = _shared(t.spark), t.spark, F.col("event_id").cast("string")
    late = F.pmod(F.xxhash64("event_id"), F.lit(36 * 3600))
    e = t.events.select("event_id", "ts", F.col("user_id").cast("string").alias("id"), "event_type", (F.unix_seconds("ts") + late).alias("arrives"))
    kind = _pick(F.col("event_type"), error="failure", signup="waiting", purchase="progress", click="start", view="start")
    category = F.when(F.col("event_id") % 5 == 0, "read").when(F.col("event_id") % 5 == 1, attention.SUBAGENT).otherwise("tool")
    facts = e.select("id", kind.alias("kind"), F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("name"), category.alias("category"), F.col("ts").alias("at"), F.concat(F.lit("f"), id_).alias("order_key"), F.concat(F.lit("f"), id_).alias("fact_id"), "arrives")
    told = e.where("event_id % 7 = 3")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % n + 1).cast("int"))
    action = pick(("handled", "not-relevant", "not-stuck", "snoozed"), 4)
    feedback = told.select("id", F.lit("feedback").alias("kind"), pick(attention.KINDS, 3).alias("name"), action.alias("category"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("at"), F.concat(F.lit("g"), id_).alias("order_key"), F.concat(F.lit("g"), id_).alias("fact_id"), "arrives")
    low, high = e.agg(F.min("arrives"), F.max("arrives")).first()
    part = F.least(F.floor((F.col("arrives") - low) * 6 / (high - low + 1)), F.lit(5))
    again = F.pmod(F.xxhash64("fact_id"), F.lit(9)) == 0
    for turn in range(6):
        for name, rows in (("facts", facts), ("feedback", feedback)):
            now = rows.where(part == turn)
            now.unionByName(now.where(again)).drop("arrives").write.mode("append").parquet(f"{folder}/{name}")
        streams = [spark.readStream.schema("id string, kind string, name string, category string, at timestamp, order_key string, fact_id string").parquet(f"{folder}/{n}") for n in ("facts", "feedback")]
        changes = fusion.run_to_end(attention.attention_episodes(*streams, delay=f"{_ATTENTION_DELAY} seconds", window=_ATTENTION_WINDOW), f"{folder}/run")
    found = attention.latest_episodes(changes)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select(F.col("id").cast("long").alias("user_id"), "kind", "rule", *map(ntz, ("opened_at", "last_at")), "facts", "feedback", ntz("snoozed_until"), "state", ntz("closed_at"))
