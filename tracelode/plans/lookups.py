"""Plans of details, watches, feedback, agents, excerpts, validators, guarded merges, staging, exports and followed logs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.operators import lookups
from tracelode.plans.base import plan
from tracelode.plans.logs import OPENCLAW
from tracelode.plans.streams import _shared
from tracelode.plans.texts import picked, picked_sql
from tracelode.sources import sinks, tail


def _plain(*names: str) -> list:
    """Instants as times without a zone."""
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


@plan("SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def watched_sessions(t):
    watches = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("session_id"))
    return lookups.watched(t.orders.select(F.col("o_orderkey").alias("session_id")), watches)


KINDS = ("waiting", "error", "stuck", "completion", "other")


@plan(f"""
WITH e AS (SELECT l_orderkey AS k, l_linenumber % 5 AS r FROM lineitem WHERE l_returnflag <> 'R'), a AS (SELECT k, count(*) AS n, min(r) AS r FROM e GROUP BY 1)
SELECT o_orderkey AS session_id, c_name AS task_title, coalesce(n, 0) AS open_episodes, {picked_sql('r', KINDS)} AS attention FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 LEFT JOIN a ON k = o_orderkey""")
def session_details(t):
    sessions = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("task_id"))
    tasks = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("title"))
    episodes = t.lineitem.select(F.col("l_orderkey").alias("session_id"), picked("l_linenumber", KINDS).alias("kind"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("resolved_at"))
    return lookups.details(sessions, tasks, episodes).select("session_id", "task_title", "open_episodes", "attention")


GIVEN = ("handled", "not-relevant", "not-stuck", "snoozed", "unknown")


@plan(f"""
WITH f AS (SELECT l_orderkey AS k, {picked_sql('l_linenumber', GIVEN)} AS feedback, l_shipdate AS t0 FROM lineitem),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t0 DESC, feedback DESC) AS r FROM f WHERE feedback <> 'unknown')
SELECT o_orderkey AS episode_id, feedback, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, CASE WHEN feedback <> 'snoozed' THEN t0 END) AS resolved_at, CASE WHEN feedback = 'snoozed' THEN t0 + INTERVAL 1 HOUR END AS snoozed_until
FROM orders LEFT JOIN l ON k = o_orderkey AND r = 1""")
def episode_feedback(t):
    episodes = t.orders.select(F.col("o_orderkey").alias("episode_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("resolved_at"))
    given = t.lineitem.select(F.col("l_orderkey").alias("episode_id"), picked("l_linenumber", GIVEN).alias("feedback"), F.col("l_shipdate").alias("given_at"))
    return lookups.with_feedback(episodes, given).select("episode_id", "feedback", *_plain("resolved_at", "snoozed_until"))


ORIGINS, AVAILABLE = ("cli", "app"), ("available", "available", "lost")


@plan(f"""
SELECT o_orderstatus AS status, coalesce({picked_sql('o_orderkey', AVAILABLE)} = 'available' AND (o_orderstatus <> 'F' OR {picked_sql('o_custkey', ORIGINS)} = 'cli'), false) AS notify, count(*) AS n FROM orders GROUP BY 1, 2""")
def notification_eligibility(t):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise(F.col("o_orderstatus"))
    rows = t.orders.select(F.col("o_orderstatus").alias("status"), lookups.notifiable(picked("o_orderkey", AVAILABLE), status, picked("o_custkey", ORIGINS)).alias("notify"))
    return rows.groupBy("status", "notify").agg(F.count("*").alias("n"))


@plan("""
WITH s AS (SELECT n_name AS agent, n_nationkey % 3 <> 0 AS available, n_nationkey % 4 <> 0 AS selected, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS sessions, CASE WHEN n_nationkey % 6 = 0 THEN 'none' ELSE 'hooks' END AS live FROM nation),
u AS (SELECT n_name AS label, sum(c_acctbal) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT 'default' AS list, agent FROM s WHERE available AND selected AND sessions > 0 AND agent IN (SELECT label FROM u WHERE value > 0) UNION ALL SELECT 'filter', agent FROM s WHERE available OR live <> 'none'""")
def visible_agents(t):
    counted = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    k = F.col("n_nationkey")
    sources = t.nation.join(counted, k == F.col("k"), "left").select(F.col("n_name").alias("agent"), (k % 3 != 0).alias("available"), (k % 4 != 0).alias("selected"), F.coalesce("n", F.lit(0)).alias("session_count"), F.when(k % 6 == 0, "none").otherwise("hooks").alias("live_capability"))
    usage = t.customer.join(t.nation, F.col("c_nationkey") == k).groupBy(F.col("n_name").alias("label")).agg(F.sum("c_acctbal").alias("value"))
    return lookups.default_agents(sources, usage).select(F.lit("default").alias("list"), "agent").unionByName(lookups.filter_agents(sources).select(F.lit("filter").alias("list"), "agent"))


METRICS = ("cost", "tokens", "time")


@plan(f"SELECT c_custkey, CASE {picked_sql('c_custkey', METRICS)} WHEN 'cost' THEN c_acctbal > 0 WHEN 'tokens' THEN c_nationkey % 2 = 0 ELSE true END AS visible FROM customer")
def metric_visibility(t):
    shown = F.create_map(F.lit("cost"), F.col("c_acctbal") > 0, F.lit("tokens"), F.col("c_nationkey") % 2 == 0)
    return t.customer.select("c_custkey", lookups.metric_visible(shown, picked("c_custkey", METRICS)).alias("visible"))


SUPPLIERS = ("cursor", "zai", "claude", "codex")


@plan(f"""
WITH p AS (SELECT {picked_sql('s_suppkey', SUPPLIERS)} AS provider, count(*) AS n FROM supplier GROUP BY 1)
SELECT provider, n, CASE provider WHEN 'claude' THEN 0 WHEN 'codex' THEN 1 WHEN 'cursor' THEN 2 ELSE 3 END AS place FROM p""")
def provider_order(t):
    p = t.supplier.groupBy(picked("s_suppkey", SUPPLIERS).alias("provider")).agg(F.count("*").alias("n"))
    return p.withColumn("place", lookups.provider_rank(F.col("provider"))).orderBy("place", "provider")


@plan("SELECT o_orderkey AS session_id FROM orders ORDER BY o_orderkey % 97 = 3 OR o_custkey % 89 = 5 DESC, o_orderdate DESC, o_orderkey LIMIT 1")
def recap_default_session(t):
    rows = t.orders.select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderkey") % 97 == 3).cast("long").alias("files"), (F.col("o_custkey") % 89 == 5).cast("long").alias("lines"), F.col("o_orderdate").alias("started_at"))
    return lookups.recap_session(rows).select("session_id")


@plan("""
SELECT 'u7' AS path, 'Prompt ' || CAST(min(event_id) FILTER (event_type = 'signup') AS VARCHAR) AS prompt, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' END AS output FROM events WHERE user_id = 7""")
def session_excerpt(t):
    return lookups.excerpt(OPENCLAW.rows(t), hashlib.sha256(b"u7").hexdigest()[:16])


LABELS = ("Bash", "Read file", "mcp__a.b-c", "!!!")


@plan(f"""
WITH s AS (SELECT *, list_extract(['waiting', 'completed', 'error', 'running', 'idle'], CAST(o_orderkey % 5 AS INTEGER) + 1) AS status, list_extract(['tool', 'compact', 'note'], CAST(o_custkey % 3 AS INTEGER) + 1) AS kind, {picked_sql('o_orderkey // 3', LABELS)} AS label FROM orders),
e AS (SELECT *, CASE status WHEN 'waiting' THEN 'PermissionRequest' WHEN 'completed' THEN 'SessionEnd' WHEN 'error' THEN 'PostToolUseFailure' ELSE CASE kind WHEN 'tool' THEN 'PreToolUse' WHEN 'compact' THEN 'PreCompact' ELSE 'Resume' END END AS event_name FROM s)
SELECT 's' || CAST(o_orderkey AS VARCHAR) AS source_session_id, event_name, status, substr(sha256('codex|s' || CAST(o_orderkey AS VARCHAR) || '|' || event_name || '|' || status || '|k' || CAST(o_custkey AS VARCHAR)), 1, 16) AS fingerprint,
  CASE WHEN kind = 'tool' THEN '{{"tool_name":"' || CASE label WHEN 'Read file' THEN 'Readfile' WHEN '!!!' THEN 'other' ELSE label END || '"}}' ELSE '{{}}' END AS payload_json FROM e""")
def observed_runtime_events(t):
    status = picked("o_orderkey", ("waiting", "completed", "error", "running", "idle"))
    action = F.struct(picked("o_custkey", ("tool", "compact", "note")).alias("kind"), picked(F.floor(F.col("o_orderkey") / 3), LABELS).alias("label"))
    sessions = t.orders.select(F.lit("codex").alias("agent"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("source_session_id"), status.alias("status"), F.lit("p").alias("phase"), F.lit("x").alias("project_label"), action.alias("action"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("order_key"), F.col("o_orderdate").alias("updated_at"))
    return lookups.observed_events(sessions).select("source_session_id", "event_name", "status", "fingerprint", "payload_json")


IDS = ("", " a b ", "%12", "%x", "/dev/ttys001", "/dev/tty/" + "x" * 60, "a:b.c-d", "é", "p%q", "y" * 81)


@plan(f"""
WITH i AS (SELECT c_custkey, {picked_sql('c_custkey', IDS)} AS x FROM customer)
SELECT c_custkey, regexp_full_match(x, '[A-Za-z0-9_:.-]{{1,160}}') AS live, regexp_full_match(x, '[A-Za-z0-9_:.%-]{{1,160}}') AS target, regexp_full_match(x, '%[0-9]+') AS pane, regexp_full_match(x, '/dev/tty[A-Za-z0-9/_]*') AND length(x) <= 64 AS device,
  CASE WHEN regexp_full_match(trim(x), '[A-Za-z0-9_. -]{{1,80}}') THEN trim(x) END AS label, CASE WHEN regexp_full_match(trim(x), '[A-Za-z0-9_.-]{{1,80}}') THEN trim(x) END AS tool FROM i""")
def live_validators(t):
    x = picked("c_custkey", IDS)
    return t.customer.select(
        "c_custkey", text.live_identifier(x).alias("live"), text.target_identifier(x).alias("target"), text.terminal_pane(x).alias("pane"), text.terminal_device(x).alias("device"), text.safe_label(x).alias("label"), text.safe_tool_name(x).alias("tool"),
    )


STATES = {"click": "running", "view": "idle", "signup": "waiting", "purchase": "completed", "error": "error"}


@plan(f"""
WITH e AS (SELECT user_id AS id, ts AS t0, event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())} END AS status, event_id % 3 = 0 AS paused, event_id % 2 = 0 AS live FROM events WHERE event_type <> 'view' OR event_id % 4 = 0),
a AS (SELECT *, status IN ('waiting', 'error', 'idle') OR (status = 'completed' AND live) AS sets FROM e),
b AS (SELECT *, coalesce(last_value(CASE WHEN sets THEN status IN ('waiting', 'error') AND NOT paused END IGNORE NULLS) OVER (PARTITION BY id ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS sticky FROM a),
c AS (SELECT *, sets OR (status = 'running' AND NOT sticky) AS counts FROM b),
d AS (SELECT *, last_value(CASE WHEN counts THEN status END IGNORE NULLS) OVER (PARTITION BY id ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM c),
k AS (SELECT * FROM d WHERE counts OR (status = 'completed' AND NOT live AND coalesce(was = 'completed', false))),
r AS (SELECT id, list(status ORDER BY t0, event_id)[-1] AS status, max(t0) AS updated_at, coalesce(max(t0) FILTER (status = 'running' AND was IN ('waiting', 'error', 'completed')), min(t0)) AS started_at,
  max(t0) FILTER (status NOT IN ('idle', 'running') AND coalesce(was IN ('idle', 'running'), true)) AS stopped FROM k GROUP BY 1)
SELECT id, status, updated_at, started_at, CASE WHEN status NOT IN ('idle', 'running') THEN stopped END AS activity_ended_at FROM r""")
def guarded_states(t):
    n = F.col("event_id")
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("event_type"))
    signals = t.events.where("event_type <> 'view' OR event_id % 4 = 0").select(
        F.col("user_id").alias("id"), F.col("ts").alias("at"), F.lpad(n.cast("string"), 20, "0").alias("order_key"), status.alias("status"), F.when(n % 3 == 0, "turn-paused").alias("reason"), (n % 2 == 0).alias("live"),
    )
    return lookups.guarded_merge(signals).select("id", "status", *_plain("updated_at", "started_at", "activity_ended_at"))


@plan("SELECT o_orderkey AS session_id, o_custkey AS source, true AS in_order FROM orders")
def staged_sessions(t):
    rows = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("source"))
    staged = sinks.stage(rows, _shared(t.spark), ["source", "session_id"])
    # Ordinals of one source rise with its sessions.
    w = Window.partitionBy("source").orderBy("session_id")
    return staged.select("session_id", "source", F.coalesce(F.col("ordinal") > F.lag("ordinal").over(w), F.lit(True)).alias("in_order"))


@plan("SELECT 'recap' AS template, kind, (SELECT count(*) FROM customer) AS n_rows, TIMESTAMP '2024-02-01 00:00:00' AS exported_at FROM (VALUES ('json'), ('csv'), ('parquet')) k(kind)")
def export_audit(t):
    cards, at = t.customer.select("c_custkey", "c_name", "c_acctbal"), F.lit("2024-02-01").cast("timestamp_ntz")
    return sinks.union_all([sinks.export(cards, _shared(t.spark), kind, "recap", at) for kind in ("json", "csv", "parquet")])


def _grown_logs(t) -> str:
    """A folder with a log file of each user, a line an event."""
    folder = _shared(t.spark)
    if not folder.startswith("file:") and "://" in folder:
        raise ValueError("logs are followed in a file system that driver and executors have in common")
    line = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}"))
    sinks.log_files(t.events.select("user_id", "event_id", line.alias("value")), folder, "user_id", ["event_id"])
    return folder.removeprefix("file://")


@plan("SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def followed_lines(t):
    at = _shared(t.spark)
    query = tail.follow(t.spark, _grown_logs(t), "*.txt").writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = t.spark.read.schema("path string, at long, raw string").parquet(f"{at}/rows")
    user = F.regexp_extract("path", r"user_id=(\d+)", 1).cast("long")
    return rows.groupBy(user.alias("user_id")).agg(F.count("*").alias("n"), F.sum(F.try_variant_get(F.try_parse_json("raw"), "$.id", "bigint")).alias("ids"))


@plan("""
WITH l AS (SELECT user_id, event_id, length(CAST(event_id AS VARCHAR)) + 8 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
s AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY r) AS back FROM l)
SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM s WHERE back <= 100 GROUP BY 1""")
def last_lines(t):
    rows = tail.tail(t.spark, _grown_logs(t), "*.txt", last_bytes=100)
    record = F.try_parse_json("raw")
    user = F.regexp_extract("path", r"user_id=(\d+)", 1).cast("long")
    return rows.where(record.isNotNull()).groupBy(user.alias("user_id")).agg(F.count("*").alias("n"), F.min(F.try_variant_get(record, "$.id", "bigint")).alias("first_id"))


@plan("""
WITH s AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 1),
e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
ev AS (SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) FILTER (r <= 20) AS names FROM e GROUP BY 1),
f AS (SELECT user_id, 'f' || CAST(floor(value) AS BIGINT) % 9 AS path, sum(event_id % 5) AS added, count(*) AS changes FROM events WHERE event_type = 'click' GROUP BY 1, 2),
fl AS (SELECT user_id, string_agg(path || ':' || CAST(added AS BIGINT) || ':' || changes, ',' ORDER BY path) AS files FROM f GROUP BY 1),
m AS (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'm' || event_id % 3 END AS model, CAST(sum(floor(value)) AS BIGINT) AS tokens, bool_and(event_id % 10 <> 0) AS known FROM events WHERE event_type = 'view' GROUP BY 1, 2),
ml AS (SELECT user_id, string_agg(model || ':' || tokens || ':' || CASE WHEN known THEN 'known' ELSE '?' END, ',' ORDER BY model) AS usage FROM m GROUP BY 1),
c AS (SELECT user_id, count(DISTINCT CAST(floor(value) AS BIGINT) % 50) AS commits FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT s.user_id AS session_id, coalesce(n, 0) AS event_count, coalesce(names, '') AS names, coalesce(files, '') AS files, coalesce(usage, '') AS usage, coalesce(commits, 0) AS commits
FROM s LEFT JOIN ev USING (user_id) LEFT JOIN fl USING (user_id) LEFT JOIN ml USING (user_id) LEFT JOIN c USING (user_id)""")
def details_of_sessions(t):
    e, i, v = t.events.withColumnRenamed("user_id", "session_id"), F.col("event_id"), F.floor("value")
    none = F.lit(None)
    events = e.select("session_id", i.alias("sequence"), "ts", "event_type", none.cast("string").alias("category"), none.cast("string").alias("name"), none.cast("boolean").alias("success"))
    files = e.where("event_type = 'click'").groupBy("session_id", F.concat(F.lit("f"), (v % 9).cast("string")).alias("path")).agg(F.lit("modified").alias("kind"), F.sum(i % 5).alias("added"), F.lit(0).cast("long").alias("removed"), F.count("*").alias("changes"))
    used = e.where("event_type = 'view'").select("session_id", F.when(i % 4 != 0, F.concat(F.lit("m"), (i % 3).cast("string"))).alias("model"), v.alias("total_tokens"), F.when(i % 10 != 0, v / 4).alias("cost"))
    commits = e.where("event_type = 'purchase'").select("session_id", F.col("ts").alias("committed_at"), (v % 50).cast("string").alias("commit"), F.lit("s").alias("subject"))
    out = lookups.session_detail(e.where("session_id % 3 <> 1").select("session_id").distinct(), events, files, used, commits, most_events=20)
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select(
        "session_id", "event_count", joined("events", lambda x: x["event_type"]).alias("names"), joined("files", lambda x: F.concat_ws(":", x["path"], x["added"].cast("string"), x["changes"].cast("string"))).alias("files"),
        joined("usage", lambda x: F.concat_ws(":", x["model"], x["total_tokens"].cast("string"), F.when(x["cost"].isNull(), "?").otherwise("known"))).alias("usage"), F.size("commits").cast("long").alias("commits"),
    )
