"""Join, set and text plans over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.functions import text, timefn
from tracelode.operators import attention, joins, live, sessions, trajectory, usage
from tracelode.plans.base import plan


@plan("""
SELECT user_id, event_id, event_type FROM events e WHERE date_trunc('hour', ts) = (SELECT max(date_trunc('hour', ts)) FROM events x WHERE x.user_id = e.user_id)""")
def latest_per_key_ties(t):
    rows = t.events.select("user_id", "event_id", "event_type", F.date_trunc("hour", "ts").alias("h"))
    return joins.latest_with_ties(rows, ["user_id"], "h").drop("h")


@plan("""
WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id AS parent, ts AS pts FROM events WHERE event_type = 'purchase')
SELECT e.user_id, e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(p.pts) <= 86400 * 1000000::BIGINT THEN p.parent END AS parent_event FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.pts""")
def asof_parent(t):
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    found = joins.as_of(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("event")), ["user_id"], "ts", 86_400, ["event"])
    return found.select("user_id", "event_id", "parent_event")


@plan("""
SELECT event_id FROM events a WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts AND b.event_type = 'error')""")
def anti_newer(t):
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    return joins.not_superseded(e.where("event_type = 'purchase'"), e.select("user_id", F.col("ts").alias("at"), "event_type"), ["user_id"], "ts", "at", F.col("event_type") == "error").select("event_id")


@plan("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS stuck FROM customer")
def semi_open(t):
    return joins.overlay_exists(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "stuck")


@plan("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS label FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS m, min(o_orderpriority) AS label FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.label, b.label) AS label, n, m FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_lanes(t):
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderpriority", "o_orderstatus")
    a = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("label"))
    b = o.where("o_orderstatus = 'P'").groupBy("k").agg(F.count("*").alias("m"), F.min("o_orderpriority").alias("label"))
    return joins.merged(a, b, ["k"])


@plan("""
WITH s AS (SELECT user_id, min(ts) AS a, min(ts) + INTERVAL 5 DAY AS b FROM events GROUP BY 1)
SELECT e.event_id, s.user_id FROM events e JOIN s ON e.user_id = s.user_id AND e.ts BETWEEN s.a AND s.b WHERE e.event_type = 'purchase'""")
def interval_commits(t):
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    spans = e.groupBy("user_id").agg(F.min("ts").alias("a")).withColumn("b", F.col("a") + F.expr("INTERVAL 5 DAYS"))
    return joins.within_interval(e.where("event_type = 'purchase'"), spans, ["user_id"], "ts", "a", "b").select("event_id", "user_id")


@plan("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'view') DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def merge_prefers_known(t):
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    return joins.newest_known(rows, ["user_id"], F.col("event_type") != "view", "ts").select("user_id", "event_type", "event_id")


@plan("""
SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS name FROM orders UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_name FROM customer""")
def union_hetero(t):
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@plan("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 7 = 0")
def set_difference(t):
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.where("o_orderstatus = 'P' AND o_orderkey % 7 = 0").select(F.col("o_custkey").alias("id")))


@plan("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select(F.col("s_nationkey").alias("k")))


@plan("SELECT user_id, list_sort(list(DISTINCT event_type)) AS labels FROM events GROUP BY 1")
def label_union(t):
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("labels"))


@plan("""
SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '00') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50""")
def session_filter_page(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", F.col("c_mktsegment").alias("agent"), F.col("c_name").alias("title"))
    return sessions.page(sessions.filtered(rows, agent="BUILDING", search="00", search_in=("title",)), [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 50).select("o_orderkey", "o_totalprice")


@plan("""
SELECT 'segment' AS facet, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2""")
def facets(t):
    return sessions.facets(t.customer, {"segment": "c_mktsegment", "nation": "c_nationkey"})


@plan(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents),
r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?:/Users/[^\s]+|/home/[^\s]+|[A-Z]:\\Users\\[^\s]+)', '[path]', 'gi'), '\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[email]', 'gi'),
  '(?:sk-[a-z0-9_-]{12,}|api[_-]?key\s*[:=]\s*\S+|authorization:\s*bearer\s+\S+|-----BEGIN [A-Z ]*PRIVATE KEY-----)', '[secret]', 'gi'), '(?:https?://|git@)[^\s]+(?:\.git)?', '[url]', 'gi') AS s FROM d WHERE s <> '')
SELECT doc_id, CASE WHEN length(s) > 240 THEN substr(s, 1, 240) || '…' ELSE s END AS excerpt FROM r""")
def redact_text(t):
    return t.documents.select("doc_id", text.bounded_text(F.col("text"), text.PROMPT_CHARS).alias("excerpt")).where(F.col("excerpt").isNotNull())


@plan(r"""
SELECT conv_id, turn, coalesce(nullif(trim(regexp_replace(trim(text), '^(?:\s*(?:\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\(|\[[^\]]*\]|\(?\[[a-z]+\]\)?|/[\w.:-]+|@[^\s]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\d+[.)、]|[-*·•])\s*)+', '')), ''), trim(text)) AS title FROM conversations WHERE role = 'user'""")
def clean_titles(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", text.clean_title(F.col("text")).alias("title"))


@plan(r"""
WITH f AS (SELECT text, regexp_matches(text, 'sk-[a-z0-9_-]{12,}|api[_-]?key\s*[:=]\s*\S+|authorization:\s*bearer\s+\S+|-----BEGIN [A-Z ]*PRIVATE KEY-----', 'i') AS secret,
  regexp_matches(text, '/Users/[^\s]+|/home/[^\s]+|[A-Z]:\\Users\\[^\s]+|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b|(?:https?://|git@)[^\s]+', 'i') AS other FROM documents)
SELECT CASE WHEN secret THEN 'block' WHEN other THEN 'review' ELSE 'safe' END AS decision, count(*) AS n FROM f GROUP BY 1""")
def share_guard(t):
    return t.documents.groupBy(text.share_decision(F.col("text")).alias("decision")).agg(F.count("*").alias("n"))


@plan(r"""
WITH u AS (SELECT conv_id, text, string_split(text, chr(10)) AS lines FROM conversations WHERE role = 'user')
SELECT conv_id, count(*) AS prompts, CAST(sum(length(text)) AS BIGINT) AS characters,
  count(*) FILTER (len(lines) >= 3 OR len(list_filter(lines, lambda x: regexp_matches(trim(x), '^(?:- |\* |1\.|1、|##)'))) > 0 OR contains(text, '```')) AS structured,
  count(*) FILTER (regexp_matches(lower(text), 'acceptance|done when|must pass|definition of done')) AS acceptance,
  count(*) FILTER (regexp_matches(lower(text), 'file|folder|directory|module|do not change|only change')) AS scoped FROM u GROUP BY 1""")
def prompt_structure_rates(t):
    c = F.col("text")
    return t.conversations.where("role = 'user'").groupBy("conv_id").agg(
        F.count("*").alias("prompts"), F.sum(F.length(c)).alias("characters"), F.count_if(text.structured_prompt(c)).alias("structured"),
        F.count_if(text.mentions(c, text.ACCEPTANCE_WORDS)).alias("acceptance"), F.count_if(text.mentions(c, text.SCOPE_WORDS)).alias("scoped"),
    )


@plan("""
WITH e AS (SELECT *, user_id % 3 AS g, count(*) OVER (PARTITION BY user_id % 3 ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT event_id, g, n AS failures FROM e WHERE n >= 3""")
def stuck_rule_10m(t):
    rows = t.events.select("event_id", (F.col("user_id") % 3).alias("g"), "ts")
    return attention.repeated(rows, ["g"], "ts", 600, 3).select("event_id", "g", F.col("repeats").alias("failures"))


@plan("""
WITH e AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')
SELECT event_id, user_id, n AS failures FROM e WHERE n >= 3""")
def stuck_rule_1d(t):
    rows = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return attention.repeated(rows, ["user_id"], "ts", 86_400, 3).select("event_id", "user_id", F.col("repeats").alias("failures"))


@plan("SELECT event_type, round(quantile_cont(value, 0.95), 9) AS p95, count(*) AS n FROM events GROUP BY 1")
def attention_p95(t):
    return t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 9).alias("p95"), F.count("*").alias("n"))


@plan("""
WITH l AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, sha256(CAST(event_id AS VARCHAR)) DESC) AS r FROM events),
s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'waiting' ELSE 'running' END AS status, ts AS updated_at, CAST(epoch_us(TIMESTAMP '2024-01-30 12:00:00') / 1000000.0 AS DOUBLE) - epoch_us(ts) / 1000000.0 AS age FROM l WHERE r = 1)
SELECT user_id, status, updated_at, CASE WHEN greatest(trunc(age), 0) <= 30 THEN 'fresh' WHEN greatest(trunc(age), 0) <= 120 THEN 'aging' ELSE 'lost-update' END AS freshness FROM s""")
def live_snapshot_batch(t):
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "purchase", "completed").when(kind == "signup", "waiting").otherwise("running")
    rows = t.events.select("user_id", status.alias("status"), F.col("ts").alias("updated_at"), F.sha2(F.col("event_id").cast("string"), 256).alias("order_key"))
    out = live.latest_state(rows, ["user_id"]).withColumn("freshness", live.freshness(F.col("updated_at"), F.lit("2024-01-30 12:00:00").cast("timestamp")))
    return out.select("user_id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "freshness")


@plan("""
WITH e AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, min(ts) OVER (PARTITION BY user_id) AS lo, max(ts) OVER (PARTITION BY user_id) AS hi FROM events)
SELECT event_id, round(CASE WHEN hi > lo THEN (epoch_us(ts) - epoch_us(lo)) * 100.0 / (epoch_us(hi) - epoch_us(lo)) ELSE 0 END, 6) AS x0, round(CASE WHEN hi > lo THEN (epoch_us(coalesce(nxt, ts)) - epoch_us(lo)) * 100.0 / (epoch_us(hi) - epoch_us(lo)) ELSE 0 END, 6) AS x1 FROM e""")
def trajectory_spans(t):
    rows = t.events.select("user_id", "event_id", "ts")
    out = trajectory.spans(rows, ["user_id"], "event_id", "ts")
    return out.select("event_id", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@plan("""
WITH w AS (SELECT o AS k, TIMESTAMP '2024-01-31' - to_days(CAST(o * 14 AS INTEGER)) AS e, TIMESTAMP '2024-01-31' - to_days(CAST(o * 14 + 13 AS INTEGER)) AS s FROM range(6) t(o))
SELECT strftime(s, '%Y-%m-%d') AS period_start, count(*) AS records, round(avg(value), 9) AS mean FROM w JOIN events ON ts BETWEEN s AND e GROUP BY 1 HAVING count(*) >= 2""")
def trend_windows(t):
    rows = sessions.trend_windows(t.events, "ts", "2024-01-31 00:00:00")
    return rows.groupBy("period_start").agg(F.count("*").alias("records"), F.round(F.avg("value"), 9).alias("mean")).where("records >= 2")


@plan("""
WITH s AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS edits, count(*) FILTER (l_linestatus = 'O') AS verifications, bool_or(l_discount > 0.09) AS committed FROM lineitem GROUP BY 1)
SELECT CASE WHEN edits <= 0 THEN 'not-applicable' WHEN verifications > 0 OR committed THEN 'verified' ELSE 'unverified' END AS state, count(*) AS n FROM s GROUP BY 1""")
def verification_states(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("edits"), F.count_if(F.col("l_linestatus") == "O").alias("verifications"), F.bool_or(F.col("l_discount") > 0.09).alias("committed"))
    return rows.groupBy(usage.verification_state(F.col("edits"), F.col("verifications"), F.col("committed")).alias("state")).agg(F.count("*").alias("n"))


COMMANDS = ("git diff --stat", "cd app && npm test", "FOO=1 cargo clippy", "npx tsc -p .", "pnpm run build; ls", "pip install x", "vite --host", "docker push a/b", "echo hi", "env CI=1 pytest -q")
WANTED = ("git-review", "test", "lint", "typecheck", "build", "dependency", "preview", "deploy", "shell", "test")


@plan(f"""
WITH c(k, category) AS (VALUES {', '.join(f"({i}, '{w}')" for i, w in enumerate(WANTED))})
SELECT user_id, category, count(*) AS n FROM events JOIN c ON event_id % 10 = k GROUP BY 1, 2""")
def command_category(t):
    command = F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("event_id") % 10 + 1).cast("int"))
    return t.events.select("user_id", text.command_category(command).alias("category")).groupBy("user_id", "category").agg(F.count("*").alias("n"))


@plan("""
SELECT CASE WHEN regexp_matches(event_type, 'read|view') THEN 'read' WHEN regexp_matches(event_type, 'search|grep|glob') THEN 'search' WHEN regexp_matches(event_type, 'edit|write|patch') THEN 'edit' ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1""")
def tool_category(t):
    return t.events.groupBy(text.tool_category(F.col("event_type")).alias("category")).agg(F.count("*").alias("n"))


@plan("""
SELECT user_id, event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-30' ORDER BY ts DESC, event_id LIMIT 64""")
def recent_newest_64(t):
    rows = t.events.select("user_id", "event_id", "ts")
    return live.newest(rows, "ts", F.lit("2024-01-30").cast("timestamp"), 86_400, 64, "event_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@plan("""
WITH r AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) FILTER (role = 'user') AS cycles, count(*) FILTER (role = 'assistant' AND before = 'user') AS answered FROM r GROUP BY 1""")
def activity_cycles(t):
    return trajectory.cycles(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "cycles", "answered")


@plan("SELECT user_id, list_slice(list(event_type ORDER BY ts, event_id), -3, -1) AS actions FROM events GROUP BY 1")
def last_three_actions(t):
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    return live.last_actions(rows, ["user_id"], ["ts", "event_id"], "event_type", 3)


@plan("""
WITH s AS (SELECT CASE WHEN hour(ts) <= 5 THEN 'night' WHEN hour(ts) <= 11 THEN 'morning' WHEN hour(ts) <= 17 THEN 'afternoon' ELSE 'evening' END AS period FROM events)
SELECT period, count(*) AS n FROM s GROUP BY 1""")
def work_periods(t):
    return t.events.groupBy(timefn.work_period(F.hour("ts")).alias("period")).agg(F.count("*").alias("n"))


@plan("""
SELECT user_id, event_id, n_before FROM (SELECT user_id, event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS n_before FROM events) WHERE n_before % 25 = 0""")
def history_pages(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", (F.count("*").over(w) - 1).alias("n_before")).where("n_before % 25 = 0")
