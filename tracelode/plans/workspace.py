"""Plans of projects, helper sessions and work events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.operators import workspace
from tracelode.plans.base import plan


@plan("""
WITH q AS (SELECT '/w/M' || (CAST(substr(p_brand, 7) AS INT) % 5 + 1) AS m, p_brand, p_type || ' ' || p_name AS p_container, p_partkey FROM part),
p AS (SELECT *, m || '/' || p_brand AS b, m || '/' || p_brand || '/' || replace(p_container, ' ', '_') AS c FROM q),
cwd AS (SELECT DISTINCT c || '/p' || p_partkey % 10 AS cwd FROM p UNION SELECT DISTINCT b FROM p),
k AS (
  SELECT DISTINCT m AS dir, '.git' AS file, CAST(NULL AS VARCHAR) AS name FROM p WHERE m LIKE '%1'
  UNION SELECT DISTINCT b, CASE CAST(right(p_brand, 1) AS INT) % 4 WHEN 0 THEN '.git' WHEN 1 THEN 'package.json' WHEN 2 THEN 'Cargo.toml' ELSE 'pyproject.toml' END, CASE CAST(right(p_brand, 1) AS INT) % 4 WHEN 1 THEN '@scope/' || lower(p_brand) WHEN 2 THEN lower(p_brand) WHEN 3 THEN ' ' END FROM p
  UNION SELECT DISTINCT b, 'Cargo.toml', 'crate-' || p_brand FROM p WHERE p_brand LIKE '%4'
  UNION SELECT DISTINCT c, 'package.json', 'bad\\name' FROM p WHERE p_container LIKE 'LARGE%'
  UNION SELECT DISTINCT c, 'Cargo.toml', p_container FROM p WHERE p_container LIKE 'SM%' OR p_container LIKE 'LARGE b%'
), n AS (SELECT dir, bool_or(file = '.git') AS git, bool_or(file <> '.git') AS manifest, max(CASE WHEN file = 'package.json' AND name NOT LIKE '%\\%' THEN split_part(name, '/', -1) END) AS pk, max(CASE WHEN file = 'Cargo.toml' THEN name END) AS cg FROM k GROUP BY dir),
j AS (SELECT cwd.cwd, n.*, row_number() OVER (PARTITION BY cwd.cwd ORDER BY git DESC, length(dir) DESC) AS r FROM cwd JOIN n ON cwd.cwd = n.dir OR starts_with(cwd.cwd, n.dir || '/'))
SELECT cwd.cwd, coalesce(dir, cwd.cwd) AS root, coalesce(pk, cg, split_part(coalesce(dir, cwd.cwd), '/', -1)) AS project FROM cwd LEFT JOIN j ON j.cwd = cwd.cwd AND j.r = 1""")
def project_roots(t):
    m = F.concat(F.lit("/w/M"), (F.substring("p_brand", 7, 9).cast("int") % 5 + 1).cast("string"))
    parts = t.part.withColumn("p_container", F.concat_ws(" ", "p_type", "p_name"))
    p = parts.select(m.alias("m"), F.concat_ws("/", m, "p_brand").alias("b"), "p_brand", "p_container", F.concat_ws("/", m, "p_brand", F.regexp_replace("p_container", " ", "_")).alias("c"), "p_partkey")
    cwds = p.select(F.concat(F.col("c"), F.lit("/p"), (F.col("p_partkey") % 10).cast("string")).alias("cwd")).unionByName(p.select(F.col("b").alias("cwd")))
    kind = F.right("p_brand", F.lit(1)).cast("int") % 4
    row = lambda where, at, file, name: p.where(where).select(F.col(at).alias("dir"), file.alias("file"), name.alias("name"))
    nothing = F.lit(None).cast("string")
    by_kind = F.when(kind == 0, ".git").when(kind == 1, "package.json").when(kind == 2, "Cargo.toml").otherwise("pyproject.toml")
    named = F.when(kind == 1, F.concat(F.lit("@scope/"), F.lower("p_brand"))).when(kind == 2, F.lower("p_brand")).when(kind == 3, " ")
    markers = row(F.col("m").endswith("1"), "m", F.lit(".git"), nothing).unionByName(row(F.lit(True), "b", by_kind, named)).unionByName(row(F.col("p_brand").endswith("4"), "b", F.lit("Cargo.toml"), F.concat(F.lit("crate-"), "p_brand")))
    markers = markers.unionByName(row(F.col("p_container").startswith("LARGE"), "c", F.lit("package.json"), F.lit("bad\\name"))).unionByName(row(F.col("p_container").startswith("SM") | F.col("p_container").startswith("LARGE b"), "c", F.lit("Cargo.toml"), F.col("p_container")))
    return workspace.project_roots(cwds, markers)


@plan("""
WITH h AS (SELECT event_id, 'x' || user_id % 25 AS id, CASE WHEN event_id % 5 <> 0 THEN user_id % 10 END AS process, 'o' || user_id % 3 AS origin, ts FROM events WHERE event_type = 'view'),
p AS (SELECT 's' || user_id AS id, CASE WHEN event_id % 4 <> 0 THEN user_id % 10 END AS process, 'o' || user_id % 3 AS origin, ts, event_type IN ('click', 'signup') AS takes, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM events WHERE event_type <> 'view'),
d AS (
  SELECT h.event_id, arg_max(p.id, (p.ts, p.id)) AS direct FROM h JOIN p ON p.takes AND p.ts <= h.ts AND h.ts - p.ts <= INTERVAL 6 HOURS AND (p.until IS NULL OR p.until > h.ts)
    AND CASE WHEN h.process IS NOT NULL AND p.process IS NOT NULL THEN h.process = p.process ELSE h.origin = p.origin END GROUP BY h.event_id
), a AS (SELECT h.id, min(ts) AS since, arg_min(direct, ts) AS alias FROM h JOIN d USING (event_id) GROUP BY h.id)
SELECT h.event_id, h.id, CASE WHEN h.ts >= a.since AND p.takes THEN a.alias ELSE d.direct END AS parent_id
FROM h LEFT JOIN d USING (event_id) LEFT JOIN a ON a.id = h.id LEFT JOIN p ON p.id = a.alias AND p.ts <= h.ts AND (p.until IS NULL OR p.until > h.ts)""")
def helpers_under_parents(t):
    e = t.events.select("event_id", "user_id", "event_type", F.col("ts").alias("at"), F.concat(F.lit("o"), (F.col("user_id") % 3).cast("string")).alias("origin"))
    process = lambda n: F.when(F.col("event_id") % n != 0, F.col("user_id") % 10).alias("process_id")
    helpers = e.where("event_type = 'view'").select("event_id", F.concat(F.lit("x"), (F.col("user_id") % 25).cast("string")).alias("id"), process(5), "origin", "at")
    parents = e.where("event_type <> 'view'").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("id"), process(4), "origin", "at", F.col("event_type").isin("click", "signup").alias("accepts"))
    return workspace.folded_helpers(helpers, parents, 6 * 3600).select("event_id", "id", "parent_id")


@plan("""
WITH RECURSIVE s AS (SELECT o_orderkey AS id, o_custkey AS project, o_orderpriority AS branch, o_orderstatus || '-' || o_orderkey % 11 AS goal, CAST(o_orderdate AS TIMESTAMP) AS a, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS z FROM orders),
o AS (SELECT * FROM s WHERE id % 23 <> 0),
fs AS (SELECT id, project, list_sort(list_distinct(list(l_partkey % 40))) AS f FROM o JOIN lineitem ON l_orderkey = id GROUP BY id, project),
m AS (SELECT id AS a, min(id) OVER (PARTITION BY project) AS b FROM s QUALIFY id % 50 = 1 AND id <> min(id) OVER (PARTITION BY project)),
l AS (
  SELECT x.id AS a, y.id AS b, 'semantic' AS reason FROM o x JOIN o y ON x.project = y.project AND x.goal = y.goal AND x.id > y.id
  UNION ALL SELECT x.id, y.id, 'files' FROM fs x JOIN fs y ON x.project = y.project AND x.id > y.id AND len(list_intersect(x.f, y.f)) * 2 >= len(list_distinct(list_concat(x.f, y.f)))
  UNION ALL SELECT id, p, 'branch' FROM (SELECT id, a, lag(id) OVER w AS p, lag(z) OVER w AS e FROM o WINDOW w AS (PARTITION BY project, branch ORDER BY a, id)) WHERE epoch(a) - epoch(e) <= 60 * 86400
  UNION ALL SELECT id, p, 'time' FROM (SELECT id, a, lag(id) OVER w AS p, lag(z) OVER w AS e FROM o WINDOW w AS (PARTITION BY project ORDER BY a, id)) WHERE epoch(a) - epoch(e) <= 10 * 86400
), k AS (SELECT * FROM l UNION ALL SELECT a, b, 'manual' FROM m),
u AS (SELECT DISTINCT a, b FROM k UNION SELECT DISTINCT b, a FROM k),
r AS (SELECT id AS a, id AS b FROM s UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
t AS (SELECT a AS id, min(b) AS task_id FROM r GROUP BY a)
SELECT t.task_id, min(s.project) AS project, count(*) AS sessions, min(s.a) AS started_at, max(s.z) AS ended_at,
  array_to_string(list_filter(['manual', 'semantic', 'files', 'branch', 'time'], lambda x: list_contains(any_value(w.why), x)), ',') AS reasons
FROM t JOIN s ON s.id = t.id LEFT JOIN (SELECT task_id, list(DISTINCT reason) AS why FROM k JOIN t ON t.id = k.a GROUP BY task_id) w ON w.task_id = t.task_id GROUP BY t.task_id""")
def work_events_by_five_reasons(t):
    o = t.orders
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    goal = F.concat(F.when(key % 2 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")), F.when(key % 3 == 0, "  - ").otherwise(": "), (key % 11).cast("string"))
    sessions = o.select(key.alias("session_id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("branch"), goal.alias("objective"), day.alias("started_at"), (day + F.expr("INTERVAL 1 DAY")).alias("ended_at"))
    files = t.lineitem.join(o, F.col("l_orderkey") == key).select(F.col("o_custkey").alias("project"), key.alias("session_id"), (F.col("l_partkey") % 40).alias("file"))
    merges = o.select(key.alias("a"), F.min("o_orderkey").over(Window.partitionBy("o_custkey")).alias("b")).where("a % 50 = 1 AND a <> b")
    splits = o.where(key % 23 == 0).select(key.alias("session_id"))
    _, tasks = workspace.work_events(sessions, files, merges, splits, pause=10 * 86_400, branch_pause=60 * 86_400)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return tasks.select("task_id", "project", "sessions", ntz("started_at"), ntz("ended_at"), F.array_join("reasons", ",").alias("reasons"))
