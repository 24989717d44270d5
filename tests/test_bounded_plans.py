"""Steps whose work must not grow faster than their input, told by their plans."""

from pyspark.sql import functions as F


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_of_pages_order_numbers_only(spark):
    from tracelode.sources import live_logs

    body = lambda *ids: '{"usageEventsDisplay":[' + ",".join(f'{{"id":{i}}}' for i in ids) + "]}"
    pages = spark.createDataFrame([(1, body(1, 1, 2, 1)), (4, body(1, 2, 1, 1, 3)), (5, body(3, 3)), (9, body())], "page long, body string")
    found = live_logs.account_pages(pages)
    assert "lag(e" not in optimised(found)
    assert sorted((r.page, r.position, r.event) for r in found.collect()) == [(1, 0, '{"id":1}'), (1, 1, '{"id":1}'), (1, 2, '{"id":2}'), (1, 3, '{"id":1}'), (4, 0, '{"id":1}'), (4, 1, '{"id":3}'), (5, 0, '{"id":3}')]


def test_helpers_form_no_pairs_within_a_key(spark):
    from tracelode.operators import workspace

    at = lambda n: F.timestamp_micros(n * 60_000_000)
    spans = spark.range(40).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"), F.lit("o").alias("origin"), at(F.col("id")).alias("at"), F.when(F.col("id") % 3 == 0, at(F.col("id") + 2)).alias("until"), (F.col("id") % 5 != 0).alias("accepts"))
    events = spark.range(70).select(F.col("id").alias("event"), F.lit("o").alias("origin"), at(F.col("id")).alias("at"))
    found = workspace._latest_accepting(events, spans, "origin", 600)
    assert "Join" not in optimised(found)
    want = {}
    for e in range(70):
        open_ = [s for s in range(40) if s % 5 and s <= e <= s + 10 and (s % 3 or s + 2 > e)]
        if open_:
            want[e] = f"s{max(open_):02d}"
    assert {r.event: r.parent for r in found.collect()} == want


def test_commits_of_a_log_need_no_window(spark):
    from tracelode.sources import files

    log = "lost\t1\t2\n1\t1\tbefore\n" + "".join(f"\x1e h{i} \x1f 2024-01-0{i} 00:00:00 \x1f S{i}\n\n{i}\t-\tf{i} \x1e x\n3\t4\tg\n" for i in range(1, 5))
    found = files.git_log(spark.createDataFrame([("r", log), ("empty", "")], "path string, text string"), most=3)
    assert "Window" not in optimised(found)
    assert sorted((r.commit, r.subject, r.file, r.added, r.removed) for r in found.collect()) == sorted(x for i in (1, 2, 3) for x in ((f"h{i}", f"S{i}", f"f{i} \x1e x", i, 0), (f"h{i}", f"S{i}", "g", 3, 4)))


def test_all_commits_of_a_log_are_read(spark, tmp_path):
    from tests.against_sql import both
    from tracelode.sources import files

    log = "".join(f"\x1e h{i} \x1f 2024-01-01 00:00:00 \x1f S{i}\n\n1\t2\tf\n" for i in range(70))
    found = files.git_log(spark.createDataFrame([("r", log), ("none", "no commit\n"), ("empty", ""), ("null", None)], "path string, text string"))
    assert sorted(r.commit for r in found.collect()) == sorted(f"h{i}" for i in range(70))
    orders = "SELECT i AS o_orderkey, i % 2 AS o_custkey, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * i AS o_orderdate FROM range(90) t(i)"
    lines = "SELECT i AS l_orderkey, i * j AS l_partkey, i + j AS l_suppkey, j::INTEGER AS l_linenumber FROM range(90) t(i), range(1, 5) u(j)"
    got, want = both(spark, tmp_path, "git_history", {"orders": orders, "lineitem": lines})
    assert got == want and len({r[1] for r in got}) == 90


def test_small_files_share_tasks(spark, tmp_path):
    from tracelode.sources import sinks, tail

    rows = spark.range(3000).select((F.col("id") % 900).alias("k"), "id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("value"))
    assert sinks.log_files(rows, f"file://{tmp_path}", "k", ["id"]) == 900
    for parts in (tail.TailReader({"path": str(tmp_path), "pattern": "*.txt"}).partitions(), tail.FollowReader({"path": str(tmp_path), "pattern": "*.txt"}).partitions({}, tail.FollowReader({"path": str(tmp_path), "pattern": "*.txt"}).latestOffset())):
        assert len(parts) <= 3
    got = tail.tail(spark, str(tmp_path), "*.txt").withColumn("k", F.regexp_extract("path", r"k=(\d+)/", 1).cast("long"))
    lines = [(r.k, r.raw) for r in got.orderBy("k", "at").collect()]
    assert lines == [(k, f"é{i}") for k in range(900) for i in range(k, 3000, 900)]


def test_records_of_a_log_are_read_once(spark, data):
    """Rows are split by the record and not by the events made of it, and what three branches read is a written table."""
    from tracelode.plans import logs
    from tracelode.plans.base import Tables
    from tracelode.sources import adapters

    rows = spark.createDataFrame([("p", i, r) for i, r in enumerate((
        '{"type":"session_meta","payload":{"id":"s"}}', '{"type":"response_item","payload":{"type":"custom_tool_call","name":"exec","call_id":"c","input":"tools.exec_command({cmd: \\"ls\\"}); tools.exec_command({cmd: \\"pwd\\"})"}}',
        '{"type":"response_item","payload":{"type":"function_call","name":"shell","call_id":"d","arguments":"{}"}}', '{"type":"event_msg","payload":{"type":"error","name":"exec"}}',
    ))], "path string, ordinal long, raw string").selectExpr("path", "'codex' AS agent", "ordinal", "try_parse_json(raw) AS record", "false AS malformed")
    got = {r.ordinal: ([(e.event_type, e.name, e.command) for e in r.events], r.parallel) for r in adapters.codex(rows).collect()}
    assert got == {0: ([], False), 1: ([("tool", "exec_command", "ls"), ("tool", "exec_command", "pwd")], True), 2: ([("tool", "shell", None)], False), 3: ([("error", None, None)], False)}
    for build in (logs.log_codex, logs.log_claude, logs.session_records_of_log, logs.session_days_of_log):
        plan = build(Tables(spark, f"{data}/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
        assert "try_parse_json" not in plan.lower() and "InMemoryRelation" not in plan
