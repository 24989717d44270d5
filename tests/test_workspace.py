from pyspark.sql import functions as F

from tracelode.operators import usage, workspace
from tracelode.operators.graph import components
from tracelode.sources import sinks


def test_components_of_long_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == 100 for i in range(100, 161)) and all(got.get(i, i) == 1 for i in range(1, 50)) and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots_prefer_repositories_and_fall_back_to_names(spark):
    cwds = spark.createDataFrame([(c,) for c in ("/a/b/c/", "/a/b/x", "/m/n/o", "/lone dir", "", "  ", None, "/", "/a/b/c/")], "cwd string")
    marks = [("/a", ".git", None), ("/a/b/c", "package.json", "inner"), ("/m", "package.json", " "), ("/m", "Cargo.toml", "@x/crate "), ("/m/n", "pyproject.toml", "p" * 81), ("/m/n", "setup.py", "no")]
    got = {r.cwd: (r.root, r.project) for r in workspace.project_roots(cwds, spark.createDataFrame(marks, "dir string, file string, name string")).collect()}
    assert got["/a/b/c/"] == ("/a", "a") and got["/a/b/x"] == ("/a", "a")
    assert got["/m/n/o"] == ("/m/n", "n") and got["/lone dir"] == ("/lone dir", "lone dir")
    assert got[""][1] == got["  "][1] == got["/"][1] == workspace.UNKNOWN


def test_helpers_keep_their_parent_while_it_accepts(spark):
    at = lambda df: df.withColumn("at", F.timestamp_seconds("at"))
    parents = at(spark.createDataFrame([("p", 1, "o", 0, True), ("q", 1, "o", 50, True), ("p", 1, "o", 100, True), ("p", 1, "o", 130, False), ("r", None, "o", 140, True)], "id string, process_id long, origin string, at long, accepts boolean"))
    helpers = at(spark.createDataFrame([("h", 1, "o", 10), ("h", 1, "o", 60), ("h", 1, "o", 135), ("h", 1, "o", 145), ("h", 1, "o", 900), ("g", 2, "o", 145), ("k", 2, "z", 145)], "id string, process_id long, origin string, at long"))
    got = {(r.id, r.origin, int(r.at.timestamp())): r.parent_id for r in workspace.folded_helpers(helpers, parents).collect()}
    assert got == {("h", "o", 10): "p", ("h", "o", 60): "p", ("h", "o", 135): "q", ("h", "o", 145): "r", ("h", "o", 900): None, ("g", "o", 145): "r", ("k", "z", 145): None}


def test_many_sessions_with_equal_files_are_linked_without_pairs(spark):
    files = spark.range(400).selectExpr("'p' project", "id session_id", "'README' file").unionByName(spark.createDataFrame([("p", 900, f) for f in "abc"] + [("p", 901, f) for f in "bcd"] + [("p", 902, "d"), ("q", 903, "a")], "project string, session_id long, file string"))
    links = {(r.a, r.b) for r in workspace.shared_files(files).collect()}
    assert links == {(i, 0) for i in range(1, 400)} | {(900, 901)}


def test_splits_and_merges_by_hand_go_first(spark):
    rows = [(i, "p", None, "Do it!" if i < 4 else f"goal {i}", i * 10, i * 10 + 1) for i in range(6)]
    sessions = spark.createDataFrame(rows, "session_id long, project string, branch string, objective string, started_at long, ended_at long").withColumns({c: F.timestamp_seconds(c) for c in ("started_at", "ended_at")})
    none = spark.createDataFrame([], "project string, session_id long, file string")
    merges = spark.createDataFrame([(5, 1)], "a long, b long")
    of, tasks = workspace.work_events(sessions, none, merges, spark.createDataFrame([(1,)], "session_id long"), pause=0)
    assert {r.session_id: r.task_id for r in of.collect()} == {0: 0, 2: 0, 3: 0, 1: 1, 5: 1, 4: 4}
    assert {r.task_id: r.reasons for r in tasks.collect()} == {0: ["semantic"], 1: ["manual"], 4: []}


def test_empty_tables_have_an_empty_overview(spark):
    used = spark.createDataFrame([], "session_id long, agent string, model string, ts timestamp, total_tokens long, cost double")
    called = spark.createDataFrame([], "session_id long, agent string, tool string, ts timestamp")
    parts = usage.overview_parts(used, called)
    assert parts.count() == 0
    assert usage.overview_response(spark.range(1).selectExpr("0L sessions"), parts).first().asDict() == {"sessions": 0, "daily": [], "hourly": [], "agents": [], "models": [], "tools": []}


def test_retention_keys_are_in_no_plan(spark):
    key = bytes(range(100, 132))
    rows = sinks.sealed(spark.createDataFrame([("e", "body")], "event_id string, value string"), key, F.lit("2026-01-01").cast("timestamp"))
    said = rows._jdf.queryExecution().toString() + sinks.opened(rows, key, F.lit("2026-01-02").cast("timestamp"))._jdf.queryExecution().toString()
    assert key.hex() not in said.lower() and key.hex().upper() not in said and str(list(key))[1:-1] not in said
    assert [r.value for r in sinks.opened(rows, key, F.lit("2026-01-02").cast("timestamp")).collect()] == ["body"]


def test_sessions_and_files_are_read_for_all_links_at_once(spark):
    """Files are read once, sessions for their links and for their tasks."""
    read = {"sessions": spark.sparkContext.accumulator(0), "files": spark.sparkContext.accumulator(0)}

    def counted(rows, name):
        def count(batches):
            for b in batches:
                read[name].add(b.num_rows)
                yield b

        return rows.mapInArrow(count, rows.schema)

    day = lambda c: F.timestamp_seconds(F.lit(86_400) * c)
    i = F.col("id")
    sessions = spark.range(60).select(i.alias("session_id"), (i % 3).alias("project"), F.when(i % 5 < 2, "b").alias("branch"), F.when(i % 12 < 6, F.concat(F.lit(" Go: "), (i % 4).cast("string"), F.lit("!"))).alias("objective"), day(3 * i).alias("started_at"), day(3 * i + 1).alias("ended_at"))
    files = spark.range(120).select((i % 3).alias("project"), (i % 60).alias("session_id"), (i % 7).alias("file"))
    none = spark.createDataFrame([], "a long, b long")
    _, tasks = workspace.work_events(counted(sessions, "sessions"), counted(files, "files"), none, none.select(F.col("a").alias("session_id")), pause=0)
    rows = tasks.collect()
    assert sum(r.sessions for r in rows) == 60 and {x for r in rows for x in r.reasons} >= {"semantic", "files"}
    assert read["sessions"].value <= 120 and read["files"].value == 120


def test_both_orders_of_a_project_give_links_in_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 0, "b", 0, 10), (2, 0, None, 12, 20), (3, 0, "b", 60, 70), (4, 0, None, 500, 510), (5, 1, "b", 0, 5)], "session_id long, project long, branch string, s long, e long")
    links = workspace._chained(rows.select("session_id", "project", "branch", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("e").alias("ended_at")), pause=5, branch_pause=50)
    assert sorted(map(tuple, links.collect())) == [(2, 1, "time"), (3, 1, "branch")]
    assert links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
