"""Literal facts about single operators."""

import pytest
from pyspark.sql import functions as F

from tracelode.operators import activity, attention, joins, live, pricing, sequence, sessions, trajectory, usage

USAGE = "input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, cache_write_1h_tokens long, reasoning_tokens long"


def test_cost_of_a_large_session(spark):
    rows = [("codex", "gpt-5.5", 1_000_000, 100_000, 2_000_000, 0, 0, 5), ("codex", "gpt-5.5-2026-01-01", 1_000_000, 100_000, 2_000_000, 0, 0, 5), ("codex", "gpt-5.55", 1, 0, 0, 0, 0, 0), ("kimi-code", "k3", 1_000_000, 0, 0, 0, 0, 0), ("codex", "k3", 1_000_000, 0, 0, 0, 0, 0), ("codex", "anthropic.claude-opus-4.6@2026", 0, 0, 0, 0, 1_000_000, 0)]
    out = pricing.priced(spark.createDataFrame(rows, f"agent string, model string, {USAGE}")).collect()
    assert [None if r.cost is None else round(r.cost, 6) for r in out] == [9.0, 9.0, None, 3.0, None, 10.0]
    assert out[0].covered_tokens == 3_100_000 and out[2].covered_tokens == 0


def test_usage_without_time_has_no_day(spark):
    rows = [("s", None, 100, 0, 0, 0, 0, 0), ("s", "2026-01-01 10:00:00", 5, 0, 0, 0, 0, 0), ("s", "2026-01-01 10:00:00", 0, 0, 0, 0, 0, 7)]
    df = spark.createDataFrame(rows, f"session_id string, t string, {USAGE}").withColumn("ts", F.col("t").cast("timestamp"))
    assert usage.session_totals(df).first().total_tokens == 105 and usage.session_totals(df).first().reasoning_tokens == 0
    assert [(r.date, r.total_tokens) for r in usage.by_day(df).collect()] == [("2026-01-01", 5)]
    assert usage.by_hour(df, "Asia/Shanghai").first().hour == "2026-01-01T18:00"


def test_account_events_of_mixed_encodings(spark):
    token = "tokenUsage struct<inputTokens:string,outputTokens:string,cacheReadTokens:string,cacheWriteTokens:string,totalCents:string>"
    rows = [("1767261600000", "m", "2.5", ("100", "50", "0", "0", "1.5")), ("1767261600", "m", "2.5", ("40", "25", "0", "0", "2.0")), ("1767261600000", "m", "0", None)]
    day = usage.account_events(spark.createDataFrame(rows, f"timestamp string, model string, chargedCents string, {token}")).first()
    assert (day.input_tokens + day.output_tokens, day.requests, day.token_requests) == (215, 3, 2)
    assert day.api_cost == pytest.approx(0.035) and day.metered_cost == pytest.approx(0.05)
    void = spark.createDataFrame([*rows, ("1767261600000", "m", None, None)], f"timestamp string, model string, chargedCents string, {token}")
    assert usage.account_events(void).first().metered_cost is None
    summary = spark.createDataFrame([("2026-01-01", "a", 100, 100, 40, 0, 0.2, 0.1, 1, 1), ("2026-01-02", "b", 200, 40, 0, 0, 0.4, 0.3, 2, 2)], "date string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, api_cost double, metered_cost double, requests long, token_requests long")
    r = usage.account_summary(summary, []).first()
    assert (r.tokens, r.requests) == (480, 3) and r.api_cost == pytest.approx(0.6) and r.metered_cost == pytest.approx(0.4)


def test_smoothing(spark):
    s = lambda v: spark.createDataFrame([(v,)], "v array<double>").select(activity.smoothed(F.col("v")).alias("s")).first().s
    assert s([5.0] * 9) == pytest.approx([5.0] * 9) and s([float(i * i) for i in range(7)])[3] == pytest.approx(9.0)
    assert s([float(i * i) for i in range(5)])[2] == pytest.approx(4.0) and s([1.0, 9.0]) == [1.0, 9.0]


def test_trajectory_spans(spark):
    rows = [("p", 1, "2026-01-01 00:00:00"), ("p", 2, "2026-01-01 00:00:05"), ("p", 3, "2026-01-01 00:00:15"), ("p", 4, "2026-01-01 00:00:20"), ("q", 1, None), ("q", 2, None), ("q", 3, "2026-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, i long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {(r.k, r.i): (r.x0, r.x1) for r in trajectory.spans(df, ["k"], "i", "ts").collect()}
    assert [got["p", i] for i in range(1, 5)] == [(0.0, 25.0), (25.0, 75.0), (75.0, 100.0), (100.0, 100.0)]
    assert [got["q", i][0] for i in range(1, 4)] == [0.0, 50.0, 100.0]


def test_a_record_without_time_breaks_the_chain(spark):
    rows = [("s", 1, "2026-01-01 00:00:00"), ("s", 2, None), ("s", 3, "2026-01-01 00:00:30"), ("s", 4, "2026-01-01 00:10:30"), ("s", 5, "2026-01-01 00:20:31"), ("s", 6, "2026-01-01 00:20:30")]
    df = spark.createDataFrame(rows, "k string, i long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r.active_seconds for r in sequence.activity_gaps(df, ["k"], ["i"]).orderBy("i").collect()] == [0, 0, 0, 600, 0, 0]


def test_counters_that_fall_back(spark):
    df = spark.createDataFrame([("s", i, v, m) for i, (v, m) in enumerate([(10, "a"), (25, "a"), (5, None), (8, None)])], "k string, i long, n long, m string")
    assert [r.n_delta for r in sequence.cumulative_delta(df, ["k"], ["i"], ["n"]).orderBy("i").collect()] == [10, 15, 0, 3]
    assert [r.n_delta for r in sequence.same_id_delta(df, ["k"], ["i"], "m", ["n"]).orderBy("i").collect()] == [10, 15, 5, 3]


def test_file_changes(spark):
    rows = [("s", "a", "added", 5, 0, 1), ("s", "a", "modified", 1, 2, 2), ("s", "b", "modified", 1, 1, 1), ("s", "b", "deleted", 0, 3, 2)]
    df = spark.createDataFrame(rows, "s string, path string, kind string, added long, removed long, ordinal long").withColumn("ts", F.timestamp_seconds("ordinal"))
    assert {r.path: (r.kind, r.added, r.removed, r.changes) for r in usage.file_changes(df, ["s"]).collect()} == {"a": ("added", 6, 2, 2), "b": ("deleted", 1, 4, 2)}


def test_as_of_and_interval_edges(spark):
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("t"))
    parents = at(spark.createDataFrame([(1, 0, "a"), (1, 100, "b"), (1, 100, "c")], "p long, t long, name string"))
    aux = at(spark.createDataFrame([(1, 100, 1), (1, 400, 2), (1, 401, 3), (2, 100, 4)], "p long, t long, id long"))
    got = {r.id: r.parent_name for r in joins.as_of(aux, parents, ["p"], "ts", 300, ["name"]).collect()}
    assert got == {1: "c", 2: "c", 3: None, 4: None}
    spans = spark.createDataFrame([("k", 0, 200_000)], "k string, a long, b long").select("k", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    points = at(spark.createDataFrame([("k", 0), ("k", 100_000), ("k", 200_000), ("k", 200_001), ("x", 5)], "k string, t long"))
    assert sorted(r.t for r in joins.within_interval(points, spans, ["k"], "ts", "a", "b").collect()) == [0, 100_000, 200_000]


def test_titles_pages_tasks(spark):
    rows = spark.createDataFrame([("a", "App"), ("b", "App"), ("c", "App")], "session_id string, project_label string")
    index = spark.createDataFrame([("a", "Fix it")], "session_id string, title string")
    threads = spark.createDataFrame([("a", "x", "y"), ("b", " ", "app"), ("c", "Named", "t")], "session_id string, name string, title string")
    assert {r.session_id: r.conversation_title for r in joins.titled(rows, index, threads, "session_id").collect()} == {"a": "Fix it", "b": None, "c": "Named"}
    t = spark.createDataFrame([("p", f"s{i}", a, a + 100, b, None, 1, False, f"t{i}") for i, (a, b) in enumerate([(0, "m"), (200, "m"), (300, "x"), (90_000, "x")])], "project string, session_id string, a long, b long, branch string, manual_split boolean, files long, has_commit boolean, title string")
    t = t.withColumn("started_at", F.timestamp_seconds("a")).withColumn("ended_at", F.timestamp_seconds("b"))
    assert sorted((r.task_no, r.sessions, r.title) for r in sessions.tasks(t).collect()) == [(1, 2, "t1"), (2, 1, "t2"), (3, 1, "t3")]


def test_freshness_and_unknown_times(spark):
    now = F.lit("2026-01-01 00:10:00").cast("timestamp")
    df = spark.createDataFrame([("2026-01-01 00:09:50",), ("2026-01-01 00:08:30",), ("2026-01-01 00:05:00",), ("2026-01-01 00:11:00",)], "t string").select(F.col("t").cast("timestamp").alias("u"))
    assert [r.f for r in df.select(live.freshness(F.col("u"), now).alias("f")).collect()] == ["fresh", "aging", "lost-update", "fresh"]
    none = df.limit(1).select(F.lit(None).cast("timestamp").alias("u"))
    assert none.select(live.alive(F.lit("running"), F.col("u"), now).alias("a")).first().a is None


def test_heat_peak_and_day_fill(spark):
    d = spark.createDataFrame([("2026-01-01", 10), ("2026-01-03", 40), ("2026-01-05", 40)], "date string, n long")
    filled = activity.filled(d, "date", ["n"])
    assert [(r.date[-1], r.n) for r in filled.orderBy("date").collect()] == [("1", 10), ("2", 0), ("3", 40), ("4", 0), ("5", 40)]
    assert [r.heat for r in activity.heat(filled, "n").orderBy("date").collect()] == [1, 0, 4, 0, 4]
    assert activity.peak(d, "n", "date").first().date == "2026-01-03" and activity.most_active_date(d, "n", "date").first().date == "2026-01-05"


def test_tray_and_claims(spark):
    ts = lambda df, *c: df.withColumns({x: F.timestamp_seconds(x) for x in c})
    done = ts(spark.createDataFrame([("a", 10, False), ("b", 10, True), ("c", 10, False)], "session_id string, completed_at long, seen boolean"), "completed_at")
    gone = ts(spark.createDataFrame([("a", 5), ("b", 20)], "session_id string, deleted_at long"), "deleted_at")
    assert [r.session_id for r in attention.completed_tray(done, gone, spark.createDataFrame([("c",)], "session_id string")).collect()] == ["a"]
    leases = ts(spark.createDataFrame([("1", 0, True), ("2", 98, False), ("3", 10, False)], "episode_id string, claimed_at long, confirmed boolean"), "claimed_at")
    episodes = spark.createDataFrame([("1",), ("2",), ("3",), ("3",), ("4",)], "episode_id string")
    assert sorted(r.episode_id for r in attention.claims(episodes, leases, F.timestamp_seconds(F.lit(100))).collect()) == ["3", "4"]
