"""Logs that grow: ranges of one file, cuts of a session's rows, hand-over of a transcript at every line."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from tracelode.operators import increments
from tracelode.sources import files, sinks
from tracelode.streaming import handover


def scanned(spark, folder, width):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
    try:
        df = files.json_lines(spark, str(folder), "codex")
        return sorted((r.path.rsplit("/", 1)[1], r.ordinal, r.raw, r.malformed) for r in df.select("path", "ordinal", "raw", "malformed").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ranges_of_a_file_give_the_rows_of_the_whole(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for name, last in (("a", ""), ("b", '{"id": 1}'), ("c", '{"id": 1'), ("d", "\n")):
        lines = [rng.choice([json.dumps({"id": i, "t": "é" * rng.randrange(40)}), "{broken", "", "  ", json.dumps([i]) + "\r"]) for i in range(300)]
        (tmp_path / f"{name}.jsonl").write_bytes(("\n".join(lines) + "\n" + last).encode())
        want += [(f"{name}.jsonl", i, x, x == "{broken") for i, x in enumerate(lines) if x.strip()]
        if name == "b":
            want.append(("b.jsonl", 300, last, False))
    assert scanned(spark, tmp_path, 1 << 27) == sorted(want)
    assert scanned(spark, tmp_path, 3000) == sorted(want)


def test_any_cuts_of_the_rows_give_one_record(spark):
    rng = random.Random(2)
    rows = []
    for s in "abcd":
        for o in range(40):
            ts = None if rng.random() < 0.1 else o * 100 + rng.randrange(150) + (10_000 if o > 30 else 0)
            rows.append((s, o, ts, rng.random() < 0.9, rng.random() < 0.2 and ts is not None, rng.choice([None, "m1", "m2"]), rng.choice([None, None, o * 5, 3]), rng.random() < 0.3, rng.random() < 0.1))
    timed = lambda part: spark.createDataFrame(part, increments.ROWS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    shown = lambda known: sorted(map(tuple, increments.records(known).collect()))
    kept = lambda known: spark.createDataFrame(known.collect(), increments.ACCUMULATORS)
    whole = shown(increments.advance(increments.empty(spark), timed(rows)))
    assert len(whole) == 4 and all(r[-1] == 40 for r in whole)
    for _ in range(2):
        known = increments.empty(spark)
        cuts = {s: sorted(rng.sample(range(40), 2)) for s in "abcd"}
        for i in range(3):
            part = [r for r in rows if ([0, *cuts[r[0]]][i] - (3 if i else 0)) <= r[1] < [*cuts[r[0]], 40][i]]
            known = kept(increments.replaced(known, increments.advance(known, timed(part))))
        assert shown(known) == whole


def test_untouched_sessions_are_not_changed(spark):
    row = lambda s, o: (s, o, None, True, False, "m", o, True, False)
    known = increments.advance(increments.empty(spark), spark.createDataFrame([row("a", 1), row("b", 1)], increments.ROWS))
    changed = increments.advance(known, spark.createDataFrame([row("a", 2)], increments.ROWS))
    assert [r.session for r in changed.collect()] == ["a"] and increments.advance(known, spark.createDataFrame([], increments.ROWS)).count() == 0
    assert sorted((r.session, r.rows_read) for r in increments.replaced(known, changed).collect()) == [("a", 2), ("b", 1)]


def test_bootstrap_and_tail_equal_one_read_for_cuts_at_every_line(spark):
    rng = random.Random(3)
    lines, at = [], 0
    for i in range(25):
        stamp = f"2026-01-01T00:{i:02d}:00Z"
        record = rng.choice([
            {"type": "event_msg", "timestamp": stamp, "payload": {"type": rng.choice(["task_started", "task_complete", "error", "agent_message", "unknown"])}},
            {"type": "turn_context", "timestamp": stamp, "payload": {"collaboration_mode": rng.choice(["plan", {"mode": "code"}])}},
        ])
        raw = json.dumps(record) if rng.random() < 0.9 else "{broken"
        lines.append((at, raw))
        at += len(raw) + 1
    # One transcript a cut, so that one batch covers all cuts.
    whole = spark.createDataFrame([(f"p{cut}", a, raw) for cut in range(26) for a, raw in lines[:cut]], "path string, at long, raw string")
    starts = {r.path: {c: r[c] for c in handover.NAMES} for r in handover.bootstrap(whole).collect()}
    read = handover.signals(spark.createDataFrame([("p", a, raw) for a, raw in lines], "path string, at long, raw string")).orderBy("at").collect()
    ends = []
    for cut in range(26):
        s = starts.get(f"p{cut}", handover.unread(f"p{cut}"))
        for r in read:  # those before the cut come again and are passed over
            s = handover.take(s, r.asDict())
        ends.append({k: v for k, v in s.items() if k != "path"})
    assert all(e == ends[0] for e in ends) and ends[0] == {k: v for k, v in starts["p25"].items() if k != "path"}


def test_a_group_of_the_state_holds_many_transcripts():
    """Lines of several transcripts, mixed and cut anywhere, with and without a state handed over."""
    states = {}

    class Map:
        getValue, updateValue = staticmethod(states.get), staticmethod(states.__setitem__)

    turns = handover.Turns()
    turns.init(type("Handle", (), {"getMapState": lambda *_: Map()})())
    turns.handleInitialState((0,), pd.DataFrame({"path": ["a", "b"], "body": [json.dumps(handover.unread("a") | {"next": 20, "new_mode": "plan"}), json.dumps(handover.unread("b") | {"next": 10})]}), None)
    line = lambda path, at, kind=None, mode=None: {"bucket": 0, "path": path, "at": at, "size": 10, "kind": kind, "ts": None if kind is None else at * 1000, "mode": mode}
    rows = [line("c", 10, "task_complete"), line("a", 30, "error"), line("b", 0, "error"), line("a", 20, "task_started"), line("c", 0, "task_started"), line("b", 10, None, "code")]
    frame = next(turns.handleInputRows((0,), iter([pd.DataFrame(rows[:2]), pd.DataFrame(rows[2:])]), None))
    got = {r["path"]: (r["next"], r["open"], r["kind"], r["mode"], r["new_mode"]) for r in frame.to_dict("records")}
    assert got == {"a": (40, True, "error", "plan", "plan"), "b": (20, False, None, None, "code"), "c": (20, False, "task_complete", None, None)}
    assert set(states) == {("a",), ("b",), ("c",)} and json.loads(states["a",][0])["signal_at"] == 30_000


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(5000).repartition(7).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("n"), F.concat(F.lit("é"), (F.pmod(F.col("id") * 7919, F.lit(5000))).cast("string")).alias("value"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges stay apart
    try:
        size = sinks.one_file(rows, f"file://{tmp_path}/x/lines.txt", ["n"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = "".join(f"é{i}\n" for i in range(5000)).encode()
    assert (tmp_path / "x" / "lines.txt").read_bytes() == want and size == len(want)
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["lines.txt"]
    assert sinks.one_file(rows.limit(0), f"{tmp_path}/y/lines.txt", ["n"]) == 0 and (tmp_path / "y" / "lines.txt").read_bytes() == b""
