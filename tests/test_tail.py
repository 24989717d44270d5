import pickle
import random

from pyspark.sql import functions as F

from tracelode.operators import lookups
from tracelode.sources import tail
from tracelode.streaming import envelopes


def test_a_follower_gives_each_whole_line_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "RANGE_BYTES", 7)
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    a, b = logs / "a.jsonl", logs / "b.jsonl"
    stream = tail.follow(spark, str(logs))

    def poll():
        q = stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.path[-7:], r.at, r.raw) for r in spark.read.schema("path string, at long, raw string").parquet(str(out / "rows")).collect())

    a.write_bytes(b"one\n\nthree and more words\nfou")
    first = [("a.jsonl", 0, "one"), ("a.jsonl", 5, "three and more words")]
    assert poll() == first
    with a.open("ab") as f:
        f.write(b"r\n" + b"x" * (tail.MAX_LINE + 5) + b"\n\xffz\n")
    b.write_bytes(b"b1\n")
    grown = [*first, ("a.jsonl", 26, "four"), ("a.jsonl", 26 + 5 + tail.MAX_LINE + 6, "�z"), ("b.jsonl", 0, "b1")]
    assert poll() == grown
    # Written anew, shorter than before: read from its start, as it is shorter than what a follower goes back.
    a.write_bytes(b"new\n")
    assert poll() == sorted([*grown, ("a.jsonl", 0, "new")])


def test_offsets_and_tasks_do_not_grow_with_the_number_of_files(spark, tmp_path, monkeypatch):
    """The driver's offset names a listing, and a task its part of a plan; a checkpoint whose offset names files goes on."""
    monkeypatch.setattr(tail, "RANGE_BYTES", 7)
    logs, out, listings = tmp_path / "logs", tmp_path / "out", str(tmp_path / "listings")
    logs.mkdir()

    def poll(listings=listings):
        stream = tail.follow(spark, str(logs), listings=listings)
        q = stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.path.removeprefix(f"{logs}/"), r.at, r.raw) for r in spark.read.schema("path string, at long, raw string").parquet(str(out / "rows")).collect())

    (logs / "0.jsonl").write_text("old\n")
    want = [("0.jsonl", 0, "old")]
    assert poll(None) == want
    for i in range(300):
        (logs / f"k={i % 7}").mkdir(exist_ok=True)
        (logs / f"k={i % 7}" / f"{i}.jsonl").write_text(f"one {i}\nhalf")
        want.append((f"k={i % 7}/{i}.jsonl", 0, f"one {i}"))
    assert poll() == sorted(want) == poll()
    with (logs / "k=3" / "3.jsonl").open("a") as f:
        f.write(" and whole\n")
    (logs / "0.jsonl").write_text("")
    assert poll() == sorted([*want, ("k=3/3.jsonl", 6, "half and whole")])
    (logs / "0.jsonl").write_text("new\n")
    assert poll() == sorted([*want, ("k=3/3.jsonl", 6, "half and whole"), ("0.jsonl", 0, "new")])
    offsets = sorted((p for p in (out / "state" / "offsets").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    assert len(offsets) == 4 and all(p.stat().st_size < 1500 for p in offsets)
    reader = tail.FollowReader({"path": str(logs), "listings": listings})
    monkeypatch.setattr(tail, "RANGE_BYTES", 1 << 20)
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) < 20 and sum(len(pickle.dumps(p)) for p in parts) < 300 * len(parts)
    assert sorted(x for p in parts for x in reader.read(p)) == sorted((str(logs / p), at, raw) for p, at, raw in poll() if raw != "old")


def test_files_are_listed_in_one_order_and_old_listings_go(tmp_path, monkeypatch):
    rng = random.Random(4)
    for _ in range(200):
        at = tmp_path.joinpath("logs", *rng.choices(["a", "a.b", "a-b", "b", "B"], k=rng.randrange(0, 4)))
        at.mkdir(parents=True, exist_ok=True)
        (at / rng.choice(["a.jsonl", "a.b.jsonl", "c.jsonl", "no.txt"])).write_text("x\n")
    found = list(tail.files_below(str(tmp_path / "logs"), "*.jsonl"))
    assert found == sorted(found, key=tail.place) and sorted(found) == sorted(map(str, (tmp_path / "logs").rglob("*.jsonl")))
    monkeypatch.setattr(tail, "KEPT", 6)
    reader = tail.FollowReader({"path": str(tmp_path / "logs"), "listings": str(tmp_path / "listings")})
    before: dict = {}
    for i in range(9):
        (tmp_path / "logs" / "grows.jsonl").write_text("x\n" * (i + 1))
        now = reader.latestOffset()
        assert now == reader.latestOffset() and now != before
        got = [x for p in reader.partitions(before, now) for x in reader.read(p)]
        assert len(got) == (len(found) + 1 if i == 0 else 1)
        reader.commit(now)
        before = now
    assert len(list((tmp_path / "listings").iterdir())) == 6
    assert list(tail.files_below(str(tmp_path / "none"), "*")) == []


def test_ranges_share_out_every_line(tmp_path, monkeypatch):
    rng = random.Random(2)
    lines = ["y" * rng.randrange(0, 30) for _ in range(200)]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(lines) + "\n")
    for size in (1, 3, 16, 10_000):
        monkeypatch.setattr(tail, "RANGE_BYTES", size)
        got = [raw for r in tail.ranges(str(path), 0, tail.whole_lines(str(path)), True) for _, _, raw in tail.lines_of(r)]
        assert got == [x for x in lines if x]


def test_the_end_of_a_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("aaaa\nbbbb\ncc")
    (tmp_path / "gone.txt").write_text("no log\n")
    read = lambda n: [r.raw for r in tail.tail(spark, str(tmp_path), last_bytes=n).orderBy("at").collect()]
    # A line that begins at the very first of these bytes is whole.
    assert read(100) == ["aaaa", "bbbb", "cc"] and read(8) == read(7) == ["bbbb", "cc"] and read(6) == ["cc"]
    assert read(1) == [] and tail.whole_lines(str(tmp_path / "none")) == 0


def test_landed_envelopes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"provider":"codex","payload":{"session_id":"s",\n"hook_event_name":"Stop","event_id":"e"}}')
    (tmp_path / "in" / "2.json").write_text('{"provider":"codex","payl')
    out = str(tmp_path / "out")
    envelopes.canonical(envelopes.landed(spark, str(tmp_path / "in"))).drop("updated_at").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.status, r.event_id) for r in spark.read.parquet(out).collect()] == [("completed", "e")]


def one_by_one(signals):
    """The guards as they read, signal by signal."""
    s = None
    for at, status, reason, live in signals:
        was = s and s["status"]
        if status == "completed" and not live and was != "completed":
            continue
        if was in ("waiting", "error") and status == "running" and s["reason"] != "turn-paused":
            continue
        s = dict(s or {"started": at, "ended": None, "reason": None})
        if status in ("idle", "running"):
            s["ended"] = None
        elif was in (None, "idle", "running"):
            s["ended"] = at
        if was in ("waiting", "error", "completed") and status == "running":
            s["started"] = at
        s.update(status=status, updated=at, reason=reason)
    return s


def test_guarded_merge_equals_signals_one_by_one(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(150):
        signals = [(n, rng.choice(("running", "waiting", "error", "completed", "idle")), rng.choice((None, "turn-paused", "other")), rng.random() < 0.5) for n in range(rng.randrange(1, 14))]
        rows += [(i, n, f"{n:03d}", *rest) for n, *rest in signals] * 2
        s = one_by_one(signals)
        if s:
            want[i] = (s["status"], s["updated"], s["started"], s["ended"])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, at long, order_key string, status string, reason string, live boolean")
    got = {r.id: (r.status, r.updated_at, r.started_at, r.activity_ended_at) for r in lookups.guarded_merge(df).collect()}
    assert got == want
    assert lookups.guarded_merge(df.limit(0)).count() == 0


def test_feedback_and_unknown_availability(spark):
    e = spark.createDataFrame([(1, None), (2, None)], "episode_id long, resolved_at timestamp")
    f = spark.createDataFrame([(1, "snoozed", 5), (1, "what", 9)], "episode_id long, feedback string, s long").select("episode_id", "feedback", F.timestamp_seconds("s").alias("given_at"))
    one, two = lookups.with_feedback(e, f).orderBy("episode_id").collect()
    assert one.feedback == "snoozed" and one.resolved_at is None and one.snoozed_until is not None and two.feedback is None
    row = spark.range(1).select(lookups.notifiable(F.lit(None).cast("string"), F.lit("error"), F.lit("cli")).alias("x")).first()
    assert row.x is False
