"""Keyed state of fused sources and of attention episodes, driven without a stream: any order, cut and repeat gives one result."""

import random

import pandas as pd
import pytest
from pyspark.sql.datasource import DataSourceStreamReader, SimpleDataSourceStreamReader

from tracelode.streaming import attention, fusion


class MapState:
    def __init__(self):
        self.d = {}

    def containsKey(self, k):
        return k in self.d

    def getValue(self, k):
        return self.d.get(k)

    def updateValue(self, k, v):
        self.d[k] = v

    def removeKey(self, k):
        self.d.pop(k, None)

    def iterator(self):
        return iter(list(self.d.items()))


class Cell:
    def __init__(self):
        self.rows = None

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows

    def update(self, v):
        self.rows = v

    def clear(self):
        self.rows = None

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows = [*(self.rows or []), *rows]


class Handle:
    def __init__(self):
        self.timers = set()
        self.getMapState = lambda *a: MapState()
        self.getValueState = self.getListState = lambda *a: Cell()

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def fused(batches, kept=fusion.KEPT):
    p = fusion.FusedSessions(kept)
    p.init(Handle())
    cards = {}
    for rows in batches:
        for pdf in p.handleInputRows((0,), iter([pd.DataFrame(rows)]), None):
            for r in pdf.to_dict("records"):
                cards[r["id"]] = None if r["status"] is None else {k: (None if v is pd.NA else v) for k, v in r.items()}
    return {k: v for k, v in cards.items() if v is not None}, p


def fact(origin, status, at, n, id_="a", live=True, reason=None):
    return {"id": id_, "agent": "x", "origin": origin, "status": status, "phase": "p", "label": f"l{n}", "reason": reason, "live": live, "at": at, "order_key": f"k{n:04d}", "fact_id": f"{origin}:{n}"}


def poll(at, session, updated, status="running"):
    if session is None:
        return {"id": None, "agent": "x", "origin": "snapshot", "status": None, "phase": None, "label": None, "reason": None, "live": True, "at": at, "order_key": "", "fact_id": str(at)}
    return {"id": session, "agent": "x", "origin": "poll", "status": status, "phase": "p", "label": "poll", "reason": None, "live": True, "at": updated, "order_key": f"poll:{status}", "fact_id": str(at)}


def drawn(seed, n=60):
    rng = random.Random(seed)
    facts = []
    for i in range(n):
        status = rng.choice(["running", "waiting", "error", "paused", "completed", "running"])
        facts.append(fact(rng.choice(["hook", "transcript"]), status, rng.randrange(1000), i, rng.choice("ab"), rng.random() < 0.6, "turn-paused" if status == "paused" else None))
    for p in range(100, 1000, 100):
        facts += [poll(p, s, rng.randrange(p - 90, p), rng.choice(["running", "waiting", "completed"])) for s in "abc" if rng.random() < 0.5]
        facts.append(poll(p, None, None))
    return facts


def test_cards_do_not_depend_on_order_cuts_and_repeats():
    for seed in range(25):
        facts = drawn(seed)
        want, _ = fused([facts])
        rng = random.Random(seed)
        for _ in range(4):
            again = facts + rng.sample(facts, 20)
            rng.shuffle(again)
            cuts = sorted(rng.sample(range(1, len(again)), 6))
            got, _ = fused([again[a:b] for a, b in zip([0, *cuts], [*cuts, len(again)])])
            assert got == want, seed


def test_rules_of_the_sources():
    card = lambda *facts: fused([list(facts)])[0].get("a")
    assert card(fact("transcript", "running", 1, 1)) is None
    opened = fact("hook", "running", 1, 1)
    assert card(opened, fact("transcript", "completed", 2, 2, live=False))["status"] == "running"
    assert card(opened, fact("transcript", "completed", 2, 2))["status"] == "completed"
    asked = fact("hook", "waiting", 2, 2)
    assert card(opened, asked, fact("transcript", "running", 3, 3))["status"] == "waiting"
    assert card(opened, asked, fact("hook", "running", 3, 3))["started_at"] == 3
    assert card(opened, fact("transcript", "paused", 2, 2, reason="turn-paused"), fact("transcript", "running", 3, 3))["status"] == "running"
    done = card(opened, fact("hook", "completed", 2, 2), fact("hook", "running", 3, 3))
    assert done["actions"] == ["l3"] and done["activity_ended_at"] is None


def test_disappearance_is_found_and_taken_back():
    seen, end1, end2 = poll(10, "a", 5), poll(10, None, None), poll(20, None, None)
    assert set(fused([[seen, end1]])[0]) == {"a"}
    assert fused([[seen, end1], [end2]])[0] == {}
    assert set(fused([[seen, end1], [end2], [poll(20, "a", 5)]])[0]) == {"a"}, "a late row of the second snapshot"
    assert set(fused([[seen, end1], [end2], [fact("hook", "running", 30, 1)]])[0]) == {"a"}, "it began again"
    assert fused([[seen], [fact("hook", "running", 15, 1)], [end2]])[0] == {}


def test_state_stays_small_where_sessions_stop_and_resume():
    facts = [fact("hook", "completed" if i % 2 else "running", i, i) for i in range(2000)]
    want, _ = fused([facts])
    got, p = fused([facts[i : i + 50] for i in range(0, 2000, 50)])
    assert got == want and len(p.sessions.getValue(("a",))[0]) < 4000


def episodes(batches, window=100):
    """Batches of (facts, watermark in seconds) -> the last change of each episode."""
    p = attention.Episodes(window)
    p.init(Handle())
    last = {}
    for rows, watermark in batches:
        out = p.handleInputRows(("s",), iter([pd.DataFrame(rows)]), Clock(watermark * 1000)) if rows else p.handleExpiredTimer(("s",), Clock(watermark * 1000), None)
        for pdf in out:
            for r in pdf.to_dict("records"):
                last[r["episode_id"]] = {k: (None if v is pd.NA else v) for k, v in r.items()}
    return sorted((e["kind"], e["rule"], e["opened_at"] // 10**6, e["facts"], e["feedback"], e["state"], e["closed_at"] and e["closed_at"] // 10**6) for e in last.values() if e["state"] != "withdrawn"), p


def said(kind, at, n, name="x", category="tool"):
    return {"kind": kind, "name": name, "category": category, "at": at * 10**6, "order_key": f"{n:05d}", "fact_id": f"f{n}"}


def test_episodes_do_not_depend_on_order_cuts_and_repeats():
    for seed in range(25):
        rng = random.Random(seed)
        kinds = ["failure"] * 3 + ["start"] * 3 + ["waiting", "progress", "feedback"]
        facts = []
        for n in range(80):
            kind = rng.choice(kinds)
            name, category = (rng.choice(attention.KINDS), rng.choice(["handled", "snoozed:60", "not-stuck"])) if kind == "feedback" else (rng.choice("xy"), rng.choice(["tool", "tool", "read", attention.SUBAGENT]))
            facts.append(said(kind, rng.randrange(200_000), n, name, category))
        want, _ = episodes([(facts, 0), ([], 400_000)])
        line = sorted(facts, key=lambda f: f["at"] + rng.randrange(20_000) * 10**6)
        cuts = [0, *sorted(rng.sample(range(1, 80), 7)), 80]
        batches, watermark = [], 0
        for a, b in zip(cuts, cuts[1:]):
            batches.append((line[a:b] + [f for f in rng.sample(line[:b], min(3, b)) if f["at"] > watermark * 10**6], watermark))
            watermark = max(watermark, max(f["at"] for f in line[a:b]) // 10**6 - 20_000)
        got, p = episodes([*batches, ([], 400_000)])
        assert got == want, seed
        assert not p.pending.exists() and not p.shown.d


def test_stuck_rules_and_exclusions():
    rules = lambda *facts: [(k, r) for k, r, *_ in episodes([(list(facts), 0)])[0] if k == "stuck"]
    assert rules(*[said("failure", t, t) for t in (1, 50, 100)]) == [("stuck", "repeated-failure")]
    assert rules(*[said("failure", t, t) for t in (1, 50, 102)]) == []
    assert rules(*[said("failure", t, t, category="edit") for t in (1, 2, 3)]) == []
    assert rules(said("failure", 1, 1), said("failure", 2, 2, "y"), said("failure", 3, 3)) == []
    assert rules(*[said("failure", t, t, str(t), attention.SUBAGENT) for t in (1, 2, 3)]) == [("stuck", "subagent-start-failures")]
    assert rules(said("start", 1, 1), said("start", 9, 2), said("progress", 10, 3), said("start", 11, 4)) == []
    assert rules(*[said("start", t, t) for t in (1, 2000, 30000)]) == [("stuck", "repeated-start")]


@pytest.mark.parametrize("after,state,closed", [(86_401, "open", None), (90_000, "expired", 86_401)])
def test_a_day_ends_an_episode(after, state, closed):
    got, p = episodes([([said("waiting", 1, 1), said("feedback", 2, 2, "waiting", "handled")], 0), ([], after)])
    assert got == [("waiting", "waiting", 1, 1, "handled", state, closed)]
    assert (state == "open") == bool(p.handle.timers)


def test_streams_of_both_kinds_go_on_where_they_ended(spark, tmp_path):
    """Two runs over one checkpoint each: a late fact, feedback and a day's end by the watermark; a disappearance and its late row."""
    from pyspark.sql import functions as F

    schema = "id string, kind string, name string, category string, at timestamp, order_key string, fact_id string"

    def land(name, rows):
        spark.createDataFrame(rows, schema.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run():
        streams = [spark.readStream.schema(schema).parquet(f"{tmp_path}/{n}") for n in ("facts", "feedback")]
        changes = fusion.run_to_end(attention.attention_episodes(*streams, delay="1 hour"), f"file://{tmp_path}/run")
        return sorted((r.id, r.kind, int(r.opened_at.timestamp()), r.facts, r.feedback, r.state) for r in attention.latest_episodes(changes).collect())

    said = lambda id_, kind, at, n: (id_, kind, "x", "tool", at, f"{n:03d}", f"f{n}")
    land("facts", [said("s", "waiting", 10_000, 1), said("s", "waiting", 10_100, 2), said("t", "waiting", 10_000, 3)])
    land("feedback", [("s", "feedback", "waiting", "handled", 10_050, "fb", "g1")])
    assert run() == [("s", "waiting", 10_000, 2, "handled", "open"), ("t", "waiting", 10_000, 1, None, "open")]
    land("facts", [said("s", "start", 9_900, 4), said("s", "progress", 10_060, 5), said("s", "waiting", 10_000, 1), said("u", "progress", 200_000, 6)])
    assert run() == [("s", "waiting", 10_000, 1, "handled", "resolved"), ("s", "waiting", 10_100, 1, None, "expired"), ("t", "waiting", 10_000, 1, None, "expired")]


def test_a_late_poll_takes_back_a_disappearance_before_a_resume():
    """What a transcript's fact before a stop adds depends on whether the session was shown, so it stays open."""
    facts = [fact("hook", "running", 10, 1), poll(100, "a", 20), poll(100, None, None), poll(300, None, None), fact("transcript", "error", 310, 2), fact("hook", "waiting", 320, 3), fact("hook", "running", 330, 4)]
    late = [poll(300, "a", 290)]
    want, _ = fused([facts + late])
    assert want["a"]["actions"] == ["l2", "l3", "l4"]
    assert fused([facts, late])[0] == want


def test_polled_snapshots_are_read_by_tasks(spark, tmp_path):
    """Two runs over one checkpoint: snapshots as files and as folders, a missing field, and only new names the second time."""
    import json

    def land(name, *rows):
        path = tmp_path / "polls" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))

    def run():
        out = fusion.run_to_end(fusion.polled(spark, f"file://{tmp_path}/polls"), f"file://{tmp_path}/run")
        return [(r.batch, r.poll.isoformat(), r.agent, r.session, r.status, r.updated_at and r.updated_at.isoformat()) for r in out.collect()]

    assert issubclass(fusion.SnapshotReader, DataSourceStreamReader) and not issubclass(fusion.SnapshotReader, SimpleDataSourceStreamReader)
    land("1.json", {"poll": "2026-01-01T00:00:01.000002Z", "agent": "x", "session": "s" * 300_000, "status": "running", "updated_at": "2026-01-01T00:00:00Z"}, {"poll": "2026-01-01T00:00:01.000002Z", "agent": "x"})
    first = [(0, "2026-01-01T00:00:01.000002", "x", None, None, None), (0, "2026-01-01T00:00:01.000002", "x", "s" * 300_000, "running", "2026-01-01T00:00:00")]
    assert sorted(run(), key=repr) == sorted(first, key=repr)
    land("2/part-0.json", {"poll": "2026-01-01T02:00:01+01:00", "agent": "x"})
    land("2/part-1.json", {"poll": "2026-01-01T02:00:01+01:00", "agent": "y", "session": "t", "status": "idle"})
    assert sorted(run(), key=repr) == sorted([*first, (1, "2026-01-01T01:00:01", "x", None, None, None), (1, "2026-01-01T01:00:01", "y", "t", "idle", None)], key=repr)


def test_sessions_of_one_group_are_as_each_alone():
    """Several sessions in one group of the state, cut anywhere, with one timer: what each gives as a group of its own."""
    rng = random.Random(9)
    batches = []
    for watermark in (0, 20_000, 60_000, 90_000):
        facts = [{"id": i, **said(rng.choice(["failure", "start", "waiting", "progress"]), rng.randrange(watermark, watermark + 60_000), watermark + n, rng.choice("xy"))} for n in range(30) for i in "abc"]
        batches.append((rng.sample(facts, 60), watermark))
    want = [(i, *e) for i in "abc" for e in episodes([*[([f for f in rows if f["id"] == i], w) for rows, w in batches], ([], 400_000)])[0]]
    p = attention.GroupedEpisodes(100)
    p.init(Handle())
    last = {}
    end = type("Expired", (), {"getExpiryTimeInMs": lambda self: max(p.handle.timers)})()
    for rows, watermark in [*batches, ([], 400_000)]:
        clock = Clock(watermark * 1000)
        for pdf in p.handleInputRows((0,), iter([pd.DataFrame(rows[:20]), pd.DataFrame(rows[20:])]), clock) if rows else p.handleExpiredTimer((0,), clock, end):
            last |= {(r["id"], r["episode_id"]): {k: (None if v is pd.NA else v) for k, v in r.items()} for r in pdf.to_dict("records")}
        assert len(p.handle.timers) <= 1
    got = [(e["id"], e["kind"], e["rule"], e["opened_at"] // 10**6, e["facts"], e["feedback"], e["state"], e["closed_at"] and e["closed_at"] // 10**6) for e in last.values() if e["state"] != "withdrawn"]
    assert sorted(got) == sorted(want) and not p.wakes.d
