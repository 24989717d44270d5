"""Attention episodes kept in a stream: they open, take further facts and feedback, resolve, and expire after a day.

Facts of a session are folded in their order. A waiting or a failing fact opens an episode of its kind or belongs to the
one that is open; work that starts again resolves those two, progress resolves every kind. Stuck is told by exact facts
alone: three equal failures within the window, three failures to start a subagent within it, or three equal starts without
progress between. Reading and editing may repeat, a failure may stand alone, silence and tokens say nothing. Feedback is a
second input: it marks the open episode of its kind and resolves nothing.

Late facts are taken up to the watermark: facts behind it are folded into the base for good, those before it stay in a
list. After each batch the episodes are those of the base and the list, so the order of arrival
and repeats do not matter; an episode that a late fact makes vanish is withdrawn. Event-time timers fold and expire.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The day after which an unresolved episode expires, the window and number of equal failures, and what may repeat.
EXPIRES, WINDOW, TIMES = 86_400, 600, 3
MAY_REPEAT = ("read", "edit")
KINDS = ("waiting", "error", "stuck")
SUBAGENT = "subagent-start"
FACT = ("id", "kind", "name", "category", "at", "order_key", "fact_id")
EPISODE = (
    "id string, episode_id string, kind string, rule string, opened_at long, last_at long, facts long, feedback string, snoozed_until long, "
    "state string, closed_at long"
)
INSTANTS = ("opened_at", "last_at", "snoozed_until", "closed_at")
SECOND = 1_000_000
#: Groups of the state; fixed for a checkpoint.
BUCKETS = 256


def nothing() -> dict:
    return {"open": {}, "failures": [], "starts": {}}


def _close(s: dict, kind: str, state: str, at: int, closed: list[dict]) -> None:
    closed.append({**s["open"].pop(kind), "state": state, "closed_at": at})


def _touch(s: dict, id_: str, kind: str, rule: str, f: dict) -> None:
    """Opens an episode with fact f, or adds f to the one that is open."""
    if kind in s["open"]:
        s["open"][kind] |= {"last_at": f["at"], "facts": s["open"][kind]["facts"] + 1}
        return
    name = hashlib.sha256(f"{id_}|{kind}|{f['at']}|{f['order_key']}".encode()).hexdigest()[:16]
    s["open"][kind] = {"episode_id": name, "kind": kind, "rule": rule, "opened_at": f["at"], "last_at": f["at"], "facts": 1, "feedback": None, "snoozed_until": None, "state": "open", "closed_at": None}


def expire(s: dict, now: int, closed: list[dict]) -> None:
    for kind in [k for k in KINDS if k in s["open"] and now > s["open"][k]["opened_at"] + EXPIRES * SECOND]:
        _close(s, kind, "expired", s["open"][kind]["opened_at"] + EXPIRES * SECOND, closed)


def step(s: dict, id_: str, f: dict, window: int, closed: list[dict]) -> None:
    """Changes s by fact f; episodes that end are put to closed."""
    expire(s, f["at"], closed)
    kind, at = f["kind"], f["at"]
    for k in KINDS if kind == "progress" else KINDS[:2] if kind == "start" else ():
        if k in s["open"]:
            _close(s, k, "resolved", at, closed)
    counts = f["category"] not in MAY_REPEAT
    if kind == "progress":
        s["failures"], s["starts"] = [], {}
    elif kind == "waiting":
        _touch(s, id_, "waiting", "waiting", f)
    elif kind == "failure":
        _touch(s, id_, "error", "error", f)
        if counts:
            what = SUBAGENT if f["category"] == SUBAGENT else f["name"]
            # Of one name the last ones tell all there is to know.
            same = [x for x in s["failures"] if x[0] == what and x[1] >= at - window * SECOND][-(TIMES - 1) :] + [[what, at]]
            s["failures"] = [x for x in s["failures"] if x[0] != what and x[1] >= at - window * SECOND] + same
            if len(same) >= TIMES:
                _touch(s, id_, "stuck", "subagent-start-failures" if what == SUBAGENT else "repeated-failure", f)
    elif kind == "start" and counts:
        s["starts"][f["name"]] = s["starts"].get(f["name"], 0) + 1
        if s["starts"][f["name"]] >= TIMES:
            _touch(s, id_, "stuck", "repeated-start", f)
    elif kind == "feedback" and f["name"] in s["open"]:
        # `snoozed` tells its seconds behind a colon.
        action, _, seconds = f["category"].partition(":")
        s["open"][f["name"]] |= {"feedback": action, "snoozed_until": at + int(seconds or 3600) * SECOND if action == "snoozed" else None}


def place(f: dict) -> tuple:
    return f["at"], f["order_key"], f["fact_id"]


def settle(s: dict, id_: str, fresh: list[dict], watermark: int, window: int) -> list[dict]:
    """Folds into s (base, pending, shown: all of one session) what the watermark has passed, keeps the rest, and returns the episodes that are new or changed."""
    line = sorted([*s["pending"], *fresh], key=place)
    passed = [f for f in line if f["at"] <= watermark]
    final: list[dict] = []
    for f in passed:
        step(s["base"], id_, f, window, final)
    expire(s["base"], watermark, final)
    s["pending"] = line[len(passed) :]
    view, ended = json.loads(json.dumps(s["base"])), []
    for f in s["pending"]:
        step(view, id_, f, window, ended)
    now = {e["episode_id"]: e for e in [*final, *ended, *view["open"].values()]}
    sure = {e["episode_id"] for e in final}
    before, s["shown"] = s["shown"], {name: json.dumps(e, sort_keys=True) for name, e in now.items() if name not in sure}
    out = [{"id": id_, **e} for name, e in now.items() if before.get(name) != json.dumps(e, sort_keys=True)]
    return out + [{"id": id_, **json.loads(before[name]), "state": "withdrawn"} for name in before.keys() - now.keys()]


def wakes(s: dict) -> int | None:
    """The next millisecond at which something of s passes the watermark for good."""
    next_ = [f["at"] for f in s["pending"][:1]] + [e["opened_at"] + EXPIRES * SECOND for e in s["base"]["open"].values()]
    return min(next_) // 1000 + 2 if next_ else None


def new_facts(s: dict, rows: list[dict]) -> list[dict]:
    """rows without those that s knows, each once."""
    known, fresh = {f["fact_id"] for f in s["pending"]}, []
    for r in rows:
        if r["fact_id"] not in known:
            known.add(r["fact_id"])
            fresh.append({**r, "at": int(r["at"])})
    return fresh


class Episodes(StatefulProcessor):
    """One session a group, for streams of few sessions with many facts: its list of facts grows by appending."""

    def __init__(self, window: int = WINDOW):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "body string")
        self.pending = handle.getListState("pending", "kind string, name string, category string, at long, order_key string, fact_id string")
        #: Episodes that were given out and may still change.
        self.shown = handle.getMapState("shown", "episode_id string", "body string")

    def _settle(self, id_: str, rows: list[dict], watermark: int) -> list[dict]:
        s = {
            "base": json.loads(self.base.get()[0]) if self.base.exists() else nothing(), "shown": {k[0]: v[0] for k, v in self.shown.iterator()},
            "pending": [dict(zip(FACT[1:], row)) for row in self.pending.get()] if self.pending.exists() else [],
        }
        held, before, fresh = len(s["pending"]), s["shown"], new_facts(s, rows)
        out = settle(s, id_, fresh, watermark, self.window)
        self.base.update((json.dumps(s["base"]),))
        if len(s["pending"]) < held + len(fresh):
            self.pending.clear()
            if s["pending"]:
                self.pending.put([tuple(f[c] for c in FACT[1:]) for f in s["pending"]])
        elif fresh:
            self.pending.appendList([tuple(f[c] for c in FACT[1:]) for f in fresh])
        for name in before.keys() - s["shown"].keys():
            self.shown.removeKey((name,))
        for name, body in s["shown"].items():
            if before.get(name) != body:
                self.shown.updateValue((name,), (body,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (at := wakes(s)) is not None:
            self.handle.registerTimer(at)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = self._settle(key[0], [r for pdf in rows for r in pdf[list(FACT[1:])].to_dict("records")], timerValues.getCurrentWatermarkInMs() * 1000)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._settle(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


class GroupedEpisodes(StatefulProcessor):
    """Many sessions a group, as a group costs far more than a session; one timer a group, at the first instant of any of its sessions."""

    def __init__(self, window: int = WINDOW):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "id string", "body string")
        self.wakes = handle.getMapState("wakes", "id string", "at long")

    def _settle(self, id_: str, rows: list[dict], watermark: int) -> list[dict]:
        found = self.sessions.getValue((id_,))
        s = json.loads(found[0]) if found else {"base": nothing(), "pending": [], "shown": {}}
        out = settle(s, id_, new_facts(s, rows), watermark, self.window)
        self.sessions.updateValue((id_,), (json.dumps(s),))
        if (at := wakes(s)) is not None:
            self.wakes.updateValue((id_,), (at,))
        elif self.wakes.containsKey((id_,)):
            self.wakes.removeKey((id_,))
        return out

    def _timer(self, at: int | None, ended: int | None = None) -> None:
        """Registers a timer at the given instant; one that has just expired is deleted by Spark."""
        for timer in list(self.handle.listTimers()):
            if timer != ended:
                self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def _first(self) -> int | None:
        return min((v[0] for _, v in self.wakes.iterator()), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts: dict[str, list[dict]] = {}
        for pdf in rows:
            for values in zip(*(pdf[c] for c in FACT)):
                facts.setdefault(values[0], []).append(dict(zip(FACT[1:], values[1:])))
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        out = [e for id_, new in facts.items() for e in self._settle(id_, new, watermark)]
        self._timer(self._first())
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = [k[0] for k, v in self.wakes.iterator() if v[0] <= now]
        out = [e for id_ in due for e in self._settle(id_, [], now * 1000)]
        # What a settled session still waits for lies behind the watermark.
        self._timer(self._first(), expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(episodes: list[dict]) -> pd.DataFrame:
    kinds = dict(c.strip().split(" ") for c in EPISODE.split(","))
    return pd.DataFrame({c: pd.Series([e.get(c) for e in episodes], dtype="Int64" if t == "long" else "object") for c, t in kinds.items()})


def attention_episodes(facts: DataFrame, feedback: DataFrame | None = None, delay: str = "1 hour", window: int = WINDOW, buckets: int = BUCKETS) -> DataFrame:
    """Changed episodes of a stream of facts (columns FACT, at a timestamp) and of feedback (id, name: the kind of episode, category: the action).

    Facts later than delay are refused. Each change of an episode is a row; the last one counts. Needs the RocksDB state store.
    """
    rows = facts.select(*FACT)
    if feedback is not None:
        rows = rows.unionByName(feedback.withColumn("kind", F.lit("feedback")).select(*FACT))
    # The event time stays a timestamp for the watermark and goes into the state as microseconds.
    rows = rows.withWatermark("at", delay).withColumn("event_time", F.col("at"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select(bucket, "id", "event_time", *[c for c in FACT if c not in ("id", "at")], F.unix_micros("at").alias("at"))
    out = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=GroupedEpisodes(window), outputStructType=EPISODE, outputMode="Update", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in INSTANTS})


def latest_episodes(changes: DataFrame) -> DataFrame:
    """Each episode as its last change left it, without withdrawn ones."""
    names = [c for c in changes.columns if c not in ("id", "episode_id", "batch")]
    newest = changes.groupBy("id", "episode_id").agg(F.max_by(F.struct(*names), "batch").alias("e")).select("id", "episode_id", "e.*")
    return newest.where("state <> 'withdrawn'")
