"""Hooks, followed transcripts and polled runtimes fused into one state a session.

The three sources become rows of FACTS and are united before the one stateful operator. What a session shows is the fold
of its facts in their total order (instant, order key), so any order of arrival, repeats and restarts lead to the same
card. The sources have rules of their own: hooks and polls set the state; a transcript opens no session, ends waiting or
error only after a paused turn, and its completion counts only if it was read live or the session is completed already.

A poll is a snapshot of all sessions that a runtime shows, and its end is a row as well. A session that one poll shows
and the next finished one does not has disappeared at that next poll. To see this in the state, facts are grouped by
buckets of ids and not by id: the end of a snapshot goes to every bucket. A late row of a snapshot takes a disappearance
back, as that is found anew whenever facts come in.

State: facts of a session after the last run of two unconditional ones that stop and resume it, or after it disappeared;
what lies before is folded into a base. Only `kept` facts without such a place, and `kept` snapshots of one runtime, are a
bound: what is later than that is refused.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tracelode.functions.hashing import live_session_id, stable_hash
from tracelode.functions.timefn import instant
from tracelode.sources.live_logs import SIGNALS
from tracelode.sources.tail import Ranges, files_below, lines_of, packed, ranges, size_of

ACTIVE = ("idle", "running")
KEPT, SHOWN, BUCKETS = 4096, 3, 64
#: Bytes of the longest row of a snapshot.
MAX_ROW = 1 << 30
FACTS = "bucket int, id string, agent string, origin string, status string, phase string, label string, reason string, live boolean, at timestamp, order_key string, fact_id string"
#: Instants are microseconds inside the state, so that no zone plays a part there.
CARD = "id string, agent string, status string, phase string, reason string, started_at long, updated_at long, activity_ended_at long, actions array<string>"
TIMES = ("started_at", "updated_at", "activity_ended_at")
#: Where facts come from; `snapshot` is the end of a poll.
HOOK, TRANSCRIPT, POLL, SNAPSHOT, GONE = "hook", "transcript", "poll", "snapshot", "gone"


def _bucket(id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def hook_facts(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Facts of canonical events (envelopes.canonical)."""
    reason = F.when(F.col("status") == "waiting", F.col("phase"))
    return events.select(
        _bucket(F.col("id"), buckets).alias("bucket"), "id", "agent", F.lit(HOOK).alias("origin"), "status", "phase", "label", reason.alias("reason"), F.lit(True).alias("live"), F.col("updated_at").alias("at"), "order_key",
        F.concat_ws(":", F.lit(HOOK), "event_id").alias("fact_id"),
    )


def transcript_facts(lines: DataFrame, agent: str = "codex", session: Column | None = None, live: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Facts of a transcript's lines (path, at, raw); the session is the file's name without its ending unless told otherwise."""
    record = F.try_parse_json("raw")
    get = lambda p: F.try_variant_get("r", p, "string")
    table = F.create_map(*[x for k, (s, p) in SIGNALS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("status"), F.lit(p).alias("phase")))])
    name = session if session is not None else F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z]+)*$", 1)
    rows = lines.select("path", F.col("at").alias("byte"), record.alias("r"), name.alias("session"), (F.lit(True) if live is None else live).alias("live"))
    kind = get("$.payload.type")
    rows = rows.where((get("$.type") == "event_msg") & kind.isin(*SIGNALS)).withColumn("s", F.try_element_at(table, kind)).withColumn("ts", instant(F.coalesce(get("$.timestamp"), F.lit(""))))
    paused = (kind == "turn_aborted") & (get("$.payload.reason") == "paused")
    id_ = live_session_id(F.lit(agent), F.col("session"))
    return rows.where(F.col("ts").isNotNull()).select(
        _bucket(id_, buckets).alias("bucket"), id_.alias("id"), F.lit(agent).alias("agent"), F.lit(TRANSCRIPT).alias("origin"), F.when(paused, "paused").otherwise(F.col("s.status")).alias("status"), F.col("s.phase").alias("phase"),
        kind.alias("label"), F.when(paused, "turn-paused").when(F.col("s.status") == "waiting", kind).alias("reason"), "live", F.col("ts").alias("at"),
        F.concat(F.lit("transcript:"), F.lpad(F.col("byte").cast("string"), 20, "0")).alias("order_key"), F.concat_ws(":", F.lit(TRANSCRIPT), stable_hash(F.col("path")), F.col("byte").cast("string")).alias("fact_id"),
    )


def poll_facts(polls: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Facts of polled snapshots (poll, agent, session, status, phase, label, updated_at); a row without a session ends a snapshot.

    A poll's fact carries the instant of the session's own last change; that the poll saw the session is kept beside it.
    """
    shown = polls.where(F.col("session").isNotNull())
    id_ = live_session_id(F.col("agent"), F.col("session"))
    seen = shown.select(
        _bucket(id_, buckets).alias("bucket"), id_.alias("id"), "agent", F.lit(POLL).alias("origin"), "status", "phase", "label", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("live"), F.col("updated_at").alias("at"),
        F.concat(F.lit("poll:"), "status", F.lit(":"), F.coalesce("phase", F.lit(""))).alias("order_key"), F.unix_micros("poll").cast("string").alias("fact_id"),
    )
    ends = polls.where(F.col("session").isNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast("string").alias("id"), "agent", F.lit(SNAPSHOT).alias("origin"), *[F.lit(None).cast("string").alias(c) for c in ("status", "phase", "label", "reason")],
        F.lit(True).alias("live"), F.col("poll").alias("at"), F.lit("").alias("order_key"), F.unix_micros("poll").cast("string").alias("fact_id"),
    )
    return seen.unionByName(ends)


def step(s: dict | None, f: dict) -> dict | None:
    """What a session shows after fact f; None is a session that is not shown."""
    if f["origin"] == GONE:
        return None
    active = f["status"] in ACTIVE
    if s is None:
        if f["origin"] == TRANSCRIPT:
            return None
        return {"agent": f["agent"], "status": f["status"], "phase": f["phase"], "reason": f["reason"], "started": f["at"], "updated": f["at"], "ended": None if active else f["at"], "actions": [f["label"]]}
    if f["origin"] == TRANSCRIPT:
        if f["status"] == "completed" and not f["live"] and s["status"] != "completed":
            return s
        if s["status"] in ("waiting", "error") and f["status"] == "running" and s["reason"] != "turn-paused":
            return s
    resumed = active and s["status"] not in ACTIVE
    before = [] if resumed and s["status"] == "completed" else s["actions"]
    return {
        "agent": s["agent"], "status": f["status"], "phase": f["phase"], "reason": f["reason"], "started": f["at"] if resumed else s["started"], "updated": f["at"],
        "ended": None if active else f["at"] if s["status"] in ACTIVE else s["ended"], "actions": [*before, f["label"]][-SHOWN:],
    }


def place(f: dict) -> tuple:
    return f["at"], f["key"]


def with_gone(facts: list[dict], seen: list[int], polls: list[int]) -> list[dict]:
    """facts and a disappearance for every finished poll that is the next after one that saw the session and does not see it."""
    held, out = set(seen), list(facts)
    for p in seen:
        i = bisect_right(polls, p)
        if i < len(polls) and polls[i] not in held:
            out.append({"id": f"gone:{polls[i]}", "origin": GONE, "at": polls[i], "key": "~", "status": None})
    return sorted(out, key=place)


def settled(line: list[dict], kept: int) -> int:
    """How many of the first of all facts in order cannot matter any more, whatever arrives after them."""
    n = max(0, len(line) - kept)
    sure = [f["origin"] in (HOOK, POLL) for f in line]
    for i in range(len(line) - 1, 0, -1):
        a, b = line[i - 1], line[i]
        # Sure to stop and sure to resume, neither by a transcript, whose facts depend on what was before.
        if sure[i] and b["status"] in ACTIVE and sure[i - 1] and a["status"] not in ACTIVE:
            # What else is shown of before are actions: none where a completion is resumed, else those from one more sure fact on.
            if a["status"] == "completed":
                return max(n, i - 1)
            if i > 1 and sure[i - 2]:
                return max(n, i - 2)
    return n


class FusedSessions(StatefulProcessor):
    def __init__(self, kept: int = KEPT):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "id string", "body string")
        self.polls = handle.getMapState("polls", "agent string", "body string")
        #: Which sessions polls have shown, by agent: those that the end of a snapshot may concern.
        self.polled = handle.getMapState("polled", "agent string, id string", "last long")

    def _polls(self, agent: str) -> list[int]:
        return json.loads(self.polls.getValue((agent,))[0]) if self.polls.containsKey((agent,)) else []

    def _load(self, id_: str) -> dict:
        if self.sessions.containsKey((id_,)):
            return json.loads(self.sessions.getValue((id_,))[0])
        return {"agent": None, "base": None, "horizon": None, "facts": [], "seen": [], "shown": None}

    def _take(self, s: dict, r: dict) -> None:
        """Adds one fact to what is stored of its session."""
        at = int(r["at"])
        s["agent"] = s["agent"] or r["agent"]
        if r["origin"] == POLL:
            poll = int(r["fact_id"])
            if poll not in s["seen"]:
                s["seen"] = sorted([*s["seen"], poll])
            # The same state shown by further polls is one fact.
            fact_id = f"poll:{at}:{r['order_key']}"
        else:
            fact_id = r["fact_id"]
        f = {"id": fact_id, "origin": r["origin"], "agent": r["agent"], "status": r["status"], "phase": r["phase"], "label": r["label"], "reason": r["reason"], "live": bool(r["live"]), "at": at, "key": r["order_key"]}
        if fact_id not in {x["id"] for x in s["facts"]} and (s["horizon"] is None or place(f) > tuple(s["horizon"])):
            s["facts"].append(f)

    def _show(self, id_: str, s: dict, polls: list[int]) -> dict | None:
        """Folds the session, stores it, and returns its card where that changed."""
        line = [f for f in with_gone(s["facts"], s["seen"], polls) if s["horizon"] is None or place(f) > tuple(s["horizon"])]
        if n := settled(line, self.kept):
            for f in line[:n]:
                s["base"] = step(s["base"], f)
            s["horizon"], line = list(place(line[n - 1])), line[n:]
            s["facts"] = [f for f in s["facts"] if place(f) > tuple(s["horizon"])]
            # Of polls before the horizon the last one is kept: the next may still miss the session.
            old = [p for p in s["seen"] if p <= s["horizon"][0]]
            s["seen"] = [*old[-1:], *s["seen"][len(old) :]]
        now = s["base"]
        for f in line:
            now = step(now, f)
        changed = now != s["shown"]
        s["shown"] = now
        self.sessions.updateValue((id_,), (json.dumps(s),))
        return {"id": id_, **(now or {"agent": s["agent"]})} if changed else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        touched: dict[str, dict] = {}
        ended: dict[str, set[int]] = {}
        for pdf in rows:
            for r in pdf.to_dict("records"):
                if r["origin"] == SNAPSHOT:
                    ended.setdefault(r["agent"], set()).add(int(r["fact_id"]))
                    continue
                if r["id"] not in touched:
                    touched[r["id"]] = self._load(r["id"])
                self._take(touched[r["id"]], r)
                if r["origin"] == POLL:
                    self.polled.updateValue((r["agent"], r["id"]), (int(r["fact_id"]),))
        for agent, new in ended.items():
            self.polls.updateValue((agent,), (json.dumps(sorted({*self._polls(agent), *new})[-self.kept :]),))
        if ended:
            for (agent, id_), _ in list(self.polled.iterator()):
                if agent in ended and id_ not in touched:
                    touched[id_] = self._load(id_)
        polls = {}
        cards = []
        for id_, s in touched.items():
            if s["agent"] not in polls:
                polls[s["agent"]] = self._polls(s["agent"])
            if card := self._show(id_, s, polls[s["agent"]]):
                cards.append(card)
        if cards:
            yield _frame(cards)

    def close(self) -> None:
        pass


def _frame(cards: list[dict]) -> pd.DataFrame:
    names = {"started_at": "started", "updated_at": "updated", "activity_ended_at": "ended"}
    at = lambda k: pd.Series([c.get(names[k]) for c in cards], dtype="Int64")
    say = lambda k: pd.Series([c.get(k) for c in cards], dtype="object")
    return pd.DataFrame({k: say(k) for k in ("id", "agent", "status", "phase", "reason")} | {k: at(k) for k in TIMES} | {"actions": say("actions")})


def fused_sessions(facts: DataFrame, kept: int = KEPT) -> DataFrame:
    """Changed cards of a stream of facts; a card without a status says that its session is shown no more. Needs the RocksDB state store."""
    rows = facts.withColumn("at", F.unix_micros("at"))
    cards = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=FusedSessions(kept), outputStructType=CARD, outputMode="Update", timeMode="None")
    return cards.withColumns({c: F.timestamp_micros(c) for c in TIMES})


class SnapshotReader(DataSourceStreamReader):
    """Lines of polled snapshots below a folder, one JSON-lines file or folder of such a poll, in the order of their names.

    The offset is the name of the last one. The driver lists names and sizes; tasks read the lines.
    """

    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")

    def _names(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for path in files_below(self.folder, "*.json"):
            found.setdefault(path[len(self.folder) :].strip("/").split("/")[0], []).append(path)
        return found

    def initialOffset(self) -> dict:
        return {"name": ""}

    def latestOffset(self) -> dict:
        return {"name": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        new = sorted((n, p) for n, paths in self._names().items() if start["name"] < n <= end["name"] for p in paths)
        return packed(r for _, p in new for r in ranges(p, 0, size_of(p), True))

    def read(self, partition: Ranges) -> Iterator[tuple]:
        return ((raw,) for r in partition.ranges for _, _, raw in lines_of(r, MAX_ROW) if raw.strip())

    def commit(self, end: dict) -> None:
        pass


class PolledSnapshots(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polled_snapshots"

    def schema(self) -> str:
        return "raw string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SnapshotReader(self.options)


def polled(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots below folder as a stream; a line that is no JSON fails it."""
    spark.dataSource.register(PolledSnapshots)
    names = ("poll", "agent", "session", "status", "phase", "label", "updated_at")
    rows = spark.readStream.format("polled_snapshots").load(folder).select(F.from_json("raw", ", ".join(f"{n} string" for n in names), {"mode": "FAILFAST"}).alias("r"))
    return rows.select(*[F.to_timestamp(f"r.{n}").alias(n) if n in ("poll", "updated_at") else F.col(f"r.{n}").alias(n) for n in names])


def latest_cards(changes: DataFrame) -> DataFrame:
    """The newest card of each session that is still shown, from all changes and the numbers of their batches."""
    names = [c for c in changes.columns if c not in ("id", "batch")]
    newest = changes.groupBy("id").agg(F.max_by(F.struct(*names), "batch").alias("c")).select("id", "c.*")
    return newest.where(F.col("status").isNotNull())


def run_to_end(changes: DataFrame, folder: str) -> DataFrame:
    """Runs all that the sources have now; returns every change of a card with its batch. A second call goes on where the first ended."""
    spark = changes.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own folder.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/batch_no={number}")

    try:
        query = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{folder}/changes").drop("batch_no")
