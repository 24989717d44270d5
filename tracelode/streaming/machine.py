"""The live session state machine on keyed state.

Events of a session are kept in their total order (instant, order key). The visible state is the fold over them, so it
is the same for every order of arrival, duplicates included. What lies before the last stop that was followed by a
resume can no longer change that state, nor can events that arrive late for it: it is folded into a base, and later
arrivals before its end are passed over. Only a run of more than `KEPT` events without a stop and a resume is folded
at its old end for want of room; events later than that bound are refused. No watermark: late events are taken. Timers
end the state: 45 s after completion, 6 h after anything else.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelode.operators.live import COMPLETED_TTL, OTHER_TTL

KEPT = 4096
#: The labels that a card shows.
SHOWN = 3
STOPPED = ("waiting", "error", "completed")
OUTPUT = "id string, agent string, status string, phase string, started_at timestamp, updated_at timestamp, activity_ended_at timestamp, actions array<string>, transition string"
INPUT = ("id", "agent", "status", "phase", "label", "updated_at", "order_key", "event_id")


def step(state: dict, e: dict) -> dict:
    """The state after e: a resume begins anew, a first stop is kept through further ones."""
    resumed = state.get("status") in STOPPED and e["status"] not in STOPPED
    stopped = e["status"] in STOPPED
    return {
        "agent": e["agent"], "status": e["status"], "phase": e["phase"], "updated": e["ts"],
        "started": e["ts"] if resumed or state.get("started") is None else state["started"],
        "ended": (state.get("ended") or e["ts"]) if stopped else None,
        "actions": [*state.get("actions", []), e["label"]][-SHOWN:],
    }


def fold(base: dict, events: list[dict]) -> dict:
    for e in sorted(events, key=place):
        base = step(base, e)
    return base


def place(e: dict) -> tuple:
    return e["ts"], e["key"]


def settled(events: list[dict], kept: int) -> int:
    """How many of the first of events, which are in order, no further event can make matter to the visible state."""
    n = 0
    for i in range(len(events) - 1, 1, -1):
        if events[i]["status"] not in STOPPED and events[i - 1]["status"] in STOPPED:
            n = min(i - 1, len(events) - SHOWN)
            break
    return max(n, len(events) - kept, 0)


def arrive(s: dict, new: list[dict], kept: int) -> dict:
    """The stored state s with new events: each once, in order, what is settled folded into the base."""
    known, horizon = {e["id"] for e in s["events"]}, s["horizon"] and tuple(s["horizon"])
    for e in new:
        if e["id"] not in known and (horizon is None or place(e) > horizon):
            known.add(e["id"])
            s["events"].append(e)
    s["events"].sort(key=place)
    if n := settled(s["events"], kept):
        s["horizon"] = list(place(s["events"][n - 1]))
        s["base"] = fold(s["base"], s["events"][:n])
        del s["events"][:n]
    return s


class LiveSessions(StatefulProcessor):
    def __init__(self, expire: bool = True, kept: int = KEPT):
        self.expire, self.kept = expire, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "body string")

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {"base": {}, "events": [], "horizon": None, "seen": None}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        for pdf in rows:
            s = arrive(s, [{"id": r["event_id"], "ts": r["updated_at"].value // 1000, "key": r["order_key"], "agent": r["agent"], "status": r["status"], "phase": r["phase"], "label": r["label"]} for r in pdf.to_dict("records")], self.kept)
        now = fold(s["base"], s["events"])
        shown = [now["status"], now["updated"], now["phase"], now["actions"], now["started"], now["ended"]]
        if shown == s["seen"]:
            self.state.update((json.dumps(s),))
            return
        before, s["seen"] = s["seen"], shown
        self.state.update((json.dumps(s),))
        if self.expire:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            ttl = COMPLETED_TTL if now["status"] == "completed" else OTHER_TTL
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + ttl * 1000)
        at = lambda us: pd.NaT if us is None else pd.Timestamp(us, unit="us")
        moved = now["status"] in STOPPED and (before is None or before[0] != now["status"])
        yield pd.DataFrame({
            "id": [key[0]], "agent": [now["agent"]], "status": [now["status"]], "phase": [now["phase"]], "started_at": [at(now["started"])], "updated_at": [at(now["updated"])],
            "activity_ended_at": pd.Series([at(now["ended"])], dtype="datetime64[ns]"), "actions": [now["actions"]], "transition": pd.Series([now["status"] if moved else None], dtype="object"),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_sessions(events: DataFrame, expire: bool = True, kept: int = KEPT) -> DataFrame:
    """Changed session cards from a stream of canonical events; needs the RocksDB state store.

    Without expire there are no timers: a stream that has timers always has a next batch, so a replay to its end has none.
    """
    mode = "ProcessingTime" if expire else "None"
    return events.select(*INPUT).groupBy("id").transformWithStateInPandas(statefulProcessor=LiveSessions(expire, kept), outputStructType=OUTPUT, outputMode="Update", timeMode=mode)


def latest_cards(changes: DataFrame) -> DataFrame:
    """The newest card of each session from all emitted changes, with their number of batches as tie order."""
    from pyspark.sql import functions as F

    names = [c for c in changes.columns if c not in ("id", "batch")]
    return changes.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("batch", "updated_at")).alias("c")).select("id", "c.*")


def replay(stream: DataFrame, folder: str) -> DataFrame:
    """Runs all that a stream has now through the machine and returns the cards; folder is one that executors share."""
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def keep(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        # A batch that is run again replaces its own folder.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/batch_no={number}")

    try:
        query = live_sessions(stream, expire=False).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return latest_cards(spark.read.parquet(f"{folder}/changes").drop("batch_no"))


def episodes(events: DataFrame, key: str = "id") -> DataFrame:
    """Attention episodes of stored events: a run of waiting or error events is one episode, resolved by the next progress.

    Repeated facts belong to the open episode; it expires after a day.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(key).orderBy("updated_at", "order_key")
    open_ = F.col("status").isin("waiting", "error")
    rows = events.withColumn("o", open_).withColumn("head", (open_ & ~F.coalesce(F.lag("o").over(w), F.lit(False))).cast("long"))
    rows = rows.withColumn("n", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("n > 0")
    out = rows.groupBy(key, "n").agg(
        F.min_by("status", F.struct("updated_at", "order_key")).alias("kind"), F.min("updated_at").alias("opened_at"), F.count_if("o").alias("facts"),
        F.min(F.when(~F.col("o"), F.col("updated_at"))).alias("resolved_at"),
    )
    day = F.col("opened_at") + F.expr("INTERVAL 24 HOURS")
    return out.withColumn("resolved_at", F.when(F.col("resolved_at") <= day, F.col("resolved_at"))).withColumn("expires_at", day)
