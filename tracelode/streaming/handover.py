"""Transcripts read once up to a byte and followed from there: the state of each goes from a batch into the stream's state.

The batch is a plain scan of the lines before each file's byte; its result is the initial state of the keyed operator, and
the follower begins at the same bytes. A line before its file's byte that comes all the same is passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelode.functions.timefn import instant
from tracelode.sources.live_logs import CLOSES, OPENS, SIGNALS

#: What is known of a transcript; `next` is the byte at which reading goes on. Instants are microseconds.
TURNS = "path string, next long, open boolean, started_at long, kind string, status string, phase string, signal_at long, mode string, new_mode string"
NAMES = tuple(c.split()[0] for c in TURNS.split(", "))
LINE = ("path", "at", "size", "kind", "ts", "mode")
#: Groups of the state; fixed for a checkpoint.
BUCKETS = 512


def signals(lines: DataFrame) -> DataFrame:
    """(path, at, size, kind, ts, mode) of lines (path, at, raw): kind where a line is a signal, mode where it sets the collaboration mode."""
    get = lambda p: F.try_variant_get("r", p, "string")
    rows = lines.select("path", "at", (F.octet_length("raw") + 1).alias("size"), F.try_parse_json("raw").alias("r"))
    kind = F.when((get("$.type") == "event_msg") & get("$.payload.type").isin(*SIGNALS), get("$.payload.type"))
    mode = F.when(get("$.type") == "turn_context", F.coalesce(get("$.payload.collaboration_mode.mode"), get("$.payload.collaboration_mode")))
    return rows.select("path", "at", "size", kind.alias("kind"), F.unix_micros(instant(F.coalesce(get("$.timestamp"), F.lit("")))).alias("ts"), mode.alias("mode"))


def bootstrap(lines: DataFrame) -> DataFrame:
    """TURNS of the lines of a batch, one row a transcript: the last boundary, the last signal and the mode at it."""
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = signals(lines).withColumn("now", F.last("mode", ignorenulls=True).over(w))
    bound, signal = F.col("kind").isin(*OPENS, *CLOSES), F.col("kind").isNotNull()
    last = rows.groupBy("path").agg(
        F.max(F.col("at") + F.col("size")).alias("next"), F.max(F.when(bound, F.struct("at", F.col("kind").isin(*OPENS).alias("open"), "ts"))).alias("b"), F.max(F.when(signal, F.struct("at", "kind", "ts", "now"))).alias("s"), F.max(F.struct("at", "now")).alias("l"),
    )
    table = F.create_map(*[x for k, (s, p) in SIGNALS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("status"), F.lit(p).alias("phase")))])
    shown = F.try_element_at(table, F.col("s.kind"))
    return last.select("path", "next", F.coalesce("b.open", F.lit(False)).alias("open"), F.when(F.col("b.open"), F.col("b.ts")).alias("started_at"), F.col("s.kind").alias("kind"), shown["status"].alias("status"), shown["phase"].alias("phase"), F.col("s.ts").alias("signal_at"), F.col("s.now").alias("mode"), F.col("l.now").alias("new_mode"))


def take(s: dict, line: dict) -> dict:
    """s after one line of signals."""
    if line["at"] < s["next"]:
        return s
    s = {**s, "next": line["at"] + line["size"]}
    if line["mode"] is not None:
        s["new_mode"] = line["mode"]
    kind = line["kind"]
    if kind in OPENS:
        s |= {"open": True, "started_at": line["ts"]}
    elif kind in CLOSES:
        s |= {"open": False, "started_at": None}
    if kind is not None:
        s |= {"kind": kind, "status": SIGNALS[kind][0], "phase": SIGNALS[kind][1], "signal_at": line["ts"], "mode": s["new_mode"]}
    return s


def unread(path: str) -> dict:
    return dict.fromkeys(NAMES) | {"path": path, "next": 0, "open": False}


def _plain(record: dict) -> dict:
    return {k: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) else v for k, v in record.items()}


class Turns(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "path string", "body string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # Instants may be missing, so they pass as text.
        for path, body in zip(initialState["path"], initialState["body"]):
            self.turns.updateValue((path,), (body,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines: dict[str, list[tuple]] = {}
        for pdf in rows:
            for path, *line in zip(*(pdf[c] for c in LINE)):
                lines.setdefault(path, []).append(tuple(line))
        out = []
        for path, new in lines.items():
            found = self.turns.getValue((path,))
            s = json.loads(found[0]) if found else unread(path)
            for line in sorted(new, key=lambda x: x[0]):
                s = take(s, _plain(dict(zip(LINE[1:], line))))
            self.turns.updateValue((path,), (json.dumps(s),))
            out.append(s)
        yield pd.DataFrame({c: pd.Series([s[c] for s in out], dtype="Int64" if c in ("next", "started_at", "signal_at") else "object") for c in NAMES})

    def close(self) -> None:
        pass


def followed(lines: DataFrame, known: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Changed TURNS of a stream of lines (path, at, raw) that goes on where known, the TURNS of a batch, ended. Needs the RocksDB state store.

    The state is grouped by buckets of paths, as the rows of one key cost far more than a row; a task holds a bucket's lines of a batch.
    """
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
    first = known.select(bucket, "path", F.to_json(F.struct(*NAMES), {"ignoreNullFields": "false"}).alias("body")).groupBy("bucket")
    return signals(lines).select(bucket, *LINE).groupBy("bucket").transformWithStateInPandas(statefulProcessor=Turns(), outputStructType=TURNS, outputMode="Update", timeMode="None", initialState=first)


def latest(known: DataFrame, changes: DataFrame) -> DataFrame:
    """TURNS of all transcripts: the batch's, or as the stream's last change left them."""
    newest = changes.groupBy("path").agg(F.max_by(F.struct(*NAMES[1:]), "next").alias("c")).select("path", "c.*")
    return known.join(newest.select("path"), "path", "left_anti").unionByName(newest)
