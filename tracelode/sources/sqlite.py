"""Embedded databases as a Python data source: one verified copy for all tasks, read in ranges of its keys.

A hot rollback journal is refused, the copy is checked, and columns that a database does not have are null.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import time
import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tracelode.operators.graph import shared_folder

MAX_PAYLOAD = 1 << 20
#: Names of folders of copies; what marks the path of a copy that frozen() made; the age at which copies count as abandoned.
SNAPSHOTS, FROZEN, DAY = "sqlite", "#frozen", 86_400.0


def revision(path: str) -> str:
    """Length and time of the database, its log and its journal: equal as long as nothing was written."""
    parts = []
    for suffix in ("", "-wal", "-journal"):
        try:
            s = os.stat(path + suffix)
            parts.append(f"{s.st_size}:{s.st_mtime_ns}")
        except FileNotFoundError:
            parts.append("-")
    return "|".join(parts)


def snapshot(path: str, folder: str) -> str:
    """A verified copy of the database with its write-ahead log."""
    journal = path + "-journal"
    if os.path.exists(journal) and os.path.getsize(journal) > 0:
        raise RuntimeError(f"{path} has a hot rollback journal")
    before = revision(path)
    copy = os.path.join(folder, "snapshot.db")
    shutil.copyfile(path, copy)
    if os.path.exists(path + "-wal"):
        shutil.copyfile(path + "-wal", copy + "-wal")
    if revision(path) != before:
        raise RuntimeError(f"{path} changed while it was copied")
    with closing(sqlite3.connect(copy)) as c:
        if c.execute("PRAGMA quick_check").fetchone()[0] != "ok":
            raise RuntimeError(f"{path} is damaged")
        # The log goes into the copy itself, so that tasks read it without writing beside it.
        c.execute("PRAGMA journal_mode = DELETE")
    return copy


@contextmanager
def frozen(spark: SparkSession, path: str) -> Iterator[str]:
    """A copy of the database in the shared folder, for as many reads as are wanted of one state of it; removed at the end."""
    folder = _fresh(shared_folder(spark, SNAPSHOTS))
    try:
        yield snapshot(path, folder) + FROZEN
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _fresh(folder: str) -> str:
    folder = folder.removeprefix("file://")
    os.makedirs(folder)
    return folder


def remove_abandoned(base: str, older_than: float = DAY) -> list[str]:
    """Removes the copies below base that nothing has touched for so many seconds: those of queries that did not end."""
    gone = []
    for name in os.listdir(base) if os.path.isdir(base) else ():
        folder = os.path.join(base, name)
        if name.startswith(f"{SNAPSHOTS}-") and time.time() - os.stat(folder).st_mtime > older_than:
            shutil.rmtree(folder, ignore_errors=True)
            gone.append(folder)
    return gone


class _Range(InputPartition):
    """Rows of the copy whose key is from low on and below high; None is no bound."""

    def __init__(self, copy: str, keys: list[str], low: tuple | None, high: tuple | None):
        self.copy, self.keys, self.low, self.high = copy, keys, low, high


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def _keys(c: sqlite3.Connection, table: str) -> list[str]:
    """rowid, or the primary key of a table that has none."""
    try:
        c.execute(f'SELECT rowid FROM "{table}" LIMIT 1')
        return ["rowid"]
    except sqlite3.OperationalError:
        rows = c.execute(f'PRAGMA table_info("{table}")').fetchall()
        return [_name(r[1]) for r in sorted((r for r in rows if r[5]), key=lambda r: r[5])]


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["dbtable"]
        self.parts, self.base = int(options.get("partitions", "1")), options["snapshots"]
        if not self.table.replace("_", "").isalnum():
            raise ValueError(f"not a table name: {self.table!r}")

    def partitions(self):
        """One copy for all tasks, cut at keys that leave the same number of rows between them."""
        if self.path.endswith(FROZEN):
            copy = self.path.removesuffix(FROZEN)
        else:
            remove_abandoned(os.path.dirname(self.base))
            copy = snapshot(self.path, _fresh(f"{self.base}-{uuid.uuid4().hex[:8]}"))
        with closing(sqlite3.connect(copy)) as c:
            keys = _keys(c, self.table)
            n = c.execute(f'SELECT count(*) FROM "{self.table}"').fetchone()[0]
            at = [n * i // self.parts for i in range(1, self.parts)]
            ordered = f'SELECT {", ".join(keys)} FROM "{self.table}" ORDER BY {", ".join(keys)} LIMIT 1 OFFSET ?'
            cuts = [c.execute(ordered, (i,)).fetchone() for i in sorted(set(at)) if 0 < i < n]
        bounds = [None, *cuts, None]
        return [_Range(copy, keys, low, high) for low, high in zip(bounds, bounds[1:])]

    def read(self, partition):
        key = f"({', '.join(partition.keys)})"
        marks = f"({', '.join('?' * len(partition.keys))})"
        limits = [(f"{key} >= {marks}", partition.low), (f"{key} < {marks}", partition.high)]
        limits = [(text, value) for text, value in limits if value is not None]
        where = " AND ".join(text for text, _ in limits) or "1"
        with closing(sqlite3.connect(f"file:{partition.copy}?mode=ro", uri=True)) as c:
            there = {r[1] for r in c.execute(f'PRAGMA table_info("{self.table}")')}
            columns = ", ".join(_name(f.name) if f.name in there else "NULL" for f in self.schema.fields)
            for row in c.execute(f'SELECT {columns} FROM "{self.table}" WHERE {where}', [v for _, value in limits for v in value]):
                yield tuple(_fit(v, f.dataType.typeName()) for v, f in zip(row, self.schema.fields))


def _fit(value, kind: str):
    """SQLite's types belong to values, not columns; what does not fit is null."""
    try:
        if value is None:
            return None
        if kind == "long":
            return int(value)
        if kind == "double":
            return float(value)
        return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (TypeError, ValueError):
        return None


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "embedded_sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 1) -> DataFrame:
    """A table of a database file with exactly the columns of schema; columns that the table has not are null.

    The driver copies the database once into the folder that all tasks share; they read ranges of the copy's keys. Copies of
    queries that ended are removed after a day by later reads; frozen() gives a copy that is removed at once.
    """
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("embedded_sqlite").schema(schema).option("path", path).option("dbtable", table).option("partitions", str(partitions))
    return reader.option("snapshots", shared_folder(spark, SNAPSHOTS).removeprefix("file://")).load()


SUMMARIES = "conversationId string, title string, tldr string, model string, updatedAt long"
CODE_HASHES = "hash string, conversationId string, timestamp long, createdAt long, model string, source string"
HERMES_SESSIONS = "id string, model string, started_at double, ended_at double, message_count long, tool_call_count long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, estimated_cost_usd double, actual_cost_usd double, cost_status string, title string"
HERMES_MESSAGES = "id long, session_id string, role string, content string, tool_calls string, timestamp double"


def cursor_history(summaries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Conversation summaries and edit hashes as one table by conversation; hashes of unknown conversations go."""
    a = summaries.where(F.coalesce(F.trim("conversationId"), F.lit("")) != "").select(F.col("conversationId").alias("conversation_id"), F.lit("summary").alias("kind"), F.timestamp_millis("updatedAt").alias("ts"), "title", "model")
    b = hashes.where(F.col("conversationId").isNotNull()).select(F.col("conversationId").alias("conversation_id"), F.lit("edit").alias("kind"), F.timestamp_millis(F.coalesce("timestamp", "createdAt")).alias("ts"), "model", F.col("hash").alias("event_id"))
    known = b.join(a.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return a.unionByName(known, allowMissingColumns=True)


def hermes_events(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions left-joined to their messages' events: one prompt a user message, one tool event a call; oversized payloads are not read."""
    small = F.when(F.octet_length("tool_calls") <= MAX_PAYLOAD, F.col("tool_calls"))
    calls = F.from_json(small, "array<struct<function:struct<name:string>,name:string>>")
    m = messages.withColumn("oversized", F.coalesce(F.octet_length("tool_calls") > MAX_PAYLOAD, F.lit(False))).withColumn("calls", F.when(F.col("role") == "assistant", calls))
    tools = m.select("session_id", F.col("id").alias("message_id"), F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")).alias("ts"), "role", "oversized", F.posexplode_outer("calls").alias("position", "call"))
    events = tools.select(
        "session_id", "message_id", "ts", "oversized", F.coalesce("position", F.lit(0)).alias("position"),
        F.when(F.col("call").isNotNull(), "tool").when((F.col("role") == "user"), "prompt").when(F.col("role") == "assistant", "response").otherwise("other").alias("event_type"),
        F.coalesce("call.function.name", "call.name").alias("name"),
    )
    return sessions.withColumnRenamed("id", "session_id").join(events, "session_id", "left")
