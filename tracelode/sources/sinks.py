"""Sinks: generations published as a whole, idempotent appends, encrypted retention, pruning."""

from __future__ import annotations

import os
import shutil
import uuid
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RETENTION_DAYS = (30, 90, 180, 365, 730)
ENVELOPE_DAYS = 7


def publish(tables: dict[str, DataFrame], root: str, generation: str) -> None:
    """All tables of a generation or none: each is written below the generation's folder, and only then the pointer.

    A run that breaks off leaves the former generation in place; running it again overwrites its own folder.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/generation={generation}/{name}")
    any_table = next(iter(tables.values()))
    pointer = any_table.sparkSession.createDataFrame([(generation, ",".join(sorted(tables)))], "generation string, tables string")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{root}/current")


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    generation = spark.read.parquet(f"{root}/current").first().generation
    return spark.read.parquet(f"{root}/generation={generation}/{name}")


def tombstones(before: DataFrame, after: DataFrame, key: list[str], at: Column) -> DataFrame:
    """Rows of the former generation that the new one lacks, with deleted_at."""
    return before.join(after.select(*key), key, "left_anti").withColumn("deleted_at", at)


def replace_sessions(stored: DataFrame, fresh: DataFrame, source: str = "source_hash") -> DataFrame:
    """stored with all sessions of the freshly parsed sources replaced: parsing a source again changes nothing."""
    return stored.join(fresh.select(source).distinct(), source, "left_anti").unionByName(fresh, allowMissingColumns=True)


def new_events(batch: DataFrame, stored: DataFrame, identity: tuple[str, ...] = ("agent", "source_session_id", "event_id")) -> DataFrame:
    """The batch's events once each, without those stored before: what an idempotent append adds."""
    return batch.dropDuplicates(list(identity)).join(stored.select(*identity), list(identity), "left_anti")


def _with_key(rows: DataFrame, key: bytes) -> DataFrame:
    """rows with the key as a column. It comes from a table of one row, as a literal would stand in plans, the UI and event logs."""
    one = rows.sparkSession.createDataFrame([(1, bytearray(key))], "__one int, __key binary")
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")


def sealed(envelopes: DataFrame, key: bytes, now: Column, days: int = ENVELOPE_DAYS, body: str = "value", ident: str = "event_id") -> DataFrame:
    """(event_id, sealed, expires_at): bodies under AES-256-GCM, bound to their id, for at most seven days."""
    if len(key) != 32 or not 0 < days <= ENVELOPE_DAYS:
        raise ValueError("a key of 32 bytes and 1 to 7 days")
    text = F.aes_encrypt(F.col(body), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col(ident))
    return _with_key(envelopes, key).select(ident, text.alias("sealed"), (now + F.make_interval(days=F.lit(days))).alias("expires_at"))


def opened(rows: DataFrame, key: bytes, now: Column, ident: str = "event_id") -> DataFrame:
    """Bodies that have not expired; a row whose id was changed is null."""
    text = F.try_aes_decrypt(F.col("sealed"), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), F.col(ident)).cast("string")
    return _with_key(rows.where(F.col("expires_at") > now), key).select(ident, text.alias("value"))


def pruned(rows: DataFrame, date: str, today: str, retention_days: int) -> DataFrame:
    if retention_days not in RETENTION_DAYS:
        raise ValueError(f"retention must be one of {RETENTION_DAYS}")
    return rows.where(F.col(date) > F.date_format(F.date_sub(F.lit(today).cast("date"), retention_days), "yyyy-MM-dd"))


def stage(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """rows written with an ordinal that follows order, and read back: the rows of a publication, settled before it begins.

    Ranges of the order are sorted apart and numbered by range, so ordinals rise but have gaps.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.withColumn("ordinal", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def export(rows: DataFrame, folder: str, kind: str, template: str, at: Column) -> DataFrame:
    """Writes rows as JSON, CSV or Parquet and gives the audit row of it: (template, kind, n_rows, exported_at), from what was written."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"no export of kind {kind!r}")
    rows.write.mode("overwrite").format(kind).save(f"{folder}/{template}")
    found = rows.sparkSession.read.format(kind).schema(rows.schema).load(f"{folder}/{template}")
    return found.agg(F.count("*").alias("n_rows")).select(F.lit(template).alias("template"), F.lit(kind).alias("kind"), "n_rows", at.alias("exported_at"))


def log_files(rows: DataFrame, folder: str, key: str, order: list[str], name: str = "lines.txt", line: str = "value") -> int:
    """Writes each key's lines in their order as the file key=.../name below folder; returns how many files there are.

    The folder lies in a file system that driver and executors have in common. A task writes its files one after the other, and
    a file appears when it is whole, so a task that runs again replaces what it wrote.
    """
    root = folder.removeprefix("file://")

    def run(batches):
        at, out, temporary, files = None, None, None, 0

        def close():
            if out is not None:
                out.close()
                os.replace(temporary, os.path.join(root, f"{key}={at}", name))

        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None or k != at:
                    close()
                    at, files = k, files + 1
                    os.makedirs(os.path.join(root, f"{key}={at}"), exist_ok=True)
                    temporary = os.path.join(root, f"{key}={at}", f".{name}-{uuid.uuid4().hex}")
                    out = open(temporary, "w", encoding="utf-8", newline="")
                out.write(text + "\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    placed = rows.repartition(key).sortWithinPartitions(key, *order).select(key, line)
    return placed.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def one_file(rows: DataFrame, path: str, order: list[str], line: str = "value") -> int:
    """Writes the lines of all rows in their order as the file path; returns how many bytes it has.

    Ranges of the order are sorted apart and written as parts; each part is then copied to its own place in the file, so that no
    task sorts or writes the whole. The file lies in a file system that driver and executors have in common, and appears when
    it is whole.
    """
    spark, parts, target = rows.sparkSession, f"{path}.parts-{uuid.uuid4().hex}", path.removeprefix("file://")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.option("lineSep", "\n").text(parts)
    # Spark numbers parts by their ranges.
    files = sorted(f.path for f in os.scandir(parts.removeprefix("file://")) if f.name.startswith("part-"))
    sizes = [os.path.getsize(f) for f in files]
    places = list(accumulate(sizes, initial=0))
    temporary = f"{target}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(temporary, "wb") as f:
        f.truncate(places[-1])

    def copy(batches):
        for b in batches:
            for source, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open(source, "rb") as f, open(temporary, "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(f, out, 1 << 20)
            yield b

    placed = spark.createDataFrame(list(zip(files, places)), "source string, at long").repartition(max(1, len(files)), "at")
    placed.mapInArrow(copy, "source string, at long").write.format("noop").mode("overwrite").save()
    os.replace(temporary, target)
    shutil.rmtree(parts.removeprefix("file://"))
    return places[-1]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
