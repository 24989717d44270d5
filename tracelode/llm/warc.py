"""WARC archives: a writer that turns equal payloads into revisits, and a reader that salvages damaged files.

The reader checks every record: the gzip member's own sums, the version line, the header, the length with the blank line
behind the block, and the digests of block and payload where the header names them. After a failed check it searches for
the next gzip member or version line from which a whole record passes all checks, goes on from there, and reports the bytes
between as a gap with the reason. A file is one task, read in windows; one record at a time is in memory. Archives are
closed once they pass `shard_bytes`, so files stay small however large a task's share is.

Nulls: a null payload is empty; a null url gives a record without a target; a null key is written as an empty one and never
referred to. Repeated rows of one key and payload are all responses where that key is the largest, else all revisits. Empty
tables give no archives. Long payloads are whole records. Only the three named columns are read. A record that lies whole
inside the payload of a damaged uncompressed one is found as a record of its own: nothing in the file tells them apart.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import fs

from tracelode.llm.common import shared_path, slices

#: Fixed values of the format.
VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
GZIP_MEMBER = b"\x1f\x8b\x08"
CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
CANDIDATE = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/\d\.\d\r\n")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WINDOW, HEADER_BYTES, RECORD_BYTES = 1 << 18, 1 << 16, 1 << 30
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = (
    "kind string, path string, offset long, length long, reason string, type string, record_id string, target string, date string, "
    "refers_to string, payload_digest string, n_bytes long, payload binary"
)


class Broken(Exception):
    """Why the bytes at a place are not a record."""


def digest(data: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """value on one header line: control characters and spaces as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def make_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with the payload, or a revisit with its HTTP header alone, which keeps the payload's length."""
    payload_digest = digest(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}:{payload_digest}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    if refers_to is not None:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{refers_to}:{payload_digest}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return make_record(fields, http if refers_to is not None else http + payload)


def _member(record: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def write_warc(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html", least_revisit: int = 0, compress: bool = True, shard_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes archives under out; returns (path, n_records, n_bytes), one row an archive.

    Of rows with equal payloads of least_revisit bytes or more, those of the largest key are responses, the others revisit them.
    Archives carry the number of the task's attempt in their names: the returned rows name those of the attempts that count.
    """
    spark = pages.sparkSession
    col = lambda c: F.col(f"`{c}`")
    rows = pages.select(col(key).cast("long").alias("key"), col(url).cast("string").alias("url"), F.coalesce(col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least_revisit, F.unhex(F.sha2("payload", 256))))
    groups = rows.where("same IS NOT NULL").groupBy("same").agg(F.max("key").alias("first"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select("same", "first")
    refers = F.when(F.col("first") != F.coalesce("key", F.col("first") - 1), F.col("first"))
    rows = rows.join(groups, "same", "left").select("key", "url", F.col("payload").cast("binary"), refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(out)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        shards, sink = [], None
        for b in slices(batches, 64):
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if sink is None:
                    system.create_dir(folder, recursive=True)
                    shard = f"{name}-{len(shards):04d}.warc{'.gz' if compress else ''}"
                    sink, records = system.open_output_stream(f"{folder}/{shard}", compression=None), 0
                    info = make_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{shard}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    sink.write(_member(info) if compress else info)
                record = page_record(*row, date)
                sink.write(_member(record) if compress else record)
                records += 1
                if (size := sink.tell()) >= shard_bytes:
                    sink.close()
                    sink = None
                    shards.append((f"{out}/{shard}", records, size))
        if sink is not None:
            size = sink.tell()
            sink.close()
            shards.append((f"{out}/{shard}", records, size))
        if shards:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*shards)], names=["path", "n_records", "n_bytes"])

    done = rows.mapInArrow(run, MANIFEST).collect()  # one row an archive
    return spark.createDataFrame(sorted(map(tuple, done)), MANIFEST)


class _Window:
    """Bytes of a file by place, read ahead in windows."""

    def __init__(self, file):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes at `at`, fewer at the end of the file."""
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(min(max(n, WINDOW), max(self.size - at, 0)), at)
        return self.data[at - self.at : at - self.at + n]

    def find(self, at: int) -> int | None:
        """The first place from `at` on that may begin a record."""
        while at < self.size:
            data = self.get(at, WINDOW)
            if found := CANDIDATE.search(data):
                return at + found.start()
            if at + len(data) >= self.size:
                return None
            at += len(data) - 9  # a version line has ten bytes
        return None


def _inflated(window: _Window, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at `at` and the place behind it."""
    pull, out, n = zlib.decompressobj(31), [], 0
    while not pull.eof:
        data = window.get(at, 1 << 16)
        if not data:
            raise Broken("truncated member")
        try:
            out.append(pull.decompress(data, RECORD_BYTES))
        except zlib.error:
            raise Broken("gzip") from None
        n += len(out[-1])
        if n > RECORD_BYTES or pull.unconsumed_tail:
            raise Broken("longer than a record may be")
        at += len(data)
    return b"".join(out), at - len(pull.unused_data)


def _header(head: bytes) -> dict[str, str]:
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name is not None:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            # As where a record was cut inside its header and the next one follows.
            if name in fields and name != "warc-concurrent-to":
                raise Broken("field given twice")
            fields[name] = value.strip()
        else:
            raise Broken("header line")
    return fields


def _check(fields: dict[str, str], name: str, data: bytes) -> None:
    said = fields.get(name, "")
    if said.lower().startswith("sha1:") and said[5:].upper() != digest(data):
        raise Broken(name)


def _record(window: _Window, at: int) -> tuple[int, dict[str, str], bytes]:
    """(place behind it, header fields, block) of the record at `at`; raises Broken where a check fails."""
    if window.get(at, 3) == GZIP_MEMBER:
        data, end = _inflated(window, at)
        get = lambda i, n: data[i : i + n]
        base, size = 0, len(data)
    else:
        get, base, size, end = window.get, at, window.size, None
    head = get(base, HEADER_BYTES)
    if not VERSION_LINE.match(head):
        raise Broken("version line")
    stop = head.find(b"\r\n\r\n")
    if stop < 0:
        raise Broken("header without an end")
    if CONTROL.search(head, 0, stop):
        raise Broken("control character in the header")
    fields = _header(head[:stop])
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or not fields.get("warc-type"):
        raise Broken("header without length or type")
    start, n = base + stop + 4, int(length)
    if n > RECORD_BYTES or start + n + 4 > size:
        raise Broken("truncated record")
    block = get(start, n)
    if get(start + n, 4) != b"\r\n\r\n":
        raise Broken("no blank line behind the block")
    if end is not None and start + n + 4 != size:
        raise Broken("member with more than a record")
    _check(fields, "warc-block-digest", block)
    return (start + n + 4 if end is None else end), fields, block


def salvage(file) -> Iterator[tuple]:
    """("record", offset, length, fields, block, payload) and ("gap", offset, length, reason), in the order of the file."""
    window, at = _Window(file), 0
    bad, reason = None, ""
    while at is not None and at < window.size:
        try:
            end, fields, block = _record(window, at)
            payload = block
            if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
                payload = block.partition(b"\r\n\r\n")[2]
            if fields["warc-type"] != "revisit":
                _check(fields, "warc-payload-digest", payload)
        except Broken as e:
            if bad is None:
                bad, reason = at, str(e)
            at = window.find(at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at - bad, reason
            bad = None
        yield "record", at, end - at, fields, block, payload
        at = end
    if bad is not None:
        yield "gap", bad, window.size - bad, reason


def _http_length(block: bytes) -> int | None:
    found = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", block.partition(b"\r\n\r\n")[0])
    return int(found.group(1)) if found else None


def scan_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps (column kind) of the archives that files (path) names, in the columns of RECORDS.

    n_bytes and payload_digest are of the full payload; for a revisit, which has none, they come from its headers.
    """
    paths = files.select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (c.split() for c in RECORDS.split(", "))])
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for path in b.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    for kind, offset, length, *rest in salvage(f):
                        if kind == "gap":
                            rows.append((kind, path, offset, length, rest[0], *[None] * 8))
                        else:
                            fields, block, payload = rest
                            revisit = fields["warc-type"] == "revisit"
                            said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                            rows.append(
                                (kind, path, offset, length, None, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to"),
                                 said if revisit else digest(payload), _http_length(block) if revisit else len(payload), payload if with_payload and not revisit else None)
                            )
                            held += len(payload)
                        if len(rows) >= 512 or held >= 4 << 20:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()

    return paths.mapInArrow(run, RECORDS)


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives, without the warcinfo ones."""
    return scan_warc(files, with_payload).where("kind = 'record' AND type <> 'warcinfo'").drop("kind", "reason")


def read_gaps(files: DataFrame) -> DataFrame:
    """(path, offset, length, reason) of the bytes that no record covers."""
    return scan_warc(files, with_payload=False).where("kind = 'gap'").select("path", "offset", "length", "reason")


def with_payloads(records: DataFrame) -> DataFrame:
    """records with the payload of each revisit taken from the response that it refers to; null where that one is lost."""
    found = records.where("type = 'response'").groupBy(F.col("record_id").alias("of")).agg(F.first("payload").alias("its"))
    joined = records.join(found, (F.col("type") == "revisit") & (F.col("refers_to") == F.col("of")), "left")
    return joined.select(*[F.coalesce("payload", "its").alias("payload") if c == "payload" else F.col(c) for c in records.columns])


def _page(c: str):
    return F.regexp_extract(c, r"^<urn:page:(-?[0-9]*):", 1).try_cast("long")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_path(spark, "warc"))
    files = written.repartition(max(1, written.count()))
    records = read_warc(files, with_payload=False)
    return records.select(
        _page("record_id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), _page("refers_to").alias("refers_to")
    )


OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
s AS (SELECT *, sha1(h) AS hex, coalesce(page_id, first - 1) <> first AS again FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM s
"""
