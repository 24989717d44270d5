"""Logs that grow: a streaming source of their new whole lines, and a batch source of their ends.

A stream's offset names every file with the byte after its last whole line; Spark keeps it in the checkpoint, so a
query that is started again goes on there, and a lost task reads the same bytes again. Where a folder for listings is
given, the offset names a listing in it instead, and so does a task its part of a plan there: files and bytes are lines of
those files and not values of the driver, whatever the number of followed files. A line belongs to the range of
bytes that holds its first one, so what a file gained is read by several tasks and a task holds one line at a time.
A file that became shorter was written anew and is read from its end's last bytes on. The files must lie in a file
system that the driver and the executors have in common.

Defined cases: an unterminated last line waits in a stream and is given in a batch; empty lines and those of more than
`MAX_LINE` bytes are passed over; bytes that are no UTF-8 become U+FFFD; a file that is gone gives nothing more.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from fnmatch import fnmatch
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# The longest line, the end of a file that a listing reads, and the end at which a follower begins anew.
MAX_LINE, TAIL_BYTES, FOLLOW_BYTES = 256 << 10, 768 << 10, 1 << 20
#: Bytes of one file that one task reads.
RANGE_BYTES = 32 << 20
#: What opening a file costs a task, in bytes that it could read instead.
OPEN_BYTES = 64 << 10
BLOCK = 64 << 10
#: Listings and plans that a follower keeps, the newest ones; a checkpoint keeps 100 batches, each of which has at most one of both.
KEPT = 256


class Range(InputPartition):
    """The lines of path that begin in [low, high); whole tells that one begins at low."""

    def __init__(self, path: str, low: int, high: int, whole: bool):
        self.path, self.low, self.high, self.whole = path, low, high, whole


class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class Planned(InputPartition):
    """Ranges that one task reads, as lines of a plan: size bytes of the file plan from the byte at on."""

    def __init__(self, plan: str, at: int, size: int):
        self.plan, self.at, self.size = plan, at, size

    @property
    def ranges(self) -> Iterator[Range]:
        with open(self.plan, "rb") as f:
            f.seek(self.at)
            for line in f.read(self.size).splitlines():
                yield Range(*json.loads(line))


def packs(found: Iterable[Range]) -> Iterator[list[Range]]:
    """found in as few tasks as their bytes and files ask for: many small files are one task."""
    pack, free = [], 0
    for r in found:
        cost = r.high - r.low + OPEN_BYTES
        if cost > free:
            if pack:
                yield pack
            pack, free = [], RANGE_BYTES + OPEN_BYTES
        pack.append(r)
        free -= cost
    if pack:
        yield pack


def packed(found: Iterable[Range]) -> list[Ranges]:
    return list(map(Ranges, packs(found)))


def files_below(folder: str, pattern: str) -> Iterator[str]:
    """Files in the order of `place`, of one folder after the other; links to folders are not followed."""
    files, folders = [], []
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                if not e.is_dir():
                    files.append(e.name)
                elif not e.is_symlink():
                    folders.append(e.name)
    except OSError:
        return
    yield from (os.path.join(folder, n) for n in sorted(files) if fnmatch(n, pattern))
    folders.sort()
    for n in folders:
        yield from files_below(os.path.join(folder, n), pattern)


def place(path: str) -> list[tuple[int, str]]:
    """What files_below orders by: in each folder its files come first, then its folders."""
    *folders, name = path.split("/")
    return [*((1, f) for f in folders), (0, name)]


def size_of(path: str) -> int:
    try:
        return os.path.getsize(path)
    except FileNotFoundError:
        return 0


def whole_lines(path: str) -> int:
    """The byte after the last line end; read from the back."""
    at = size_of(path)
    if at:
        with open(path, "rb") as f:
            while at > 0:
                low = max(0, at - BLOCK)
                f.seek(low)
                found = f.read(at - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                at = low
    return 0


def ranges(path: str, low: int, high: int, whole: bool) -> list[Range]:
    return [Range(path, a, min(a + RANGE_BYTES, high), whole and a == low) for a in range(low, high, RANGE_BYTES)]


def lines_of(r: Range, most: int = MAX_LINE) -> Iterator[tuple[str, int, str]]:
    """(path, at, raw) of a range's lines of at most so many bytes; at is the byte at which a line begins."""
    if not size_of(r.path):
        return
    with open(r.path, "rb") as f:
        at = r.low
        if not r.whole and at > 0:
            # The line that holds the byte before belongs to the range before.
            f.seek(at - 1)
            at += _rest_of_line(f) - 1
        f.seek(at)
        while at < r.high:
            line = f.readline(most + 1)
            if not line:
                return
            size = len(line)
            if size > most and not line.endswith(b"\n"):
                size += _rest_of_line(f)
            elif text := line.rstrip(b"\r\n"):
                yield r.path, at, text.decode("utf-8", "replace")
            at += size


def _rest_of_line(f) -> int:
    size = 0
    while part := f.readline(BLOCK):
        size += len(part)
        if part.endswith(b"\n"):
            break
    return size


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pattern, self.last = options["path"], options.get("pattern", "*.jsonl"), int(options.get("lastbytes", str(TAIL_BYTES)))

    def partitions(self):
        sizes = [(p, size_of(p)) for p in files_below(self.folder, self.pattern)]
        return packed(r for p, n in sizes for r in ranges(p, max(0, n - self.last), n, n <= self.last))

    def read(self, partition):
        return chain.from_iterable(map(lines_of, partition.ranges))


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.pattern, self.begin = options["path"], options.get("pattern", "*.jsonl"), options.get("begin")
        self.listings = options.get("listings")

    def initialOffset(self) -> dict:
        if self.begin is None:
            return {}
        with open(self.begin, encoding="utf-8") as f:
            return json.load(f)

    def latestOffset(self) -> dict:
        now = ((p, whole_lines(p)) for p in files_below(self.folder, self.pattern))
        if self.listings is None:
            return dict(now)
        # Named by what it says, so that an offset is another one only where files have changed.
        os.makedirs(self.listings, exist_ok=True)
        temporary, says = os.path.join(self.listings, f".{uuid.uuid4().hex}"), hashlib.sha256()
        with open(temporary, "wb") as f:
            for entry in now:
                line = json.dumps(entry).encode() + b"\n"
                says.update(line)
                f.write(line)
        name = f"files-{says.hexdigest()}"
        os.replace(temporary, os.path.join(self.listings, name))
        return {"listing": name}

    def _entries(self, offset: dict) -> Iterator[tuple[str, int]]:
        """(path, byte) of an offset, in the order of `place`."""
        if "listing" not in offset:
            yield from sorted(offset.items(), key=lambda x: place(x[0]))
            return
        with open(os.path.join(self.listings, offset["listing"]), "rb") as f:
            yield from map(json.loads, f)

    def _gained(self, start: dict, end: dict) -> Iterator[Range]:
        """What the files gained between two offsets: both are read side by side."""
        entries = iter(self._entries(start))
        was = next(entries, None)
        for path, high in self._entries(end):
            at = place(path)
            while was is not None and place(was[0]) < at:
                was = next(entries, None)
            low = was[1] if was is not None and was[0] == path else 0
            if high < low:
                begin = max(0, high - FOLLOW_BYTES)
                yield from ranges(path, begin, high, begin == 0)
            else:
                yield from ranges(path, low, high, True)

    def partitions(self, start: dict, end: dict):
        if self.listings is None:
            return packed(self._gained(start, end))
        os.makedirs(self.listings, exist_ok=True)
        plan = os.path.join(self.listings, f"plan-{uuid.uuid4().hex}")
        found, at = [], 0
        with open(plan, "wb") as f:
            for pack in packs(self._gained(start, end)):
                size = f.write(b"".join(json.dumps([r.path, r.low, r.high, r.whole]).encode() + b"\n" for r in pack))
                found.append(Planned(plan, at, size))
                at += size
        return found

    def read(self, partition):
        return chain.from_iterable(map(lines_of, partition.ranges))

    def commit(self, end: dict) -> None:
        if self.listings is None:
            return
        # A listing that is found again is written again and so counts as new.
        written = sorted((f.stat().st_mtime_ns, f.path) for f in os.scandir(self.listings) if f.name.startswith(("files-", "plan-")))
        for _, path in written[:-KEPT]:
            if os.path.basename(path) != end.get("listing"):
                os.remove(path)


class TailedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return "path string, at long, raw string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TailReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FollowReader(self.options)


def tail(spark: SparkSession, folder: str, pattern: str = "*.jsonl", last_bytes: int = TAIL_BYTES) -> DataFrame:
    """(path, at, raw): the lines that begin in the last bytes of each file below folder."""
    spark.dataSource.register(TailedLines)
    return spark.read.format("tailed_lines").option("pattern", pattern).option("lastbytes", str(last_bytes)).load(folder)


def follow(spark: SparkSession, folder: str, pattern: str = "*.jsonl", begin: str | None = None, listings: str | None = None) -> DataFrame:
    """(path, at, raw) as a stream: every whole line of the files below folder, and those they gain.

    begin names a JSON file of the bytes, by path, at which a new query begins in files that were read before. listings names
    a folder that belongs to the query as its checkpoint does, where driver and executors both reach it: the offsets are files there.
    """
    spark.dataSource.register(TailedLines)
    stream = spark.readStream.format("tailed_lines").option("pattern", pattern)
    for name, value in (("begin", begin), ("listings", listings)):
        stream = stream if value is None else stream.option(name, value)
    return stream.load(folder)
