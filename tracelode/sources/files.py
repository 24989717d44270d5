"""File listings, JSON-line scans, compressed logs, skipping what was ingested before."""

from __future__ import annotations

import io
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions.hashing import stable_hash

# A record's and a live envelope's largest size in bytes.
MAX_RECORD, MAX_ENVELOPE = 32 << 20, 768 << 10
PARSER_VERSION = 1

#: Agent, adapter, folder under the home directory, environment variable that replaces it, pattern of files.
ROOTS = (
    ("claude-code", "claude", ".claude/projects", "CLAUDE_CONFIG_DIR", "*.jsonl"),
    ("codex", "codex", ".codex/sessions", "CODEX_HOME", "*.jsonl"),
    ("cursor", "cursor", ".cursor/projects", "CURSOR_HOME", "*.jsonl"),
    ("deepseek-harness", "deepseek", ".deepseek/sessions", "DEEPSEEK_HOME", "session.jsonl.zstd"),
    ("kimi-code", "kimi", ".kimi/sessions", "KIMI_HOME", "*.jsonl"),
    ("openclaw", "openclaw", ".openclaw/agents", "OPENCLAW_HOME", "*.jsonl"),
    ("zcode", "zcode", ".zcode/sessions", "ZCODE_HOME", "*.json"),
    ("zcode", "zcode-model-io", ".zcode/model-io", "ZCODE_HOME", "model-io-*.jsonl"),
)


def roots(spark: SparkSession, home: str, environment: dict[str, str] | None = None) -> DataFrame:
    """(agent, adapter, path, pattern), each once."""
    env = environment or {}
    rows = [(agent, adapter, os.path.join(env[var], folder.split("/", 1)[1]) if var in env else os.path.join(home, folder), pattern) for agent, adapter, folder, var, pattern in ROOTS]
    return spark.createDataFrame(rows, "agent string, adapter string, path string, pattern string").dropDuplicates(["agent", "path", "adapter"]).orderBy("agent", "path", "adapter")


def listing(spark: SparkSession, folder: str, pattern: str = "*.jsonl", without: str | None = r"\.deleted\.json$") -> DataFrame:
    """(path, size, modified) of the files below folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out if without is None else out.where(~F.col("path").rlike(without))


def changed(files: DataFrame, log: DataFrame, version: int = PARSER_VERSION) -> DataFrame:
    """Files that the ingest log (path, size, modified, version) does not know as they are."""
    seen = log.where(F.col("version") == version).select("path", "size", "modified")
    return files.join(seen, ["path", "size", "modified"], "left_anti")


def without_superseded(snapshots: DataFrame, model_io: DataFrame, ident: str = "session_id") -> DataFrame:
    """Snapshot files of sessions that also have a model-io log go: the log knows more."""
    return snapshots.join(model_io.select(ident).distinct(), ident, "left_anti")


def json_lines(spark: SparkSession, folder: str, agent: str, pattern: str = "*.jsonl") -> DataFrame:
    """Bronze records (path, agent, ordinal, raw text, record VARIANT, malformed) of JSON-line files.

    ordinal is a line's number in its file. A file is read in ranges of bytes (spark.sql.files.maxPartitionBytes) by several
    tasks, one line at a time. A first pass counts the lines and bytes of each range; their sums before a range give its
    first ordinal, and the file's size tells whether its last line has an end. An unterminated last line that is no JSON
    stays for the next pass; other lines that are no JSON, or longer than a record may be, are malformed.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(folder)
    # Ids rise along the lines of a range, without gaps: ranges of one task follow one another.
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    ranges = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("raw") + 1).alias("bytes"), F.max("size").alias("size"))
    whole = Window.partitionBy("path")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("lines"), (F.sum("bytes").over(whole) <= F.col("size")).alias("ended"))
    rows = lines.drop("size").join(ranges, ["path", "start"]).withColumn("ordinal", F.col("before") + F.col("id") - F.col("first"))
    parsed = F.when(F.octet_length("raw") <= MAX_RECORD, F.try_parse_json("raw"))
    rows = rows.where(F.trim("raw") != "").withColumn("record", parsed).where(F.col("ended") | (F.col("ordinal") < F.col("lines") - 1) | F.col("record").isNotNull())
    return rows.select("path", F.lit(agent).alias("agent"), "ordinal", "raw", "record", F.col("record").isNull().alias("malformed"))


def split_lines(texts: DataFrame, agent: str, path: str = "path", text: str = "text") -> DataFrame:
    """Bronze records from whole files' texts."""
    lines = F.split(text, "\n")
    # What a line needs to know of its text goes beside it, so that no row carries the whole text.
    told = F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda raw, after: F.struct(raw.alias("raw"), after.isNotNull().alias("ended")))
    rows = texts.select(F.col(path).alias("path"), F.posexplode(told).alias("__i", "__l")).select("path", "__i", "__l.raw", "__l.ended")
    parsed = F.when(F.octet_length("raw") <= MAX_RECORD, F.try_parse_json("raw"))
    rows = rows.where(F.trim("raw") != "").withColumn("record", parsed).where(F.col("ended") | F.col("record").isNotNull())
    return rows.select("path", F.lit(agent).alias("agent"), F.col("__i").cast("long").alias("ordinal"), "raw", "record", F.col("record").isNull().alias("malformed"))


def json_document_or_lines(texts: DataFrame, agent: str) -> DataFrame:
    """Bronze records of files that hold one JSON document, or else JSON lines."""
    whole = F.try_parse_json("text")
    documents = texts.where(whole.isNotNull()).select("path", F.lit(agent).alias("agent"), F.lit(0).cast("long").alias("ordinal"), F.col("text").alias("raw"), whole.alias("record"), F.lit(False).alias("malformed"))
    return documents.unionByName(split_lines(texts.where(whole.isNull()), agent))


def zstd_lines(spark: SparkSession, folder: str, agent: str, pattern: str = "*.zstd") -> DataFrame:
    """Bronze records of compressed JSON lines. A frame that breaks off ends the file; bad lines are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches):
        import zstandard

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content))
                chunk: list[tuple[int, str]] = []
                rest, ordinal = b"", 0
                while True:
                    try:
                        data = reader.read(1 << 20)
                    except zstandard.ZstdError:
                        data = b""
                    lines = (rest + data).split(b"\n")
                    rest = lines.pop() if data else b""
                    for line in lines:
                        if line.strip() and len(line) <= MAX_RECORD:
                            chunk.append((ordinal, line.decode("utf-8", "replace")))
                        ordinal += 1
                    if chunk and (len(chunk) >= 1000 or not data):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(chunk)), pa.array([o for o, _ in chunk], pa.int64()), pa.array([r for _, r in chunk])], names=["path", "ordinal", "raw"])
                        chunk = []
                    if not data:
                        break

    rows = files.mapInArrow(run, "path string, ordinal long, raw string").withColumn("record", F.try_parse_json("raw"))
    return rows.where(F.col("record").isNotNull()).select("path", F.lit(agent).alias("agent"), "ordinal", "raw", "record", F.lit(False).alias("malformed"))


def receipts(records: DataFrame, native_id: Column | None = None) -> DataFrame:
    """Bronze records with a receipt: a hash of kind and native id, else of the record itself."""
    kind = F.try_variant_get("record", "$.type", "string")
    ident = native_id if native_id is not None else F.try_variant_get("record", "$.id", "string")
    return records.withColumn("receipt", stable_hash(F.coalesce(F.concat_ws(":", kind, F.when(ident.isNotNull(), ident)), F.to_json("record"))).alias("receipt"))


def unseen(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose receipt is new, the first of equal ones in each file."""
    first = records.join(known.select("receipt").distinct(), "receipt", "left_anti")
    earliest = first.groupBy("path", "receipt").agg(F.min("ordinal").alias("ordinal"))
    return first.join(earliest, ["path", "receipt", "ordinal"], "left_semi")


def skill_files(texts: DataFrame) -> DataFrame:
    """Names of installed skills from (path, text): the front matter's name, else the folder's; plugins prefix theirs."""
    named = F.nullif(F.trim(F.regexp_extract("text", r"(?s)\A---\s.*?^name:\s*[\"']?([^\"'\r\n]+)", 1)), F.lit(""))
    named = F.coalesce(named, F.nullif(F.trim(F.regexp_extract("text", r"(?m)^name:\s*[\"']?([^\"'\r\n]+)", 1)), F.lit("")))
    folder = F.element_at(F.split("path", "/"), -2)
    plugin = F.nullif(F.regexp_extract("path", r"/plugins/(?:cache/)?([^/]+)/", 1), F.lit(""))
    name = F.lower(F.coalesce(named, folder))
    return texts.select(F.when(plugin.isNotNull() & ~F.contains(name, F.lit(":")), F.concat_ws(":", F.lower(plugin), name)).otherwise(name).alias("skill")).distinct()


def git_log(texts: DataFrame, most: int | None = None) -> DataFrame:
    """(path, commit, committed_at, subject, file, added, removed) from `git log --numstat` texts with header lines `\\x1e hash \\x1f time \\x1f subject`; all commits, or the first `most` of each text."""
    # A line's start with \x1e begins a commit; what stands before the first is none. Commits need no order among them but their place.
    bodies = F.split("text", "(?:\\A|\n)\x1e", -1 if most is None else most + 2)
    commits = texts.select("path", F.explode(F.slice(bodies, F.lit(2), F.size(bodies) if most is None else F.lit(most))).alias("body"))
    lines = commits.select("path", F.substring_index("body", "\n", 1).alias("header"), F.explode(F.split("body", "\n")).alias("line"))
    parts = F.split("header", "\x1f")
    stat = F.split("line", "\t")
    files = lines.withColumn("is_stat", (F.col("line") != F.col("header")) & (F.size(stat) == 3))
    number = lambda i: F.element_at(stat, i).try_cast("long")
    return files.where("is_stat").select(
        "path", F.trim(parts[0]).alias("commit"), F.try_to_timestamp(F.trim(parts[1])).alias("committed_at"), F.trim(parts[2]).alias("subject"),
        F.element_at(stat, 3).alias("file"), F.coalesce(number(1), F.lit(0)).alias("added"), F.coalesce(number(2), F.lit(0)).alias("removed"),
    )


#: What each source can tell. agent, label, exact live events, history, prompts, usage, tool results.
CAPABILITIES = (
    ("claude-code", "Claude Code", True, True, True, True, True),
    ("codex", "Codex", True, True, True, True, True),
    ("cursor", "Cursor", True, True, False, False, False),
    ("deepseek-harness", "DeepSeek", False, True, True, True, True),
    ("kimi-code", "Kimi Code", True, True, True, True, True),
    ("openclaw", "OpenClaw", False, True, True, True, True),
    ("zcode", "ZCode", True, True, True, True, True),
    ("hermes", "Hermes", False, True, False, True, False),
)


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAPABILITIES), "agent string, label string, exact_live boolean, history boolean, prompts boolean, usage boolean, tool_results boolean")
