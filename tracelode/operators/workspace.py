"""What sessions belong to: the project of a working folder, the parent of a helper session, the work event of a session."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracelode.operators.graph import components, kept
from tracelode.operators.joins import as_of

# What marks the root of a project, in the order in which their names count, and the name of none.
REPOSITORY, MANIFESTS, UNKNOWN = ".git", ("package.json", "Cargo.toml", "pyproject.toml"), "Unknown project"
NAME_BYTES = 80
#: Why sessions are one work event, strongest first.
REASONS = ("manual", "semantic", "files", "branch", "time")


def clean_name(c: Column) -> Column:
    """The last part of a project's name; null where it is empty, too long or holds what names do not."""
    last = F.trim(F.element_at(F.split(F.trim(c), "/"), -1))
    return F.when((last != "") & (F.octet_length(last) <= NAME_BYTES) & ~last.contains("\\") & ~last.rlike(r"[\x00-\x1F\x7F-\x9F]"), last)


def ancestors(path: Column) -> Column:
    """(dir, depth) of an absolute path and all folders above it."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("dir"), n.alias("depth")))


def project_roots(cwds: DataFrame, markers: DataFrame) -> DataFrame:
    """(cwd, root, project) of distinct working folders (cwd).

    markers: (dir, file, name), a row for each REPOSITORY or manifest found, with the name a manifest gives. The root is the
    nearest folder at or above cwd with a repository, else with a manifest, else cwd itself: each folder above is looked
    up by equality and the deepest that is found wins. The project is named by the root's manifests in their order, else
    by the root's own name.
    """
    said = lambda m: F.max(F.when(F.col("file") == m, clean_name(F.col("name"))))
    at = markers.groupBy("dir").agg(F.bool_or(F.col("file") == REPOSITORY).alias("repository"), F.bool_or(F.col("file").isin(*MANIFESTS)).alias("manifest"), F.coalesce(*[said(m) for m in MANIFESTS]).alias("named"))
    folders = cwds.select("cwd").distinct().withColumn("path", F.trim("cwd"))
    above = folders.where(F.coalesce("path", F.lit("")) != "").select("cwd", F.inline(ancestors(F.col("path"))).alias("dir", "depth"))
    found = above.join(at.where("repository OR manifest"), "dir").groupBy("cwd").agg(
        F.max(F.when(F.col("repository"), F.struct("depth", "dir", "named"))).alias("r"), F.max(F.when(F.col("manifest"), F.struct("depth", "dir", "named"))).alias("m"),
    )
    root = F.coalesce(F.col("r"), F.col("m"))
    out = folders.join(found, "cwd", "left").select("cwd", F.coalesce(root["dir"], F.when(F.col("path") != "", F.element_at(ancestors(F.col("path")), -1)["dir"])).alias("root"), root["named"].alias("named"))
    return out.select("cwd", "root", F.coalesce("named", clean_name(F.col("root")), F.lit(UNKNOWN)).alias("project"))


def folded_helpers(helpers: DataFrame, parents: DataFrame, tolerance_seconds: int = 300) -> DataFrame:
    """helpers plus parent_id: whose work an event of a helper session (memory, review) shows, or null.

    Both: (id, process_id, origin, at); parents also accepts, whether the session takes such work after this event. The
    first parent that is found for a helper session stays its alias, for later events at which that parent accepts. Without
    it the parent is the latest accepting session of the same process within the tolerance before; where either side knows
    no process, of the same origin. A parent's state is that of its last event, so it is never looked for in pairs.
    """
    keyed = helpers.withColumn("event", F.xxhash64("id", "at", "process_id", "origin"))
    # A session that stops accepting must not be found by its earlier events: spans end at its next event.
    w = Window.partitionBy("id").orderBy("at")
    spans = parents.withColumn("until", F.lead("at").over(w))
    own = keyed.select("event", "at", "process_id", "origin")
    known, unknown = F.col("process_id").isNotNull(), F.col("process_id").isNull()
    found = [
        _latest_accepting(own.where(known), spans.where(known), "process_id", tolerance_seconds),
        _latest_accepting(own.where(known), spans.where(unknown), "origin", tolerance_seconds),
        _latest_accepting(own.where(unknown), spans, "origin", tolerance_seconds),
    ]
    direct = reduce(DataFrame.unionByName, found).groupBy("event").agg(F.max(F.struct("seen", "parent")).alias("p")).select("event", F.col("p.parent").alias("direct"))
    met = kept(keyed.join(direct, "event", "left"), "helpers")
    alias = met.where("direct IS NOT NULL").groupBy("id").agg(F.min(F.struct("at", "direct")).alias("first")).select("id", F.col("first.at").alias("since"), F.col("first.direct").alias("alias"))
    named = met.join(alias, "id", "left")
    # Whether the alias accepts at the event is its last state before: one more as-of, by the alias itself.
    asked = named.where("alias IS NOT NULL AND at >= since").select("event", F.col("alias").alias("who"), "at")
    state = as_of(asked, parents.select(F.col("id").alias("who"), "at", F.col("accepts").alias("takes")), ["who"], "at", 1 << 40, ["takes"]).where("parent_takes").select("event", F.lit(True).alias("holds")).distinct()
    out = named.join(state, "event", "left").withColumn("parent_id", F.when(F.coalesce("holds", F.lit(False)), F.col("alias")).otherwise(F.col("direct")))
    return out.select(*helpers.columns, "parent_id")


def _latest_accepting(events: DataFrame, spans: DataFrame, key: str, tolerance_seconds: int) -> DataFrame:
    """(event, seen, parent): of sessions with that key the one with the latest accepting event that is still its state at the event.

    Spans [at, until) are cut to the tolerance and laid on equal buckets of time, as wide as it. Each bucket of a key is one walk
    in time over its spans and events: spans that began are a stack, whose top is the latest, and those that ended leave it for
    good when they come to the top. So no pairs are formed, however many sessions share a key.
    """
    us = tolerance_seconds * 1_000_000
    bucket = lambda c: F.floor(F.unix_micros(c) / us)
    ends = F.least(F.timestamp_micros(F.unix_micros("at") + us), F.coalesce("until", F.timestamp_micros(F.unix_micros("at") + us)))
    laid = spans.where("accepts").withColumn("ends", ends).where(F.col(key).isNotNull())
    laid = laid.select(F.col(key).alias("k"), F.col("id").alias("parent"), F.col("at").alias("seen"), "until", F.explode(F.sequence(bucket(F.col("at")), bucket(F.col("ends")))).alias("b"))
    asked = events.where(F.col(key).isNotNull()).select("event", "at", F.col(key).alias("k"), bucket(F.col("at")).alias("b"))
    kind, parent = asked.schema["event"].dataType, laid.schema["parent"].dataType
    rows = laid.select("k", "b", F.unix_micros("seen").alias("at"), F.unix_micros("until").alias("until"), "parent", F.lit(None).cast(kind).alias("event"))
    rows = rows.unionByName(asked.select("k", "b", F.unix_micros("at").alias("at"), F.lit(None).cast("long").alias("until"), F.lit(None).cast(parent).alias("parent"), "event"))

    def walk(table: pa.Table) -> pa.Table:
        # Spans before events of one instant; null parents are events and come last.
        table = table.sort_by([("at", "ascending"), ("parent", "ascending")])
        stack, found = [], []
        for at, until, name, event in zip(*(table.column(c).to_pylist() for c in ("at", "until", "parent", "event"))):
            if name is not None:
                stack.append((at, until, name))
                continue
            while stack and stack[-1][1] is not None and stack[-1][1] <= at:
                stack.pop()
            if stack and at - stack[-1][0] <= us:
                found.append((event, stack[-1][0], stack[-1][2]))
        columns = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(columns[0], table.schema.field("event").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], table.schema.field("parent").type)], names=["event", "seen", "parent"])

    out = StructType([StructField("event", kind), StructField("seen", LongType()), StructField("parent", parent)])
    return rows.groupBy("k", "b").applyInArrow(walk, out).withColumn("seen", F.timestamp_micros("seen"))


def _chained(rows: DataFrame, pause: int, branch_pause: int) -> DataFrame:
    """Links of each session to the one before it in its project, and in its branch, where it begins within the pause of that one's end.

    Rows of a project lie together, so that both orders share one shuffle.
    """
    order = ["started_at", "session_id"]
    before = rows.select("project", "branch", *order, "ended_at")
    for reason, by in (("time", ["project"]), ("branch", ["project", "branch"])):
        w = Window.partitionBy(*by).orderBy(*order)
        before = before.withColumns({f"{reason}_b": F.lag("session_id").over(w), f"{reason}_gap": F.unix_seconds("started_at") - F.unix_seconds(F.lag("ended_at").over(w))})
    link = lambda reason, near: F.when(near, F.struct(F.col("session_id").alias("a"), F.col(f"{reason}_b").alias("b"), F.lit(reason).alias("reason")))
    found = F.array(link("time", F.col("time_gap") <= pause), link("branch", F.col("branch").isNotNull() & (F.col("branch_gap") <= branch_pause)))
    return before.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def _starred(rows: DataFrame, by: list[str], reason: str) -> DataFrame:
    """Links of all sessions with the same values to the least of them."""
    heads = rows.groupBy(*by).agg(F.min("session_id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(heads, by).where("session_id <> b").select(F.col("session_id").alias("a"), "b", F.lit(reason).alias("reason"))


def shared_files(files: DataFrame, similarity: float = 0.5) -> DataFrame:
    """Links of sessions of one project whose sets of files (project, session_id, file) are at least so similar (Jaccard).

    Sets are made once and written. Equal sets are one. Files are ordered by how few sets hold them; sets that similar share one of the first
    n - ceil(similarity n) + 1, and none is smaller than similarity times the other. What these bounds leave is compared.
    """
    sets = kept(files.groupBy("project", "session_id").agg(F.array_sort(F.collect_set("file")).alias("files")), "session-files")
    same = kept(sets.groupBy("project", "files").agg(F.min("session_id").alias("head"), F.count("*").alias("sessions")), "file-sets")
    equal = sets.join(same.where("sessions > 1"), ["project", "files"]).where("session_id <> head").select(F.col("session_id").alias("a"), F.col("head").alias("b"))
    rare = same.select("project", F.explode("files").alias("file")).groupBy("project", "file").agg(F.count("*").alias("held"))
    marked = same.select("project", "head", F.size("files").alias("n"), F.explode("files").alias("file")).join(rare, ["project", "file"])
    place = F.row_number().over(Window.partitionBy("project", "head").orderBy("held", "file"))
    first = marked.withColumn("place", place).where((F.col("held") > 1) & (F.col("place") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1)).select("project", "file", "head", "n")
    x, y = first.alias("x"), first.alias("y")
    fits = (F.col("x.head") < F.col("y.head")) & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9)
    pairs = x.join(y, (F.col("x.project") == F.col("y.project")) & (F.col("x.file") == F.col("y.file")) & fits).select(F.col("x.head").alias("a"), F.col("y.head").alias("b")).distinct()
    held = same.select("head", "files")
    whole = pairs.join(held.select(F.col("head").alias("a"), F.col("files").alias("fa")), "a").join(held.select(F.col("head").alias("b"), F.col("files").alias("fb")), "b")
    near = F.size(F.array_intersect("fa", "fb")) >= similarity * F.size(F.array_union("fa", "fb")) - 1e-9
    return whole.where(near).select("a", "b").unionByName(equal).withColumn("reason", F.lit("files"))


def work_events(sessions: DataFrame, files: DataFrame, merges: DataFrame, splits: DataFrame, pause: int = 7200, branch_pause: int = 86_400, similarity: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((session_id, task_id), (task_id, project, sessions, started_at, ended_at, reasons)) of sessions (session_id, project, branch, objective, started_at, ended_at).

    Sessions of a project are one work event if links join them: the same objective, similar sets of files, the same branch
    within a day, or any within a pause; and those that a user has merged (a, b). A session that a user has split off
    (session_id) has only links by hand; the others are linked as if it were not there. The task is named by its least session; reasons are those of its links.
    Decisions: objectives are equal where their words are, whatever case and marks; the pauses and the similarity are parameters.
    """
    words = F.trim(F.regexp_replace(F.lower("objective"), r"[^\p{L}\p{N}]+", " "))
    cut = splits.select("session_id").distinct()
    rows = kept(sessions.join(cut, "session_id", "left_anti").select("session_id", "project", "branch", words.alias("goal"), "started_at", "ended_at"), "linked-sessions")
    files = files.join(cut, "session_id", "left_anti")
    found = [
        _starred(rows.where(F.coalesce("goal", F.lit("")) != ""), ["project", "goal"], "semantic"), shared_files(files, similarity),
        _chained(rows, pause, branch_pause),
    ]
    links = kept(reduce(DataFrame.unionByName, found).unionByName(merges.select("a", "b", F.lit("manual").alias("reason"))), "session-links")
    roots = components(links)
    of = kept(sessions.select("session_id", "project", "started_at", "ended_at").join(roots, F.col("session_id") == F.col("node"), "left").select("session_id", "project", "started_at", "ended_at", F.coalesce("root", "session_id").alias("task_id")), "session-tasks")
    why = links.join(of.select(F.col("session_id").alias("a"), "task_id"), "a").groupBy("task_id").agg(F.collect_set("reason").alias("r"))
    tasks = of.groupBy("task_id").agg(F.min("project").alias("project"), F.count("*").alias("sessions"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at")).join(why, "task_id", "left")
    ordered = F.filter(F.array(*map(F.lit, REASONS)), lambda x: F.array_contains("r", x))
    return of.select("session_id", "task_id"), tasks.withColumn("reasons", F.coalesce(ordered, F.array().cast("array<string>"))).drop("r")
