"""The session ledger: filters, pages, facets, range windows, tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.timefn import in_range, window_days


def filtered(
    rows: DataFrame, *, agent: str | None = None, model: str | None = None, project: str | None = None, search: str | None = None, search_in: tuple[str, ...] = ("title", "model", "project"),
    verification_state: str | None = None, attention_only: bool = False, code_only: bool = False, commit_only: bool = False, files: DataFrame | None = None, key: str = "session_id",
) -> DataFrame:
    """Sessions that meet every filter given. A search matches any of its columns, or a file of the session."""
    for column, value in (("agent", agent), ("model", model), ("project", project), ("verification_state", verification_state)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    for column, wanted in (("needs_attention", attention_only), ("has_code", code_only), ("has_commit", commit_only)):
        if wanted:
            rows = rows.where(F.col(column))
    if search:
        q = F.lit(search.lower())
        hit = F.lit(False)
        for c in search_in:
            hit = hit | F.coalesce(F.contains(F.lower(c), q), F.lit(False))
        if files is not None:
            named = files.where(F.contains(F.lower("path"), q)).select(key).distinct().withColumn("__file", F.lit(True))
            rows = rows.join(named, key, "left").where(hit | F.coalesce("__file", F.lit(False))).drop("__file")
        else:
            rows = rows.where(hit)
    return rows


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """The number-th page from 1; pages are the feature here, so the limit is part of the plan."""
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def facets(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass: each row gives one entry a facet."""
    entries = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, c in columns.items()])
    return rows.select(F.explode(entries).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def last_activity(ended: str = "ended_at", started: str = "started_at") -> Column:
    """A session of several days belongs to a range by its last activity."""
    return F.coalesce(ended, started)


def of_range(rows: DataFrame, name: str, today: str, date: str = "date") -> DataFrame:
    return rows.where(in_range(F.col(date), today, window_days(name)))


def without_projects(rows: DataFrame, excluded: DataFrame, project: str = "project") -> DataFrame:
    return rows.join(excluded.select(project).distinct(), project, "left_anti")


def trend_windows(rows: DataFrame, ts: str, now: str, windows: int = 6, stride: int = 14, width: int = 13) -> DataFrame:
    """rows with period_start for each of the trailing windows (a stride of 14 days, 13 days wide, both ends in) that holds them.

    A time lies in at most one window, whose number follows from its distance to now: no join.
    """
    end = F.lit(now).cast("timestamp")
    days_us = 86_400_000_000
    back = F.floor((F.unix_micros(end) - F.unix_micros(F.col(ts))) / (stride * days_us))
    start = end - F.make_interval(days=(back * stride + width).cast("int"))
    inside = back.between(0, windows - 1) & (F.col(ts) >= start)
    return rows.where(inside).withColumn("period_start", F.date_format(start, "yyyy-MM-dd"))


def tasks(rows: DataFrame, gap_seconds: int = 7200) -> DataFrame:
    """Sessions of one project as work events: a new one begins after a pause of `gap_seconds`, on another branch or by hand.

    Decision: grouping by project, branch and time, the reasons that the sources name; text similarity is not used.
    """
    w = Window.partitionBy("project").orderBy("started_at", "session_id")
    pause = F.unix_seconds("started_at") - F.unix_seconds(F.max("ended_at").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    head = pause.isNull() | (pause > gap_seconds) | ~F.col("branch").eqNullSafe(F.lag("branch").over(w)) | F.coalesce("manual_split", F.lit(False))
    n = F.sum(head.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("task_no", n)
    return numbered.groupBy("project", "task_no").agg(
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.count("*").alias("sessions"), F.sum("files").alias("files"),
        F.bool_or(F.coalesce("has_commit", F.lit(False))).alias("has_commit"), F.max_by("title", "ended_at").alias("title"),
    )


def task_card_state(active: Column, needs_review: Column, verified: Column) -> Column:
    return F.when(active, "active").when(needs_review, "review").when(verified, "verified").otherwise("recorded")
