"""Replay: extents of events on a 0-100 scale, lifecycle cycles, lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(rows: DataFrame, key: list[str], order: str, ts: str) -> DataFrame:
    """rows plus x0 and x1: from each event to the next, by time where all events of the key have one and times differ, else by sequence."""
    whole = Window.partitionBy(*key)
    w = whole.orderBy(order)
    lo, hi = F.unix_micros(F.min(ts).over(whole)), F.unix_micros(F.max(ts).over(whole))
    timed = (F.count(ts).over(whole) == F.count(F.lit(1)).over(whole)) & (hi > lo)
    at = lambda c: (F.unix_micros(c) - lo) * 100.0 / (hi - lo)
    n, i = F.count(F.lit(1)).over(whole), F.row_number().over(w) - 1
    place = lambda k: F.when(n > 1, k * 100.0 / (n - 1)).otherwise(F.lit(0.0))
    x0 = F.when(timed, at(F.col(ts))).otherwise(place(i))
    x1 = F.when(timed, at(F.coalesce(F.lead(ts).over(w), F.col(ts)))).otherwise(place(F.least(i + 1, n - 1)))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    return rows.withColumn("x0", clamp(x0)).withColumn("x1", clamp(F.greatest(x0, x1)))


def cycles(rows: DataFrame, key: list[str], order: str, starts: Column, ends: Column) -> DataFrame:
    """Per key: how many cycles begin, and how many are ended directly after their start."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = rows.withColumn("__s", starts).withColumn("__e", ends & F.coalesce(F.lag(starts).over(w), F.lit(False)))
    return marked.groupBy(*key).agg(F.count_if("__s").alias("cycles"), F.count_if("__e").alias("answered"))


def lifecycle(rows: DataFrame, key: list[str], order: str, kind: str = "event_type") -> DataFrame:
    """rows plus running: whether the latest start, resume, completion, error or abort up to the row leaves the session running."""
    state = F.when(F.col(kind).isin("start", "resume", "prompt"), F.lit(True)).when(F.col(kind).isin("complete", "error", "abort", "stop"), F.lit(False))
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(False)))


#: Categories of the three lanes; everything else is shown with the tools.
LANES = {"conversation": ("prompt", "response", "message"), "checks": ("test", "build", "lint", "typecheck", "git-review")}


def lane(category: Column) -> Column:
    out = F.lit("tools")
    for name, kinds in LANES.items():
        out = F.when(category.isin(*kinds), name).otherwise(out)
    return out


def phase_summary(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key, "island").agg(F.first("category").alias("category"), F.count("*").alias("events"), F.count_if(F.col("success")).alias("successes"), F.count_if(~F.col("success")).alias("failures"))
