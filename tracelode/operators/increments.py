"""Session records that are kept up to date: appended rows change only their sessions, and only appended rows are read.

Of each session an accumulator holds what its counters are so far and what the next row has to be compared with: the last
time, the run in progress, the last model, the last running total. Advancing joins the new rows to the accumulators of
their sessions, so that the first new row sees the row before it, and merges what they add. Any cuts of a log give the
accumulators of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions.mathfn import nonnegative, saturating_delta
from tracelode.functions.timefn import gap_seconds
from tracelode.operators.sequence import MAX_GAP_SECONDS

#: Rows: ts is null where a time cannot be read, timed tells that there is one; total is a running counter; the others may be null.
ROWS = "session string, ordinal long, ts timestamp, timed boolean, human boolean, model string, total long, tool boolean, failed boolean"
ACCUMULATORS = (
    "session string, last_ordinal long, rows_read long, started_at timestamp, ended_at timestamp, chained boolean, last_ts timestamp, active_seconds long, "
    "run_started timestamp, longest_run long, last_model string, model_switches long, models map<string, long>, last_total long, tokens long, prompts long, tool_calls long, errors long"
)
SUMS = ("rows_read", "active_seconds", "model_switches", "tokens", "prompts", "tool_calls", "errors")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ACCUMULATORS)


def _seconds(end: Column, start: Column) -> Column:
    return nonnegative(gap_seconds(end, start))


def advance(known: DataFrame, rows: DataFrame) -> DataFrame:
    """The accumulators of the sessions that rows touch. Rows that an accumulator has already are passed over, so a repeat adds nothing."""
    seeds = known.select("session", *[F.col(c).alias(f"was_{c}") for c in ("last_ordinal", "chained", "last_ts", "run_started", "last_model", "last_total")])
    r = rows.join(seeds, "session", "left").where(F.col("was_last_ordinal").isNull() | (F.col("ordinal") > F.col("was_last_ordinal")))
    w = Window.partitionBy("session").orderBy("ordinal")
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda when, value, seed: F.coalesce(F.last(F.when(when, F.struct(value.alias("v"))), ignorenulls=True).over(before), seed)["v"]
    human, timed = F.coalesce("human", F.lit(False)), F.coalesce("timed", F.lit(False))
    prev_ts = carried(timed, F.col("ts"), F.when(F.coalesce("was_chained", F.lit(False)), F.struct(F.col("was_last_ts").alias("v"))))
    gap = gap_seconds(F.col("ts"), prev_ts)
    prev_model = carried(F.col("model").isNotNull(), F.col("model"), F.struct(F.col("was_last_model").alias("v")))
    prev_total = carried(F.col("total").isNotNull(), F.col("total"), F.struct(F.coalesce("was_last_total", F.lit(0)).alias("v")))
    r = r.select(
        "*", timed.alias("t"), (human & timed).alias("h"), F.when(timed & gap.between(0, MAX_GAP_SECONDS), gap).otherwise(F.lit(0)).alias("active"),
        F.coalesce(F.col("model") != prev_model, F.lit(False)).cast("long").alias("switched"), F.when(F.col("total").isNotNull(), saturating_delta(F.col("total"), prev_total)).alias("gained"),
    ).withColumn("run", F.sum(F.col("h").cast("long")).over(so_far))
    # Runs: the one in progress goes on as run 0; a run ends where the next one's human row is.
    runs = r.where("t").groupBy("session", "run").agg(
        F.min(F.when(~F.col("h") & F.col("ts").isNotNull(), F.struct("ordinal", "ts"))).getField("ts").alias("opened"), F.max(F.when(F.col("h"), F.col("ts"))).alias("human_ts"), F.max("was_run_started").alias("was_run_started"),
    )
    runs = runs.withColumn("opened", F.when(F.col("run") == 0, F.coalesce("was_run_started", "opened")).otherwise(F.col("opened"))).withColumn("closed", F.lead("human_ts").over(Window.partitionBy("session").orderBy("run")))
    by_run = runs.groupBy("session").agg(F.max(_seconds(F.col("closed"), F.col("opened"))).alias("longest_run"), F.max(F.struct("run", "opened"))["opened"].alias("run_started"), F.max("run").alias("last_run"))
    # A session whose first new row is a person's has no row of run 0 here: its run in progress ends at that row.
    first_human = r.where("h and run = 1").groupBy("session").agg(F.max("ts").alias("ends"), F.max("was_run_started").alias("began"))
    by_run = by_run.join(first_human, "session", "left").select("session", F.greatest("longest_run", _seconds(F.col("ends"), F.col("began"))).alias("longest_run"), "run_started")
    at = lambda c, when: F.max_by(c, F.when(when, F.col("ordinal")))
    models = r.where("model IS NOT NULL").groupBy("session", "model").agg(F.count("*").alias("n")).groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("model", "n"))).alias("models"))
    new = r.groupBy("session").agg(
        F.max("ordinal").alias("last_ordinal"), F.count("*").alias("rows_read"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.bool_or("t").alias("chained"), at("ts", F.col("t")).alias("last_ts"), F.sum("active").alias("active_seconds"),
        at("model", F.col("model").isNotNull()).alias("last_model"), F.sum("switched").alias("model_switches"), at("total", F.col("total").isNotNull()).alias("last_total"), F.coalesce(F.sum("gained"), F.lit(0)).alias("tokens"),
        F.count_if("human").alias("prompts"), F.count_if("tool").alias("tool_calls"), F.count_if("failed").alias("errors"),
    )
    new = new.join(by_run, "session", "left").join(models, "session", "left")
    return _merged(known, new)


def _merged(known: DataFrame, new: DataFrame) -> DataFrame:
    """Each session of new with what was known of it."""
    k, n = known.alias("k"), new.alias("n")
    old, add = lambda c: F.col(f"k.{c}"), lambda c: F.col(f"n.{c}")
    chained = F.coalesce(add("chained"), F.lit(False))
    both = F.map_zip_with(F.coalesce(old("models"), F.create_map().cast("map<string, long>")), F.coalesce(add("models"), F.create_map().cast("map<string, long>")), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    made = {
        "last_ordinal": add("last_ordinal"), "started_at": F.least(old("started_at"), add("started_at")), "ended_at": F.greatest(old("ended_at"), add("ended_at")), "chained": chained | F.coalesce(old("chained"), F.lit(False)),
        "last_ts": F.when(chained, add("last_ts")).otherwise(old("last_ts")), "run_started": F.when(chained, add("run_started")).otherwise(old("run_started")), "longest_run": F.greatest(old("longest_run"), add("longest_run")),
        "last_model": F.coalesce(add("last_model"), old("last_model")), "models": both, "last_total": F.coalesce(add("last_total"), old("last_total")), **{c: F.coalesce(old(c), F.lit(0)) + add(c) for c in SUMS},
    }
    names = [c.split()[0] for c in ACCUMULATORS.replace("map<string, long>", "map").split(", ")]
    return n.join(k, "session", "left").select(*[F.col("session") if c == "session" else made[c].alias(c) for c in names])


def replaced(known: DataFrame, changed: DataFrame) -> DataFrame:
    """All accumulators after some have changed."""
    return known.join(changed.select("session"), "session", "left_anti").unionByName(changed)


def records(accumulators: DataFrame) -> DataFrame:
    """What a session's accumulator says now: the run in progress ends at the session's latest time, the model is the one seen most, then the least."""
    longest = F.greatest(F.col("longest_run"), _seconds(F.col("ended_at"), F.col("run_started")))
    seen = F.transform(F.map_entries("models"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("model")))
    return accumulators.select(
        "session", "started_at", "ended_at", "active_seconds", F.coalesce(longest, F.lit(0)).alias("longest_run"), F.array_min(seen)["model"].alias("model"), "model_switches", "tokens", "prompts", "tool_calls", "errors", "rows_read",
    )
