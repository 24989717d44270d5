"""Ordered-sequence operators. Order is always that of the records in their source, never that of their clocks.

Each is one window over a session's key, so all of them that share key and order run in one shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.mathfn import nonnegative, saturating_delta
from tracelode.functions.timefn import gap_seconds

MAX_GAP_SECONDS = 600
MAX_EVENTS = 4000


def _over(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def activity_gaps(df: DataFrame, key: list[str], order: list[str], ts: str = "ts", max_gap: int = MAX_GAP_SECONDS) -> DataFrame:
    """df plus prev_ts and active_seconds: the whole seconds since the record before, 0 unless within 0 to max_gap.

    A record without a readable time breaks the chain on both sides. The seconds belong to the day of prev_ts.
    """
    before = F.lag(ts).over(_over(key, order))
    gap = gap_seconds(F.col(ts), F.col("prev_ts"))
    return df.withColumn("prev_ts", before).withColumn("active_seconds", F.when(gap.between(0, max_gap), gap).otherwise(F.lit(0).cast("long")))


def agent_runs(df: DataFrame, key: list[str], order: list[str], human: Column, ts: str = "ts") -> DataFrame:
    """One row a run of records that no person interrupts: run number, start, end, seconds.

    A run opens at the first timed record after a person's (or at the start) and closes at the next person's record,
    the last one at the session's latest time.
    """
    w = _over(key, order)
    marked = df.withColumn("__human", F.coalesce(human, F.lit(False))).withColumn("run", F.sum(F.col("__human").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*key, "run").agg(
        F.min(F.when(~F.col("__human") & F.col(ts).isNotNull(), F.struct(*order, ts))).getField(ts).alias("started"),
        F.max(F.when(F.col("__human"), F.col(ts))).alias("human_ts"),
        F.max(ts).alias("latest"),
    )
    after = Window.partitionBy(*key).orderBy("run")
    closes = F.coalesce(F.lead("human_ts").over(after), F.max("latest").over(Window.partitionBy(*key)))
    out = runs.withColumn("ended", closes).where(F.col("started").isNotNull())
    return out.select(*key, "run", "started", "ended", nonnegative(gap_seconds(F.col("ended"), F.col("started"))).alias("seconds"))


def cumulative_delta(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Running totals as increments; a counter that falls back gives 0, not its new value."""
    w = _over(key, order)
    return df.withColumns({f"{c}_delta": saturating_delta(F.col(c), F.lag(c, 1, 0).over(w)) for c in columns})


def same_id_delta(df: DataFrame, key: list[str], order: list[str], ident: str, columns: list[str]) -> DataFrame:
    """Increments over the record before if it has the same id (a missing id equals another missing one), else the value itself."""
    w = _over(key, order)
    name = F.coalesce(F.col(ident).cast("string"), F.lit(""))
    same = name == F.lag(name).over(w)
    return df.withColumns({f"{c}_delta": F.when(same, saturating_delta(F.col(c), F.lag(c).over(w))).otherwise(F.col(c)) for c in columns})


def switches(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """How often the value of a session's observations changes; nulls are no observations."""
    seen = df.where(F.col(value).isNotNull()).withColumn("__before", F.lag(value).over(_over(key, order)))
    return seen.groupBy(*key).agg(F.count_if(F.col(value) != F.col("__before")).alias("switches"))


def numbered(df: DataFrame, key: list[str], order: list[str], limit: int = MAX_EVENTS) -> DataFrame:
    """df with sequence 1..limit; later records of a session go."""
    return df.withColumn("sequence", F.row_number().over(_over(key, order))).where(F.col("sequence") <= limit)


def duplicate_ordinal(df: DataFrame, key: list[str], identity: list[str], order: list[str]) -> DataFrame:
    """df with ordinal: 0 for the first of identical records, then 1, 2 ..."""
    return df.withColumn("ordinal", F.row_number().over(_over([*key, *identity], order)) - 1)


def without_adjacent_repeats(df: DataFrame, key: list[str], order: list[str], fingerprint: Column) -> DataFrame:
    """df without records whose fingerprint is that of the record before; unknown fingerprints stay."""
    marked = df.withColumn("__f", fingerprint).withColumn("__before", F.lag("__f").over(_over(key, order)))
    return marked.where(F.col("__f").isNull() | ~F.col("__f").eqNullSafe(F.col("__before"))).drop("__f", "__before")


def top_per_group(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def carried(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """df with the last known value of each column carried forward."""
    w = _over(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def primary_value(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest among equals: two aggregations, no window over a hot key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.v").alias(f"primary_{value}"), (-F.col("b.n")).alias("observations"))


def islands(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of consecutive records of equal value, numbered from 1 within the key."""
    w = _over(key, order)
    head = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | F.lag(F.lit(1)).over(w).isNull()
    numbered_runs = df.withColumn("__head", head.cast("long")).withColumn("island", F.sum("__head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered_runs.drop("__head")


def first_tool(df: DataFrame, key: list[str], order: list[str], kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """First prompt and tool times and the milliseconds between, at least 0.

    A prompt's time is that of the last timed record up to it, as prompts may carry none.
    """
    known = F.last(ts, ignorenulls=True).over(_over(key, order).rowsBetween(Window.unboundedPreceding, 0))
    at = df.withColumn("__known", known)
    first = lambda k, c: F.min(F.when(F.col(kind) == k, F.struct(*order, F.col(c).alias("at")))).getField("at")
    out = at.groupBy(*key).agg(first("prompt", "__known").alias("first_prompt_at"), first("tool", ts).alias("first_tool_at"))
    ms = nonnegative(((F.unix_micros("first_tool_at") - F.unix_micros("first_prompt_at")) / 1000).cast("long"))
    return out.withColumn("time_to_first_tool_ms", ms)


def replay_free(df: DataFrame, key: list[str], order: list[str], fingerprint: str, position: str) -> DataFrame:
    """Prompts of cumulative requests once each: a record goes if fingerprint and position are those of the one before."""
    w = _over(key, order)
    repeat = F.col(fingerprint).eqNullSafe(F.lag(fingerprint).over(w)) & F.col(position).eqNullSafe(F.lag(position).over(w))
    return df.withColumn("__repeat", F.coalesce(repeat, F.lit(False))).where(~F.col("__repeat")).drop("__repeat")
