"""Usage records: session totals, days, hours, distributions, comparison, overview; account usage that fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.mathfn import complete_sum, tolerant_double, tolerant_long
from tracelode.functions.timefn import epoch_instant, local_date, local_hour
from tracelode.operators.pricing import USAGE, token_total

COUNTERS = (*USAGE, "reasoning_tokens")


def counted(usage: DataFrame) -> DataFrame:
    """Usage rows that count: a row without tokens goes even if it has reasoning tokens."""
    return usage.where(token_total() > 0)


def session_totals(usage: DataFrame, key: str = "session_id") -> DataFrame:
    return counted(usage).groupBy(key).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum(token_total()).alias("total_tokens"))


def by_day(usage: DataFrame, tz: str = "UTC", extra: tuple[str, ...] = ()) -> DataFrame:
    """Totals a local day; usage without a readable time belongs to its session but to no day."""
    rows = counted(usage).where(F.col("ts").isNotNull()).withColumn("date", local_date(F.col("ts"), tz))
    return rows.groupBy("date", *extra).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum(token_total()).alias("total_tokens"))


def by_hour(usage: DataFrame, tz: str = "UTC", extra: tuple[str, ...] = ()) -> DataFrame:
    rows = counted(usage).where(F.col("ts").isNotNull()).withColumn("hour", local_hour(F.col("ts"), tz))
    return rows.groupBy("hour", *extra).agg(F.sum(token_total()).alias("total_tokens"))


def distribution(df: DataFrame, by: str, value: Column, name: str = "value") -> DataFrame:
    """Sums by a label with their share, largest first among equals by label."""
    sums = df.groupBy(by).agg(value.alias(name))
    total = F.sum(name).over(Window.partitionBy())
    return sums.withColumn("share", F.when(total > 0, F.col(name) / total).otherwise(F.lit(0.0)))


def comparison(sessions: DataFrame) -> DataFrame:
    """Agents and (agent, model) pairs in one list: sessions, tokens, usage share and cost coverage by grouping sets."""
    base = sessions.groupingSets([[F.col("agent")], [F.col("agent"), F.col("model")]], "agent", "model").agg(
        F.grouping("model").alias("level"),
        F.count("*").alias("sessions"),
        F.sum("total_tokens").alias("tokens"),
        complete_sum(F.col("cost")).alias("cost"),
        F.sum(F.when(F.col("cost").isNotNull(), F.col("total_tokens")).otherwise(0)).alias("covered"),
    )
    total = F.sum("tokens").over(Window.partitionBy("level"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return base.select(
        F.when(F.col("level") == 1, "agent").otherwise("model").alias("kind"), "agent", "model", "sessions", "tokens", "cost",
        part(F.col("tokens"), total).alias("usage_share"), part(F.col("covered"), F.col("tokens")).alias("cost_coverage"),
    )


def overview(sessions: DataFrame) -> DataFrame:
    """One row of totals over session rows; rates are null where nothing could be counted."""
    rate = lambda a, b: F.when(b > 0, a / b)
    tokens, covered = F.sum("total_tokens"), F.sum(F.when(F.col("cost").isNotNull(), F.col("total_tokens")))
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.count_distinct("date").alias("active_days"),
        tokens.alias("total_tokens"),
        F.sum("cost").alias("known_cost"),
        rate(F.coalesce(covered, F.lit(0)), tokens).alias("cost_coverage"),
        F.sum("active_seconds").alias("active_seconds"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("errors").alias("errors"),
        rate(F.sum("errors"), F.sum("tool_calls")).alias("error_rate"),
        F.count_distinct("agent").alias("agents"),
        F.count_distinct("model").alias("models"),
    )


def overview_parts(usage: DataFrame, tools: DataFrame, tz: str = "UTC") -> DataFrame:
    """(part, key, agent, tokens, cost, calls, sessions, share, place): what stands beside the totals of an overview.

    usage: session_id, agent, model, ts, total_tokens, cost; tools: session_id, agent, tool, ts. Parts are daily and hourly (by
    agent, times that can be read), agents, models (both by tokens) and tools (by calls), the last three with share and place,
    largest first. Both tables are read once: the parts are grouping sets of one aggregation.
    """
    none = lambda kind="string": F.lit(None).cast(kind)
    used = usage.select("session_id", "agent", "model", none().alias("tool"), "ts", F.col("total_tokens").alias("tokens"), "cost", F.lit(0).alias("call"))
    called = tools.select("session_id", "agent", none().alias("model"), "tool", "ts", F.lit(0).cast("long").alias("tokens"), none("double").alias("cost"), F.lit(1).alias("call"))
    rows = used.unionByName(called).withColumn("date", local_date(F.col("ts"), tz)).withColumn("hour", local_hour(F.col("ts"), tz))
    sets = {"daily": ["date", "agent"], "hourly": ["hour", "agent"], "agents": ["agent"], "models": ["model"], "tools": ["tool"]}
    keys = ["date", "hour", "agent", "model", "tool"]
    grouped = rows.groupingSets([[F.col(c) for c in by] for by in sets.values()], *keys).agg(
        F.grouping_id().alias("g"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("call").alias("calls"), F.count_distinct("session_id").alias("sessions"),
    )
    part, key = none(), none()
    for name, by in sets.items():
        number = sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in by)
        part, key = F.when(F.col("g") == number, name).otherwise(part), F.when(F.col("g") == number, F.col(by[0])).otherwise(key)
    out = grouped.select(part.alias("part"), key.alias("key"), F.when(F.col("date").isNotNull() | F.col("hour").isNotNull(), F.col("agent")).alias("agent"), "tokens", "cost", "calls", "sessions").where("key IS NOT NULL")
    # Labels of a part are few, dates and hours those of a range.
    value = F.when(F.col("part") == "tools", F.col("calls")).otherwise(F.col("tokens"))
    ranked = ~F.col("part").isin("daily", "hourly")
    total = F.sum(value).over(Window.partitionBy("part"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc(value), "key"))
    return out.select("*", F.when(ranked & (total > 0), value / total).alias("share"), F.when(ranked, place).alias("place"))


def overview_response(totals: DataFrame, parts: DataFrame) -> DataFrame:
    """The one row of totals with daily, hourly, agents, models and tools as arrays, times in order and labels by place."""
    def listed(name: str, order: list[str], *fields: str) -> Column:
        found = F.collect_list(F.when(F.col("part") == name, F.struct(*order, *fields)))
        return F.transform(F.array_sort(found), lambda x: F.struct(*[x[c].alias(c) for c in (*[o for o in order if o != "place"], *fields)])).alias(name)

    points = ("tokens", "cost", "calls", "sessions")
    nested = parts.agg(*[listed(n, ["key", "agent"], *points) for n in ("daily", "hourly")], *[listed(n, ["place"], "key", *points, "share") for n in ("agents", "models", "tools")])
    # Two tables of one row each.
    return totals.withColumn("__one", F.lit(1)).join(nested.withColumn("__one", F.lit(1)), "__one").drop("__one")


def behavior_summary(s: DataFrame) -> DataFrame:
    """Rates over sessions and the share of sessions that can show them; null where nothing was seen."""
    rate = lambda a, b: F.when(b > 0, a / b)
    has = lambda c: F.avg(F.col(c).cast("double"))
    return s.agg(
        F.count("*").alias("sessions"),
        rate(F.sum("structured_prompts"), F.sum("prompt_count")).alias("structured_rate"),
        rate(F.sum("acceptance_prompts"), F.sum("prompt_count")).alias("acceptance_rate"),
        rate(F.sum("task_completions"), F.sum("task_completions") + F.sum("task_aborts")).alias("completion_rate"),
        rate(F.sum("successful_tools"), F.sum("successful_tools") + F.sum("failed_tools")).alias("tool_success_rate"),
        *[F.coalesce(has(c), F.lit(0.0)).alias(c.replace("has_", "") + "_coverage") for c in ("has_structure", "has_lifecycle", "has_tool_result", "has_orchestration", "has_process_control")],
    )


def skill_ranking(uses: DataFrame, installed: DataFrame | None = None) -> DataFrame:
    """Uses and sessions of each skill with ranks from both ends; installed skills without use have zero."""
    rows = uses.groupBy("skill").agg(F.count("*").alias("uses"), F.count_distinct("session_id").alias("sessions"))
    if installed is not None:
        unused = installed.select("skill").distinct().join(rows, "skill", "left_anti").select("skill", F.lit(0).cast("long").alias("uses"), F.lit(0).cast("long").alias("sessions"))
        rows = rows.unionByName(unused)
    # Skills are few: the ranks' single partition holds one row a skill.
    most = F.row_number().over(Window.orderBy(F.desc("uses"), "skill"))
    least = F.row_number().over(Window.orderBy(F.asc("uses"), "skill"))
    return rows.withColumn("most_rank", most).withColumn("least_rank", least)


def account_events(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """Per (local date, model) usage of an account's events: numbers may be text; an event without a charge voids the metered cost."""
    ts = epoch_instant(tolerant_long(F.col("timestamp")))
    token = lambda c: tolerant_long(F.col(f"tokenUsage.{c}"))
    rows = events.select(
        local_date(ts, tz).alias("date"), F.coalesce("model", F.lit("unknown")).alias("model"),
        token("inputTokens").alias("input_tokens"), token("outputTokens").alias("output_tokens"), token("cacheReadTokens").alias("cache_read_tokens"), token("cacheWriteTokens").alias("cache_write_tokens"),
        (tolerant_double(F.col("tokenUsage.totalCents")) / 100).alias("api_cost"), (tolerant_double(F.col("chargedCents")) / 100).alias("metered_cost"),
        F.col("tokenUsage").isNotNull().alias("has_tokens"),
    ).where(F.col("date").isNotNull())
    return rows.groupBy("date", "model").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in USAGE[:4]],
        complete_sum(F.when(~F.col("has_tokens"), F.lit(0.0)).otherwise(F.col("api_cost"))).alias("api_cost"),
        complete_sum(F.col("metered_cost")).alias("metered_cost"),
        F.count("*").alias("requests"),
        F.count_if("has_tokens").alias("token_requests"),
    )


def account_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals of account rows by date, by model or (with []) over all; a cost is known only if all its rows have it."""
    tokens = sum((F.coalesce(c, F.lit(0)) for c in USAGE[:4]), F.lit(0))
    return rows.groupBy(*by).agg(
        F.sum(tokens).alias("tokens"),
        complete_sum(F.col("api_cost")).alias("api_cost"),
        complete_sum(F.col("metered_cost")).alias("metered_cost"),
        F.sum("requests").alias("requests"),
        F.sum("token_requests").alias("token_requests"),
        (F.sum("requests") == F.sum("token_requests")).alias("tokens_complete"),
    )


def file_changes(changes: DataFrame, key: list[str]) -> DataFrame:
    """Per file: kind (an added file stays added, a deleted one is deleted), sums, count, first and last change."""
    last = F.max_by("kind", "ordinal")
    return changes.groupBy(*key, "path").agg(
        F.when(last == "deleted", "deleted").when(F.max(F.col("kind") == "added"), "added").otherwise(last).alias("kind"),
        F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("changes"),
        F.min_by("ts", "ordinal").alias("first_at"), F.max_by("ts", "ordinal").alias("last_at"),
    )


def verification_state(edits: Column, verifications: Column, committed: Column) -> Column:
    return F.when(edits <= 0, "not-applicable").when((verifications > 0) | committed, "verified").otherwise("unverified")


def insights(sessions: DataFrame, minimum: int = 20) -> DataFrame:
    """(id, label, value) facts over session rows; below `minimum` sessions they are marked as early."""
    base = sessions.persist()
    n = base.agg(F.count("*").alias("sample_size"))
    fact = lambda i, df: df.select(F.lit(i).alias("id"), F.col("label").cast("string").alias("label"), F.col("value").cast("double").alias("value"))
    best = lambda by, v: base.groupBy(by).agg(v.alias("v")).agg(F.max(F.struct("v", F.col(by).alias("l"))).alias("b")).select(F.col("b.l").alias("label"), F.col("b.v").alias("value"))
    one = lambda v: base.agg(v.alias("value")).select(F.lit(None).cast("string").alias("label"), "value")
    rows = [
        fact("top-agent", best("agent", F.sum("total_tokens"))),
        fact("busiest-hour", best("hour", F.count("*"))),
        fact("average-duration", one(F.avg("active_seconds"))),
        fact("longest-focus", one(F.max("active_seconds"))),
        fact("verification-rate", one(F.avg(F.when(F.col("edits") > 0, (F.col("verifications") > 0).cast("double"))))),
        fact("verification-gap", one(F.sum(F.when((F.col("edits") > 0) & (F.col("verifications") == 0), 1).otherwise(0)))),
        fact("files", one(F.sum("files"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    # One row of counts beside seven facts.
    return out.join(F.broadcast(n)).withColumn("early", F.col("sample_size") < minimum)
