"""The behaviour profile: one weighted aggregation of sessions to features, features to type scores, ranks and gates.

All of it is relational: a groupBy with weighted sums (one row a profile group, partial sums before the shuffle), a
projection to features, an explode over 24 types, and windows over those 24 rows a group. The same steps serve the
whole range and the trailing trend windows, where the window's start is a group key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.mathfn import EPSILON, average, cap, clamp, half_life_weight, inverse, nonnegative, ratio, weighted
from tracelode.functions.timefn import instant, iso_week, local, work_period

CANONICAL_DAYS = 90

# Type code, guild, weights of features (an "i:" inverts the feature), and what makes a type eligible.
TYPES = (
    ("VIBE", "start", {"exploration": 0.40, "i:requirement_clarity": 0.34, "polish": 0.26}, "structure"),
    ("SPEC", "start", {"requirement_clarity": 0.58, "i:scope_drift": 0.24, "context_reuse": 0.18}, "structure"),
    ("HACK", "start", {"exploration": 0.40, "automation": 0.27, "dependency_reuse": 0.20, "i:requirement_clarity": 0.13}, "structure"),
    ("MIX", "start", {"dependency_reuse": 0.55, "iteration_granularity": 0.18, "first_result_speed": 0.17, "i:infrastructure": 0.10}, "structure_modified"),
    ("YOLO", "agent", {"delegation": 0.46, "iteration_granularity": 0.27, "i:guardrail": 0.27}, "modified"),
    ("LOOP", "agent", {"human_intervention": 0.50, "i:iteration_granularity": 0.27, "polish": 0.23}, "modified_or_process"),
    ("BOSS", "agent", {"parallel_orchestration": 0.42, "requirement_clarity": 0.34, "context_reuse": 0.24}, "orchestration"),
    ("SWARM", "agent", {"parallel_orchestration": 0.68, "tool_switching": 0.18, "delegation": 0.14}, "orchestration"),
    ("DIFF", "quality", {"diff_review": 0.66, "human_intervention": 0.18, "rollback_awareness": 0.16}, "modified"),
    ("TEST", "quality", {"automated_verification": 0.72, "root_cause": 0.16, "rollback_awareness": 0.12}, "modified"),
    ("DOCS", "quality", {"context_reuse": 0.50, "requirement_clarity": 0.30, "i:scope_drift": 0.20}, "modified"),
    ("UNDO", "quality", {"rollback_awareness": 0.68, "iteration_granularity": 0.18, "exploration": 0.14}, "modified_traced"),
    ("DEBUG", "debug", {"root_cause": 0.62, "automated_verification": 0.20, "i:first_result_speed": 0.18}, "modified"),
    ("PATCH", "debug", {"local_fix": 0.58, "first_result_speed": 0.28, "i:infrastructure": 0.14}, "modified"),
    ("STACK", "debug", {"infrastructure": 0.56, "dependency_reuse": 0.24, "iteration_granularity": 0.20}, "modified"),
    ("AUTO", "debug", {"automation": 0.64, "parallel_orchestration": 0.18, "context_reuse": 0.18}, "modified"),
    ("SHIP", "delivery", {"shipping_tendency": 0.55, "first_result_speed": 0.26, "completion": 0.19}, "lifecycle_or_modified"),
    ("RUSH", "delivery", {"burst": 0.58, "completion": 0.24, "first_result_speed": 0.18}, "lifecycle"),
    ("MVP", "delivery", {"first_result_speed": 0.34, "local_fix": 0.28, "i:polish": 0.22, "shipping_tendency": 0.16}, "structured_first_tool"),
    ("DETAIL", "delivery", {"polish": 0.62, "i:first_result_speed": 0.18, "human_intervention": 0.20}, "modified"),
    ("FORK", "tools", {"tool_switching": 0.74, "exploration": 0.16, "cost_routing": 0.10}, "several_agents"),
    ("TOKEN", "tools", {"cost_routing": 0.72, "context_reuse": 0.18, "i:iteration_granularity": 0.10}, "tokens"),
    ("CACHE", "tools", {"context_reuse": 0.68, "requirement_clarity": 0.18, "cost_routing": 0.14}, "tokens_or_prompts"),
    ("BUDDY", "tools", {"i:tool_switching": 0.62, "context_reuse": 0.22, "i:scope_drift": 0.16}, "several_agents_known"),
)

#: Counters of a session record that are summed with its weight.
SUMMED = (
    "files_touched lines_changed tool_calls human_interventions parallel_batches plan_events goal_changes context_compactions rollbacks git_review_events edit_events shell_events errors "
    "automation_events infrastructure_events dependency_events style_events document_events instruction_file_events deploy_events task_completions task_aborts successful_tools failed_tools "
    "completed_task_duration_ms prompt_count prompt_characters structured_prompts acceptance_criteria_prompts file_scope_prompts total_tokens cache_read_tokens model_switches"
).split()


@dataclass(frozen=True)
class Setting:
    """What is known about the sources: agents there are, whether prompts and git may be read, coverage of capabilities."""

    available_agents: int = 1
    structure: bool = True
    git: bool = True
    structure_coverage: float = 1.0
    lifecycle_coverage: float = 1.0
    tool_result_coverage: float = 1.0
    orchestration_coverage: float = 1.0
    process_control_coverage: float = 1.0
    #: Weighted sums up to this are no signal.
    nothing: float = EPSILON


def sums(records: DataFrame, now: Column, days: int, group: list[str] | None = None, tz: str = "UTC") -> DataFrame:
    """Weighted sums, distinct sets and the day statistics of each group of records."""
    group = group or []
    at = instant(F.col("started_at"))
    age = nonnegative(((F.unix_micros(now) - F.unix_micros(at)) / 1_000_000).cast("long")) / 86_400.0
    w = half_life_weight(F.coalesce(age, F.lit(float(days))))
    day = F.when(F.length("started_at") >= 10, F.substring("started_at", 1, 10))
    rows = records.withColumn("w", w).withColumn("day", day).withColumn("hour", F.hour(local(at, tz)))
    c = F.col
    v = lambda name: c(name) * c("w")
    modified = (c("files_touched") > 0) | (c("lines_changed") > 0)
    when = lambda cond: F.sum(F.when(cond, c("w")).otherwise(0.0))
    # Days first: their counts give the variation, and sums over days add up to sums over records.
    daily = rows.groupBy(*group, "day").agg(
        F.count("*").alias("n"), F.sum("w").alias("ws"),
        when(modified).alias("ms"), when(modified & ((c("verification_events") > 0) | c("has_commit"))).alias("verified"), when(c("has_commit")).alias("committed"),
        F.sum(F.greatest("subagent_starts", "subagent_count") * c("w")).alias("subagents"),
        F.sum((c("test_events") + c("build_events") + c("lint_events") + c("typecheck_events")) * c("w")).alias("tests"),
        F.sum((c("read_events") + c("search_events")) * c("w")).alias("reads"),
        F.sum(F.coalesce(v("time_to_first_tool_ms"), F.lit(0.0))).alias("first_tool_ms"), when(c("time_to_first_tool_ms").isNotNull()).alias("first_tool_w"),
        F.sum(F.greatest("longest_uninterrupted_seconds", "active_seconds") * c("w")).alias("uninterrupted"),
        F.count_if(c("longest_uninterrupted_seconds") >= 5400).alias("long_sessions"),
        F.max(F.coalesce(c("hour") < 5, F.lit(False))).alias("night"),
        F.collect_set("agent").alias("agents"), F.collect_set("model").alias("models"), F.collect_set(F.coalesce(iso_week(at), F.lit(""))).alias("weeks"),
        *[F.sum(v(s)).alias(s) for s in SUMMED],
    )
    total = [s for s in ("ws", "ms", "verified", "committed", "subagents", "tests", "reads", "first_tool_ms", "first_tool_w", "uninterrupted", "long_sessions", *SUMMED)]
    size = lambda x: F.size(F.array_distinct(F.flatten(F.collect_list(x)))).cast("long")
    dated = F.col("day").isNotNull()
    mean, spread = F.avg(F.when(dated, c("n"))), F.stddev_pop(F.when(dated, c("n")))
    return daily.groupBy(*group).agg(
        F.sum("n").alias("session_count"), F.count("day").alias("active_days"), F.count_if(F.col("night") & dated).alias("night_days"),
        F.when((F.count("day") > 1) & (mean > 0), spread / mean).otherwise(F.lit(1.0)).alias("variation"),
        size("agents").alias("providers"), size("models").alias("models"), size("weeks").alias("weeks"),
        *[F.sum(t).alias(t) for t in total],
    )


def features(s: DataFrame, setting: Setting) -> DataFrame:
    """s plus the scored features (0 to 100) and the signals that say which of them rest on something."""
    c = F.col
    ws, ms = F.greatest("ws", F.lit(0.001)), c("ms")
    per = lambda a: ratio(c(a), ws)
    mod = lambda a: ratio(c(a), ms)
    half = lambda signal, x: F.when(signal, x).otherwise(F.lit(50.0))
    eps = setting.nothing
    s = s.withColumns({
        "prompt_signal": c("prompt_count") > eps, "modification_signal": ms > eps, "lifecycle_signal": c("task_completions") + c("task_aborts") > eps,
        "first_tool_signal": c("first_tool_w") > eps, "token_signal": c("total_tokens") > eps,
        "structure_rate": ratio(c("structured_prompts"), c("prompt_count")), "acceptance_rate": ratio(c("acceptance_criteria_prompts"), c("prompt_count")),
        "scope_rate": ratio(c("file_scope_prompts"), c("prompt_count")), "plan_rate": per("plan_events"), "cache_ratio": ratio(c("cache_read_tokens"), c("total_tokens")),
        "scope_drift": cap(per("goal_changes"), 0.28), "more_models": F.greatest(c("models") - 1, F.lit(0)).cast("double"), "more_providers": F.greatest(c("providers") - 1, F.lit(0)).cast("double"),
    })
    prompted, modified = c("prompt_signal"), c("modification_signal")
    chars = F.when(prompted, inverse(cap(ratio(c("prompt_characters"), c("prompt_count")), 1200.0))).otherwise(F.lit(50.0))
    s = s.withColumns({
        "requirement_clarity": half(prompted, weighted((c("structure_rate") * 100.0, 0.38), (cap(c("acceptance_rate"), 0.28), 0.26), (cap(c("scope_rate"), 0.38), 0.22), (cap(c("plan_rate"), 0.45), 0.14))),
        "exploration": clamp(c("scope_drift") * 0.38 + cap(per("model_switches"), 0.20) * 0.22 + cap(per("dependency_events"), 0.40) * 0.20 + chars * 0.20),
        "delegation": clamp(cap(per("files_touched"), 8.0) * 0.35 + cap(ratio(c("tool_calls"), F.greatest(c("prompt_count"), ws)), 18.0) * 0.30 + cap(per("uninterrupted"), 7200.0) * 0.20 + inverse(cap(per("human_interventions"), 5.0)) * 0.15),
        "human_intervention": cap(per("human_interventions"), 4.0),
        "parallel_orchestration": clamp(cap(per("subagents"), 0.65) * 0.65 + cap(per("parallel_batches"), 0.45) * 0.35),
        "diff_review": half(modified, cap(mod("git_review_events"), 1.15)),
        "automated_verification": half(modified, weighted((mod("verified") * 100.0, 0.70), (cap(mod("tests"), 1.2), 0.30))),
        "rollback_awareness": half(modified, clamp(cap(mod("rollbacks"), 0.16) * 0.58 + mod("committed") * 42.0)),
        "root_cause": clamp(cap(ratio(c("reads") + c("shell_events") * 0.08, F.greatest(c("edit_events"), F.lit(1.0))), 0.95) * 0.45 + cap(ratio(c("tests"), F.greatest(ms, F.lit(1.0))), 1.0) * 0.30 + cap(per("errors"), 0.35) * 0.25),
        "local_fix": half(modified, clamp(inverse(cap(mod("files_touched"), 9.0)) * 0.58 + inverse(cap(mod("lines_changed"), 480.0)) * 0.42)),
        "automation": clamp(cap(per("automation_events"), 0.30) * 0.58 + cap(per("tool_calls"), 55.0) * 0.24 + cap(c("plan_rate"), 0.60) * 0.18),
        "first_result_speed": half(c("first_tool_signal"), inverse(cap(ratio(c("first_tool_ms"), c("first_tool_w")), 720_000.0))),
        "iteration_granularity": half(modified, clamp(cap(mod("files_touched"), 10.0) * 0.58 + cap(mod("lines_changed"), 600.0) * 0.42)),
        "done": F.when(c("lifecycle_signal"), ratio(c("task_completions"), c("task_completions") + c("task_aborts"))).otherwise(F.lit(0.5)),
        "tool_switching": clamp((cap(c("more_providers"), 2.0) if setting.available_agents >= 2 else F.lit(0.0)) * 0.42 + cap(c("more_models"), 5.0) * 0.34 + cap(per("model_switches"), 0.18) * 0.24),
        "cost_routing": clamp(cap(c("cache_ratio"), 0.72) * 0.62 + cap(per("model_switches"), 0.12) * 0.22 + cap(c("more_models"), 3.0) * 0.16),
        "context_reuse": clamp(cap(ratio(c("instruction_file_events") + c("document_events"), ws), 0.24) * 0.42 + cap(per("context_compactions"), 0.18) * 0.22 + cap(c("cache_ratio"), 0.72) * 0.36),
        "infrastructure": half(modified, cap(mod("infrastructure_events"), 0.85)),
        "dependency_reuse": half(modified, cap(mod("dependency_events"), 0.55)),
        "burst": clamp(cap(c("variation"), 1.2) * 0.62 + cap(ratio(c("long_sessions").cast("double"), c("session_count").cast("double")), 0.18) * 0.38),
        "tool_success": ratio(c("successful_tools"), c("successful_tools") + c("failed_tools")) * 100.0,
        "average_task_seconds": ratio(c("completed_task_duration_ms"), F.greatest(c("task_completions"), F.lit(1.0))) / 1000.0,
        "night_rate": ratio(c("night_days").cast("double"), F.greatest(c("active_days"), F.lit(1)).cast("double")) * 100.0,
    })
    return s.withColumns({
        "shipping_tendency": clamp(cap(per("deploy_events"), 0.08) * 0.34 + per("committed") * 34.0 + c("done") * 32.0),
        "polish": half(modified, clamp(cap(mod("style_events"), 1.8) * 0.48 + cap(mod("document_events"), 0.65) * 0.20 + inverse(c("first_result_speed")) * 0.12 + inverse(c("local_fix")) * 0.20)),
        "completion": c("done") * 100.0,
        "guardrail": average(c("diff_review"), c("automated_verification"), c("rollback_awareness")),
    })


def _eligible(setting: Setting) -> dict[str, Column]:
    c, lit = F.col, F.lit
    structure, process = lit(setting.structure), lit(setting.process_control_coverage >= 0.30)
    modified = c("modification_signal")
    several = lit(setting.available_agents >= 2)
    return {
        "structure": structure & c("prompt_signal"), "structure_modified": structure & c("prompt_signal") & modified, "modified": modified, "modified_or_process": modified | process,
        "orchestration": lit(setting.orchestration_coverage >= 0.30), "modified_traced": modified & (lit(setting.git) | process), "lifecycle_or_modified": c("lifecycle_signal") | modified,
        "lifecycle": c("lifecycle_signal"), "structured_first_tool": structure & modified & c("first_tool_signal"), "several_agents": several, "tokens": c("token_signal"),
        "tokens_or_prompts": c("token_signal") | c("prompt_signal"), "several_agents_known": several & (c("token_signal") | c("prompt_signal")),
    }


def type_scores(f: DataFrame, setting: Setting, group: list[str] | None = None) -> DataFrame:
    """Eligible types of each group with raw score, distinctiveness (over the guild's mean of all its types), score and rank."""
    group = group or []
    allowed = _eligible(setting)

    def value(name: str) -> Column:
        return inverse(F.col(name[2:])) if name.startswith("i:") else F.col(name)

    entries = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(guild).alias("guild"), weighted(*[(value(n), w) for n, w in parts.items()]).alias("raw_score"), allowed[rule].alias("eligible")) for code, guild, parts, rule in TYPES])
    rows = f.select(*group, F.explode(entries).alias("t")).select(*group, "t.*")
    distinct = F.col("raw_score") - F.avg("raw_score").over(Window.partitionBy(*group, "guild"))
    rows = rows.withColumn("distinctiveness", distinct).where("eligible")
    rows = rows.withColumn("score", clamp(50.0 + F.col("distinctiveness") * 1.35 + (F.col("raw_score") - 50.0) * 0.20))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "code"))).drop("eligible")


def public_scores(f: DataFrame, setting: Setting, group: list[str] | None = None) -> DataFrame:
    """The six shown scores with their coverage."""
    clipped = lambda x: min(max(x, 0.0), 1.0)
    shown = (
        ("requirementClarity", "requirement_clarity", setting.structure_coverage), ("delegation", "delegation", max(setting.orchestration_coverage, 0.55)),
        ("guardrail", "guardrail", (setting.tool_result_coverage + setting.process_control_coverage) / 2), ("debugDepth", "root_cause", setting.tool_result_coverage),
        ("shipping", "shipping_tendency", setting.lifecycle_coverage), ("toolNomad", "tool_switching", 1.0),
    )
    entries = F.array(*[F.struct(F.lit(i).alias("id"), clamp(F.col(n)).alias("value"), F.lit(clipped(cov)).alias("coverage")) for i, n, cov in shown])
    return f.select(*(group or []), F.explode(entries).alias("s")).select(*(group or []), "s.*")


def dimensions(f: DataFrame, setting: Setting) -> DataFrame:
    """The 18 dimensions with coverage: what rests on nothing is covered by nothing."""
    any_ = F.when(F.col("session_count") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    on = lambda signal, x: F.when(F.col(signal), x).otherwise(F.lit(0.0))
    lit = F.lit
    modified, tokens = on("modification_signal", any_), on("token_signal", any_)
    structure = on("prompt_signal", lit(setting.structure_coverage if setting.structure else 0.0))
    results, process, lifecycle, orchestration = (lit(x) for x in (setting.tool_result_coverage, setting.process_control_coverage, setting.lifecycle_coverage, setting.orchestration_coverage))
    rows = (
        ("requirementClarity", "requirement_clarity", structure), ("exploration", "exploration", any_), ("scopeDrift", "scope_drift", process), ("delegation", "delegation", orchestration),
        ("humanIntervention", "human_intervention", lifecycle), ("parallelOrchestration", "parallel_orchestration", orchestration), ("diffReview", "diff_review", modified if setting.git else F.least(modified, results)),
        ("automatedVerification", "automated_verification", F.least(modified, results)), ("rollbackAwareness", "rollback_awareness", F.least(modified, process)), ("rootCause", "root_cause", results),
        ("localFix", "local_fix", modified), ("automation", "automation", results), ("firstResultSpeed", "first_result_speed", on("first_tool_signal", any_)), ("iterationGranularity", "iteration_granularity", modified),
        ("shippingTendency", "shipping_tendency", F.greatest(lifecycle, modified if setting.git else lit(0.0))), ("toolSwitching", "tool_switching", any_), ("costRouting", "cost_routing", tokens), ("contextReuse", "context_reuse", F.greatest(tokens, process)),
    )
    entries = F.array(*[F.struct(F.lit(i).alias("id"), clamp(F.col(n)).alias("value"), F.least(F.greatest(cov, lit(0.0)), lit(1.0)).alias("coverage")) for i, n, cov in rows])
    return f.select(F.explode(entries).alias("s")).select("s.*")


def badges(f: DataFrame, setting: Setting) -> DataFrame:
    """Badges by strength, equal ones in the rules' order."""
    c, n = F.col, F.col("session_count")
    lit = F.lit
    rules = (
        ("GUARD", (c("guardrail") >= 70) & (c("automated_verification") >= 65) & lit(setting.git or setting.process_control_coverage >= 0.6), c("guardrail")),
        ("TURBO", (c("first_result_speed") >= 72) & (c("tool_success") >= 78) & (c("completion") >= 65), c("first_result_speed")),
        ("BUDGET", (c("cost_routing") >= 72) & (n >= 30), c("cost_routing")),
        ("LIVE", (c("human_intervention") >= 55) & (c("tool_success") >= 72) & (n >= 20), average(c("human_intervention"), c("tool_success"))),
        ("NIGHT", (c("night_rate") >= 35) & (c("active_days") >= 7), c("night_rate")),
        ("MARATHON", c("long_sessions") >= 8, cap(c("long_sessions").cast("double"), 14.0)),
        ("SOLO", lit(setting.orchestration_coverage >= 0.6) & (c("parallel_orchestration") <= 8) & (n >= 30), inverse(c("parallel_orchestration"))),
        ("FINISH", (c("completion") >= 80) & (c("automated_verification") >= 55) & lit(setting.lifecycle_coverage >= 0.6), average(c("completion"), c("automated_verification"))),
        ("STEADY", (c("active_days") >= 42) & (c("variation") <= 0.55), inverse(cap(c("variation"), 1.2))),
    )
    entries = F.array_compact(F.array(*[F.when(cond, F.struct((-strength).alias("order"), F.lit(i).alias("i"), F.lit(code).alias("code"))) for i, (code, cond, strength) in enumerate(rules)]))
    return f.select(F.posexplode(F.array_sort(entries)).alias("position", "b")).select("position", "b.code")


def profile(records: DataFrame, setting: Setting, now: str, days: int = CANONICAL_DAYS, tz: str = "UTC") -> DataFrame:
    """One row: status, primary and secondary type, margin, confidence, missing capabilities."""
    f = features(sums(records, F.lit(now).cast("timestamp"), days, tz=tz), setting)
    ranked = type_scores(f, setting)
    # At most 24 rows, folded into one.
    types = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", "code", "guild", "score", "raw_score", "distinctiveness"))).alias("types"))
    c, n, d = F.col, F.col("session_count"), F.col("active_days")
    first = F.try_element_at("types", F.lit(1))
    base = F.when((n >= 80) & (d >= 21), "high-confidence").when((n >= 30) & (d >= 7), "stable").when((n >= 8) & (d >= 2), "preview").otherwise("collecting")
    gate = lambda raw, distinct: (first["raw_score"] >= raw) & (first["distinctiveness"] >= distinct)
    short = days < CANONICAL_DAYS
    row = f.join(F.broadcast(types)).withColumns({"base": base})
    row = row.withColumns({"gated": F.coalesce((c("base") != "collecting") & gate(42.0, 4.0), F.lit(False))})
    row = row.withColumns({"fallback": F.coalesce(~c("gated") & (n >= 3) & gate(35.0, 3.0), F.lit(False))})
    row = row.withColumns({
        "found": c("gated") | c("fallback"),
        "temporary": c("fallback") | (F.lit(short) & c("gated")),
        "status": F.when(c("fallback") | (F.lit(short) & c("gated") & c("base").isin("stable", "high-confidence")), "preview").otherwise(c("base")),
    })
    top = F.when(c("found"), first)
    others = F.filter("types", lambda t: (t["rank"] > 1) & (t["guild"] != first["guild"]) & (t["score"] >= 40.0) & (first["score"] - t["score"] <= 18.0))
    runner = F.try_element_at("types", F.lit(2))
    second = F.coalesce(F.try_element_at(others, F.lit(1)), F.when(first["score"] - runner["score"] <= 10.0, runner))
    margin = F.least(F.greatest((F.coalesce(top["score"], F.lit(0.0)) - F.coalesce(runner["score"], F.lit(0.0))) / 100.0, F.lit(0.0)), F.lit(1.0))
    coverage = (setting.structure_coverage + setting.lifecycle_coverage + setting.tool_result_coverage + setting.orchestration_coverage + setting.process_control_coverage) / 5
    stability = F.when(n < 8, F.lit(0.25)).otherwise(cap(c("weeks").cast("double"), 8.0) / 100.0)
    raw = clamp(cap(n.cast("double"), 80.0) * 0.25 + cap(d.cast("double"), 21.0) * 0.20 + coverage * 100.0 * 0.20 + cap(c("margin"), 0.12) * 0.20 + stability * 100.0 * 0.15)
    limit = F.when(c("margin") < 0.02, 65.0).when(c("margin") < 0.04, 72.0).when(c("margin") < 0.08, 80.0).when(c("margin") < 0.12, 86.0).otherwise(92.0)
    row = row.withColumns({"margin": margin, "primary": top["code"], "guild": top["guild"], "secondary": F.when(c("found"), second["code"])})
    row = row.withColumns({"confidence": F.least(raw, limit, F.when(c("temporary"), 55.0).otherwise(100.0))})
    label = F.when(c("confidence") >= 80, "high").when(c("confidence") >= 60, "clear").when(c("confidence") >= 40, "preview").otherwise("collecting")
    missing = [k for k, gone in (("prompt-structure", not setting.structure), ("git-evidence", not setting.git), ("task-lifecycle", setting.lifecycle_coverage < 0.5), ("tool-results", setting.tool_result_coverage < 0.5), ("agent-orchestration", setting.orchestration_coverage < 0.5)) if gone]
    return row.select(
        "status", "temporary", "session_count", "active_days", F.col("primary").alias("primary_type"), F.col("secondary").alias("secondary_type"), "guild", "confidence", label.alias("confidence_label"),
        F.col("margin").alias("type_margin"), F.array(*[F.lit(m) for m in missing]).cast("array<string>").alias("missing_capabilities"),
    )


def trend(records: DataFrame, setting: Setting, now: str) -> DataFrame:
    """(period_start, dominant_type, scores of that window) for the trailing windows with two or more sessions."""
    from tracelode.operators.sessions import trend_windows

    end = F.lit(now).cast("timestamp")
    windowed = trend_windows(records.withColumn("__at", instant(F.col("started_at"))), "__at", now)
    own_end = F.col("period_start").cast("timestamp") + F.make_interval(days=F.lit(13), hours=F.hour(end), mins=F.minute(end), secs=F.second(end))
    f = features(sums(windowed.withColumn("__end", own_end), F.col("__end"), 14, ["period_start"]).where("session_count >= 2"), setting)
    return type_scores(f, setting, ["period_start"]).where("rank = 1").select("period_start", F.col("code").alias("dominant_type"), "score")


def identity_evidence(records: DataFrame, tz: str = "UTC") -> DataFrame:
    """Sessions a part of the day and, once, active days and sessions a day."""
    at = local(instant(F.col("started_at")), tz)
    rows = records.select(work_period(F.hour(at)).alias("period"), F.date_format(at, "yyyy-MM-dd").alias("day")).where(F.col("day").isNotNull())
    return rows.groupBy("period").agg(F.count("*").alias("sessions"), F.count_distinct("day").alias("days"))


#: Up to four features that explain a type.
EVIDENCE = {code: [n.removeprefix("i:") for n in parts][:4] for code, _, parts, _ in TYPES}


def evidence(f: DataFrame, primary: DataFrame) -> DataFrame:
    """(id, value) of the features behind the primary type."""
    table = F.create_map(*[x for code, names in EVIDENCE.items() for x in (F.lit(code), F.array(*[F.struct(F.lit(n).alias("id"), F.col(n).alias("value")) for n in names]))])
    return f.join(F.broadcast(primary.select("primary_type"))).select(F.explode(F.try_element_at(table, F.col("primary_type"))).alias("e")).select("e.*")
