import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import profile

EXTRA = "verification_events test_events build_events lint_events typecheck_events read_events search_events subagent_count subagent_starts longest_uninterrupted_seconds active_seconds".split()


def records(spark, rows):
    base = {**{k: 0 for k in (*profile.SUMMED, *EXTRA)}, "has_commit": False, "time_to_first_tool_ms": None, "agent": "codex", "model": "m"}
    schema = "started_at string, agent string, model string, has_commit boolean, time_to_first_tool_ms long, " + ", ".join(f"{k} long" for k in (*profile.SUMMED, *EXTRA))
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], schema)


def daily(n, **more):
    return [{"started_at": f"2026-{6 + i // 30:02d}-{i % 30 + 1:02d}T10:00:00Z", "files_touched": 2, "lines_changed": 40, "tool_calls": 12, "edit_events": 3, "read_events": 4, "verification_events": 1, "test_events": 2, "prompt_count": 2, "prompt_characters": 300, "structured_prompts": 1, "total_tokens": 1000, "cache_read_tokens": 500, "task_completions": 1, "successful_tools": 10, "failed_tools": 1, "time_to_first_tool_ms": 4000, **more} for i in range(n)]


NOW = "2026-07-06 12:00:00"


def test_thirty_five_daily_records_are_stable(spark):
    setting = profile.Setting(available_agents=2)
    row = profile.profile(records(spark, daily(35)), setting, NOW).first()
    assert (row.status, row.session_count, row.active_days) == ("stable", 35, 35)
    assert row.primary_type == "BUDDY" and row.guild == "tools" and 0 < row.confidence <= 92
    f = profile.features(profile.sums(records(spark, daily(35)), F.lit(NOW).cast("timestamp"), 90), setting)
    assert profile.public_scores(f, setting).count() == 6 and profile.dimensions(f, setting).count() == 18


def test_gates(spark):
    few = profile.profile(records(spark, daily(2)), profile.Setting(), NOW).first()
    assert (few.status, few.primary_type) == ("collecting", None)
    three = profile.profile(records(spark, daily(3)), profile.Setting(), NOW).first()
    assert three.temporary and three.status == "preview" and three.confidence <= 55
    short = profile.profile(records(spark, daily(35)), profile.Setting(), NOW, days=30).first()
    assert short.temporary and short.status == "preview"
    bare = profile.profile(records(spark, daily(10)), profile.Setting(structure=False, git=False, lifecycle_coverage=0.2), NOW).first()
    assert list(bare.missing_capabilities) == ["prompt-structure", "git-evidence", "task-lifecycle"]


def test_weights_and_signals(spark):
    rows = [{"started_at": "2026-07-06T12:00:00Z", "files_touched": 1}, {"started_at": "2026-05-22T12:00:00Z"}, {"started_at": "odd"}]
    s = profile.sums(records(spark, rows), F.lit(NOW).cast("timestamp"), 90).first()
    assert s.ws == pytest.approx(1 + 0.5 + 0.25) and s.ms == pytest.approx(1) and s.active_days == 2
    f = profile.features(profile.sums(records(spark, [{"started_at": "2026-07-06T12:00:00Z"}]), F.lit(NOW).cast("timestamp"), 90), profile.Setting()).first()
    assert not f.modification_signal and f.diff_review == 50 and f.requirement_clarity == 50 and f.completion == 50


def test_scores_over_guild_means(spark):
    setting = profile.Setting(available_agents=3)
    f = profile.features(profile.sums(records(spark, daily(20, rollbacks=1, has_commit=True)), F.lit(NOW).cast("timestamp"), 90), setting)
    rows = profile.type_scores(f, setting).collect()
    assert len(rows) == 24 and [r["rank"] for r in sorted(rows, key=lambda r: (-r.score, r.code))] == list(range(1, 25))
    for guild in {r.guild for r in rows}:
        own = [r for r in rows if r.guild == guild]
        mean = np.mean([r.raw_score for r in own])
        for r in own:
            assert r.score == pytest.approx(min(max(50 + 1.35 * (r.raw_score - mean) + 0.2 * (r.raw_score - 50), 0), 100))


def test_trend_has_a_hole_between_windows(spark):
    rows = [{"started_at": t, "files_touched": 1} for t in ("2026-07-06T11:00:00Z", "2026-06-24T12:00:00Z", "2026-06-23T11:00:00Z", "2026-06-22T12:00:00Z", "2026-06-21T12:00:00Z")]
    got = {r.period_start for r in profile.trend(records(spark, rows), profile.Setting(), NOW).collect()}
    assert got == {"2026-06-23", "2026-06-09"}


def test_badges_order(spark):
    rows = daily(45, human_interventions=4, longest_uninterrupted_seconds=6000, has_commit=True, git_review_events=2, rollbacks=1)
    f = profile.features(profile.sums(records(spark, rows), F.lit(NOW).cast("timestamp"), 90), profile.Setting())
    got = [r.code for r in profile.badges(f, profile.Setting()).orderBy("position").collect()]
    assert {"GUARD", "MARATHON", "SOLO", "STEADY", "TURBO", "LIVE", "FINISH"} <= set(got) and math.isfinite(len(got))
    assert {r.id for r in profile.evidence(f, profile.profile(records(spark, rows), profile.Setting(), NOW)).collect()}
