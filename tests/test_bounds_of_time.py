from tests.against_sql import both

NOW = "TIMESTAMP '2024-01-30 23:58:00'"


def events(kind, ages):
    rows = ", ".join(f"({i}, {NOW} - to_microseconds({round(age * 1e6)}), {i}, '{kind}', 1.0, '')" for i, age in enumerate(ages))
    return {"events": f"SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)"}


def test_runtime_states_at_the_bounds(spark, tmp_path):
    got, want = both(spark, tmp_path, "runtime_states", events("error", (-3600, -2000, -1, 0, 1, 323_999, 324_000, 324_001, 324_003, 324_004)))
    assert got == want and len(want) == 4
    (tmp_path / "s").mkdir()
    got, want = both(spark, tmp_path / "s", "runtime_states", events("signup", (-1, 2_159_999, 2_160_000, 2_160_001, 2_160_003)))
    assert got == want and len(want) == 2
