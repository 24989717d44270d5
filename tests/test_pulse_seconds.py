from tests.against_sql import both
from tests.test_bounds_of_time import events


def test_freshness_by_the_seconds_of_the_clock(spark, tmp_path):
    got, want = both(spark, tmp_path, "work_pulse", events("view", (-5.5, 0.5, 29.5, 30, 30.5, 31, 119.5, 120, 120.5, 121)))
    assert got == want and {r[4] for r in want} == {"fresh", "aging", "lost-update"}
