from tests.against_sql import both


def test_features_of_weights_at_the_least_signal(spark, tmp_path):
    # The weight of a day's record lies below, between and above 2.2e-16 and 2.3e-16.
    days = ["1995-03-05", "1995-03-08", "1995-03-09", "1995-03-12", "2001-01-01"]
    rows = ", ".join(f"({i * 24 + 1}, {i}, TIMESTAMP '{d}')" for i, d in enumerate(days))
    got, want = both(spark, tmp_path, "profile_features", {"orders": f"SELECT k::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, d AS o_orderdate, '1-URGENT' AS o_orderpriority FROM (VALUES {rows}) t(k, c, d)"})
    assert got == want
