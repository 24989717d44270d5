from pyspark.sql import functions as F

from tracelode.operators import live


def test_recent_rows_are_told_to_the_microsecond(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-30 00:00:00.5'), (2, TIMESTAMP '2024-01-30'), (3, TIMESTAMP '2024-01-29'), (4, TIMESTAMP '2024-01-28 23:59:59.5') t(event_id, ts)")
    assert [r.event_id for r in live.newest(rows, "ts", F.lit("2024-01-30").cast("timestamp"), 86_400, 64, "event_id").collect()] == [2, 3]
