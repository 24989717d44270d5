"""Calendar spines, buckets and shares over daily and hourly points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_spine(df: DataFrame, date: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """df left-joined to every day from its first to its last (or the given bounds); missing days have null measures."""
    bounds = df.agg((first if first is not None else F.min(date)).alias("a"), (last if last is not None else F.max(date)).alias("b"))
    days = bounds.where("a <= b").select(F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias("__day"))
    days = days.select(F.date_format("__day", "yyyy-MM-dd").alias(date))
    return days.join(df, date, "left")


def filled(df: DataFrame, date: str, measures: list[str], first: Column | None = None, last: Column | None = None) -> DataFrame:
    """date_spine with zeros: a day without records had no usage, which is known and not missing."""
    return date_spine(df, date, first, last).select(date, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def hour_spine(df: DataFrame, hour: str, measure: str, step: int, hours: int, until: str) -> DataFrame:
    """`hours` hours up to the one of `until` in cells of `step` hours, counted back from its day's grid; zero filled."""
    end = F.date_trunc("hour", F.lit(until).cast("timestamp"))
    cells = df.sparkSession.range(1).select(F.explode(F.sequence(end - F.expr(f"INTERVAL {hours - 1} HOURS"), end, F.expr("INTERVAL 1 HOUR"))).alias("h"))
    cell = lambda h: F.date_trunc("day", h) + F.make_interval(hours=(F.floor(F.hour(h) / step) * step).cast("int"))
    cells = cells.select(cell(F.col("h")).alias("cell")).distinct()
    sums = df.where(F.col(hour).between(end - F.expr(f"INTERVAL {hours - 1} HOURS"), end)).groupBy(cell(F.col(hour)).alias("cell")).agg(F.sum(measure).alias(measure))
    return cells.join(sums, "cell", "left").select("cell", F.coalesce(measure, F.lit(0)).alias(measure))


def trend_bucket(date: Column, start: Column, days: int) -> Column:
    """Bucket start by the length of the range: days to 14, then 7-day chunks from its start, months and quarters."""
    if days <= 14:
        return date.cast("date")
    if days <= 180:
        return F.date_add(start.cast("date"), (F.floor(F.datediff(date.cast("date"), start.cast("date")) / 7) * 7).cast("int"))
    return F.date_trunc("month" if days <= 400 else "quarter", date.cast("date")).cast("date")


def calendar_bucket(date: Column, unit: str) -> Column:
    return F.date_trunc(unit, date.cast("date")).cast("date")


def compacted(df: DataFrame, order: str, measures: list[str], most: int) -> DataFrame:
    """At most `most` buckets of equally many neighbours; for the few points of a chart, after aggregation."""
    w = Window.orderBy(order)
    width = F.ceil(F.count("*").over(Window.partitionBy()) / F.lit(most))
    marked = df.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / width).cast("long"))
    return marked.groupBy("bucket").agg(F.min(order).alias(f"first_{order}"), F.max(order).alias(f"last_{order}"), *[F.sum(m).alias(m) for m in measures])


def heat(df: DataFrame, measure: str, partition: list[str] | None = None) -> DataFrame:
    """df with heat 0 to 4: the quarter of the largest value that a value reaches."""
    top = F.max(measure).over(Window.partitionBy(*(partition or [])))
    level = F.least(F.lit(4), F.ceil(F.col(measure) / top * 4))
    return df.withColumn("heat", F.when((top > 0) & (F.col(measure) > 0), level).otherwise(0).cast("long"))


def peak(df: DataFrame, measure: str, order: str) -> DataFrame:
    """The first of the largest positive cells, if any."""
    return df.where(F.col(measure) > 0).orderBy(F.desc(measure), order).limit(1)


def most_active_date(df: DataFrame, measure: str, date: str) -> DataFrame:
    """The day of the largest value, the last among equals."""
    return df.agg(F.max(F.struct(measure, date)).alias("m")).select(F.col(f"m.{date}").alias(date), F.col(f"m.{measure}").alias(measure)).where(F.col(date).isNotNull())


def lanes(df: DataFrame, by: str, agent: str, measure: str, first_agent: str) -> DataFrame:
    """Two lanes a bucket: one agent's, and all others' under the second name."""
    mine = F.col(agent) == first_agent
    zero = F.lit(0)
    return df.groupBy(by).agg(
        F.coalesce(F.sum(F.when(mine, F.col(measure))), zero).alias("first_lane"),
        F.coalesce(F.sum(F.when(~mine, F.col(measure))), zero).alias("second_lane"),
        F.sum(measure).alias("total"),
    )


def share(df: DataFrame, measure: str, name: str = "share") -> DataFrame:
    """df with each row's part of the total; 0 where the total is 0."""
    total = F.sum(measure).over(Window.partitionBy())
    return df.withColumn(name, F.when(total > 0, F.col(measure) / total).otherwise(F.lit(0.0)))


def day_variation(df: DataFrame, key: list[str], day: str) -> DataFrame:
    """Coefficient of variation of records a day over active days; 1.0 with at most one."""
    daily = df.groupBy(*key, day).agg(F.count("*").alias("n"))
    return daily.groupBy(*key).agg(F.count("*").alias("active_days"), F.when((F.count("*") > 1) & (F.avg("n") > 0), F.stddev_pop("n") / F.avg("n")).otherwise(F.lit(1.0)).alias("variation"))


#: Savitzky-Golay weights of a quadratic over 7 and 5 points.
SMOOTH_7 = ((-2, 3, 6, 7, 6, 3, -2), 21)
SMOOTH_5 = ((-3, 12, 17, 12, -3), 35)


def smoothed(values: Column) -> Column:
    """Savitzky-Golay smoothing of an array: 7 points if it has as many, else 5; edges mirrored, at least 0; shorter ones as they are."""

    def apply(weights: tuple[int, ...], norm: int) -> Column:
        half = len(weights) // 2
        n = F.size(values)

        def at(i: Column) -> Column:
            j = F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)
            return F.element_at(values, j + 1)

        def point(x: Column, i: Column) -> Column:
            total = F.lit(0.0)
            for k, w in enumerate(weights):
                total = total + at(i + (k - half)) * float(w)
            return F.greatest(total / float(norm), F.lit(0.0))

        return F.transform(values, point)

    return F.when(F.size(values) >= 7, apply(*SMOOTH_7)).when(F.size(values) >= 5, apply(*SMOOTH_5)).otherwise(values)


def smoothed_rows(df: DataFrame, key: list[str], order: str, measure: str) -> DataFrame:
    """smoothed over each key's points in order; a series has one point a day or hour, which bounds its array."""
    series = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(measure).cast("double").alias("v")))).alias("s"))
    both = series.withColumn("smooth", smoothed(F.transform("s", lambda x: x["v"])))
    return both.select(*key, F.explode(F.arrays_zip(F.transform("s", lambda x: x[order]).alias(order), F.col("smooth").alias("smooth"))).alias("z")).select(*key, F.col(f"z.{order}").alias(order), F.col("z.smooth").alias("smooth"))
