"""Joins that are more than an equality: latest with ties, as-of, interval, anti with order, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_with_ties(df: DataFrame, key: list[str], by: str) -> DataFrame:
    """All rows of each key that share its greatest `by`; decorrelated to a rank."""
    return df.withColumn("__r", F.rank().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(by)))).where("__r = 1").drop("__r")


def as_of(events: DataFrame, parents: DataFrame, key: list[str], ts: str, tolerance_seconds: int, value: list[str]) -> DataFrame:
    """events plus the values of the latest parent of the same key at or before, within the tolerance.

    Both sides meet in one sorted window, so that no pairs are formed: linear in rows whatever the key's size.
    Of parents at one time the greatest values win.
    """
    columns = events.columns
    kept = F.struct(*[F.col(v) for v in value])
    a = parents.select(*key, F.col(ts), F.lit(0).alias("__side"), F.struct(F.col(ts).alias("at"), kept.alias("v")).alias("__p"), F.lit(None).cast(events.schema).alias("__e"))
    b = events.select(*key, F.col(ts), F.lit(1).alias("__side"), F.lit(None).cast(a.schema["__p"].dataType).alias("__p"), F.struct(*columns).alias("__e"))
    w = Window.partitionBy(*key).orderBy(ts, "__side", "__p").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("__p", F.last("__p", ignorenulls=True).over(w)).where("__side = 1")
    near = F.unix_micros(F.col(f"__e.{ts}")) - F.unix_micros("__p.at") <= tolerance_seconds * 1_000_000
    return met.select("__e.*", *[F.when(near, F.col(f"__p.v.{v}")).alias(f"parent_{v}") for v in value])


def within_interval(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, bucket_seconds: int = 86_400) -> DataFrame:
    """points joined to the spans of their key that hold them, by equal time buckets: an equi-join, not a range scan."""
    b = lambda c: F.floor(F.unix_seconds(c) / bucket_seconds)
    cut = spans.withColumn("__b", F.explode(F.sequence(b(F.col(start)), b(F.col(end)))))
    return points.withColumn("__b", b(F.col(at))).join(cut, [*key, "__b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__b")


def not_superseded(items: DataFrame, sessions: DataFrame, key: list[str], item_at: str, session_at: str, superseding: Column) -> DataFrame:
    """items without a later session row of the same key for which `superseding` holds: the latest one a key decides."""
    newest = sessions.where(superseding).groupBy(*key).agg(F.max(session_at).alias("__newest"))
    return items.join(newest, key, "left").where(F.col("__newest").isNull() | (F.col("__newest") <= F.col(item_at))).drop("__newest")


def overlay_exists(rows: DataFrame, open_rows: DataFrame, key: list[str], flag: str) -> DataFrame:
    """rows with a flag that says whether open_rows has their key."""
    keys = open_rows.select(*key).distinct().withColumn(flag, F.lit(True))
    return rows.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def merged(left: DataFrame, right: DataFrame, key: list[str], right_wins: bool = False) -> DataFrame:
    """Full outer join; the first non-null of each shared column, from the side that wins."""
    shared = [c for c in left.columns if c in right.columns and c not in key]
    a, b = left.alias("a"), right.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    first, second = ("b", "a") if right_wins else ("a", "b")
    out = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key]
    out += [F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c) for c in shared]
    out += [F.col(f"a.{c}") for c in left.columns if c not in shared and c not in key]
    out += [F.col(f"b.{c}") for c in right.columns if c not in shared and c not in key]
    return a.join(b, on, "full").select(*out)


def newest_known(rows: DataFrame, key: list[str], known: Column, at: str) -> DataFrame:
    """One row a key: known labels before unknown ones, then the newest. The rule is associative, unlike a fold in arrival order."""
    best = F.max(F.struct(F.coalesce(known, F.lit(False)).alias("k"), F.col(at).alias("t"), F.struct(*[c for c in rows.columns if c not in key]).alias("r")))
    return rows.groupBy(*key).agg(best.alias("b")).select(*key, "b.r.*")


def new_rows(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key was not seen, once each."""
    return rows.dropDuplicates(key).join(seen.select(*key).distinct(), key, "left_anti")


def titled(rows: DataFrame, index_titles: DataFrame, thread_titles: DataFrame, key: str, label: str = "project_label") -> DataFrame:
    """rows with conversation_title from the index, else from the threads; none that only repeats the project's label."""
    named = thread_titles.select(key, F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("title"), F.lit(""))).alias("__t2")).dropDuplicates([key])
    both = rows.join(index_titles.select(key, F.nullif(F.trim("title"), F.lit("")).alias("__t1")).dropDuplicates([key]), key, "left").join(named, key, "left")
    best = F.coalesce("__t1", "__t2")
    return both.withColumn("conversation_title", F.when(F.lower(best) != F.lower(F.coalesce(label, F.lit(""))), best)).drop("__t1", "__t2")


def page_overlap(before: list, after: list) -> int:
    """How many leading items of a page repeat the end of the one before."""
    for n in range(min(len(before), len(after)), 0, -1):
        if before[-n:] == after[:n]:
            return n
    return 0
