"""Filter interaction audit: what each of several filters removes at each step of every order of applying them.

A document is known by the set of filters that it fails, so the table reduces to one count a set and part before anything
else happens. Orders are paths through the lattice of filter subsets, from none applied to all. Counting the paths that
reach each subset forward and those that leave it backward weighs every edge (a subset and the filter applied next) by the
orders that pass it; an edge's removals times its weight, summed by filter, is the Shapley figure, and every step of an
order is one edge.

Nulls: a null text is empty, a null part the empty string; a row with a null doc_id repeats no other, none repeats it,
and it has no labels.
Empty tables give no rows. Rows repeated with the same doc_id are documents of their own and no copies of one another. Of
labels with one doc_id, any that says 1 counts. Only the named columns are read, so others may have any name. Copies of a
text, however many, meet as rows of a hash; groups of one document are never joined.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import written

WORD_BREAKS = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"
#: Orders are listed for so many filters at most (5,040 orders); edges and Shapley figures have no such need.
MOST_LISTED = 7


def text_failures(text: Column, words: Column) -> list[Column]:
    """Failure conditions of the filters that look at one text alone, in order."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, fails) of every document; bit i of fails is set where filter i fails it, the last being repeated text."""
    col = lambda c: F.col(f"`{c}`")
    plain = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(col(text), F.lit("")).alias("text"))
    split = plain.withColumn("words", F.filter(F.split("text", WORD_BREAKS), lambda w: w != ""))
    flags = text_failures(F.col("text"), F.col("words"))
    fails = sum((f.cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    rows = written(split.select("doc_id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("same")), "filter-audit")
    repeated = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    again = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).cast("int") * (1 << len(flags))
    return rows.join(repeated, "same", "left").select("doc_id", "part", (F.col("fails") + again).alias("fails"))


def state_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, states): of each part the counts of every set of failures that occurs, at most 2^filters of them."""
    marks = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("long")).alias(c) for c in ("quality", "toxic")])
    marked = failed.join(marks, "doc_id", "left")
    counts = marked.groupBy("part", "fails").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    return counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("states"))


def lattice_edges(k: int) -> list[tuple[int, int, int]]:
    """(subset applied before, bit of the next filter, orders that pass there) of every edge of the lattice of k filters."""
    full = (1 << k) - 1
    reach, leave = [1] + [0] * full, [0] * full + [1]
    for s in range(1, full + 1):
        reach[s] = sum(reach[s & ~(1 << i)] for i in range(k) if s >> i & 1)
    for s in range(full - 1, -1, -1):
        leave[s] = sum(leave[s | 1 << i] for i in range(k) if not s >> i & 1)
    return [(s, 1 << i, reach[s] * leave[s | 1 << i]) for s in range(full + 1) for i in range(k) if not s >> i & 1]


def edge_report(states: DataFrame, k: int = len(LETTERS)) -> DataFrame:
    """One row a part and edge: (part, before, filter, orders) and the counts at that edge, with the filter's Shapley figure."""
    edges = json.dumps([dict(zip(("before", "filter", "orders"), e)) for e in lattice_edges(k)])
    at = states.select("part", "states", F.inline(F.from_json(F.lit(edges), "array<struct<before: int, filter: int, orders: long>>")))
    total = lambda when, c="n": F.aggregate(F.filter("states", when), F.lit(0).cast("long"), lambda a, s: a + s[c])
    before, own = F.col("before"), F.col("filter")
    here = lambda s: (s["fails"].bitwiseAND(before) == 0) & (s["fails"].bitwiseAND(own) != 0)
    counted = at.select(
        "part", "before", "filter", "orders",
        total(lambda s: s["fails"].bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda s: (s["fails"].bitwiseAND(before) != 0) & (s["fails"].bitwiseAND(own) != 0)).alias("redundant"),
        total(lambda s: s["fails"] == own).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    shares = counted.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    return counted.join(shares, ["part", "filter"])


def order_report(edges: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row a part, order and step, each read from the edge that the step is."""
    k = len(letters)
    if k > MOST_LISTED:
        raise ValueError(f"orders of {k} filters are too many to list")
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(letters[j] for j in order), step, before, 1 << i))
            before |= 1 << i
    listed = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    return edges.join(F.broadcast(listed), ["before", "filter"])  # constants of the code


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = failures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    report = order_report(edge_report(state_counts(failed, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
    return report.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT x1.l || x2.l || x3.l || x4.l || x5.l AS filter_order, unnest([
    {'step': 1, 's': 0, 'b': x1.b}, {'step': 2, 's': x1.b, 'b': x2.b}, {'step': 3, 's': x1.b + x2.b, 'b': x3.b},
    {'step': 4, 's': x1.b + x2.b + x3.b, 'b': x4.b}, {'step': 5, 's': x1.b + x2.b + x3.b + x4.b, 'b': x5.b}]) AS e
  FROM x x1, x x2, x x3, x x4, x x5 WHERE x1.b + x2.b + x3.b + x4.b + x5.b = 31 AND x1.b | x2.b | x3.b | x4.b | x5.b = 31
), r AS (
  SELECT part, filter_order, e.step AS step, e.b AS b,
    sum(CASE WHEN mask & (e.s | e.b) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & e.s = 0 AND mask & e.b <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & e.s <> 0 AND mask & e.b <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = e.b THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & e.s = 0 AND mask & e.b <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & e.s = 0 AND mask & e.b <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, o GROUP BY part, filter_order, e.step, e.b
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM r
"""
