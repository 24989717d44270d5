"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of `size` consecutive words (one shorter window if it has fewer). For exact
containment the necessary prefix of a window is its single rarest word (rarity: in how many windows of the
benchmark the word occurs, ties by longer, then greater word), so a document is probed only at words that are
some window's prefix. A probe at word i with prefix offset o passes the positional and length bounds
0 <= i-o and i-o+length <= words, and is then verified word by word.

The benchmark is read in blocks whose windows stay under `block_bytes`; one block is broadcast at a time against
all documents, so that no bound on the benchmark is assumed and no window is dropped. Documents never shuffle
while there is one block; with more, hits meet again by document.

Defined cases: null texts have no words; a document without words or an item without words is never hit; equal
windows of several items count for each of them; repeated documents are answered alike; empty tables give no
rows or no hits; other columns pass through, but those with the names of the results are replaced.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import add_columns, numbered, renamed, written

#: Word characters are 0-9, A-Z, a-z and all beyond ASCII; in UTF-8 that is a class of bytes.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_BYTES = 32 << 20
RESULT = "n_words long, hit array<int>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS).split() if text else []


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(window binary, items array<string>): distinct windows with the items that have them."""

    def run(batches):
        for b in batches:
            out: list[tuple[bytes, str]] = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text)
                out += {(b" ".join(w[i : i + size]), item) for i in range(max(1, len(w) - size + 1))} if w else set()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["window", "item"])

    flat = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "window binary, item string")
    return flat.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def probe_table(windows: list[tuple[bytes, list[str]]]) -> dict:
    """prefix word -> [(offset, length, {window's words: items})]"""
    seen: dict[bytes, int] = defaultdict(int)
    split = [(tuple(w.split(b" ")), items) for w, items in windows]
    for w, _ in split:
        for x in set(w):
            seen[x] += 1
    table: dict = defaultdict(lambda: defaultdict(dict))
    for w, items in split:
        o = min(range(len(w)), key=lambda i: (seen[w[i]], -len(w[i]), w[i], i))
        table[w[o]][o, len(w)][w] = items
    return {k: [(o, n, d) for (o, n), d in v.items()] for k, v in table.items()}


def find_windows(documents: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents plus n_words, hit (sorted positions of words inside any occurrence) and items (sorted ids)."""
    spark = documents.sparkSession
    windows = item_windows(benchmark, size).withColumn("bytes", F.length("window") + F.size("items") * 24 + 400)
    total = windows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total * 2 // block_bytes)) if total > block_bytes else 1
    parts = []
    for k in range(n_blocks):
        block = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == k).select("window", "items").collect()
        table = spark.sparkContext.broadcast(probe_table(sorted((bytes(r[0]), r[1]) for r in block)))

        def make(table=table):
            probe = table.value
            known = probe.keys()

            def find(t):
                w = words(t)
                n = len(w)
                hit: set[int] = set()
                items: set[str] = set()
                if not known.isdisjoint(w):
                    for i, x in enumerate(w):
                        if x in probe:
                            for o, size, found in probe[x]:
                                at = i - o
                                if at >= 0 and at + size <= n and (got := found.get(tuple(w[at : at + size]))):
                                    hit.update(range(at, at + size))
                                    items.update(got)
                return n, sorted(hit), sorted(items)

            return find

        parts.append(make)
    if len(parts) == 1:
        return add_columns(documents, [text], parts[0], RESULT)
    row = "row"
    while row in documents.columns:
        row += "_"
    own = [F.col(f"`{c}`") for c in documents.columns if c not in ("n_words", "hit", "items")]
    # Written with their numbers, which are then the same in every block's reading.
    keyed = written(documents.select(*own, F.monotonically_increasing_id().alias(row)), "decontam-rows")
    rows = None
    for make in parts:
        part = add_columns(keyed.select(row, text), [text], make, RESULT).select(row, "n_words", "hit", "items")
        rows = part if rows is None else rows.unionByName(part)
    merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = rows.groupBy(row).agg(F.max("n_words").alias("n_words"), merge("hit"), merge("items"))
    return keyed.join(merged, row).drop(row)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, size: int = 10) -> DataFrame:
    """docs of which at most max_share of the words are inside benchmark windows, with their own columns."""
    found = find_windows(numbered(docs), benchmark, size, text=f"d_{docs.columns.index('text')}")
    kept = found.where(F.size("hit") <= F.lit(max_share) * F.col("n_words"))
    return renamed(kept, docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT dw.r, dw.n, dw.i, win.item_id FROM dw JOIN win ON win.s = dw.s AND win.n = dw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN it ON it.r = d.r
"""
