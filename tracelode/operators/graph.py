"""Connected components on shuffles, with lineage cut by written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share (spark.checkpoint.dir); a temporary one only where they are one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, which later jobs read instead of computing it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of every component of edges (a, b); nodes without an edge to another have no row.

    Each round moves the larger neighbours of a node to its least one, then the smaller ones. Both are groupings by node with
    partial minima, so that a node of many edges is no task of its own.
    """
    links = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    sign = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")))
    before = links.agg(sign).first()
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = moved.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        links = kept(moved.join(lowest, "u").select(F.inline(pairs).alias("u", "v")).where("u <> v").distinct(), "links")
        after = links.agg(sign).first()
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
