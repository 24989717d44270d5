"""What the training-data operators share: the shared folder, written tables, row-wise Arrow maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of A-Z to a-z, everything else as it is.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where they are one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder, so that later reads neither recompute it nor need its executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what a task derives from long texts at a time stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def add_columns(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """df plus columns of schema ddl: what make()(*inputs) returns for each row.

    make is called once a task, on the executor, so that tables it builds are built there once.
    Rows pass in Arrow batches; the columns of df pass through untouched.
    """
    new = T._parse_datatype_string(ddl)
    clash = {f.name for f in new.fields}
    df = df.select(*[f"`{c}`" for c in df.columns if c not in clash])
    where = [df.columns.index(c) for c in inputs]
    names = [*df.columns, *[f.name for f in new.fields]]
    # mapInArrow looks columns up by name, which fails for names with dots.
    df = numbered(df)
    passed = [*df.columns, *[f"new_{i}" for i in range(len(new.fields))]]
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        f = make()
        for b in slices(batches):
            rows = [f(*v) for v in zip(*[b.column(i).to_pylist() for i in where])]
            out = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(list(v), type=k) for v, k in zip(out, kinds)]], names=passed)

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(passed[len(df.columns) :], new.fields)]])
    return df.mapInArrow(run, schema).toDF(*names)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named d_0, d_1, ..., so that what an operator adds clashes with none of them."""
    return df.toDF(*[f"d_{i}" for i in range(len(df.columns))])


def renamed(df: DataFrame, names: list[str], instead: dict[str, str] | None = None) -> DataFrame:
    """The columns d_0, d_1, ... of df under their names again; `instead` names the column to take for one of them."""
    instead = instead or {}
    return df.select(*[F.col(instead.get(c, f"d_{i}")).alias(c) for i, c in enumerate(names)])


def broadcast_value(spark: SparkSession, value, limit_bytes: int, size_bytes: int, what: str):
    """Broadcasts value only after its size was checked against limit_bytes."""
    if size_bytes > limit_bytes:
        raise ValueError(f"{what}: {size_bytes} bytes exceed the broadcast bound of {limit_bytes}")
    return spark.sparkContext.broadcast(value)
