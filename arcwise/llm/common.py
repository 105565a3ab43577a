"""Shared pieces: tables kept in the shared folder, byte columns, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch handed to Python; long texts make batches heavy.
BATCH_ROWS = 1000


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) that hold inside the block and are put back after it."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spent_shuffles_go(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Writes in the block delete their shuffle files when they end, as nothing reads them again."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a temporary folder of this machine is set, which only a
    local master shares with its executors; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="arcwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") + "/arcwise"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of df.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with spent_shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Delete tables that keep() wrote and nothing will read again."""
    for df in kept:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches so that long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives empty bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def merge_links(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a bigint, b bigint): rows (node, component).

    Alternating large-star and small-star steps: every node links to the
    smallest neighbour, so chains shrink in a logarithmic number of rounds
    and no step gathers a component into one task. Each round is written to
    the shared folder. The component is the smallest node reached, which has no row of its own. Nodes
    without edges are absent; loops and nulls are ignored.
    """
    spark = edges.sparkSession
    now = keep(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    last = None
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours of u move to the smallest of u's closed neighbourhood.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        now = keep(small.distinct(), "edges")
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == last:
            break
        last = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


LONG, INT, STR, BIN, DBL, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType(), T.BooleanType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
