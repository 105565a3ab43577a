"""Small deterministic graphs, made by arithmetic on ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def _graph(spark: SparkSession, edges: DataFrame, n: int, directed: bool = True) -> Graph:
    return Graph(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.lit(1.0).alias("w")), spark.range(n), directed)


def source_star(spark: SparkSession, degree: int, branch: int, length: int) -> Graph:
    """A root with degree children; each node of the first length - 1 rings has branch children."""
    sizes = [degree * branch**i for i in range(length)]
    first = [1 + sum(sizes[:i]) for i in range(length)]
    edges = spark.range(degree).select(F.lit(0).alias("src"), (F.col("id") + 1).alias("dst"))
    for i in range(1, length):
        edges = edges.unionAll(spark.range(sizes[i]).select((F.floor(F.col("id") / branch) + first[i - 1]).alias("src"), (F.col("id") + first[i]).alias("dst")))
    return _graph(spark, edges, 1 + sum(sizes))


def diamond(spark: SparkSession, n: int) -> Graph:
    """0 -> 1..n-2 -> n-1."""
    middle = spark.range(1, n - 1)
    return _graph(spark, middle.select(F.lit(0).alias("src"), F.col("id").alias("dst")).unionAll(middle.select("id", F.lit(n - 1))), n)


def cycle(spark: SparkSession, n: int, chords: int = 0) -> Graph:
    """i -> i + 1 around, and chords evenly spaced nodes -> the opposite one."""
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    if chords:
        edges = edges.unionAll(spark.range(chords).select(F.floor(F.col("id") * n / chords).alias("src"), ((F.floor(F.col("id") * n / chords) + n // 2) % n).alias("dst")))
    return _graph(spark, edges, n)


def clique(spark: SparkSession, n: int) -> Graph:
    edges = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst")).where("src <> dst")
    return _graph(spark, edges, n)
