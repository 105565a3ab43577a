"""Graphs derived from the star-schema tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, drop_loops, sum_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chain(rows: DataFrame, group: str, key: str, order: list[str], weight) -> DataFrame:
    """Edges from each row's key to the next one's in its group, not summed."""
    w = Window.partitionBy(group).orderBy(*order)
    return drop_loops(rows.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst"), weight.cast("double").alias("w")))


ORDER = ["l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey"]


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Next part within an order, weighted by quantity; nodes carry size, price and brand."""
    edges = _chain(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", ORDER, F.col("l_quantity"))
    return Graph(sum_repeats(edges), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice", F.col("p_brand").alias("label")), links=edges.select("src", "dst"))


def supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Next supplier within an order."""
    edges = _chain(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", ORDER, F.col("l_quantity"))
    return Graph(sum_repeats(edges), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("label")))


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Next user by time within an event type."""
    events = table(spark, sf_dir, "events")
    edges = _chain(events, "event_type", "user_id", ["ts", "event_id"], F.lit(1.0))
    return Graph(sum_repeats(edges), events.select(F.col("user_id").alias("id")).distinct())


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Supplier nation to customer nation, weighted by price; sums are in cents, so they are exact."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    edges = joined.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("label"))
    return Graph(edges.agg((cents / 100.0).alias("w")), nodes)


def customer_supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers to the suppliers of their orders; supplier ids are moved by a million."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    edges = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst")).agg(F.sum("l_quantity").alias("w"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id")))
    return Graph(edges, nodes)
