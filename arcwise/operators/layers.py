"""Message-passing layers as joins and aggregations over scalar or column features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, bidirected_with_loops, drop_loops, flip


def sage_mean(graph: Graph, columns: list[str], self_weight: float = 0.5) -> DataFrame:
    """(id, columns): self and mean in-neighbour features mixed, then ReLU."""
    x = graph.nodes.select("id", *[F.col(c).cast("double").alias(c) for c in columns])
    e = graph.edges.select("src", "dst").distinct()
    m = e.join(x, e.src == x.id).groupBy(F.col("dst").alias("id")).agg(*[F.avg(c).alias(f"{c}_m") for c in columns])
    h = x.join(m, "id", "left")
    return h.select("id", *[F.greatest(F.lit(0.0), self_weight * F.col(c) + (1 - self_weight) * F.coalesce(f"{c}_m", F.lit(0.0))).alias(c) for c in columns])


def gcn(graph: Graph, columns: list[str]) -> DataFrame:
    """(id, columns): D^-1/2 (A + I) D^-1/2 X on the bidirected graph with loops."""
    e = bidirected_with_loops(graph).select("src", "dst")
    d = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    x = graph.nodes.select("id", *[F.col(c).cast("double").alias(c) for c in columns])
    j = e.join(d.select("src", F.col("d").alias("ds")), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst").join(x, F.col("src") == x.id)
    return j.groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col(c) / F.sqrt(F.col("ds") * F.col("dd"))).alias(c) for c in columns])


def gat(graph: Graph, column: str, a_src: float = 0.3, a_dst: float = 0.2, slope: float = 0.2) -> DataFrame:
    """(id, h): one attention head on a scalar feature: softmax over in-edges of a leaky-ReLU score."""
    x = graph.nodes.select("id", F.col(column).cast("double").alias("x"))
    e = drop_loops(graph.edges).select("src", "dst").distinct()
    j = e.join(x.select(F.col("id").alias("src"), F.col("x").alias("xs")), "src").join(x.select(F.col("id").alias("dst"), F.col("x").alias("xd")), "dst")
    raw = a_src * F.col("xs") + a_dst * F.col("xd")
    j = j.withColumn("s", F.when(raw > 0, raw).otherwise(slope * raw))
    top = j.groupBy("dst").agg(F.max("s").alias("top"))
    w = F.exp(F.col("s") - F.col("top"))
    return j.join(top, "dst").groupBy(F.col("dst").alias("id")).agg((F.sum(w * F.col("xs")) / F.sum(w)).alias("h"))


def direction_mix(graph: Graph, columns: list[str], alpha: float = 0.5) -> DataFrame:
    """(id, columns): alpha times mean over in-edges plus the rest over out-edges."""
    x = graph.nodes.select("id", *[F.col(c).cast("double").alias(c) for c in columns])
    e = graph.edges.select("src", "dst").distinct()

    def mean(edges: DataFrame, tag: str) -> DataFrame:
        return edges.join(x, edges.src == x.id).groupBy(F.col("dst").alias("id")).agg(*[F.avg(c).alias(f"{c}_{tag}") for c in columns])

    h = x.select("id").join(mean(e, "f"), "id", "left").join(mean(flip(e), "b"), "id", "left").na.fill(0.0)
    return h.select("id", *[(alpha * F.col(f"{c}_f") + (1 - alpha) * F.col(f"{c}_b")).alias(c) for c in columns])
