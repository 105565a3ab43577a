"""The graph value and edge-table rewrites.

Edges are (src, dst, w), nodes (id, ...). The node table holds every end of an
edge; isolated nodes exist only there. Every function maps DataFrames to DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """links, if known: (src, dst) of the edges before repeats were summed, for operators that ask only which nodes are linked."""

    edges: DataFrame
    nodes: DataFrame
    directed: bool = True
    links: DataFrame | None = None

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges, links=None)


def flip(edges: DataFrame) -> DataFrame:
    """Edges reversed; other columns stay."""
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst").select(edges.columns)


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def sum_repeats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def unweighted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.lit(1.0))


def canonical_mean(edges: DataFrame) -> DataFrame:
    """Endpoints in order, weights of repeats averaged."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.avg("w").alias("w"))


def symmetrize(edges: DataFrame, how: str = "sum") -> DataFrame:
    """Both directions of every edge; repeats are summed, averaged or their largest taken."""
    how_ = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    return edges.select("src", "dst", "w").unionAll(flip(edges.select("src", "dst", "w"))).groupBy("src", "dst").agg(how_("w").alias("w"))


def bidirected_with_loops(graph: Graph) -> DataFrame:
    """Distinct edges in both directions and a loop at every node."""
    pairs = drop_loops(graph.edges).select("src", "dst")
    both = pairs.unionAll(flip(pairs)).distinct()
    return both.unionAll(graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))).withColumn("w", F.lit(1.0))


def split_signed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Negative and non-negative edges."""
    return edges.where("w < 0"), edges.where("w >= 0")


def canonical_flow(edges: DataFrame) -> DataFrame:
    """Signed flow (src, dst, flow, cnt, w): reversed edges negate it; flows and counts sum, weights average."""
    turn = F.col("src") > F.col("dst")
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.sum(F.when(turn, -F.col("flow")).otherwise(F.col("flow"))).alias("flow"), F.sum("cnt").alias("cnt"), F.avg("w").alias("w")
    )


def is_weighted(edges: DataFrame) -> bool:
    return bool(edges.agg(F.coalesce(F.max(F.abs(F.col("w") - 1)) > 1e-5, F.lit(False))).first()[0])


def is_canonical(edges: DataFrame) -> bool:
    """All src <= dst and no pair twice."""
    bad = edges.where("src > dst").limit(1).count()
    return not bad and edges.groupBy("src", "dst").count().where("count > 1").limit(1).count() == 0


def induced(graph: Graph, keep: DataFrame) -> Graph:
    """The subgraph on the nodes keep(id)."""
    keep = keep.select("id").distinct()
    e = graph.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(e.select(graph.edges.columns), graph.nodes.join(keep, "id", "left_semi"), graph.directed)


def permutation(nodes: DataFrame, seed: int = 13) -> DataFrame:
    """A seeded relabelling (id, new_id) to 0..n-1."""
    order = Window.orderBy(mix("id", "id", seed), "id")
    return nodes.select("id", (F.row_number().over(order) - 1).cast("long").alias("new_id"))


def relabel(graph: Graph, names: DataFrame) -> Graph:
    """Edges and nodes mapped through names(id, new_id)."""
    s, d = names.select(F.col("id").alias("src"), F.col("new_id").alias("_s")), names.select(F.col("id").alias("dst"), F.col("new_id").alias("_d"))
    e = graph.edges.join(s, "src").join(d, "dst").drop("src", "dst").withColumnsRenamed({"_s": "src", "_d": "dst"})
    nodes = graph.nodes.join(names, "id").drop("id").withColumnRenamed("new_id", "id")
    return Graph(e.select(graph.edges.columns), nodes.select(graph.nodes.columns), graph.directed)


def disjoint_union(a: Graph, b: Graph, offset: int) -> Graph:
    """Both graphs side by side, the second's ids moved by offset; directed if either is."""
    moved = b.edges.withColumns({"src": F.col("src") + offset, "dst": F.col("dst") + offset})
    nodes = a.nodes.select("id").unionByName(b.nodes.select((F.col("id") + offset).alias("id")))
    return Graph(a.edges.unionByName(moved), nodes, a.directed or b.directed)


def edge_union(a: Graph, b: Graph) -> Graph:
    """Edges of both over one node set."""
    return a.with_edges(a.edges.unionByName(b.edges))


def edge_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("src", "dst"), ["src", "dst"], "left_anti")


def edge_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("src", "dst"), ["src", "dst"], "left_semi")


def mix(a: str | Column, b: str | Column, seed: int, modulus: int = 1_000_003) -> Column:
    """A small arithmetic hash of two ids; SQL engines agree on it."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.pmod(a * F.lit(7919) + b * F.lit(104729) + F.lit(seed * 31337), F.lit(modulus))
