"""Seeded sampling, noise, splits, walks. Randomness is an arithmetic hash, so every engine and rerun agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, mix


def noise_candidates(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """n seeded ordered pairs of nodes, loops left out; ids are looked up by rank."""
    ranked = nodes.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("rank"))
    count = nodes.agg(F.count(F.lit(1)).alias("n"))
    draws = nodes.sparkSession.range(n).crossJoin(F.broadcast(count)).select(  # one row
        F.pmod(mix("id", F.lit(1), seed), F.col("n")).alias("a"), F.pmod(mix("id", F.lit(2), seed + 1) * 31 + F.col("id"), F.col("n")).alias("b")
    )
    pairs = draws.join(ranked.select(F.col("rank").alias("a"), F.col("id").alias("src")), "a").join(ranked.select(F.col("rank").alias("b"), F.col("id").alias("dst")), "b")
    return pairs.where("src <> dst").select("src", "dst").distinct()


def add_noise(graph: Graph, count: int, seed: int = 7) -> DataFrame:
    """Up to count new edges that the graph lacks, with weight one, smallest hash first."""
    new = noise_candidates(graph.nodes, 2 * count, seed).join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return new.orderBy(mix("src", "dst", seed), "src", "dst").limit(count).withColumn("w", F.lit(1.0))


def remove_edges(graph: Graph, count: int, seed: int = 7) -> DataFrame:
    """The edges without the count of smallest hash."""
    gone = graph.edges.select("src", "dst").orderBy(mix("src", "dst", seed), "src", "dst").limit(count)
    return graph.edges.join(gone, ["src", "dst"], "left_anti").select(graph.edges.columns)


def kfold(items: DataFrame, k: int, seed: int = 3, strata: str | None = None) -> DataFrame:
    """items(id[, strata]) with fold 0..k-1: hash order dealt round robin, within strata if given."""
    w = (Window.partitionBy(strata) if strata else Window.partitionBy()).orderBy(mix("id", "id", seed), "id")
    return items.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)))


def empirical_cdf(values: DataFrame, column: str) -> DataFrame:
    """(v, cdf) over the distinct values. One row for each value passes the window."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("v", (F.sum("c").over(w) / F.sum("c").over(Window.partitionBy())).alias("cdf"))


def inverse_cdf(cdf: DataFrame, draws: DataFrame) -> DataFrame:
    """draws(u) with v, linear between the distinct values of cdf(v, cdf)."""
    w = Window.orderBy("v")
    steps = cdf.select("v", "cdf", F.lag("v").over(w).alias("v0"), F.coalesce(F.lag("cdf").over(w), F.lit(0.0)).alias("c0"))
    hit = draws.join(steps, (F.col("u") > F.col("c0")) & (F.col("u") <= F.col("cdf")))
    return hit.select("u", F.when(F.col("v0").isNull(), F.col("v")).otherwise(F.col("v0") + (F.col("v") - F.col("v0")) * (F.col("u") - F.col("c0")) / (F.col("cdf") - F.col("c0"))).alias("v"))


def random_walks(graph: Graph, starts: DataFrame, length: int, seed: int = 5) -> DataFrame:
    """(walk_id, walk): uniform walks of up to length steps from starts(walk_id, id); a walk ends where no edge leaves."""
    out = graph.edges.groupBy(F.col("src").alias("_n")).agg(F.sort_array(F.collect_set("dst")).alias("_next"))
    walks = starts.select("walk_id", F.array("id").alias("walk"))
    for k in range(1, length + 1):
        here = walks.withColumn("_n", F.element_at("walk", -1)).join(out, "_n", "left")
        alive = F.col("_next").isNotNull() & (F.size("walk") == k)
        pick = F.element_at("_next", (F.pmod(mix("walk_id", F.col("_n"), seed + k), F.size("_next")) + 1).cast("int"))
        walks = here.select("walk_id", F.when(alive, F.concat("walk", F.array(pick))).otherwise(F.col("walk")).alias("walk"))
    return walks


def context_windows(walks: DataFrame, size: int) -> DataFrame:
    """(walk_id, start, window): all runs of size nodes of walks(walk_id, walk)."""
    starts = F.expr(f"sequence(0, size(walk) - {size})")
    return walks.where(F.size("walk") >= size).select("walk_id", "walk", F.explode(starts).alias("start")).select("walk_id", "start", F.expr(f"slice(walk, start + 1, {size})").alias("window"))


def weighted_sample(nodes: DataFrame, weight: str, count: int, seed: int = 9) -> DataFrame:
    """count nodes without replacement, weight-proportional: the smallest -ln(u) / w."""
    u = (mix("id", "id", seed) + 1) / 1_000_004.0
    return nodes.where(F.col(weight) > 0).withColumn("key", -F.log(u) / F.col(weight)).orderBy("key", "id").limit(count).select("id")


def drop_edges(edges: DataFrame, share: float, seed: int = 11) -> DataFrame:
    """Each edge goes with probability share."""
    return edges.where(mix("src", "dst", seed) >= int(share * 1_000_003))
