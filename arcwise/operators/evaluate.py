"""Nearest neighbours, alignment, classification and ranking scores, edge features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one block of the block-wise search.
BLOCK = 2048


def _blocks(vectors: DataFrame, name: str, count: int) -> DataFrame:
    return vectors.select(F.pmod(F.hash("id"), F.lit(count)).alias(name), F.struct("id", F.col("emb").cast("array<double>").alias("emb")).alias("v")).groupBy(name).agg(F.collect_list("v").alias(f"{name}s"))


def nearest(queries: DataFrame, data: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """(id, other, dist, rank): the k Euclidean nearest data(id, emb) of each of queries(id, emb), ties by id.

    Blocks of bounded size meet, each pair in one numpy product that keeps k
    for each query; a last window merges them.
    """
    nq, nd = max(1, -(-queries.count() // BLOCK)), max(1, -(-data.count() // BLOCK))
    q, d = _blocks(queries, "q", nq).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(nd - 1)))), _blocks(data, "d", nd)

    def best(frames):
        for frame in frames:
            for qs, ds in zip(frame["qs"], frame["ds"], strict=True):
                qi, di = np.array([v["id"] for v in qs]), np.array([v["id"] for v in ds])
                qe, de = np.stack([v["emb"] for v in qs]), np.stack([v["emb"] for v in ds])
                for i in range(0, len(qi), 64):
                    dist = np.sqrt(((qe[i : i + 64, None, :] - de[None, :, :]) ** 2).sum(2))
                    if skip_self:
                        dist[qi[i : i + 64, None] == di[None, :]] = np.inf
                    order = np.lexsort((np.broadcast_to(di, dist.shape), dist), axis=1)[:, :k]
                    rows = np.repeat(np.arange(len(dist)), order.shape[1])
                    out = pd.DataFrame({"id": qi[i + rows], "other": di[order.ravel()], "dist": dist[rows, order.ravel()]})
                    yield out[np.isfinite(out["dist"])]

    near = q.join(d, "d").select("qs", "ds").mapInPandas(best, "id long, other long, dist double")
    w = Window.partitionBy("id").orderBy("dist", "other")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def alignment_scores(near: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row of k@: the share of truth(id, other) whose match is among the k nearest."""
    hit = truth.join(near.select("id", "other", "rank"), ["id", "other"], "left")
    return hit.agg(*[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"k_at_{k}") for k in ks])


def multiclass_scores(pairs: DataFrame) -> DataFrame:
    """accuracy, macro_f1, micro_f1 of pairs(label, pred)."""
    hit = F.sum(F.when(F.col("label") == F.col("pred"), 1).otherwise(0))
    cells = pairs.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("c"))
    both = cells.select(F.col("label").alias("y"), F.when(F.col("label") == F.col("pred"), F.col("c")).otherwise(0).alias("tp"), F.col("c").alias("p"), F.lit(0).alias("q")).unionAll(cells.select("pred", F.lit(0), F.lit(0), "c"))
    f1 = both.groupBy("y").agg((2.0 * F.sum("tp") / (F.sum("p") + F.sum("q"))).alias("f1")).agg(F.avg("f1").alias("macro_f1"))
    acc = pairs.agg((hit / F.count(F.lit(1))).alias("accuracy"))
    return acc.crossJoin(f1).select("accuracy", "macro_f1", F.col("accuracy").alias("micro_f1"))  # one row each


def auc(scored: DataFrame) -> DataFrame:
    """One row auc of scored(label 0/1, score), ties at their mean rank, from counts by score."""
    c = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = c.withColumn("rank", before + (F.col("n") + 1) / 2)
    t = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return t.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def binary_scores(pairs: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 of pairs(label, pred) of 0/1."""
    tp, fp, fn = (F.sum(F.when(F.expr(c), 1).otherwise(0)) for c in ("label = 1 and pred = 1", "label = 0 and pred = 1", "label = 1 and pred = 0"))
    hit = F.avg(F.when(F.col("label") == F.col("pred"), 1.0).otherwise(0.0))
    return pairs.agg(hit.alias("accuracy"), (tp / (tp + fp)).alias("precision"), (tp / (tp + fn)).alias("recall"), (2 * tp / (2 * tp + fp + fn)).alias("f1"))


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """One row ndcg of ranked(id, score, rel): gain by score order over gain by relevance order, top k."""
    top = lambda col: ranked.orderBy(F.col(col).desc(), "id").limit(k).withColumn("pos", F.row_number().over(Window.orderBy(F.col(col).desc(), "id"))).agg(F.sum(F.greatest(F.col("rel"), F.lit(0.0)) / F.log2(F.col("pos") + 1.0)).alias(col))
    return top("score").crossJoin(top("rel")).select((F.col("score") / F.col("rel")).alias("ndcg"))  # one row each


def spearman(values: DataFrame, a: str, b: str) -> DataFrame:
    """One row rho: correlation of mean ranks, ties averaged; ranks come from counts by value."""

    def ranks(c: str) -> DataFrame:
        n = values.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return n.select(c, (before + (F.col("_n") + 1) / 2).alias(f"r_{c}"))

    return values.join(ranks(a), a).join(ranks(b), b).agg(F.corr(f"r_{a}", f"r_{b}").alias("rho"))


def reconstruction(scores: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """micro and macro precision of each node's k best-scored others, scores(source, node, r), against edges."""
    return precision_of(reconstruction_counts(scores, edges, k))


def reconstruction_counts(scores: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(source, h, c): how many of a node's k best-scored others, c of them, are edges."""
    w = Window.partitionBy("source").orderBy(F.col("r").desc(), "node")
    best = scores.where("source <> node").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    hit = best.join(edges.select(F.col("src").alias("source"), F.col("dst").alias("node"), F.lit(1.0).alias("hit")).distinct(), ["source", "node"], "left").na.fill(0.0)
    return hit.groupBy("source").agg(F.sum("hit").alias("h"), F.count(F.lit(1)).alias("c"))


def precision_of(per: DataFrame) -> DataFrame:
    """One row micro, macro of (source, h, c)."""
    return per.agg((F.sum("h") / F.sum("c")).alias("micro"), F.avg(F.col("h") / F.col("c")).alias("macro"))


def link_scores(pairs: DataFrame, hub: DataFrame, authority: DataFrame) -> DataFrame:
    """(src, dst, score): sigmoid of hub(src) . authority(dst), both (id, emb)."""
    x = pairs.join(hub.select(F.col("id").alias("src"), F.col("emb").alias("_a")), "src").join(authority.select(F.col("id").alias("dst"), F.col("emb").alias("_b")), "dst")
    dot = F.aggregate(F.zip_with("_a", "_b", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return x.select("src", "dst", (1 / (1 + F.exp(-dot))).alias("score"))


def combine_edges(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(src, dst, j, average, hadamard, l1, l2): edge features of the end vectors by dimension."""
    v = vectors.select("id", F.posexplode(F.col("emb").cast("array<double>")).alias("j", "x"))
    a, b = v.select(F.col("id").alias("src"), "j", F.col("x").alias("p")), v.select(F.col("id").alias("dst"), "j", F.col("x").alias("q"))
    p, q = F.col("p"), F.col("q")
    return pairs.join(a, "src").join(b, ["dst", "j"]).select("src", "dst", "j", ((p + q) / 2).alias("average"), (p * q).alias("hadamard"), F.abs(p - q).alias("l1"), ((p - q) * (p - q)).alias("l2"))
