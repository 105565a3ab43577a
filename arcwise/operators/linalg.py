"""Singular values, projections and sketches through small Gram matrices."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.tables import cut
from .walk import each_mass, propagate_features, pull_features


def gram(vectors: DataFrame) -> np.ndarray:
    """X^T X of vectors(id, emb): partial products by Arrow batch, summed; d x d comes to the driver."""

    def part(frames):
        total = None
        for f in frames:
            if len(f):
                x = np.stack(f["emb"].to_numpy()).astype("f8")
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    rows = vectors.select("emb").mapInPandas(part, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    d = int(rows["i"].max()) + 1 if len(rows) else 0
    out = np.zeros((d, d))
    out[rows["i"], rows["j"]] = rows["v"]
    return out


def singular_values(vectors: DataFrame, k: int) -> list[float]:
    """The k largest singular values, uncentred."""
    return [float(math.sqrt(max(0.0, v))) for v in np.linalg.eigvalsh(gram(vectors))[::-1][:k]]


def project(vectors: DataFrame, k: int, rtol: float = 1e-10) -> DataFrame:
    """(id, emb): rows on the k leading right singular vectors (an uncentred PCA); signs make each vector's largest entry positive."""
    values, basis = np.linalg.eigh(gram(vectors))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    basis = basis[:, values > values[0] * rtol]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    v = vectors.sparkSession.sparkContext.broadcast(basis)  # d x k

    def apply(frames):
        for f in frames:
            x = np.stack(f["emb"].to_numpy()).astype("f8") if len(f) else np.zeros((0, len(v.value)))
            yield pd.DataFrame({"id": f["id"], "emb": list(x @ v.value)})

    return vectors.select("id", "emb").mapInPandas(apply, "id long, emb array<double>")


def omega(node: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Gaussian rows of a sketch, one for each node id, the same wherever they are made."""
    return np.stack([np.random.default_rng([seed, int(n)]).standard_normal(width) for n in node]) if len(node) else np.zeros((0, width))


def sketch(reach: DataFrame, width: int, seed: int = 1) -> DataFrame:
    """(source, g): G = R^T Omega, one row for each source of reach(source, node, r)."""
    nodes = reach.select("node").distinct()

    def rows(frames):
        for f in frames:
            yield pd.DataFrame({"node": f["node"], "o": list(omega(f["node"].to_numpy(), width, seed))})

    o = nodes.mapInPandas(rows, "node long, o array<double>").select("node", F.posexplode("o").alias("j", "o"))
    g = reach.join(o, "node").groupBy("source", "j").agg(F.sum(F.col("r") * F.col("o")).alias("g"))
    return g.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("j", "g"))).alias("g")).select("source", F.col("g.g").alias("g"))


def co_sketch(reach: DataFrame, g: DataFrame) -> DataFrame:
    """(node, h): H = R G summed over sources; additive, so batches of sources may be merged."""
    long = g.select("source", F.posexplode("g").alias("j", "g"))
    h = reach.join(long, "source").groupBy("node", "j").agg(F.sum(F.col("r") * F.col("g")).alias("h"))
    return h.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("j", "h"))).alias("h")).select("node", F.col("h.h").alias("h"))


def sketched_singular_values(reach: DataFrame, k: int, oversampling: int = 10, seed: int = 1) -> list[float]:
    """Estimates of the k largest singular values of R from one pass over G and H.

    With G = R^T Omega and H = R G, the values of R are those of H against
    G's orthonormal factor; only width x width matrices reach the driver.
    """
    width = k + oversampling
    g = sketch(reach, width, seed)
    h = co_sketch(reach, g)
    a, b = gram(g.select(F.col("g").alias("emb"))), gram(h.select(F.col("h").alias("emb")))
    values, vectors = np.linalg.eigh(a)
    keep = values > values.max() * 1e-12
    root = vectors[:, keep] / np.sqrt(values[keep])
    return [float(math.sqrt(max(0.0, v))) for v in np.linalg.eigvalsh(root.T @ b @ root)[::-1][:k]]


def walk_sketch(graph: Graph, orientation: str, coefficients: list[float], width: int, seed: int = 1) -> tuple[DataFrame, DataFrame, list[str]]:
    """G = R Omega and H = R^T G of the reachability R of all nodes, as tables (id, x0..), and the columns' names.

    R is never formed: both products pass width columns through the walk
    operators, so the cost is edges times width for each step.
    """
    columns = [f"x{j}" for j in range(width)]

    def rows(frames):
        for f in frames:
            o = omega(f["id"].to_numpy(), width, seed)
            yield pd.DataFrame({"id": f["id"], **{c: o[:, j] for j, c in enumerate(columns)}})

    o = cut(graph.nodes.select(F.col("id").cast("long").alias("id")).mapInPandas(rows, "id long, " + ", ".join(f"{c} double" for c in columns)), "omega")
    g = cut(pull_features(graph, o, columns, orientation, coefficients), "sketch")
    return g, cut(propagate_features(graph, g, columns, orientation, coefficients), "co-sketch"), columns


def _right(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From the Gram matrices of G and H: the k largest singular values and the basis M T: G M T is U, and H M T is V S."""
    values, vectors = np.linalg.eigh(a)
    keep = values > max(values.max(), 0.0) * 1e-12
    root = vectors[:, keep] / np.sqrt(values[keep])
    s2, turn = np.linalg.eigh(root.T @ b @ root)
    order = np.argsort(s2)[::-1][:k]
    return np.sqrt(np.maximum(s2[order], 0.0)), root @ turn[:, order]


def walk_singular_values(graph: Graph, orientation: str, coefficients: list[float], k: int, oversampling: int = 10, seed: int = 1) -> list[float]:
    """Estimates of the k largest singular values of the reachability of all nodes; only width x width matrices reach the driver."""
    g, h, columns = walk_sketch(graph, orientation, coefficients, k + oversampling, seed)
    a, b = (gram(x.select(F.array(*columns).alias("emb"))) for x in (g, h))
    return [float(v) for v in _right(a, b, k)[0]]


def walk_embedding(graph: Graph, orientation: str, coefficients: list[float], k: int, oversampling: int = 10, seed: int = 1) -> DataFrame:
    """(id, emb): [U sqrt(S), V sqrt(S)] of the reachability of all nodes, k of each side, by one pass of a random sketch.

    G spans R's columns: Q = G M is orthonormal, and H M = R^T Q. With its
    decomposition (eigenvectors T, values S), U = Q T and V = R^T Q T / S.
    Signs make the largest entry of each column of M T positive.
    """
    g, h, columns = walk_sketch(graph, orientation, coefficients, k + oversampling, seed)
    a, b = (gram(x.select(F.array(*columns).alias("emb"))) for x in (g, h))
    s, turn = _right(a, b, k)
    turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(turn.shape[1])] < 0, -1.0, 1.0)
    left, right = turn * np.sqrt(s), turn / np.sqrt(np.maximum(s, 1e-300))
    times = lambda m: [sum((F.col(c) * float(m[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(m.shape[1])]
    u = g.select("id", F.array(*times(left)).alias("u"))
    v = h.select("id", F.array(*times(right)).alias("v"))
    return u.join(v, "id").select("id", F.concat("u", "v").alias("emb"))


def _beta_fraction(y: np.ndarray, a: float, b: float, terms: int) -> np.ndarray:
    """The continued fraction of I_y(a, b), for each value up to the term from which it stays."""
    y = np.clip(y, 0.0, 1.0)
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(np.maximum(y, 1e-300)) + b * np.log1p(-np.minimum(y, 1 - 1e-16))) / a
    out, at = np.zeros_like(y), np.flatnonzero(y > 0)
    y = y[at]
    f, c, d = np.ones_like(y), np.full_like(y, 2.0), np.ones_like(y)  # after the first term, one
    f *= c * d
    still = np.zeros(len(y), bool)
    for i in range(1, terms + 1):
        m = i // 2
        num = y * (m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 + num * d
        d[np.abs(d) < 1e-30] = 1e-30
        d = 1 / d
        c = 1 + num / c
        c[np.abs(c) < 1e-30] = 1e-30
        step = c * d
        f *= step
        same = np.abs(step - 1) < 4e-16
        done, still = same & still, same  # twice, so that one small term ends nothing
        if done.any():
            out[at[done]] = f[done]
            on = ~done
            at, y, f, c, d, still = at[on], y[on], f[on], c[on], d[on], still[on]
            if not len(at):
                break
    out[at] = f
    return np.where(out > 0, front * (out - 1), 0.0)


def reg_inc_beta(x: np.ndarray, p: float, q: float, terms: int = 60) -> np.ndarray:
    """Regularised incomplete beta by the continued fraction, mirrored where that converges faster."""
    x = np.asarray(x, "f8")
    flip, out = x > (p + 1) / (p + q + 2), np.empty_like(x)
    out[~flip] = _beta_fraction(x[~flip], p, q, terms)
    out[flip] = 1 - _beta_fraction(1 - x[flip], q, p, terms)
    return out


def betainc(p: float, q: float, scale: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """The function scale * I_r(p, q) of masses r; p = q = 1 changes nothing but the scale."""
    if p == q == 1:
        return lambda x: x * scale
    return lambda x: scale * reg_inc_beta(np.clip(x, 0, 1), p, q)


def betainc_filter(r: DataFrame, p: float, q: float, scale: float = 1.0) -> DataFrame:
    """r replaced by betainc() of it."""
    if p == q == 1:
        return r.withColumn("r", F.col("r") * scale)
    return each_mass(r, ["r"], betainc(p, q, scale))
