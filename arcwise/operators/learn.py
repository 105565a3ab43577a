"""Learned parts: clustering, classifiers, walk embeddings, exact betweenness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, drop_loops
from ..plans.tables import cut, discard
from .iterate import _degrees_at, _links
from .number import numbered
from .sample import kfold
from .walk import _opened, shared_frames


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector(F.col("emb").cast("array<double>")))


def kmeans_auto(vectors: DataFrame, ks: range = range(3, 7), seed: int = 4) -> DataFrame:
    """(id, cluster) for the k of largest silhouette."""
    data = cut(_features(vectors), "features")
    best = max(((ClusteringEvaluator().evaluate(p), k, p) for k in ks for p in [KMeans(k=k, seed=seed).fit(data).transform(data)]), key=lambda x: x[0])
    return best[2].select("id", F.col("prediction").alias("cluster"))


def cross_validated(vectors: DataFrame, folds: int = 3, seed: int = 3) -> DataFrame:
    """(fold, accuracy) of logistic regression over vectors(id, emb, label), stratified folds."""
    data = cut(kfold(_features(vectors), folds, seed, "label").withColumn("label", F.col("label").cast("double")), "folds")
    rows = []
    for k in range(folds):
        model = LogisticRegression(maxIter=30, regParam=1e-3).fit(data.where(F.col("fold") != k))
        acc = model.transform(data.where(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        rows.append((k, float(acc)))
    return vectors.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def skip_gram(windows: DataFrame, nodes: DataFrame, dim: int = 16, epochs: int = 3, negatives: int = 3, rate: float = 0.5, seed: int = 2, batches: int = 2) -> DataFrame:
    """(id, emb): source and context vectors, [in, out], by negative sampling over windows(window).

    A window's first node is trained against the others. The state is a table
    (id, u0.., v0..); a batch of windows is one pass: pairs meet both vectors
    by joins, gradients are summed by node, each node moves by the mean of
    its gradients times rate, and the state is written again. Nothing but
    the number of nodes reaches the driver. Negative contexts are nodes drawn
    by a hash of the window, the batch and a count; nodes no window has keep
    their start.
    """
    dims = range(dim)
    known = numbered(nodes.select("id").distinct(), ["id"], "k")
    n = known.count()
    u0 = [((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j)), F.lit(1 << 24)) / (1 << 24) - 0.5) / dim).alias(f"u{j}") for j in dims]
    state = cut(known.select("id", "k", *u0, *[F.lit(0.0).alias(f"v{j}") for j in dims]), "vectors")
    pairs = windows.select(F.xxhash64("window").alias("w"), F.element_at("window", 1).alias("id"), F.explode(F.expr("slice(window, 2, size(window))")).alias("other"))
    pairs = cut(pairs.join(known.select(F.col("id").alias("other"), "k"), "other").select("w", "id", "k"), "pairs")
    for step in range(epochs * batches):
        some = pairs.where(F.pmod(F.col("w"), F.lit(batches)) == step % batches)
        drawn = F.transform(F.sequence(F.lit(0), F.lit(negatives - 1)), lambda j: F.struct(F.pmod(F.xxhash64("w", "k", F.lit(seed + step), j), F.lit(n)).alias("k"), F.lit(0.0).alias("y")))
        told = some.select("id", F.explode(F.concat(F.array(F.struct("k", F.lit(1.0).alias("y"))), drawn)).alias("t")).select("id", "t.k", "t.y")
        met = told.join(state.select("id", *[f"u{j}" for j in dims]), "id").join(state.select("k", *[f"v{j}" for j in dims]), "k")
        dot = sum((F.col(f"u{j}") * F.col(f"v{j}") for j in dims), F.lit(0.0))
        met = met.withColumn("g", F.col("y") - 1 / (1 + F.exp(-dot)))
        du = met.groupBy("id").agg(*[F.avg(F.col("g") * F.col(f"v{j}")).alias(f"du{j}") for j in dims])
        dv = met.groupBy("k").agg(*[F.avg(F.col("g") * F.col(f"u{j}")).alias(f"dv{j}") for j in dims])
        moved = state.join(du, "id", "left").join(dv, "k", "left").na.fill(0.0)
        old, state = state, cut(moved.select("id", "k", *[(F.col(f"{c}{j}") + rate * F.col(f"d{c}{j}")).alias(f"{c}{j}") for c in "uv" for j in dims]), "vectors")
        discard(old)
    return state.select("id", F.array(*[f"{c}{j}" for c in "uv" for j in dims]).alias("emb"))


#: Edges (4 bytes each, by both ends) that betweenness shares with every worker.
SHARED_EDGES = 1 << 25


#: Edges of a component whose places are kept as numpy's own integers, which it looks up faster.
WIDE = 1 << 22

Table = tuple[np.ndarray, np.ndarray]


def _table(a: np.ndarray, b: np.ndarray, n: int) -> Table:
    """b by a: where the row of each of n nodes begins, and the rows one after another."""
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[np.argsort(a, kind="stable")].astype("i4")


def _rows(table: Table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows at, one after another, where each begins and how long it is."""
    first, to = table
    many = first[at + 1] - first[at]
    ends = np.cumsum(many)
    rows = np.repeat(first[at] - ends + many, many)
    rows += np.arange(len(rows))
    return to.take(rows), ends - many, many


def _shared_rows(frame: tuple[int, list[tuple]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a shared frame at sorted places, one after another, and how long each is."""
    return np.concatenate([np.zeros(0, "i4"), *(to for _, _, to in _links(frame, at))]), _degrees_at(frame, at)


def _component(s: int, out, into, label: np.ndarray) -> tuple[np.ndarray, Table, Table]:
    """The sorted nodes linked with s in either direction, which are labelled, and the tables of their places among themselves, of shared frames by both ends."""
    new, found, name = np.array([s]), [], int(label.max()) + 1
    label[s] = name
    while len(new):
        found.append(new)
        new = np.unique(np.concatenate([_shared_rows(out, new)[0], _shared_rows(into, new)[0]]))
        new = new[label[new] < 0]
        label[new] = name
    nodes = np.sort(np.concatenate(found))
    tables = [(np.concatenate([[0], np.cumsum(many)]), np.searchsorted(nodes, to).astype("i8" if len(to) <= WIDE else "i4")) for to, many in (_shared_rows(f, nodes) for f in (out, into))]
    return nodes, *tables


def _dependencies(s: int, out: Table, into: Table) -> np.ndarray:
    """What the shortest paths from s give to each node.

    The next level is found from the rows of this one or, if those are fewer,
    from the rows into the nodes not yet reached; the way back takes the same.
    """
    many_out, many_into = np.diff(out[0]), np.diff(into[0])
    n = len(many_out)
    paths, unseen, gain, share = np.zeros(n), np.ones(n, bool), np.zeros(n), np.zeros(n)
    paths[s], unseen[s] = 1.0, False
    left, fronts, links = np.flatnonzero((many_into > 0) & unseen), [np.array([s])], []
    while len(left):
        front = fronts[-1]
        here = front[many_out[front] > 0]
        if not len(here):
            break
        if many_out[here].sum() <= many_into[left].sum():
            ends, begins, many = _rows(out, here)
            sums = np.bincount(ends, np.repeat(paths[here], many), n) * unseen
            links.append((here, ends, begins, None))
        else:
            ends, begins, many = _rows(into, left)
            share[here] = paths[here]
            sums = np.zeros(n)
            sums[left] = np.add.reduceat(share.take(ends), begins)
            share[here] = 0.0
            links.append((left, ends, None, many))
        new = np.flatnonzero(sums > 0)
        if not len(new):
            break
        paths[new], unseen[new] = sums[new], False
        left = left[unseen[left]]
        fronts.append(new)
    for front, after, (at, ends, begins, many) in zip(fronts[-2::-1], fronts[:0:-1], links[len(fronts) - 2 :: -1] if len(fronts) > 1 else [], strict=True):
        share[after] = (1 + gain[after]) / paths[after]
        if many is None:
            gain[at] = paths[at] * np.add.reduceat(share.take(ends), begins)
        else:
            gain[front] = paths[front] * np.bincount(ends, np.repeat(share[at], many), n)[front]
        share[after] = 0.0
    gain[s] = 0.0
    return gain


def betweenness(graph: Graph, sources: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, betweenness): dependency sums of the sources' shortest-path trees, directed, not normalised.

    Sources are dealt to tasks, which share the adjacency by both ends in
    parts, so that the driver never holds it, and take one component at a
    time; exact for the sources given. For graphs of SHARED_EDGES edges at
    most, which is checked; larger ones raise an error.
    """
    spark = graph.edges.sparkSession
    pairs = cut(drop_loops(graph.links if graph.links is not None else graph.edges).select(F.col("src").alias("n_in"), F.col("dst").alias("n_out")), "pairs")
    rows = pairs.count()
    if rows > SHARED_EDGES:  # repeats do not count
        old, pairs = pairs, cut(pairs.distinct(), "pairs")
        discard(old)
        rows = pairs.count()
        if rows > SHARED_EDGES:
            raise ValueError(f"betweenness shares at most {SHARED_EDGES} edges with its workers")
    ends = pairs.select(F.explode(F.array(F.col("n_in").cast("long"), F.col("n_out").cast("long"))).alias("id")).distinct()
    names = np.sort(ends.toArrow()["id"].to_numpy())  # at most the nodes
    named = spark.sparkContext.broadcast(names)
    shared = named, dict(zip(("out", "in"), shared_frames(pairs, named, len(names), rows, ["out", "in"]), strict=True))
    discard(pairs)
    parts = parts or 4 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, frames = _opened(shared, False)
        out, into = frames["out"], frames["in"]
        total, label = np.zeros(len(names)), np.full(len(names), -1, "i4")
        asked = [np.searchsorted(names, ids["id"][ids["id"].isin(names)]) for ids in batches]
        asked = np.sort(np.concatenate(asked or [np.zeros(0, "i8")]))
        while len(asked):
            nodes, *tables = _component(asked[0], out, into, label)
            mine = label[asked] == label[asked[0]]
            for s in np.searchsorted(nodes, asked[mine]).tolist():
                total[nodes] += _dependencies(s, *tables)
            asked = asked[~mine]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": names[some], "betweenness": total[some]})

    # A stated number of partitions is not coalesced, however few bytes the sources have.
    per = sources.select(F.col("id").cast("long").alias("id")).repartition(parts).mapInPandas(run, "id long, betweenness double")
    found = per.groupBy("id").agg(F.sum("betweenness").alias("betweenness"))
    return graph.nodes.select("id").join(found, "id", "left").na.fill(0.0)
