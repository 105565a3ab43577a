"""Walks, searches, triangles and embeddings against dense or plain Python forms."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwise.graph import Graph
from arcwise.operators import iterate, learn, linalg, reduce, sample, structure, walk
from arcwise.operators.number import numbered


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 30, (120, 2))}
    edges = spark.createDataFrame([(a * 7, b * 7, float(1 + (a + b) % 4)) for a, b in sorted(pairs)], "src long, dst long, w double")
    return Graph(edges, spark.range(32).select((F.col("id") * 7).alias("id")))  # two nodes without edges


def matrix(graph, symbol):
    n = 32
    m = np.zeros((n, n))
    for r in walk.operator_frame(graph, symbol).collect():
        m[r["n_in"] // 7, r["n_out"] // 7] += r["p"]
    return m


def test_numbers_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    got = {r["x"]: r["k"] for r in numbered(rows, ["x"], "k").collect()}
    assert got == {i: i for i in range(1000)}
    assert numbered(rows.where("x < 0"), ["x"], "k").count() == 0


@pytest.mark.parametrize("shared", [walk.SHARED_ROWS, 0])
@pytest.mark.parametrize("products", [None, 50])
def test_shared_and_joined_walks_equal_dense(graph, shared, products):
    c = [0.4, 0.3, 0.2, 0.1]
    walks = [("OI", c), ("U", c), ("OI", [0.0, 0.0, 0.0, 1.0])]
    rows = walk.walk_table(graph, graph.nodes.select("id"), walks, lambda r: r, shared, products).collect()
    o, i, u = (matrix(graph, s) for s in "OIU")
    want = [c[0] * np.eye(32) + c[1] * a + c[2] * a @ b + c[3] * a @ b @ b for a, b in ((o, i), (u, u))] + [o @ i @ i]
    for k, w in enumerate(want):
        got = np.zeros((32, 32))
        for r in rows:
            got[r["source"] // 7, r["node"] // 7] += r[f"r{k}"]
        assert np.allclose(got, w)


def test_reductions_in_the_walk_equal_those_of_tables(graph):
    c, other, n = [0.4, 0.3, 0.2, 0.1], [0.0, 0.0, 0.5, 0.5], 32
    sources = graph.nodes.select("id")
    every = [reduce.entropy_reduction(), reduce.coverage_reduction(n), reduce.gini_reduction(n), reduce.dispersal_reduction(n), reduce.characteristic_reduction(n), reduce.moments_reduction(n)]
    for r in every:
        a, b = (sorted(map(tuple, walk.reachability(graph, sources, "OA", [c, other], r, shared_rows=k).collect())) for k in (walk.SHARED_ROWS, 0))
        assert len(a) == len(b) > 32 and np.allclose(a, b)
    for r in (reduce.TOTAL_VARIATION, reduce.HELLINGER):
        a, b = (sorted(map(tuple, walk.walk_table(graph, sources, [("O", c), ("A", other)], r, k).collect())) for k in (walk.SHARED_ROWS, 0))
        assert len(a) == 32 and np.allclose(a, b, atol=1e-6)
    none = walk.reachability(graph, sources.where("id < 0"), "O", [c], every[0])
    assert none.count() == 0 and none.columns == ["series", "source", "entropy"]


def test_pulled_features_are_rows_of_reachability(graph):
    c = [0.5, 0.3, 0.2]
    f = graph.nodes.select("id", (F.col("id") / 7.0).alias("x"))
    got = {r["id"] // 7: r["x"] for r in walk.pull_features(graph, f, ["x"], "OI", c).collect()}
    o, i = matrix(graph, "O"), matrix(graph, "I")
    want = (c[0] * np.eye(32) + c[1] * o + c[2] * o @ i) @ np.arange(32)
    assert np.allclose([got[k] for k in range(32)], want)


@pytest.mark.parametrize("directed", [False, True])
def test_distances_equal_plain_search(graph, directed, monkeypatch):
    monkeypatch.setattr(iterate, "LANES", 1)
    many = graph.nodes.select("id").unionAll(graph.nodes.select("id"))  # repeated sources count once
    got = {(r["source"], r["node"]): r["d"] for r in iterate.distances(graph, many, directed).collect()}
    near = collections.defaultdict(set)
    for r in graph.edges.collect():
        near[r["src"]].add(r["dst"])
        if not directed:
            near[r["dst"]].add(r["src"])
    want = {}
    for s in range(0, 32 * 7, 7):
        seen, front = {s: 0}, [s]
        while front:
            front = [b for a in front for b in near[a] if b not in seen and not seen.update({b: seen[a] + 1})]
        want |= {(s, k): v for k, v in seen.items()}
    assert got == want


def test_triangles_and_egonets_by_hand(graph):
    e = {(r["src"], r["dst"]): r["w"] for r in graph.edges.collect() if r["src"] != r["dst"]}
    ends = {"out": lambda v, a, b: ((v, a), (a, b), (v, b)), "cycle": lambda v, a, b: ((v, a), (a, b), (b, v)), "mid": lambda v, a, b: ((a, v), (a, b), (v, b)), "in": lambda v, a, b: ((a, v), (a, b), (b, v))}
    nodes = range(0, 32 * 7, 7)
    for kind, f in ends.items():
        want = {v: n for v in nodes if (n := sum(all(x in e for x in f(v, a, b)) for a in nodes for b in nodes if len({v, a, b}) == 3))}
        assert {r["id"]: r["tri"] for r in structure.triangles(graph, kind).collect()} == want
    for r in structure.egonets(graph).collect():
        m = {r["id"]} | {b for a, b in e if a == r["id"]} | {a for a, b in e if b == r["id"]}
        parts = [[w for (a, b), w in e.items() if (a in m, b in m) == k] for k in ((True, True), (True, False), (False, True))]
        assert [r["n_edges"], r["n_src"], r["n_dst"]] == [len(p) for p in parts]
        assert np.allclose([r["w_edges"], r["w_src"], r["w_dst"]], [sum(p) for p in parts])


def test_walk_embedding_gives_back_reachability(graph):
    c = [0.5, 0.3, 0.2]
    o, u = matrix(graph, "O"), matrix(graph, "U")
    want = c[0] * np.eye(32) + c[1] * o + c[2] * o @ u
    rows = {r["id"] // 7: np.array(r["emb"]) for r in linalg.walk_embedding(graph, "OU", c, 20, 0).collect()}
    x = np.stack([rows[k] for k in range(32)])
    k = x.shape[1] // 2
    s = np.linalg.svd(want)[1]
    # A sketch as wide as the rank kept: near the best approximation of that rank.
    assert k == 20 and np.linalg.norm(x[:, :k] @ x[:, k:].T - want) <= 3 * np.linalg.norm(s[k:])
    found = np.array(linalg.walk_singular_values(graph, "OU", c, 5, 15))
    assert np.all(np.abs(found - s[:5]) <= 0.1 * s[:5]) and np.all(np.diff(found) <= 1e-12)


def test_skip_gram_needs_no_arrow_conversion(spark, graph):
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        # Two groups that never meet: a node's vector scores its own group's contexts higher.
        edges = spark.createDataFrame([(g * 100 + a, g * 100 + b, 1.0) for g in (0, 1) for a in range(6) for b in range(6) if a != b], "src long, dst long, w double")
        g = Graph(edges, edges.select(F.col("src").alias("id")).distinct())
        w = sample.context_windows(sample.random_walks(g, g.nodes.select(F.col("id").alias("walk_id"), "id"), 6), 3)
        rows = {r["id"]: np.array(r["emb"]) for r in learn.skip_gram(w, g.nodes, 8, 12, rate=2.0).collect()}
        assert len(rows) == 12 and all(len(v) == 16 and np.isfinite(v).all() for v in rows.values())
        same = np.mean([rows[a][:8] @ rows[b][8:] for a in rows for b in rows if a != b and a // 100 == b // 100])
        other = np.mean([rows[a][:8] @ rows[b][8:] for a in rows for b in rows if a // 100 != b // 100])
        assert same > other
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)
