"""Graph operators against dense numpy on generated graphs, files, streams, recipes."""

import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from arcwise import graph as G
from arcwise.functions.coeffs import Coefficients, parse
from arcwise.operators import iterate, learn, linalg, reduce, sample, structure, walk
from arcwise.plans import embeddings
from arcwise.sources import files, generators
from arcwise.streaming.edges import StreamingSketch, stream_degrees

SPECS = [("poisson", {"tau": 2.0}), ("geometric", {"tau": 2.0}), ("geometric", {"alpha": 0.8}), ("binom", {"tau": 2.0}), ("binom", {"alpha": 0.1}), ("nbinom", {"r": 2.0, "alpha": 0.3}), ("uniform", {"tau": 3.0})]


@pytest.mark.parametrize(("name", "params"), SPECS)
@pytest.mark.parametrize("order", [2, 5, 10])
def test_coefficients_sum_to_one(name, params, order):
    c = Coefficients(name, params).values(order)
    assert len(c) == order + 1 and math.isclose(sum(c), 1) and min(c) >= 0
    assert Coefficients(name, params, 2).values(order)[:2] == [0.0, 0.0]


def test_coefficient_values_and_parser():
    p = Coefficients("poisson", {"tau": 2.0}).values(3)
    raw = [math.exp(-2) * 2**k / math.factorial(k) for k in range(4)]
    assert np.allclose(p, np.array(raw) / sum(raw))
    assert Coefficients("geometric", {"tau": 0.0}).values(2) == [1.0, 0.0, 0.0]
    assert [x.loc for x in parse("binom::binom", "1.0::2.0", "1::3")] == [1, 3]
    with pytest.raises(ValueError):
        Coefficients("poisson", {"tau": 1.0}, 9).values(3)


def weighted_graph(spark, seed=1, n=12):
    r = np.random.default_rng(seed)
    rows = {(int(a), int(b)): float(r.integers(1, 9)) for a, b in r.integers(0, n - 1, (40, 2)) if a != b}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "src long, dst long, w double")
    dense = np.zeros((n, n))
    for (a, b), w in rows.items():
        dense[b, a] = w
    return G.Graph(edges, spark.range(n)), dense


def normalised(a, symbol):
    if symbol in "UCS":
        a, symbol = a + a.T, {"U": "O", "C": "B", "S": "X"}[symbol]
    if symbol in "AT":
        return a if symbol == "A" else a.T
    out, into, a = a.sum(0), a.sum(1), a.copy()
    for v in range(len(a)):
        if (symbol in "OB" and out[v] == 0) or (symbol in "FI" and into[v] == 0) or (symbol == "X" and out[v] + into[v] == 0):
            a[v, v] = 1
    out, into = np.where(out == 0, 1, out), np.where(into == 0, 1, into)
    m = a / out if symbol in "OB" else a / into[:, None] if symbol in "FI" else a / np.sqrt(np.outer(into, out))
    return m.T if symbol in "BI" else m


@pytest.mark.parametrize("symbol", list(walk.ORIENTATIONS))
def test_walk_operators_equal_dense(spark, symbol):
    g, a = weighted_graph(spark)
    got = np.zeros_like(a)
    for x in walk.operator_frame(g, symbol).collect():
        got[x.n_out, x.n_in] += x.p
    assert np.allclose(got, normalised(a, symbol))


def test_switching_reachability_and_features(spark):
    g, a = weighted_graph(spark, 2)
    c = Coefficients("geometric", {"alpha": 0.5}).values(3)
    r, total = np.eye(12), c[0] * np.eye(12)
    for k, s in enumerate("OIS", 1):
        r = normalised(a, s) @ r
        total = total + c[k] * r
    got = np.zeros((12, 12))
    for x in walk.reachability(g, g.nodes, "OIS", [c]).collect():
        got[x.node, x.source] = x.r
    assert np.allclose(got, total)
    x = spark.createDataFrame([(i, float(i), 1.0) for i in range(12)], "id long, f double, g double")
    feats = {y.id: (y.f, y.g) for y in walk.propagate_features(G.Graph(g.edges, x), x, ["f", "g"], "OIS", c).collect()}
    assert np.allclose([feats[i] for i in range(12)], total @ np.stack([np.arange(12.0), np.ones(12)], 1))
    with pytest.raises(ValueError):
        walk.pad_sequence("OIU", 2)
    assert walk.pad_sequence("OSI", 6) == ["O", "S", "I", "I", "I", "I"]


def test_reductions_count_the_zeros(spark):
    g, _ = weighted_graph(spark, 3)
    r = walk.reachability(g, g.nodes, "O", [Coefficients("poisson", {"tau": 1.0}).values(2)])
    dense = np.zeros((12, 12))
    for x in r.collect():
        dense[x.source, x.node] = x.r
    m = {x.source: x for x in reduce.central_moments(r, 12).collect()}
    assert np.allclose([m[i].m3 for i in range(12)], ((dense - dense.mean(1, keepdims=True)) ** 3).mean(1))
    gini = {x.source: x.gini for x in reduce.gini(r, 12).collect()}
    for i in range(12):
        cum = np.cumsum(np.sort(dense[i]))
        assert math.isclose(gini[i], (13 - 2 * cum.sum() / cum[-1]) / 12, abs_tol=1e-9)
    ecf = {(x.source, x.j): (x.re, x.im) for x in reduce.characteristic(r, 12, 8).collect()}
    assert np.allclose(ecf[3, 2], (np.cos(50 * dense[3]).mean(), np.sin(50 * dense[3]).mean()))


def test_generators_and_structure(spark):
    star = generators.source_star(spark, 6, 3, 2)
    assert (star.nodes.count(), star.edges.count()) == (25, 24)
    assert (generators.diamond(spark, 50).edges.count(), generators.cycle(spark, 20, 2).edges.count()) == (96, 22)
    full = generators.clique(spark, 5)
    assert {round(x.out_lcc, 9) for x in structure.clustering(full).collect()} == {1.0}
    assert {x.lcc for x in structure.undirected_clustering(generators.diamond(spark, 6)).collect()} == {0.0}
    ego = {x.id: (x.n_edges, x.n_src, x.n_dst) for x in structure.egonets(generators.cycle(spark, 6)).collect()}
    assert set(ego.values()) == {(2, 1, 1)}


def test_fixpoints(spark):
    ring = generators.cycle(spark, 6)
    d = {x.node: x.d for x in iterate.distances(ring, spark.range(1), True).collect()}
    assert d == {i: i for i in range(6)}
    two = G.disjoint_union(ring, generators.diamond(spark, 4), 6)
    assert {x.component for x in iterate.weak_components(two).collect()} == {0, 6}
    strong = {x.id: x.component for x in iterate.strong_components(two).collect()}
    assert strong == {**dict.fromkeys(range(6), 0), 6: 6, 7: 7, 8: 8, 9: 9}
    assert np.allclose([x["rank"] for x in iterate.pagerank(ring, 6).collect()], 1 / 6)
    b = {x.id: x.betweenness for x in learn.betweenness(generators.diamond(spark, 6), spark.range(6)).collect()}
    assert np.allclose([b[i] for i in range(6)], [0, 0.25, 0.25, 0.25, 0.25, 0])


def test_linear_algebra(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((60, 4)) @ r.standard_normal((4, 10))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, emb array<double>")
    assert np.allclose(linalg.singular_values(v, 4), np.linalg.svd(x)[1][:4])
    y = np.stack([z.emb for z in linalg.project(v, 4).orderBy("id").collect()])
    assert np.allclose(y @ y.T, x @ x.T)
    reach = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(10)], "source long, node long, r double")
    assert np.allclose(linalg.sketched_singular_values(reach, 4, 4), np.linalg.svd(x)[1][:4])
    assert np.allclose(linalg.reg_inc_beta(np.array([0.0, 0.2, 0.5, 1.0]), 2, 3), [0, 0.1808, 0.6875, 1])


def test_sketch_by_stream_equals_batch(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(s, n, float(r.random())) for s in range(6) for n in range(5)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "source long, node long, r double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = StreamingSketch(f"{tmp_path}/state", 4)
    stream = spark.readStream.schema("source long, node long, r double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    s.start(stream, f"{tmp_path}/cp").awaitTermination()
    whole = spark.createDataFrame(rows, "source long, node long, r double")
    g, h = s.result(spark)
    full = linalg.sketch(whole, 4)
    for a, b, k in ((g, full, "source"), (h, linalg.co_sketch(whole, full), "node")):
        assert np.allclose([list(x[1]) for x in a.orderBy(k).collect()], [list(x[1]) for x in b.orderBy(k).collect()])


def test_streamed_degrees(spark, tmp_path):
    g, a = weighted_graph(spark, 6)
    g.edges.repartition(3).write.parquet(f"{tmp_path}/e")
    q = stream_degrees(spark.readStream.schema(g.edges.schema).parquet(f"{tmp_path}/e")).writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {x.id: x.w_out for x in spark.table("deg").collect()}
    assert all(math.isclose(got.get(i, 0.0), a[:, i].sum()) for i in range(12))


def test_files_round_trip(spark, tmp_path):
    g, a = weighted_graph(spark, 7)
    files.write_csv(g, f"{tmp_path}/csv", 12)
    back = files.read_edges(spark, f"{tmp_path}/csv")
    assert back.nodes.count() == 12 and {tuple(x) for x in back.edges.collect()} == {tuple(x) for x in g.edges.collect()}
    (tmp_path / "e.edgelist").write_text("%4\n0 1 2.5\n1  0 1.5\n2 2 9\n")
    und = files.read_edges(spark, f"{tmp_path}/e.edgelist", "edgelist", canonical=True, symmetrical=True)
    assert und.nodes.count() == 4 and {tuple(x) for x in und.edges.collect()} == {(0, 1, 2.0), (1, 0, 2.0)}
    np.savez(tmp_path / "g.npz", edge_index=np.array([[0, 1], [1, 2]]).T, num_nodes=5, directed=True)
    z = files.read_npz(spark, f"{tmp_path}/g.npz")
    assert z.directed and z.nodes.count() == 5 and z.edges.count() == 2
    (tmp_path / "l.json").write_text('{"0": 5, "3": 1}')
    assert {tuple(x) for x in files.read_labels(spark, f"{tmp_path}/l.json").collect()} == {(0, 5), (3, 1)}
    files.write_alignment(spark.createDataFrame([(0, 2), (1, 3)], "g2 long, g1 long"), f"{tmp_path}/al", 4, 2)
    n1, n2, pairs = files.read_alignment(spark, f"{tmp_path}/al")
    assert (n1, n2) == (4, 2) and {tuple(x) for x in pairs.collect()} == {(0, 2), (1, 3)}
    v = spark.createDataFrame([(1, [0.5, 2.0]), (2, [1.0, -1.0])], "id long, emb array<double>")
    files.write_vectors(v, f"{tmp_path}/w2v")
    assert {x.id: x.emb for x in files.read_vectors(spark, f"{tmp_path}/w2v").collect()} == {1: [0.5, 2.0], 2: [1.0, -1.0]}
    (tmp_path / "acm").write_text("#index a\n#c VLDB 1\n#% b\n#% c\n\n#index b\n#c KDD\n#% c\n\n")
    assert files.citation_edges(spark, f"{tmp_path}/acm", "VLDB").count() == 2
    (tmp_path / "d.json").write_text('{"id":"a","references":["b","z"]}\n{"id":"b"}\n')
    assert [tuple(x) for x in files.reference_edges(spark, f"{tmp_path}/d.json").collect()] == [("a", "b")]
    entry = {"name": "x", "graph_file": "csv", "file_info": {"filetype": "csv"}, "graph_info": {"num_nodes": 12, "weights": True, "directed": True}}
    catalog = files.build_catalog([entry])
    assert files.load_graph(spark, catalog, "x", str(tmp_path), as_unweighted=True).edges.agg({"w": "max"}).first()[0] == 1.0
    with pytest.raises(ValueError):
        files.build_catalog([entry, entry])
    assert json.loads(files.catalog_json(catalog))["x"]["name"] == "x"


def test_sampling(spark):
    g, _ = weighted_graph(spark, 8)
    m = g.edges.count()
    assert sample.remove_edges(g, 5).count() == m - 5
    new = sample.add_noise(g, 8)
    assert G.edge_intersection(new, g.edges).count() == 0 and new.where("src = dst").count() == 0
    folds = sample.kfold(g.nodes, 3).groupBy("fold").count().collect()
    assert {x["count"] for x in folds} == {4}
    cdf = sample.empirical_cdf(g.edges, "w")
    draws = spark.createDataFrame([(0.0001,), (1.0,)], "u double")
    low, high = (x.v for x in sample.inverse_cdf(cdf, draws).orderBy("u").collect())
    assert (low, high) == g.edges.selectExpr("min(w)", "max(w)").first()
    walks = sample.random_walks(g, g.nodes.selectExpr("id as walk_id", "id"), 4).collect()
    known = {(x.src, x.dst) for x in g.edges.collect()}
    assert all(p in known for w in walks for p in zip(w.walk, w.walk[1:], strict=False))
    ids = g.nodes.withColumn("new_id", sample.mix("id", "id", 1))
    assert G.relabel(g, G.permutation(g.nodes)).edges.count() == m and ids.count() == 12


def test_recipes(spark):
    g, _ = weighted_graph(spark, 9)
    done = embeddings.compare(g, ["degree", "walk_moments", "walk_sorted", "walk_ecf"], 8)
    assert [x.outcome for x in done] == ["completed"] * 4
    assert embeddings.WalkSpec().digest == embeddings.WalkSpec().digest != embeddings.WalkSpec("U").digest
    assert embeddings.cast_graph(g, directed=False, weighted=False).edges.agg({"w": "max"}).first()[0] == 1.0
    feats = G.Graph(g.edges, g.nodes.selectExpr("id", "cast(id as double) as f", "1.0D as h"))
    assert embeddings.validate(embeddings.attributed(feats, ["f", "h"], embeddings.WalkSpec("O::I", order=3, dimensions=4)), 12) == "completed"


@pytest.mark.parametrize("name", ["edges_part", "reach_switch_oui", "lcc_directed", "twohop_homophily", "knn_embeddings", "gat_attention"])
def test_queries_equal_their_statements(spark, name):
    sf = "/root/testdata/sf0.001"
    a = __spark_entry__.queries()[name](spark, sf).toPandas()
    c = duckdb.connect()
    for t in ("lineitem", "part", "events", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    b = c.execute(__spark_entry__.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    pd.testing.assert_frame_equal(a[cols].sort_values(cols).reset_index(drop=True), b[cols].sort_values(cols).reset_index(drop=True), check_dtype=False)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
