"""The incomplete beta filter is taken where a walk ends: no block of pairs is written for it, and both forms of a walk agree."""

import itertools

import numpy as np

import __spark_entry__
from arcwise.operators import linalg, walk
from arcwise.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_no_block_of_pairs_is_written(spark, monkeypatch):
    written, cut = [], walk.cut
    monkeypatch.setattr(walk, "cut", lambda df, name="round": written.append(name) or cut(df, name))
    monkeypatch.setattr(walk, "SHARED", 1000)
    found = {(r.source, r.node): r.r for r in __spark_entry__.queries()["filter_betainc"](spark, SF).collect()}
    assert "block" not in written
    g = T.part_graph(spark, SF)
    by_joins = walk.reachability(g, g.nodes.select("id"), "O", [[0.2, 0.5, 0.3]], shared_rows=0, each=linalg.betainc(0.5, 2.0))
    at_once = walk.reachability(g, g.nodes.select("id"), "O", [[0.2, 0.5, 0.3]], each=linalg.betainc(0.5, 2.0))
    after = linalg.betainc_filter(walk.reachability(g, g.nodes.select("id"), "O", [[0.2, 0.5, 0.3]]), 0.5, 2.0)
    a, b, c = ({(r.source, r.node): r.r for r in x.collect()} for x in (by_joins, at_once, after))
    assert a.keys() == b.keys() == c.keys()
    np.testing.assert_allclose([a[k] for k in c], [c[k] for k in c], rtol=1e-9)
    np.testing.assert_allclose([b[k] for k in c], [c[k] for k in c], rtol=1e-12)
    assert {s for s, _ in found} == {r.id for r in g.nodes.collect()}


def test_integer_parameters_equal_binomial_sums():
    x = np.concatenate([[0.0, 1.0], np.geomspace(1e-12, 1.0, 400), np.linspace(0, 1, 401)])
    for p, q in itertools.product((1, 2, 3, 7), (1, 2, 5)):
        n = p + q - 1
        choose = [np.prod([(n - i) / (i + 1) for i in range(j)]) for j in range(n + 1)]
        expected = sum(choose[j] * x**j * (1 - x) ** (n - j) for j in range(p, n + 1))
        np.testing.assert_allclose(linalg.reg_inc_beta(x, p, q), expected, rtol=1e-11, atol=1e-14)
