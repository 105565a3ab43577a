"""Registered queries without a statement take every node as a source."""

import numpy as np

import __spark_entry__
from arcwise.sources import tables as T

SF = "/root/testdata/sf0.001"


def brandes(nodes, edges):
    out, total = {}, dict.fromkeys(nodes, 0.0)
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for s in nodes:
        depth, paths, order, before = {s: 0}, {s: 1}, [s], {}
        for v in order:
            for w in out.get(v, ()):
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before.setdefault(w, []).append(v)
        gain = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for v in before[w]:
                gain[v] += paths[v] / paths[w] * (1 + gain[w])
            total[w] += gain[w]
    return total


def test_betweenness_of_every_source(spark):
    g = T.part_graph(spark, SF)
    nodes = [x.id for x in g.nodes.select("id").collect()]
    expected = brandes(nodes, {(x.src, x.dst) for x in g.edges.collect() if x.src != x.dst})
    got = {x.id: x.betweenness for x in __spark_entry__.queries()["betweenness"](spark, SF).collect()}
    assert got.keys() == expected.keys() and np.allclose([got[i] for i in nodes], [expected[i] for i in nodes], atol=1e-5)


def test_filter_of_every_source(spark):
    nodes = {x.id for x in T.part_graph(spark, SF).nodes.select("id").collect()}
    assert {x.source for x in __spark_entry__.queries()["filter_betainc"](spark, SF).select("source").distinct().collect()} == nodes
