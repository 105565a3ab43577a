"""Betweenness looks at the fewer of the rows of a level and the rows into the nodes left, within one component."""

import random

import numpy as np

from arcwise.graph import Graph
from arcwise.operators import learn


def _brandes(n, edges):
    near, total = {i: [] for i in range(n)}, [0.0] * n
    for a, b in edges:
        near[a].append(b)
    for s in range(n):
        dist, paths, order, before = {s: 0}, {s: 1.0}, [s], {s: []}
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        gain = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                gain[v] += paths[v] / paths[w] * (1 + gain[w])
            total[w] += gain[w] if w != s else 0.0
    return total


def test_components_of_all_shapes_equal_brandes(spark):
    drawn, edges, n = random.Random(3), set(), 0
    for size, many in ((30, 45), (25, 300), (1, 0), (12, 11), (2, 1), (40, 1200)):
        edges |= {(n + drawn.randrange(size), n + drawn.randrange(size)) for _ in range(many)} | {(n + i, n + i + 1) for i in range(size - 1) if size == 12}
        n += size
    edges = sorted((a, b) for a, b in edges if a != b)
    g = Graph(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, w double"), spark.range(n))
    got = {r.id: r.betweenness for r in learn.betweenness(g, g.nodes, 3).collect()}
    np.testing.assert_allclose([got[i] for i in range(n)], _brandes(n, edges), rtol=1e-9, atol=1e-12)


def test_rows_that_lead_back_are_not_looked_at(monkeypatch):
    n, seen, rows = 50, [], learn._rows
    src, dst = (x[~np.eye(n, dtype=bool)] for x in np.indices((n, n)))

    def counted(table, at):
        got = rows(table, at)
        seen.append(len(got[0]))
        return got

    monkeypatch.setattr(learn, "_rows", counted)
    assert not learn._dependencies(0, learn._table(src, dst, n), learn._table(dst, src, n)).any()
    assert sum(seen) <= 2 * n
